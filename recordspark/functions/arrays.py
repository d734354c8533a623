"""Arrays and objects as columns. Arrays of rows are arrays of structs; operators.frames has the same for whole frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordspark.functions.base import VERBS, col, number, text, truthy, verb
from recordspark.functions.logic import equal


def part(x: Column, field: str | None) -> Column:
    return x if field is None else x[field]


def test(x: Column, op: str, v) -> Column:
    """=, !=, contains, startsWith, endsWith by text, the rest by number; null fails."""
    if op in ("=", "=="):
        out = equal(x, v)
    elif op in ("!=", "<>"):
        out = ~equal(x, v)
    elif op in ("<", "<=", ">", ">="):
        a, b = number(x), number(v)
        out = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    elif op in ("contains", "startsWith", "endsWith"):
        out = {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}[op](text(x), text(v))
    else:
        raise ValueError(f"operator {op!r}")
    return F.coalesce(out, F.lit(False))


@verb("filter")
def filter_(a, field: str | None = None, op: str | None = None, v=None):
    return F.filter(col(a), lambda x: truthy(part(x, field)) if op is None else test(part(x, field), op, v))


def _holds(field, op, v):
    return lambda x: truthy(part(x, field)) if op is None else test(part(x, field), op, v)


verb("every")(lambda a, field=None, op=None, v=None: F.forall(col(a), _holds(field, op, v)))
verb("some")(lambda a, field=None, op=None, v=None: F.exists(col(a), _holds(field, op, v)))
verb("find")(lambda a, field=None, op=None, v=None: F.get(F.filter(col(a), _holds(field, op, v)), F.lit(0)))
verb("findIndex")(lambda a, field=None, op=None, v=None: F.coalesce(F.array_position(F.transform(col(a), _holds(field, op, v)), F.lit(True)) - 1, F.lit(-1)))
verb("partition")(lambda a, field=None, op=None, v=None: F.array(F.filter(col(a), _holds(field, op, v)), F.filter(col(a), lambda x: ~_holds(field, op, v)(x))))
verb("flatten")(lambda a: F.flatten(col(a)))
verb("distinct", "unique")(lambda a: F.array_distinct(col(a)))
verb("sort")(lambda a: F.array_sort(col(a)))
verb("sortDesc")(lambda a: F.sort_array(col(a), asc=False))
verb("map", "pluck")(lambda a, field=None: F.transform(col(a), lambda x: part(x, field)))
verb("indexOf")(lambda a, v: F.coalesce(F.array_position(F.transform(col(a), lambda x: equal(x, v)), F.lit(True)) - 1, F.lit(-1)))
verb("includes")(lambda a, v: F.exists(col(a), lambda x: equal(x, v)))
verb("reverse")(lambda a: F.reverse(col(a)))
verb("concatArrays")(lambda *vs: F.concat(*[col(v) for v in vs]))
verb("zip")(lambda *vs: F.arrays_zip(*[col(v).alias(str(i)) for i, v in enumerate(vs)]))
verb("compact")(lambda a: F.filter(col(a), lambda x: x.isNotNull() & (x.cast("string") != "")))


@verb("sortBy")
def sort_by(a, field: str):
    """Stable, nulls last."""
    keyed = F.transform(col(a), lambda x, i: F.struct(x[field].isNull().alias("n"), x[field].alias("k"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(F.transform(keyed, lambda s: F.struct(s["n"], s["k"], s["i"]))), lambda s: F.get(col(a), s["i"]))


@verb("at")
def at(a, i):
    i = col(i).cast("int")
    return F.when(i >= 0, F.get(col(a), i)).otherwise(F.try_element_at(col(a), i))


@verb("slice")
def slice_(a, start, end=None):
    """From start up to but not including end; negative places count from the end."""
    n = F.size(col(a))
    place = lambda x: F.when(x < 0, F.greatest(n + x, F.lit(0))).otherwise(F.least(x, n))
    first = place(col(start).cast("int"))
    last = n if end is None else place(col(end).cast("int"))
    return F.slice(col(a), first + 1, F.greatest(last - first, F.lit(0)))


@verb("take", "limit")
def take(a, n):
    return F.slice(col(a), F.lit(1), F.greatest(col(n).cast("int"), F.lit(0)))


@verb("drop")
def drop(a, n):
    n = F.greatest(col(n).cast("int"), F.lit(0))
    return F.slice(col(a), n + 1, F.greatest(F.size(col(a)) - n, F.lit(0)))


@verb("chunk")
def chunk(a, n: int):
    a = col(a)
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.floor((F.size(a) - 1) / n).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(a, i * n + 1, F.lit(n)))


@verb("range")
def range_(start, end=None, step=1):
    """From start (0) up to but not including end."""
    start, end = (F.lit(0), start) if end is None else (start, end)
    a, b, s = (col(x).cast("bigint") for x in (start, end, step))
    n = F.ceil((b - a) / s)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1), lambda i: a + i * s)).otherwise(F.array().cast("array<bigint>"))


@verb("groupBy")
def group_by(a, field: str):
    """A map from key (as text) to the elements with it, keys in order of appearance."""
    key = lambda x: F.coalesce(x[field].cast("string"), F.lit("null"))
    keys = F.array_distinct(F.transform(col(a), key))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(col(a), lambda x: key(x) == k)))


@verb("dedupe")
def dedupe(a, *ignored):
    """Without elements equal to the one before."""
    return F.filter(col(a), lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(col(a), i - 1)))


@verb("sample")
def sample(a, n, seed=None):
    """In an order hashed from seed and place."""
    ranked = F.transform(col(a), lambda x, i: F.struct((F.rand() if seed is None else F.xxhash64(text(seed), i)).alias("r"), i.alias("i")))
    return F.transform(take(F.array_sort(ranked), n), lambda s: F.get(col(a), s["i"]))


def _running(a, combine, start: float):
    values = F.transform(col(a), lambda x: x.try_cast("double"))
    state = F.struct(F.lit(start).alias("now"), F.array().cast("array<double>").alias("out"))
    step = lambda s, x: F.struct(F.when(x.isNull(), s["now"]).otherwise(combine(s["now"], x)).alias("now"), F.concat(s["out"], F.array(F.when(x.isNotNull(), combine(s["now"], x)))).alias("out"))
    return F.aggregate(values, state, step, lambda s: s["out"])


verb("cumsum")(lambda a: _running(a, lambda x, y: x + y, 0.0))
verb("cumprod")(lambda a: _running(a, lambda x, y: x * y, 1.0))


@verb("shift")
def shift(a, n: int, *ignored):
    """n to the right (to the left if negative), nulls where nothing is left."""
    return F.transform(col(a), lambda x, i: F.get(col(a), i - n))


verb("lag")(lambda a, n=1, *ignored: shift(a, n))
verb("lead")(lambda a, n=1, *ignored: shift(a, -n))
verb("diff")(lambda a, *ignored: F.transform(col(a), lambda x, i: x.try_cast("double") - F.get(col(a), i - 1).try_cast("double")))


@verb("pctChange")
def pct_change(a, *ignored):
    def change(x, i):
        before = F.get(col(a), i - 1).try_cast("double")
        return F.try_divide(x.try_cast("double") - before, before)

    return F.transform(col(a), change)


@verb("rank")
def rank(a, *ignored):
    """1 for the greatest; equal ones share a rank, and the next is as far off as they are many."""
    return F.transform(col(a), lambda x: F.when(x.isNotNull(), F.size(F.filter(col(a), lambda y: y > x)) + 1))


@verb("fillMissing")
def fill_missing(a, how="forward", *ignored):
    a = col(a)
    if how == "forward":
        return F.transform(a, lambda x, i: F.coalesce(x, F.try_element_at(F.filter(F.slice(a, F.lit(1), i + 1), lambda y: y.isNotNull()), F.lit(-1))))
    if how == "backward":
        return F.transform(a, lambda x, i: F.coalesce(x, F.get(F.filter(F.slice(a, i + 1, F.size(a)), lambda y: y.isNotNull()), F.lit(0))))
    return F.transform(a, lambda x: F.coalesce(x, col(how)))


@verb("reduce")
def reduce_(a, name: str, start):
    """Folds with a function of two arguments."""
    start = number(start) if isinstance(start, (int, float)) else col(start)
    return F.aggregate(col(a), start, lambda s, x: VERBS[name](s, x))


@verb("pivot")
def pivot(a, key: str, value: str):
    """A map from one field to another; of equal keys the last counts."""
    keys = F.transform(col(a), lambda x: x[key].cast("string"))
    last = F.filter(F.transform(col(a), lambda x, i: F.struct(x[key].cast("string").alias("key"), x[value].alias("value"), i.alias("i"))), lambda e: ~F.array_contains(F.slice(keys, e["i"] + 2, F.size(keys)), e["key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


@verb("unpivot")
def unpivot(o, key: str, value: str):
    return F.transform(F.map_entries(col(o)), lambda e: F.struct(e["key"].alias(key), e["value"].alias(value)))


verb("keys")(lambda o: F.map_keys(col(o)))
verb("values")(lambda o: F.map_values(col(o)))
verb("entries")(lambda o: F.transform(F.map_entries(col(o)), lambda e: F.array(e["key"], e["value"].cast("string"))))
verb("has")(lambda o, k: F.coalesce(F.map_contains_key(col(o), col(k)), F.lit(False)))
verb("get")(lambda o, k, default=None: F.coalesce(F.try_element_at(col(o), col(k)), col(default)) if default is not None else F.try_element_at(col(o), col(k)))


@verb("merge")
def merge(*os):
    """Later maps win."""
    out = col(os[0])
    for o in os[1:]:
        out = _merged(out, col(o))
    return out


def _merged(a: Column, b: Column) -> Column:
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
