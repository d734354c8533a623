"""Conditions, null handling, coercion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordspark.functions.base import col, number, text, truthy, verb


@verb("ifNull")
def if_null(v, d):
    return F.coalesce(col(v), col(d))


@verb("ifEmpty")
def if_empty(v, d):
    return F.when(col(v).isNull() | (text(v) == ""), col(d)).otherwise(col(v))


@verb("coalesce")
def first_filled(*vs):
    """The first that is neither null nor an empty string."""
    return F.coalesce(*[F.when(text(v) != "", col(v)) for v in vs])


@verb("ifElse")
def if_else(c, a, b):
    return F.when(truthy(c), col(a)).otherwise(col(b))


@verb("cond")
def cond(*args):
    """Condition, value, condition, value, ... and perhaps a value for else."""
    out = col(args[-1]) if len(args) % 2 else F.lit(None)
    for c, v in reversed(list(zip(args[::2], args[1::2], strict=False))):
        out = F.when(truthy(c), col(v)).otherwise(out)
    return out


@verb("switch")
def switch(v, *args):
    """Match, result, match, result, ... and perhaps a default."""
    out = col(args[-1]) if len(args) % 2 else F.lit(None)
    for m, r in reversed(list(zip(args[::2], args[1::2], strict=False))):
        out = F.when(equal(v, m), col(r)).otherwise(out)
    return out


@verb("assert")
def assert_(v, message="assertion failed"):
    return F.when(truthy(v), col(v)).otherwise(F.raise_error(text(message)))


def boolean(x) -> Column:
    return col(x).cast("boolean")


@verb("and")
def and_(a, b):
    return boolean(a) & boolean(b)


@verb("or")
def or_(a, b):
    return boolean(a) | boolean(b)


@verb("xor")
def xor(a, b):
    return boolean(a) != boolean(b)


@verb("not")
def not_(v):
    return ~truthy(v)


@verb("eq")
def equal(a, b):
    """As numbers if both are, else as strings; null equals null."""
    x, y = number(a), number(b)
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(text(a).eqNullSafe(text(b)))


@verb("ne")
def not_equal(a, b):
    return ~equal(a, b)


@verb("lt")
def lt(a, b):
    return col(a) < col(b)


@verb("lte")
def lte(a, b):
    return col(a) <= col(b)


@verb("gt")
def gt(a, b):
    return col(a) > col(b)


@verb("gte")
def gte(a, b):
    return col(a) >= col(b)


@verb("between")
def between(v, lo, hi):
    return col(v).between(col(lo), col(hi))


@verb("isNull")
def is_null(v):
    return col(v).isNull()


#: Names of types, by Spark's.
TYPES = {
    "void": "null", "boolean": "boolean", "string": "string", "tinyint": "integer", "smallint": "integer", "int": "integer",
    "bigint": "integer", "float": "number", "double": "number", "date": "date", "timestamp": "timestamp",
    "timestamp_ntz": "timestamp", "binary": "binary",
}


@verb("typeOf")
def type_of(v):
    t = F.typeof(col(v))
    name = F.when(t.startswith("array"), "array").when(t.startswith("struct") | t.startswith("map"), "object").when(t.startswith("decimal"), "currency").when(t.startswith("interval"), "duration")
    for k, out in TYPES.items():
        name = name.when(t == k, out)
    return F.when(col(v).isNull(), F.lit("null")).otherwise(name.otherwise(t))


def _is(*names):
    return lambda v: F.coalesce(type_of(v).isin(*names), F.lit(False))


verb("isString")(_is("string"))
verb("isNumber")(_is("integer", "number"))
verb("isBoolean")(_is("boolean"))


@verb("isArray")
def is_array(v):
    return F.typeof(col(v)).startswith("array") | F.coalesce(F.trim(text(v)).rlike(r"(?s)^\[.*\]$") & (F.typeof(col(v)) == "string"), F.lit(False))


@verb("isObject")
def is_object(v):
    t = F.typeof(col(v))
    return t.startswith("struct") | t.startswith("map") | F.coalesce(F.trim(text(v)).rlike(r"(?s)^\{.*\}$") & (t == "string"), F.lit(False))


@verb("isDate")
def is_date(v):
    return F.coalesce((F.typeof(col(v)) == "date") | text(v).rlike(r"^\d{4}-\d{2}-\d{2}"), F.lit(False))


@verb("coerceString")
def coerce_string(v):
    """Numbers that are whole have no fraction."""
    s = text(v)
    return F.when(F.typeof(col(v)).isin("double", "float"), F.regexp_replace(s, r"^(-?\d+)\.0$", "$1")).otherwise(s)


@verb("coerceNumber")
def coerce_number(v):
    return number(F.trim(text(v)))


@verb("coerceInteger", "parseInt")
def coerce_integer(v, *ignored):
    """Cut towards zero."""
    s = F.trim(text(v))
    return F.coalesce(s.try_cast("bigint"), s.try_cast("double").try_cast("bigint"))


@verb("coerceBoolean")
def coerce_boolean(v):
    return F.when(col(v).isNull(), F.lit(False)).otherwise(~F.lower(F.trim(text(v))).isin("", "false", "0", "no", "n", "off"))


@verb("coerceDate")
def coerce_date(v):
    """YYYY-MM-DD at the start, or a whole number of seconds since 1970."""
    s = text(v)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(s, 1, 10))).otherwise(F.timestamp_seconds(s.try_cast("bigint")).cast("date"))


@verb("coerceTimestamp")
def coerce_timestamp(v):
    return F.try_to_timestamp(text(v))


@verb("tryCoerce")
def try_coerce(v):
    """As a variant: a whole number, a number, a boolean, a date or the string as it is."""
    s = text(v)
    as_boolean = F.when(F.lower(s).isin("true", "false"), s.try_cast("boolean"))
    as_date = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s))
    return F.coalesce(*[F.when(x.isNotNull(), x.cast("variant")) for x in (s.try_cast("bigint"), s.try_cast("double"), as_boolean, as_date)], s.cast("variant"))


@verb("toArray")
def to_array(v):
    return F.array(col(v))


@verb("toObject")
def to_object(pairs):
    """A map from an array of [key, value]; the last value of a key stays."""
    keys = F.transform(pairs, lambda p: F.get(p, F.lit(0)).cast("string"))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(F.get(p, F.lit(0)).cast("string").alias("key"), F.get(p, F.lit(1)).alias("value"), i.alias("i"))), lambda e: ~F.array_contains(F.slice(keys, e["i"] + 2, F.size(keys)), e["key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def lookup_map(rows: list[tuple], keys: int = 1) -> dict:
    """First row by key, keys being strings."""
    out = {}
    for *k, v in rows:
        out.setdefault("\x1f".join(map(str, k[:keys])), v)
    return out


@verb("lookup")
def lookup(table: dict, *keys, default=None):
    """The value of a table that a specification holds. Larger tables are joined: operators.frames.lookup_join."""
    if not table:
        return F.lit(default)
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, F.concat_ws("\x1f", *[coerce_string(k) for k in keys])), F.lit(default))


@verb("lookupDefault")
def lookup_default(table: dict, *keys):
    return F.coalesce(lookup(table, *keys[:-1]), col(keys[-1]))


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
