"""Mapping specifications: a text that says how records become other records, compiled to one lazy select.

    {$}
    target.format = "json"
    enforceConfidential = "redact"
    const.rate = ##2
    {table.colors[] : code, name}
    R, red
    {Person}
    Name = %upper @.name
    Total = "%multiply @.price $const.rate :decimals 2"
    Place = {city = @.city, code = "%upper @.country"}
    Phones[] = @.home
    Phones[] = @.work
    {.Address}
    Street = @.street
    {Items[]}
    _loop = @.items
    Sku = @_item.sku

A section is a field of the output: a struct, or, with [], an array with an element for each one of `_loop`'s array (a
scalar is one element, null is none). Names may have dots and places: {Person.Address} is a struct within Person, and so
is {.Address} after it; {Points[0]} and {Points[1]} are elements of an array, and a[2] = and a[] = put and append
elements. `_if` makes a section null where its condition isn't truthy, `_discriminator` and `_value` where texts differ;
where several sections make one field together, the fields of the section are null instead. Sections of later passes
(`_pass`) may refer to those before by name. Values are copies (@path), functions (%name arguments, nested), constants
($const.x), literals or objects ({name = value, ...}); directives after a colon cut, pad and cast. A name in no section
is an error at once. Tables and constants have sections of their own ({$table.x[a, b]}, {$const}) or the forms above."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordspark.functions import VERBS
from recordspark.functions.base import truthy
from recordspark.functions.logic import lookup, lookup_default

TOKEN = re.compile(r'\s*("(?:[^"\\]|\\.)*"|%&?[\w.]+|@[\w.\[\]#]*|\$const[\w.\[\]]*|#[#$%]?-?[\d.eE+-]+|\?(?:true|false)|~|\(|\)|:\w+|[^\s:()]+)')
#: Functions that take all arguments to the end of the line, or to a closing parenthesis; others take as many as ARITY says.
OPEN = {"concat", "coalesce", "lookup", "lookupDefault", "cond", "switch", "minOf", "maxOf"}
ARITY = {
    0: "today now",
    2: """ifNull ifEmpty and or xor eq ne lt lte gt gte assert contains startsWith endsWith mask repeat truncate join match leftOf rightOf matches
    tokenize levenshtein formatPhone formatNumber formatPercent parseInt add subtract multiply divide round mod log pow percentile quantile covariance
    correlation weightedAvg npv irr movingAvg jsonPath nanoid formatDate parseDate addDays addMonths addYears addHours addMinutes addSeconds isBefore
    isAfter daysBetweenDates ageFromDate isValidDate businessDays sortBy map indexOf at includes concatArrays zip groupBy take drop chunk pluck limit
    dedupe diff pctChange has merge""",
    3: """ifElse between replace replaceRegex padLeft padRight pad split substring extract wrap center random safeDivide formatLocaleNumber
    convertUnit compound discount pmt fv pv nper zscore clamp depreciation dateDiff isBetween formatLocaleDate slice range sample shift lag lead rank
    fillMissing reduce pivot unpivot get""",
    4: "rate bearing midpoint filter every some find findIndex partition",
    5: "interpolate distance",
    6: "inBoundingBox",
}
ARITIES = {name: n for n, names in ARITY.items() for name in names.split()}
CASTS = {
    "integer": "bigint", "number": "double", "currency": "double", "percent": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamp",
    "time": "string", "duration": "string", "reference": "string", "binary": "string",
}
FLAGS = {"trim", "upper", "lower", "required", "confidential", "deprecated", "attr", *CASTS}
CONTROL = {"_loop", "_from", "_if", "_when", "_discriminator", "_value", "_discriminatorValue", "_pass", "_accumulate"}


@dataclass
class Section:
    name: str
    array: bool
    fields: list[tuple[str, str]] = field(default_factory=list)
    control: dict[str, str] = field(default_factory=dict)

    @property
    def path(self) -> list:
        return target(self.name)

    @property
    def side_effect(self) -> bool:
        return self.name.startswith("_") and self.name != "_root"

    @property
    def looped(self) -> str | None:
        return self.control.get("_loop") or self.control.get("_from")


@dataclass
class Spec:
    options: dict[str, object] = field(default_factory=dict)
    constants: dict[str, object] = field(default_factory=dict)
    tables: dict[str, tuple[list[str], list[list]]] = field(default_factory=dict)
    sections: list[Section] = field(default_factory=list)
    #: accumulators that keep their value from pass to pass
    persistent: set[str] = field(default_factory=set)


def target(name: str) -> list:
    """The steps of a.b[2].c[]: names, places (int) and None for an appended element."""
    return [None if t == "[]" else int(t[1:-1]) if t[0] == "[" else t for t in re.findall(r"\[\d*\]|[^.\[\]]+", name)]


def literal(t: str):
    if t.startswith('"'):
        return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), t[1:-1])
    if t.startswith("##"):
        return int(t[2:])
    if t[0] == "#":
        return float(t.lstrip("#$%"))
    return {"~": None, "true": True, "false": False, "?true": True, "?false": False}.get(t, t)


def parts_of(text: str) -> list[str]:
    """text cut at commas that are in no quotes, brackets or braces."""
    out, depth, quoted = [""], 0, False
    for i, c in enumerate(text):
        quoted ^= c == '"' and text[i - 1 : i] != "\\"
        depth += not quoted and (c in "({[") - (c in ")}]")
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out if x.strip()]


def option(spec: Spec, key: str, value: str) -> None:
    """A line of the head: constants and accumulators have names of their own."""
    kind, _, rest = key.partition(".")
    if kind == "const" and (m := re.fullmatch(r"(.+)\[(\d+)\]", rest)):
        items = spec.constants.setdefault(m[1], [])
        items += [None] * (int(m[2]) + 1 - len(items))
        items[int(m[2])] = literal(value)
    elif kind == "const":
        spec.constants[rest] = literal(value)
    elif kind == "accumulator" and rest.endswith("._persist"):
        spec.persistent |= {rest.removesuffix("._persist")} if literal(value) in (True, "true") else set()
    else:
        spec.options[key] = literal(value)


def parse(text: str) -> Spec:
    spec, section, table, above = Spec(), None, None, ""
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith(";"):
            continue
        if line.startswith("{") and line.endswith("}") and "=" not in line:
            name, section, table = line[1:-1].strip(), None, None
            if m := re.fullmatch(r"\$?table\.(\w+)\[\]\s*:\s*(.*)|\$?table\.(\w+)\[(.*)\]", name):
                table = spec.tables[m[1] or m[3]] = ([x.strip() for x in (m[2] or m[4]).split(",")], [])
            elif name in ("$const", "const"):
                table = "const."
            elif name == "$" or name.startswith("$"):
                table = name[1:].rstrip(".") + "." if name != "$" else ""
            else:
                if name.startswith("."):
                    name = above + name
                else:
                    above = name.removesuffix("[]")
                section = Section(name.removesuffix("[]"), name.endswith("[]"))
                spec.sections.append(section)
            continue
        if isinstance(table, tuple):
            table[1].append([literal(x) for x in parts_of(line)])
            continue
        key, eq, value = (x.strip() for x in line.partition("="))
        if not eq:
            raise ValueError(f"line {number}: no = in {line!r}")
        if table is not None:
            option(spec, table + key, value)
        elif section is None:
            raise ValueError(f"line {number}: {key!r} is in no section")
        elif key in CONTROL:
            section.control[key] = value
        else:
            section.fields.append((key, value))
    return spec


class Compiler:
    def __init__(self, spec: Spec, df: DataFrame, lenient: bool = False):
        self.spec, self.df, self.schema = spec, df, df.schema
        #: with lenient: (section, field, message, condition) of what went wrong
        self.lenient, self.errors, self.at = lenient, [], ("", "")
        self.length = None
        self.tables = {name: (cols, rows) for name, (cols, rows) in spec.tables.items()}

    def path(self, path: str, item: Column | None, index: Column | None) -> Column:
        parts = re.findall(r"[^.\[\]]+|\[\d+\]", path.lstrip("."))
        if parts and parts[0] in ("_item", "_index", "_length"):
            if parts[0] == "_index":
                return index
            if parts[0] == "_length":
                return self.length
            out, parts = item, parts[1:]
            kind = None
        else:
            name, parts = parts[0], parts[1:]
            if name not in self.schema.names:
                return F.lit(None).cast("string")
            out, kind = F.col(f"`{name}`"), self.schema[name].dataType
        for p in parts:
            if p.startswith("["):
                out, kind = F.get(out, F.lit(int(p[1:-1]))), getattr(kind, "elementType", None)
            else:
                if isinstance(kind, T.StructType):
                    if p not in kind.names:
                        return F.lit(None).cast("string")
                    kind = kind[p].dataType
                out = out[p]
        return out

    def value(self, tokens: list[str], item, index):
        """The first value of tokens, which it takes away: a Column or a Python constant."""
        t = tokens.pop(0)
        if t == "(":
            out = self.value(tokens, item, index)
            tokens.pop(0)
            return out
        if t.startswith("@"):
            return self.path(t[1:], item, index)
        if t.startswith("$const"):
            name, _, place = t.removeprefix("$const.").rstrip("]").partition("[")
            return self.spec.constants[name][int(place)] if place else self.spec.constants[name]
        if not t.startswith("%"):
            return literal(t)
        name = t.lstrip("%&")
        arity = None if name in OPEN else ARITIES.get(name, 1)
        args = []
        while tokens and not tokens[0].startswith(":") and tokens[0] != ")" and (arity is None or len(args) < arity):
            args.append(self.value(tokens, item, index))
        if name in ("lookup", "lookupDefault"):
            table, column = args[0].split(".")
            columns, rows = self.tables[table]
            at = columns.index(column)
            found = {}
            for row in rows:
                found.setdefault("\x1f".join(str(x) for i, x in enumerate(row) if i != at), row[at])
            return (lookup if name == "lookup" else lookup_default)(found, *args[1:])
        if name not in VERBS:
            if t.startswith("%&"):
                return args[0] if args else F.lit(None)
            raise ValueError(f"function {name!r}")
        return VERBS[name](*args)

    def expression(self, text: str, item=None, index=None) -> tuple[Column, dict]:
        """The Column of a mapping's right side, and its modifiers."""
        if text.startswith('"') and text.endswith('"') and text[1:2] in "@%$":
            text = text[1:-1].replace('\\"', '"')
        if text.startswith("{") and text.endswith("}"):
            tree: dict = {}
            for part in parts_of(text[1:-1]):
                key, _, value = (x.strip() for x in part.partition("="))
                put(tree, target(key), self.expression(value, item, index))
            return built(tree), {}
        tokens = TOKEN.findall(text)
        out = self.value(tokens, item, index)
        out = out if isinstance(out, Column) else F.lit(out)
        directives = {}
        while tokens:
            name = tokens.pop(0).removeprefix(":")
            directives[name] = True if name in FLAGS else literal(tokens.pop(0)) if tokens else True
        return self.directed(out, directives), {k: True for k in ("required", "confidential", "deprecated", "attr") if k in directives}

    def directed(self, c: Column, d: dict) -> Column:
        number = lambda x: int(float(x))
        if "pos" in d:
            c = F.substring(c.cast("string"), number(d["pos"]) + 1, number(d.get("len", 1 << 30)))
        if "field" in d:
            c = F.get(F.split(c.cast("string"), ","), F.lit(number(d["field"])))
        if "trim" in d:
            c = VERBS["trim"](c)
        if "default" in d:
            c = F.coalesce(c, F.lit(d["default"]))
        for name in ("upper", "lower"):
            if name in d:
                c = VERBS[name](c)
        kind = CASTS.get(d.get("type")) or next((CASTS[k] for k in CASTS if k in d), None)
        if kind:
            given, c = c, c.try_cast(kind)
            if self.lenient:
                self.errors.append((*self.at, f"no {kind}", given.isNotNull() & c.isNull()))
        if "decimals" in d:
            c = F.round(c.try_cast("double"), number(d["decimals"]))
        for name, pad in (("leftPad", F.lpad), ("rightPad", F.rpad)):
            if name in d and "len" in d:
                c = pad(c.cast("string"), number(d["len"]), str(d[name]))
        if "truncate" in d:
            c = F.substring(c.cast("string"), 1, number(d["truncate"]))
        if "confidential" in d and (how := self.spec.options.get("enforceConfidential")):
            c = F.lit(None).cast("string") if how == "redact" else F.when(F.typeof(c) == "string", F.repeat(F.lit("*"), F.length(c.cast("string"))))
        return c

    def leaf(self, section: Section, name: str, text: str, item=None, index=None) -> tuple[Column, dict]:
        self.at = (section.name, name)
        if not self.lenient:
            return self.expression(text, item, index)
        try:
            return self.expression(text, item, index)
        except (ValueError, KeyError, TypeError, IndexError) as e:
            self.errors.append((*self.at, str(e), F.lit(True)))
            return F.lit(None).cast("string"), {}

    def record(self, section: Section, item=None, index=None) -> Column | dict:
        """A tree of the section's fields; the value itself, if its only field is _."""
        if len(section.fields) == 1 and section.fields[0][0] == "_":
            return self.leaf(section, *section.fields[0], item, index)[0]
        tree: dict = {}
        for name, text in section.fields:
            put(tree, target(name), self.leaf(section, name, text, item, index))
        return tree

    def condition(self, section: Section) -> Column | None:
        control = section.control
        conditions = [truthy(self.expression(control[k])[0]) for k in ("_if", "_when") if k in control]
        if "_discriminator" in control:
            wanted = control.get("_value") or control.get("_discriminatorValue")
            conditions.append(self.expression(control["_discriminator"])[0].cast("string").eqNullSafe(F.lit(str(literal(wanted)))))
        return reduce(lambda a, b: a & b, conditions) if conditions else None

    def loop(self, section: Section) -> Column:
        """An element for each one of the array; a scalar is one, null is none."""
        array = self.expression(section.looped)[0]
        if not isinstance(self.df.select(array.alias("a")).schema[0].dataType, T.ArrayType):
            array = F.when(array.isNotNull(), F.array(array))
        self.length = F.size(array)
        shaped = lambda x: built(x) if isinstance(x, dict) else x
        # errors within elements are no conditions on rows
        strict, self.lenient = self.lenient, False
        out = F.transform(array, lambda x, i: shaped(self.record(section, x, i)))
        self.lenient, self.length = strict, None
        return F.coalesce(out, F.slice(F.array(F.get(out, F.lit(0))), F.lit(1), F.lit(0)))

    def pass_columns(self, sections: list[Section]) -> dict[str, Column | dict]:
        """For each field of the output: a Column or a tree."""
        out: dict = {}
        for s in sections:
            top = s.path[0]
            shared = sum(x.path[0] == top for x in sections) > 1 or len(s.path) > 1
            held = self.condition(s)
            made = self.loop(s) if s.looped else self.record(s)
            if isinstance(made, dict) and not shared:
                made = F.array(built(made)) if s.array else built(made)
            if held is not None:
                made = when(held, made) if isinstance(made, dict) else F.when(held, made)
            if isinstance(made, dict):
                for path, leaf in paths(made):
                    put(out, [*s.path, *path], leaf)
            else:
                put(out, s.path, (made, {}))
        return out


def put(tree: dict, path: list, leaf: tuple) -> None:
    """leaf at path; the last one stays. A dict with places (int) as keys is an array."""
    for i, step in enumerate(path):
        if step is None:
            step = 1 + max([k for k in tree if isinstance(k, int)], default=-1)
        if i == len(path) - 1:
            tree[step] = leaf
        else:
            if not isinstance(tree.get(step), dict):
                tree[step] = {}
            tree = tree[step]


def paths(tree: dict, before: tuple = ()):
    for k, x in tree.items():
        if isinstance(x, dict):
            yield from paths(x, (*before, k))
        else:
            yield (*before, k), x


def when(held: Column, tree: dict) -> dict:
    return {k: when(held, x) if isinstance(x, dict) else (F.when(held, x[0]), x[1]) for k, x in tree.items()}


def built(tree: dict, shape: list | None = None) -> Column:
    """A struct of the tree, or an array, with nulls where nothing was put. Structs of one array get the same fields."""
    if all(isinstance(k, int) for k in tree) and tree:
        items = [tree.get(i) for i in range(max(tree) + 1)]
        structs = [x for x in items if isinstance(x, dict)]
        names = list(dict.fromkeys(k for x in structs for k in x))
        return F.array(*[F.lit(None) if x is None else built(x, names) if isinstance(x, dict) else x[0] for x in items])
    fields = []
    for k in shape or tree:
        x = tree.get(k)
        c = F.lit(None) if x is None else built(x) if isinstance(x, dict) else x[0]
        fields.append(c.alias(k, metadata=x[1] if isinstance(x, tuple) else {}))
    return F.struct(*fields)


def with_fields(column: Column, tree: dict) -> Column:
    """A struct of an earlier pass with the fields of a later one."""
    for path, leaf in paths(tree):
        if not all(isinstance(x, str) for x in path):
            raise ValueError(f"{path}: an earlier pass made this field; only fields of structs can be added")
        column = column.withField(".".join(path), leaf[0])
    return column


def order_of(section: Section) -> float:
    """Passes 1, 2, ... come first, then sections without one."""
    n = int(section.control.get("_pass", "##0").lstrip("#"))
    return n or float("inf")


def apply(df: DataFrame, spec: Spec | str, keep: list[str] = (), errors: str | None = None) -> DataFrame:
    """A column for each section (a section named _root gives its fields themselves), after the columns `keep`.

    errors: a column's name. It gets an array of structs (section, field, message) for what went wrong, and the fields
    concerned are null; without it a wrong expression is an error at once and a value that can't be cast is null."""
    spec = parse(spec) if isinstance(spec, str) else spec
    out, done, wrong = df, [], []
    for n in sorted({order_of(s) for s in spec.sections}):
        compiler = Compiler(spec, out, errors is not None)
        made = compiler.pass_columns([s for s in spec.sections if order_of(s) == n and not s.side_effect])
        columns = {k: (with_fields(F.col(k), x) if k in done else built(x)) if isinstance(x, dict) else x[0] for k, x in made.items()}
        found = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("section"), F.lit(f).alias("field"), F.lit(m).alias("message"))) for s, f, m, c in compiler.errors]
        if found:
            wrong.append(f"_errors{len(wrong)}")
            columns[wrong[-1]] = F.filter(F.array(*found), lambda x: x.isNotNull())
        out = out.withColumns(columns)
        done += [k for k in made if k not in done]
    names = [s.path[0] for s in spec.sections if s.path[0] in done]
    columns = [*keep, *[f"{x}.*" if x == "_root" else x for x in dict.fromkeys(names)]]
    if errors:
        none = F.array().cast("array<struct<section:string,field:string,message:string>>")
        columns.append((F.concat(*wrong) if wrong else none).alias(errors))
    return out.select(*columns)


def accumulators(df: DataFrame, spec: Spec | str, order: str) -> DataFrame:
    """One row: a column for each field `name = op value` of the sections whose names start with _ (but _root).

    An accumulator is reset when the pass changes: the last pass that has it counts alone, unless it is persistent (the
    head says accumulator.name._persist = true); then the passes add up, each after those before."""
    from recordspark.operators.frames import accumulate

    spec = parse(spec) if isinstance(spec, str) else spec
    compiler, found = Compiler(spec, df), {}
    for s in sorted(spec.sections, key=order_of):
        if s.side_effect:
            for name, text in s.fields:
                op, _, value = text.partition(" ")
                last = accumulate(df, compiler.expression(value.strip())[0], order, op)
                found.setdefault(name, []).append((order_of(s), op, last))
    merged = {"sum": lambda a, b: a + b, "add": lambda a, b: a + b, "count": lambda a, b: a + b, "min": F.least, "max": F.greatest, "concat": F.concat, "first": lambda a, b: F.coalesce(a, b), "last": lambda a, b: F.coalesce(b, a), "set": lambda a, b: F.coalesce(b, a)}
    out = []
    for name, parts in found.items():
        own = parts if name in spec.persistent else [x for x in parts if x[0] == parts[-1][0]]
        out.append(reduce(lambda a, b: merged[own[-1][1]](a, b), [x[2] for x in own]).alias(name))  # noqa: B023
    return df.agg(*out)


def discriminator(spec: Spec | str, line: str = "line") -> Column:
    """What the head says (source.discriminator.type = position, with pos and len; field, with its number; or a path) tells records apart."""
    options = (parse(spec) if isinstance(spec, str) else spec).options
    at = lambda k: options.get(f"source.discriminator.{k}")
    if at("type") == "position":
        return F.substring(line, int(at("pos")) + 1, int(at("len")))
    if at("type") == "field":
        return F.trim(F.get(F.split(F.col(line), re.escape(str(options.get("source.delimiter", ",")))), F.lit(int(at("field")))))
    return F.col(str(at("path")).lstrip("@."))


def route(lines: DataFrame, discriminator: Column, specs: dict[str, Spec | str], keep: list[str] = ()) -> dict[str, DataFrame]:
    """For each kind of record its own mapping; a key may name several kinds, with commas. Other records are left out."""
    return {kinds: apply(lines.where(discriminator.isin([k.strip() for k in kinds.split(",")])), spec, keep) for kinds, spec in specs.items()}


def route_and_merge(lines: DataFrame, discriminator: Column, specs: dict[str, Spec | str], by: list[str], order: str) -> DataFrame:
    """A row for each `by` with a column for each section, from one scan: what records give to an array is appended in
    their order; a struct is the last record's. A document's records must fit into memory as arrays."""
    out, aggregates = lines, []
    for n, (kinds, spec) in enumerate(specs.items()):
        spec = parse(spec) if isinstance(spec, str) else spec
        mine = discriminator.isin([k.strip() for k in kinds.split(",")])
        for name, tree in Compiler(spec, lines).pass_columns([s for s in spec.sections if not s.side_effect]).items():
            column = built(tree) if isinstance(tree, dict) else tree[0]
            label, array = f"_{n}_{name}", any(s.array and s.path[0] == name for s in spec.sections)
            out = out.withColumn(label, F.when(mine, column))
            if array:
                records = F.array_sort(F.collect_list(F.when(F.col(label).isNotNull(), F.struct(F.col(order).alias("o"), F.col(label).alias("x")))))
                aggregates.append(F.flatten(F.transform(records, lambda r: r["x"])).alias(name))
            else:
                aggregates.append(F.max_by(label, F.when(F.col(label).isNotNull(), F.col(order))).alias(name))
    return out.groupBy(*by).agg(*aggregates)
