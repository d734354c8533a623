"""Schemas of fields with constraints, and the violations that a frame's rows have.

Checks become Columns, evaluated in one pass without a shuffle; uniqueness over rows, and references, take one each."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordspark.storage import checkpoints

#: Named formats.
FORMATS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "url": r"^https?://[^\s/$.?#].[^\s]*$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "ssn": r"^\d{3}-?\d{2}-?\d{4}$",
    "vin": r"^[A-HJ-NPR-Z0-9]{17}$",
    "phone": r"^\+?[\d\s().-]{7,}$",
    "zip": r"^\d{5}(-\d{4})?$",
    "ipv4": r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.|$)){4}(?<!\.)$",
    "ipv6": r"^(([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(([0-9a-fA-F]{1,4}:)*[0-9a-fA-F]{1,4})?::(([0-9a-fA-F]{1,4}:)*[0-9a-fA-F]{1,4})?)$",
    "date-iso": r"^\d{4}-\d{2}-\d{2}$",
    "naic": r"^\d{5}$",
    "fein": r"^\d{2}-?\d{7}$",
}
#: Codes that named formats know.
KNOWN = {
    "currency-code": """AED ARS AUD BDT BGN BHD BRL CAD CHF CLP CNY COP CZK DKK EGP EUR GBP GHS HKD HRK HUF IDR ILS INR ISK JOD JPY KES KRW KWD
LBP MAD MXN MYR NGN NOK NZD OMR PEN PHP PKR PLN QAR RON RUB SAR SEK SGD THB TRY TWD TZS UAH UGX USD VND ZAR""".split(),
    "country-alpha2": """AE AR AT AU BD BE BG BH BR CA CH CL CN CO CY CZ DE DK EG ES FI FR GB GH GR HK HR HU ID IE IL IN IS IT JO JP KE KR KW LB
MA MX MY NG NL NO NZ OM PE PH PK PL PT QA RO RU SA SE SG TH TR TW TZ UA UG US VN ZA""".split(),
    "country-alpha3": """ARE ARG AUS AUT BEL BGD BGR BHR BRA CAN CHE CHL CHN COL CYP CZE DEU DNK EGY ESP FIN FRA GBR GHA GRC HKG HRV HUN IDN IND
IRL ISL ISR ITA JOR JPN KEN KOR KWT LBN MAR MEX MYS NGA NLD NOR NZL OMN PAK PER PHL POL PRT QAT ROU RUS SAU SGP SWE THA TUR TWN TZA UGA UKR USA VNM ZAF""".split(),
}
#: States, district and territories.
STATES = """AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC
SD TN TX UT VT VA WA WV WI WY DC AS GU MP PR VI""".split()
#: Codes of violations.
CODES = {
    "V001": "required field is missing", "V002": "type differs", "V003": "value is out of bounds", "V004": "pattern or format doesn't match",
    "V005": "value is none of those allowed", "V006": "array length is out of bounds", "V007": "array elements or rows aren't unique",
    "V008": "invariant doesn't hold", "V009": "number of present fields is out of bounds", "V010": "field is required here",
    "V011": "field is unknown", "V012": "reference is circular", "V013": "reference isn't resolved",
}
#: The tolerance of = and != in invariants.
TOLERANCE = 0.001
#: Limits of patterns (characters, depth, quantifiers).
PATTERN_LIMITS = (1024, 10, 20)
CASTS = {"integer": "bigint", "number": "double", "currency": "double", "percent": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamp"}


def matches_format(c: Column, name: str) -> Column:
    s = c.cast("string")
    if name == "creditcard":
        digits = F.regexp_replace(s, "[ -]", "")
        return digits.rlike(r"^\d{13,19}$") & F.call_function("luhn_check", digits)
    if name == "state-us" or name in KNOWN:
        return s.isin(STATES if name == "state-us" else KNOWN[name])
    if name == "date-iso":
        return s.rlike(FORMATS[name]) & F.try_to_date(s).isNotNull()
    if name == "ssn":
        return s.rlike(FORMATS[name]) & ~s.rlike(r"^(000|666|9)|^\d{3}-?00|0000$")
    return s.rlike(FORMATS[name])


def risky(pattern: str) -> str | None:
    """Why a pattern may take very long, or None: too long, too deep, too many quantifiers, or a repeated group that repeats inside."""
    bare = re.sub(r"\\.|\[(?:[^\]\\]|\\.)*\]", "x", pattern)
    depth = most = 0
    repeats, quantifiers = [False], len(re.findall(r"[*+?]|\{\d", bare))
    for i, c in enumerate(bare):
        if c == "(":
            depth += 1
            most = max(most, depth)
            repeats.append(False)
        elif c == ")" and depth:
            depth -= 1
            inner = repeats.pop()
            if inner and bare[i + 1 : i + 2] in ("*", "+", "{"):
                return "a repeated group repeats inside"
            repeats[-1] |= inner
        elif c in "*+" or re.match(r"\{\d+,", bare[i:]):
            repeats[-1] = True
    length, deep, many = PATTERN_LIMITS
    return "too long" if len(pattern) > length else "too deep" if most > deep else "too many quantifiers" if quantifiers > many else None


@dataclass
class Field:
    """A field's type (several with | between: any of them) and constraints. when: (field, operator, value) clauses, any of which makes it required."""

    path: str
    type: str = "string"
    required: bool = False
    when: list[tuple] = field(default_factory=list)
    unless: list[tuple] = field(default_factory=list)
    low: float | None = None
    high: float | None = None
    exclusive: bool = False
    pattern: str | None = None
    format: str | None = None
    enum: list | None = None
    min_items: int | None = None
    max_items: int | None = None
    unique: bool = False
    references: str | None = None


@dataclass
class Schema:
    fields: list[Field]
    invariants: list[str] = field(default_factory=list)
    #: (fields, least, most) present ones
    cardinality: list[tuple] = field(default_factory=list)
    strict: bool = False
    #: named types, and of a type the names of those that it extends
    types: dict[str, Schema] = field(default_factory=dict)
    parents: list[str] = field(default_factory=list)

    def extended(self, *parents: Schema) -> Schema:
        """With the parents' fields; those of the same path are overridden."""
        own = {f.path: f for p in (*parents, self) for f in p.fields}
        return Schema(list(own.values()), [i for p in (*parents, self) for i in p.invariants], [c for p in (*parents, self) for c in p.cardinality], self.strict)


COMPARE = {"=": lambda a, b: a == b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def clause(name: str, op: str, value) -> Column:
    left = F.col(name)
    if op in ("<", "<=", ">", ">="):
        return F.coalesce(COMPARE[op](left.try_cast("double"), F.lit(float(value))), F.lit(False))
    return F.coalesce(COMPARE[op](left.cast("string"), F.lit(str(value).lower() if isinstance(value, bool) else str(value))), F.lit(op == "!="))


def invariant(text: str) -> Column:
    """A violation of `a + b - c op d`, of fields and numbers; null fields don't violate it."""
    left, op, right = re.fullmatch(r"\s*(.+?)\s*(==|!=|<=|>=|=|<|>)\s*(.+?)\s*", text).groups()

    def side(s: str) -> Column:
        terms = re.findall(r"([+-]?)\s*([\w.]+)", s)
        values = [(F.lit(float(t)) if re.fullmatch(r"[\d.]+", t) else F.col(t).try_cast("double")) * (-1 if sign == "-" else 1) for sign, t in terms]
        return reduce(lambda a, b: a + b, values)

    a, b = side(left), side(right)
    held = {"=": F.abs(a - b) < TOLERANCE, "==": F.abs(a - b) < TOLERANCE, "!=": F.abs(a - b) >= TOLERANCE}.get(op)
    return ~(COMPARE[op](a, b) if held is None else held)


def _fits(c: Column, name: str, kind: T.DataType) -> Column | None:
    """Is a value of that type? None: all are."""
    if name not in CASTS:
        return None
    whole = (c == F.floor(c)) if name == "integer" and isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(True)
    return c.try_cast(CASTS[name]).isNotNull() & whole


def _checks(f: Field, kind: T.DataType):
    c = F.col(f.path)
    if f.required and not f.when and not f.unless:
        yield "V001", c.isNull()
    if f.when:
        yield "V010", c.isNull() & reduce(lambda a, b: a | b, [clause(*w) for w in f.when])
    if f.unless:
        yield "V010", c.isNull() & ~reduce(lambda a, b: a | b, [clause(*w) for w in f.unless])
    if isinstance(kind, T.ArrayType):
        if f.min_items is not None or f.max_items is not None:
            low, high = f.min_items or 0, f.max_items if f.max_items is not None else 1 << 30
            yield "V006", ~F.size(c).between(low, high)
        if f.unique:
            yield "V007", F.size(c) != F.size(F.array_distinct(c))
        return
    fits = [_fits(c, x, kind) for x in f.type.split("|")]
    if all(x is not None for x in fits):
        yield "V002", c.isNotNull() & ~reduce(lambda a, b: a | b, fits)
    if f.low is not None or f.high is not None:
        v = c.try_cast("double") if f.type in ("integer", "number", "currency", "percent") else F.octet_length(c) if f.type == "binary" else F.length(c.cast("string"))
        out = []
        if f.low is not None:
            out.append(v <= f.low if f.exclusive else v < f.low)
        if f.high is not None:
            out.append(v >= f.high if f.exclusive else v > f.high)
        yield "V003", reduce(lambda a, b: a | b, out)
    if f.pattern:
        if why := risky(f.pattern):
            raise ValueError(f"{f.path}: pattern {f.pattern!r}: {why}")
        yield "V004", ~F.rlike(c.cast("string"), F.lit(f.pattern))
    if f.format:
        yield "V004", ~matches_format(c, f.format)
    if f.enum:
        yield "V005", ~c.cast("string").isin([str(x) for x in f.enum])


def _leaf_paths(schema: T.StructType, above: str = ""):
    for f in schema.fields:
        path = f"{above}.{f.name}" if above else f.name
        if isinstance(f.dataType, T.StructType):
            yield from _leaf_paths(f.dataType, path)
        else:
            yield path


def with_violations(df: DataFrame, schema: Schema, out: str = "_violations") -> DataFrame:
    """df with an array of structs (code, path) for each row."""
    found, kinds = [], {}
    struct = lambda code, path: F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"))
    for f in schema.fields:
        try:
            kinds[f.path] = df.select(f.path).schema[0].dataType
        except Exception as e:
            if "UNRESOLVED_COLUMN" not in str(e) and "FIELD_NOT_FOUND" not in str(e):
                raise
            if f.required:  # no row has it
                found.append(struct("V001", f.path))
            continue
        found += [F.when(F.coalesce(bad, F.lit(False)), struct(code, f.path)) for code, bad in _checks(f, kinds[f.path])]
    found += [F.when(F.coalesce(invariant(text), F.lit(False)), struct("V008", text)) for text in schema.invariants]
    for fields, least, most in schema.cardinality:
        present = reduce(lambda a, b: a + b, [F.when(F.col(x).isNotNull(), 1).otherwise(0) for x in fields])
        found.append(F.when(~present.between(least, most), struct("V009", ",".join(fields))))
    if schema.strict:
        known = {f.path for f in schema.fields}
        found += [struct("V011", p) for p in _leaf_paths(df.schema) if not any(p == k or p.startswith(k + ".") for k in known)]
    array = F.array(*found) if found else F.array().cast("array<struct<code:string,path:string>>")
    return df.withColumn(out, F.filter(array, lambda x: x.isNotNull()))


def violations(df: DataFrame, schema: Schema, key: str) -> DataFrame:
    """A row for each violation: key, code, path, message."""
    messages = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    rows = with_violations(df, schema).select(key, F.explode("_violations").alias("v")).select(key, "v.code", "v.path")
    for f in schema.fields:
        if f.unique and f.path in df.columns and not isinstance(df.schema[f.path].dataType, T.ArrayType):
            again = df.where(F.col(f.path).isNotNull()).groupBy(f.path).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
            rows = rows.unionByName(df.join(again, f.path, "left_semi").select(key, F.lit("V007").alias("code"), F.lit(f.path).alias("path")))
    return rows.withColumn("message", messages[F.col("code")])


def unresolved(df: DataFrame, key: str, reference: str, targets: DataFrame, target: str) -> DataFrame:
    """V013: rows whose reference has no target."""
    rows = df.where(F.col(reference).isNotNull()).join(targets.select(F.col(target).alias("_t")).distinct(), F.col(reference) == F.col("_t"), "left_anti")
    return rows.select(key, F.lit("V013").alias("code"), F.lit(reference).alias("path"), F.lit(CODES["V013"]).alias("message"))


def circular(edges: DataFrame, source: str, target: str) -> DataFrame:
    """V012: nodes on a cycle of references, whatever number of targets a node has.

    Nodes without a way in or a way out are on none and go, a few rounds long. For the rest, ways double in length until
    no new pair of ends comes: at most as often as the longest way can be halved. A node that reaches itself is on a cycle."""
    checkpoints(edges.sparkSession)
    now = edges.select(F.col(source).alias("n"), F.col(target).alias("t")).where("n is not null and t is not null").distinct()
    for _ in range(2):
        inner = now.join(now.select(F.col("n").alias("m")).distinct(), F.col("t") == F.col("m"), "left_semi").checkpoint()
        now = inner.join(inner.select(F.col("t").alias("m")).distinct(), F.col("n") == F.col("m"), "left_semi").checkpoint()
    pairs, before = now.count(), -1
    while pairs != before:
        before = pairs
        further = now.join(now.toDF("m", "t2"), F.col("t") == F.col("m")).select("n", F.col("t2").alias("t"))
        now = now.union(further).distinct().checkpoint()
        pairs = now.count()
    return now.where("n = t").select(F.col("n").alias("node"), F.lit("V012").alias("code"), F.lit(CODES["V012"]).alias("message"))
