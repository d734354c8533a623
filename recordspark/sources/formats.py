"""Readers and writers of the formats that mappings know, on Spark's own sources. read() and write() go by the format's name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordspark.functions.logic import coerce_string
from recordspark.operators.documents import leaves


def read_csv(spark: SparkSession, path: str, schema: str | None = None, delimiter: str = ",", header: bool = True) -> DataFrame:
    """Without a schema Spark reads the data once more to infer types."""
    r = spark.read.option("escape", '"').option("multiLine", True)
    return r.csv(path, schema=schema, sep=delimiter, header=header, inferSchema=schema is None)


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = True) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=not lines)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    """Attributes are @name, mixed text is _text; empty elements are null."""
    r = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "@").option("valueTag", "_text").option("nullValue", "")
    return (r.schema(schema) if schema else r).load(path)


def fixed_width(value: Column, columns: str) -> list[Column]:
    """columns: name:start:width;... with starts from 0. Blanks at the right go."""
    out = []
    for spec in filter(None, columns.split(";")):
        name, start, width, *_ = spec.strip().split(":")
        out.append(F.rtrim(F.substring(value, int(start) + 1, int(width))).alias(name))
    return out


def read_fixed_width(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return spark.read.text(path).select(*fixed_width(F.col("value"), columns))


def inferred(v: Column) -> Column:
    """The type that a text looks like."""
    s = F.trim(v)
    quoted = s.rlike("(?s)^\".*\"$|^'.*'$")
    kind = F.when(quoted, "string").when(s.isin("", "~", "null"), "null").when(s.isin("true", "false"), "boolean").when(s.rlike(r"^[+-]?\d+$"), "integer").when(s.rlike(r"^[+-]?(\d+\.\d*|\.?\d+)([eE][+-]?\d+)?$"), "number").otherwise("string")
    return F.struct(kind.alias("type"), F.when(kind != "null", F.when(quoted, F.substring(s, 2, F.length(s) - 2)).otherwise(s)).alias("value"))


def flat_assignments(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines with path, type, value, of key=value lines; comments (# ;) and others go."""
    s = F.trim(F.col(line))
    rows = lines.where(s.contains("=") & ~s.rlike("^[#;]"))
    at = F.instr(s, F.lit("="))
    rows = rows.withColumn("path", F.trim(F.substring(s, F.lit(1), at - 1))).withColumn("_v", inferred(F.substring(s, at + 1, F.lit(1 << 30))))
    return rows.withColumn("type", F.col("_v.type")).withColumn("value", F.col("_v.value")).drop("_v") if line == "value" else rows.select("*", "_v.type", "_v.value").drop("_v")


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """path, type, value and the file of each line."""
    return flat_assignments(spark.read.text(path).withColumn("file", F.input_file_name()))


def yaml_assignments(text: str) -> list[tuple[str, str]]:
    """(path, value) of a subset of YAML: mappings, lists by dashes, scalars, comments."""
    out, stack = [], [(-1, "", [0])]
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not line.strip() or line.strip() == "---":
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        while body.startswith("- ") or body == "-":
            while stack[-1][0] >= indent:
                stack.pop()
            count = stack[-1][2]
            stack.append((indent, f"{stack[-1][1]}[{count[0]}]", [0]))
            count[0] += 1
            rest = body[1:].lstrip()
            indent, body = indent + len(body) - len(rest), rest
        if not body:
            continue
        m = re.fullmatch(r"(\"[^\"]*\"|'[^']*'|[^:\s][^:]*?)\s*:(?:\s+(.*))?", body)
        if m:
            while stack[-1][0] >= indent:
                stack.pop()
            at = f"{stack[-1][1]}.{m[1].strip(chr(34) + chr(39))}".lstrip(".")
            if m[2] is None:
                stack.append((indent, at, [0]))
            else:
                out.append((at, m[2].strip()))
        else:
            out.append((stack[-1][1], body))
    return out


def read_yaml(spark: SparkSession, path: str) -> DataFrame:
    """file, path, type, value of each file's scalars. A file is one document, read whole."""

    @F.udf("array<struct<path:string,raw:string>>", useArrow=True)
    def parsed(text):
        return yaml_assignments(text or "")

    # a file may hold several documents
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", r"(?m)^---[ \t]*$")).alias("at", "text"))
    rows = texts.select("file", F.concat_ws("#", "file", "at").alias("document"), F.explode(parsed("text")).alias("a"))
    return rows.select("file", "document", "a.path", inferred(F.col("a.raw")).alias("v")).select("file", "document", "path", "v.type", "v.value")


#: Marks of types in the typed key-path format.
MARKS = {"integer": "##", "number": "#", "currency": "#$", "percent": "#%", "boolean": "", "null": "~", "reference": "@", "binary": "^"}


def native_assignments(lines: DataFrame, by: list[str], order: str, line: str = "value") -> DataFrame:
    """lines (by, order, line) of the typed key-path format with path, type, value and modifiers.

    Headers {a.b} are put before the keys that follow them; {.b} goes on from the last one without a dot, {$} and {@x}
    are headers of their own ($.key, @x.key). A table {a[] : b, c.d, .e} has rows of values with commas between, as
    a[0].b and so on; {a[] : ~} has a value in each. `by` tells documents apart."""
    from pyspark.sql import Window

    s = F.trim(F.col(line))
    header = F.when(s.rlike(r"^\{.*\}$"), F.trim(F.regexp_extract(s, r"^\{(.*)\}$", 1)))
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_raw", header).withColumn("_top", F.last(F.when(~F.col("_raw").startswith("."), F.regexp_replace(F.col("_raw"), r"\[\].*$", "")), ignorenulls=True).over(w))
    named = F.when(F.col("_raw").startswith("."), F.concat("_top", "_raw")).otherwise(F.col("_raw"))
    rows = rows.withColumn("_section", F.coalesce(F.last(named, ignorenulls=True).over(w), F.lit("")))
    rows = rows.withColumn("_n", F.sum(F.when(F.col("_raw").isNotNull(), 1).otherwise(0)).over(w)).where((s != "") & ~s.startswith(";") & F.col("_raw").isNull())
    in_table = F.col("_section").rlike(r"\[\]\s*:")
    plain = rows.where(~in_table & s.contains("=")).withColumn("_key", F.trim(F.substring_index(F.col(line), "=", 1)))
    plain = plain.withColumn("_value", F.trim(F.substring(F.col(line), F.instr(F.col(line), F.lit("=")) + 1, F.lit(1 << 30))))
    # tables: the row's number within its header, then its cells
    place = F.row_number().over(Window.partitionBy(*by, "_n").orderBy(order)) - 1
    cells = F.transform(F.regexp_extract_all(s, F.lit(r'\s*("(?:[^"\\]|\\.)*"|[^,]*)(?:,|$)'), F.lit(1)), lambda x: F.trim(x))
    columns = F.transform(F.split(F.regexp_replace(F.col("_section"), r"^.*\[\]\s*:", ""), ","), lambda x: F.trim(x))
    # .e has the parent of the last column with a dot of its own
    state = F.struct(F.lit("").alias("parent"), F.array().cast("array<string>").alias("out"))

    def named_column(st: Column, c: Column) -> Column:
        relative = c.startswith(".")
        parent = F.when(relative, st["parent"]).when(c.contains("."), F.substring_index(c, ".", 1)).otherwise(F.lit(""))
        return F.struct(parent.alias("parent"), F.concat(st["out"], F.array(F.when(relative & (st["parent"] == ""), F.substring(c, 2, 1 << 30)).when(relative, F.concat(st["parent"], c)).otherwise(c))).alias("out"))

    tables = rows.where(in_table).withColumn("_place", place).withColumn("_columns", F.aggregate(columns, state, named_column, lambda st: st["out"])).withColumn("_cells", cells)
    tables = tables.select(*[c for c in tables.columns if c not in ("_columns", "_cells")], F.posexplode("_columns").alias("_i", "_column"), "_cells").withColumn("_value", F.get("_cells", F.col("_i"))).where("_value <> ''")
    table_key = F.concat(F.lit("["), F.col("_place").cast("string"), F.lit("]"), F.when(F.col("_column") != "~", F.concat(F.lit("."), F.col("_column"))).otherwise(F.lit("")))
    tables = tables.withColumn("_key", table_key).withColumn("_section", F.regexp_replace("_section", r"\[\]\s*:.*$", ""))
    rows = plain.unionByName(tables.select(*plain.columns))
    key, raw = F.col("_key"), F.col("_value")
    marks = F.regexp_extract(raw, r"^([!*-]*)(?=[\"#~@^?TP\d]|true|false|$)", 1)
    body = F.substring(raw, F.length(marks) + 1, F.lit(1 << 30))
    rules = [
        ("string", r'(?s)^"(.*)"$'), ("integer", r"^##(-?\d+)$"), ("currency", r"^#\$(-?[\d.]+)(?::[A-Z]{3})?$"), ("percent", r"^#%(-?[\d.]+)$"),
        ("number", r"^#(-?[\d.]+(?:[eE][+-]?\d+)?)$"), ("boolean", r"^\??(true|false)$"), ("null", r"^(~)$"), ("reference", r"^@(.+)$"), ("binary", r"^\^(?:\w+:)?(.*)$"),
        ("timestamp", r"^(\d{4}-\d\d-\d\dT.+)$"), ("date", r"^(\d{4}-\d\d-\d\d)$"), ("time", r"^(T\d\d:.+)$"), ("duration", r"^(P.+)$"),
    ]
    kind, value = F.lit("invalid"), body
    for name, rule in reversed(rules):
        kind = F.when(body.rlike(rule), name).otherwise(kind)
        value = F.when(body.rlike(rule), F.regexp_extract(body, rule, 1)).otherwise(value)
    section = F.col("_section")
    path = F.when(section == "", key).when(key.startswith("["), F.concat(section, key)).otherwise(F.concat_ws(".", section, key))
    return rows.select(*by, order, path.alias("path"), kind.alias("type"), F.when(kind != "null", value).alias("value"), F.filter(F.split(marks, ""), lambda m: m != "").alias("modifiers"))


def native_documents(df: DataFrame, by: list[str], text: str) -> DataFrame:
    """native_assignments of whole texts: df has a document of the typed key-path format in column `text`."""
    lines = df.select(*by, F.posexplode(F.split(text, r"\r?\n")).alias("_line", "_text"))
    return native_assignments(lines, by, "_line", "_text").withColumnRenamed("_line", "line")


def read_native(spark: SparkSession, path: str) -> DataFrame:
    """document, line, path, type, value, modifiers of texts of the typed key-path format, with --- between documents. A
    document is one row of one task, so files can be split."""
    texts = spark.read.option("lineSep", "\n---\n").text(path).where("trim(value) <> ''")
    # the same in any computation: a file's name and the document's text
    return native_documents(texts.withColumn("document", F.concat_ws("#", F.input_file_name(), F.xxhash64("value").cast("string"))), ["document"], "value")


def stream_native(spark: SparkSession, path: str, handle, checkpoint: str):
    """A streaming query over documents of the typed key-path format that arrive in path: handle(assignments, number) gets
    each batch's, as read_native() gives them. It ends when all that is there is read."""

    def each(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumn("document", F.xxhash64("value").cast("string"))
        handle(native_documents(keyed, ["document"], "value"), number)

    texts = spark.readStream.option("lineSep", "\n---\n").text(path).where("trim(value) <> ''")
    return texts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def native_text(df: DataFrame) -> Column:
    """A row as a document of the typed key-path format."""
    kinds = {T.LongType: "##", T.IntegerType: "##", T.ShortType: "##", T.DoubleType: "#", T.FloatType: "#", T.BooleanType: "", T.DateType: "", T.TimestampType: ""}
    types = {}

    def walk(schema, path=""):
        for f in schema.fields:
            name = f"{path}.{f.name}" if path else f.name
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, name)
            else:
                types[name] = f.dataType

    walk(df.schema)
    lines = []
    for path, c in leaves(df.schema):
        mark = kinds.get(type(types[path]))
        escaped = F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\\\\\"), '"', r'\\\\"')
        shown = F.concat(F.lit('"'), escaped, F.lit('"')) if mark is None else F.concat(F.lit(mark), c)
        lines.append(F.concat(F.lit(f"{path} = "), F.coalesce(shown, F.lit("~"))))
    return F.concat_ws("\n", *lines)


def flat_text(df: DataFrame) -> Column:
    """A row as sorted key=value lines; nulls are left out."""
    return F.concat_ws("\n", *[F.when(c.isNotNull(), F.concat(F.lit(f"{p}="), c)) for p, c in sorted(leaves(df.schema), key=lambda x: x[0])])


def yaml_text(df: DataFrame) -> Column:
    """A row as YAML: a line for each scalar, its parents above it; nulls are left out."""

    def lines(schema: T.StructType, at: Column | None, depth: int):
        for f in schema.fields:
            c = F.col(f"`{f.name}`") if at is None else at[f.name]
            pad = "  " * depth
            if isinstance(f.dataType, T.StructType):
                yield F.when(c.isNotNull(), F.lit(f"{pad}{f.name}:"))
                yield from lines(f.dataType, c, depth + 1)
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                yield F.when(c.isNotNull(), F.concat(F.lit(f"{pad}{f.name}: "), F.to_json(c)))
            else:
                shown = F.concat(F.lit('"'), coerce_string(c), F.lit('"')) if isinstance(f.dataType, T.StringType) else coerce_string(c)
                yield F.concat(F.lit(f"{pad}{f.name}: "), shown)

    return F.concat_ws("\n", *lines(df.schema, None, 0))


def _type_name(kind: T.DataType) -> str:
    return {"bigint": "integer", "int": "integer", "smallint": "integer", "double": "number", "float": "number", "timestamp_ntz": "timestamp"}.get(kind.simpleString(), kind.simpleString())


def export_json(df: DataFrame, types: bool = False, modifiers: bool = False, nulls: bool = True) -> Column:
    """A row as JSON. types: each scalar is {"type": ..., "value": ...}; modifiers: with those of its field, too."""

    def shaped(f: T.StructField, c: Column) -> Column:
        if isinstance(f.dataType, T.StructType):
            return F.struct(*[shaped(g, c[g.name]).alias(g.name) for g in f.dataType.fields])
        own = sorted(k for k, x in (f.metadata or {}).items() if x is True)
        parts = [F.lit(_type_name(f.dataType)).alias("type")] * types + [F.lit(own[0] if len(own) == 1 else ",".join(own)).alias("modifiers")] * bool(modifiers and own)
        return F.struct(*parts, c.alias("value")) if parts else c

    return F.to_json(F.struct(*[shaped(f, F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields]), {"ignoreNullFields": str(not nulls).lower()})


def export_csv(df: DataFrame, delimiter: str = ",", quote_all: bool = False) -> Column:
    """A row as a line of CSV; texts are quoted where they must be, or all of them."""
    cells = []
    for path, c in leaves(df.schema):
        doubled = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        text = isinstance(df.schema[path].dataType, T.StringType) if path in df.columns else False
        cells.append(F.coalesce(doubled if quote_all and text else F.when(c.rlike('[\n"' + re.escape(delimiter) + "]"), doubled).otherwise(c), F.lit("")))
    return F.concat_ws(delimiter, *cells)


def export_xml(df: DataFrame, row_tag: str = "record", types: bool = False) -> Column:
    """A row as an element, a child for each scalar; types: with its type as an attribute. Nulls are left out."""
    children = []
    for f in df.schema.fields:
        c = F.replace(F.replace(F.replace(coerce_string(F.col(f"`{f.name}`")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        mark = f' type="{_type_name(f.dataType)}"' if types else ""
        children.append(F.concat(F.lit(f"<{f.name}{mark}>"), c, F.lit(f"</{f.name}>")))
    return F.concat(F.lit(f"<{row_tag}>"), F.concat_ws("", *children), F.lit(f"</{row_tag}>"))


def fixed_width_text(columns: str, fill: str = " ") -> Column:
    """columns: name:start:width;... , with :leftPad=c or :rightPad=c after the width; texts too long are cut."""
    out, at = [], 0
    for spec in sorted(filter(None, columns.split(";")), key=lambda s: int(s.split(":")[1])):
        name, start, width, *pads = spec.strip().split(":")
        side, _, c = (pads[0] if pads else f"rightPad={fill}").partition("=")
        out += [F.repeat(F.lit(fill), F.lit(int(start) - at)), (F.lpad if side == "leftPad" else F.rpad)(F.coalesce(coerce_string(F.col(name)), F.lit("")), int(width), c or fill)]
        at = int(start) + int(width)
    return F.concat(*out)


def write(df: DataFrame, path: str, form: str = "json", **options) -> None:
    """json, csv, xml, flat (properties), fixed-width (columns=...), native; all in parallel, a file for each partition."""
    if form == "json":
        df.write.json(path, ignoreNullFields=options.get("nulls") == "omit")
    elif form == "csv":
        df.write.csv(path, header=options.get("header", True), sep=options.get("delimiter", ","), escape='"')
    elif form == "xml":
        df.write.format("xml").options(rootTag=options.get("root", "root"), rowTag=options.get("row_tag", "record"), attributePrefix="@", valueTag="_text").save(path)
    elif form in ("flat", "properties") and options.get("style") == "yaml":
        df.select(yaml_text(df).alias("value")).write.option("lineSep", "\n---\n").text(path)
    elif form in ("flat", "properties"):
        df.select(flat_text(df).alias("value")).write.option("lineSep", "\n\n").text(path)
    elif form == "fixed-width":
        df.select(fixed_width_text(options["columns"]).alias("value")).write.text(path)
    elif form == "native":
        df.select(native_text(df).alias("value")).write.option("lineSep", "\n---\n").text(path)
    else:
        raise ValueError(f"format {form!r}")


#: Format name -> reader of (spark, path, options).
READERS = {
    "csv": lambda spark, path, o: read_csv(spark, path, o.get("schema"), o.get("delimiter", ","), o.get("header", True)),
    "json": lambda spark, path, o: read_json(spark, path, o.get("schema"), o.get("lines", True)),
    "xml": lambda spark, path, o: read_xml(spark, path, o.get("row_tag", "record"), o.get("schema")),
    "fixed-width": lambda spark, path, o: read_fixed_width(spark, path, o["columns"]),
    "flat": lambda spark, path, o: read_flat(spark, path),
    "properties": lambda spark, path, o: read_flat(spark, path),
    "yaml": lambda spark, path, o: read_yaml(spark, path),
    "native": lambda spark, path, o: read_native(spark, path),
}


def read(spark: SparkSession, path: str, form: str, **options) -> DataFrame:
    """Reads by the format's name; options are the reader's."""
    if form not in READERS:
        raise ValueError(f"format {form!r}; known: {', '.join(READERS)}")
    return READERS[form](spark, path, options)
