"""Documents as rows of assignments (path, value): flattening, canonical digests, differences and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordspark.functions.logic import coerce_string


def leaves(schema: T.StructType, at: Column | None = None, path: str = ""):
    """(path, Column) of the scalar fields of a schema; arrays count as their JSON."""
    for f in schema.fields:
        c = F.col(f"`{f.name}`") if at is None else at[f.name]
        name = f"{path}.{f.name}" if path else f.name
        if isinstance(f.dataType, T.StructType):
            yield from leaves(f.dataType, c, name)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
            yield name, F.to_json(c)
        else:
            yield name, coerce_string(c)


def assignments(df: DataFrame, key: str, nulls: bool = False) -> DataFrame:
    """key, path, value of each scalar field."""
    parts = [F.struct(F.lit(p).alias("path"), c.alias("value")) for p, c in leaves(df.schema) if p != key]
    rows = df.select(key, F.explode(F.array(*parts)).alias("a")).select(key, "a.path", "a.value")
    return rows if nulls else rows.where("value is not null")


def canonical(df: DataFrame, key: str) -> Column:
    """A row's assignments in order of their paths, a line each."""
    lines = [F.when(c.isNotNull(), F.concat(F.lit(f"{p} = "), c)) for p, c in sorted(leaves(df.schema), key=lambda x: x[0]) if p != key]
    return F.concat_ws("\n", *lines)


def digests(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.sha2(canonical(df, key), 256).alias("digest"))


def difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, op (added, removed, changed, moved), path, from_path, old, new, between assignments (key, path, value).

    A removed and an added path of one key with one value, if there is just one of each, count as moved."""
    a, b = old.select(key, "path", F.col("value").alias("old")), new.select(key, "path", F.col("value").alias("new"))
    both = a.join(b, [key, "path"], "full").where("not (old <=> new)")
    op = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    rows = both.select(key, op.alias("op"), "path", "old", "new")
    loose = rows.where("op <> 'changed'").groupBy(key, F.coalesce("old", "new").alias("value")).agg(
        F.sum(F.when(F.col("op") == "added", 1).otherwise(0)).alias("added"), F.sum(F.when(F.col("op") == "removed", 1).otherwise(0)).alias("removed"),
        F.max(F.when(F.col("op") == "added", F.col("path"))).alias("to"), F.max(F.when(F.col("op") == "removed", F.col("path"))).alias("from_path"),
    )
    moved = loose.where("added = 1 and removed = 1").select(key, F.lit("moved").alias("op"), F.col("to").alias("path"), "from_path", F.col("value").alias("old"), F.col("value").alias("new"))
    ends = moved.select(key, F.explode(F.array("path", "from_path")).alias("path"))
    rest = rows.join(ends, [key, "path"], "left_anti").withColumn("from_path", F.lit(None).cast("string"))
    return rest.select(*moved.columns).unionByName(moved)


def patch(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Assignments after the changes of difference()."""
    gone = changes.where("op in ('removed', 'changed')").select(key, "path").unionByName(changes.where("op = 'moved'").select(key, F.col("from_path").alias("path")))
    put = changes.where("op <> 'removed'").select(key, "path", F.col("new").alias("value"))
    return old.select(key, "path", "value").join(gone, [key, "path"], "left_anti").unionByName(put)


def typed_assignments(df: DataFrame, key: str) -> DataFrame:
    """key, path, type, value, modifiers of each scalar field; modifiers are what its column's metadata has as true."""
    kinds = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "number", "double": "number", "timestamp_ntz": "timestamp"}
    flat: dict[str, T.StructField] = {}

    def walk(schema: T.StructType, above: str = "") -> None:
        for f in schema.fields:
            path = f"{above}.{f.name}" if above else f.name
            flat[path] = f
            if isinstance(f.dataType, T.StructType):
                walk(f.dataType, path)

    walk(df.schema)
    parts = []
    for path, c in leaves(df.schema):
        if path != key:
            name, own = flat[path].dataType.simpleString(), sorted(k for k, x in (flat[path].metadata or {}).items() if x is True)
            parts.append(F.struct(F.lit(path).alias("path"), F.lit(kinds.get(name, name)).alias("type"), c.alias("value"), F.array(*map(F.lit, own)).cast("array<string>").alias("modifiers")))
    return df.select(key, F.explode(F.array(*parts)).alias("a")).select(key, "a.*").where("value is not null")


def typed_difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, op, path, old, new, old_type, new_type between typed assignments: added, removed, changed (another type or
    value), modified (the same, with other modifiers)."""
    a, b = (x.select(key, "path", *(F.col(c).alias(f"{side}_{c}") for c in ("type", "value", "modifiers"))) for x, side in ((old, "old"), (new, "new")))
    both = a.join(b, [key, "path"], "full")
    same = F.col("old_type").eqNullSafe(F.col("new_type")) & F.col("old_value").eqNullSafe(F.col("new_value"))
    op = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").when(~same, "changed").when(~F.col("old_modifiers").eqNullSafe(F.col("new_modifiers")), "modified")
    return both.select(key, op.alias("op"), "path", F.col("old_value").alias("old"), F.col("new_value").alias("new"), "old_type", "new_type").where("op is not null")


def patch_errors(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """key, path, message of changes that patch() can't do as they are: what they remove, change or move isn't there."""
    needed = changes.where("op <> 'added'").select(key, F.when(F.col("op") == "moved", F.col("from_path")).otherwise(F.col("path")).alias("path"))
    return needed.join(old.select(key, "path"), [key, "path"], "left_anti").withColumn("message", F.lit("no such path"))


#: The last step of a path: a name after a dot, or a place in brackets.
LAST = r"(?:\.[^.\[\]]+|\[\d*\])$"


def parent(path: Column) -> Column:
    """a.b[2] -> a.b -> a -> empty"""
    return F.when(path.rlike(LAST), F.regexp_replace(path, LAST, "")).otherwise(F.lit(""))


def leaf(path: Column) -> Column:
    """The last step, without its dot."""
    return F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract(path, LAST, 0), F.lit("")), path), r"^\.", "")


def steps(path: Column) -> Column:
    """The steps of a path: names, and places in brackets."""
    return F.regexp_extract_all(path, F.lit(r"\[\d*\]|[^.\[\]]+"), F.lit(0))


def under(path: Column, prefix: str) -> Column:
    """Is it the prefix, or within it?"""
    return (path == prefix) | path.startswith(prefix + ".") | path.startswith(prefix + "[")


def joined_path(*parts: Column) -> Column:
    """Steps put together; places in brackets have no dot before them."""
    return F.regexp_replace(F.concat_ws(".", *parts), r"\.\[", "[")


class Builder:
    """Collects the assignments of one document: Builder().set("a.b", 1).set("a.c", "x", "confidential").frame(spark)."""

    def __init__(self):
        self.rows: dict[str, tuple] = {}

    def set(self, path: str, value, *modifiers: str) -> Builder:
        """The last value of a path stays."""
        kind = {bool: "boolean", int: "integer", float: "number", type(None): "null"}.get(type(value), "string")
        shown = None if value is None else str(value).lower() if isinstance(value, bool) else str(value)
        self.rows[path] = (path, kind, shown, list(modifiers))
        return self

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(list(self.rows.values()), "path string, type string, value string, modifiers array<string>")
