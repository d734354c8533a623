"""Array functions' counterparts on whole frames: lazy, shuffled by Spark, of any size.

Running operators take `order` (columns that order rows; name enough of them that ties don't matter) and `by` (columns of
the groups). Without `by` one task orders all rows; running sums and counts, prefix_sum() and row_numbers() are parallel
there too."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordspark.functions.arrays import test
from recordspark.functions.base import truthy
from recordspark.storage import checkpoints

#: Bytes of a lookup table up to which it is broadcast.
BROADCAST_BYTES = 32 << 20


def filter_rows(df: DataFrame, field: str, op: str | None = None, value=None) -> DataFrame:
    return df.where(truthy(F.col(field)) if op is None else test(F.col(field), op, value))


def partition_rows(df: DataFrame, field: str, op: str | None = None, value=None) -> tuple[DataFrame, DataFrame]:
    held = truthy(F.col(field)) if op is None else test(F.col(field), op, value)
    return df.where(held), df.where(~held)


def _window(order: Sequence, by: Sequence):
    return Window.partitionBy(*by).orderBy(*order)


def _so_far(order, by):
    return _window(order, by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running(df: DataFrame, out: str, value: str | Column, order: Sequence, by: Sequence = (), op: str = "sum") -> DataFrame:
    """An accumulator's value after each row: sum (add), count, min, max, concat, first, last (set), product, mean.

    Sums and counts without `by` go by prefix_sum(). Each row of a concat holds all text before it: by design, as long as that."""
    v = F.col(value) if isinstance(value, str) else value
    if not by and op in ("sum", "add", "count"):
        return prefix_sum(df, F.when(v.isNotNull(), 1).otherwise(0) if op == "count" else v, order, out)
    w = _so_far(order, by)
    total = {
        "sum": F.sum, "add": F.sum, "count": F.count, "min": F.min, "max": F.max, "mean": F.avg, "product": F.product,
        "concat": lambda x: F.collect_list(x.cast("string")), "first": lambda x: F.first(x, ignorenulls=True),
        "last": lambda x: F.last(x, ignorenulls=True), "set": lambda x: F.last(x, ignorenulls=True),
    }[op](v).over(w)
    return df.withColumn(out, F.array_join(total, "") if op == "concat" else total)


def accumulate(df: DataFrame, value: str | Column, order: str | None = None, op: str = "sum") -> Column:
    """An accumulator's last value, as an aggregate."""
    v = F.col(value) if isinstance(value, str) else value
    if op in ("first", "last", "set"):
        return (F.min_by if op == "first" else F.max_by)(v, F.col(order))
    if op == "concat":
        ordered = F.array_sort(F.collect_list(F.struct(F.col(order), v.cast("string").alias("v"))))
        return F.array_join(F.transform(ordered, lambda s: s["v"]), "")
    return {"sum": F.sum, "add": F.sum, "count": F.count, "min": F.min, "max": F.max}[op](v)


def cumsum(df: DataFrame, column: str, order, by=(), out: str = "cumsum") -> DataFrame:
    """Nulls stay null."""
    return df.withColumn(out, F.when(F.col(column).isNotNull(), F.sum(column).over(_so_far(order, by))))


def cumprod(df: DataFrame, column: str, order, by=(), out: str = "cumprod") -> DataFrame:
    return df.withColumn(out, F.when(F.col(column).isNotNull(), F.product(column).over(_so_far(order, by))))


def lag(df: DataFrame, column: str, order, by=(), n: int = 1, out: str = "lag") -> DataFrame:
    return df.withColumn(out, F.lag(column, n).over(_window(order, by)))


def lead(df: DataFrame, column: str, order, by=(), n: int = 1, out: str = "lead") -> DataFrame:
    return df.withColumn(out, F.lead(column, n).over(_window(order, by)))


def diff(df: DataFrame, column: str, order, by=(), out: str = "diff") -> DataFrame:
    return df.withColumn(out, F.col(column) - F.lag(column).over(_window(order, by)))


def pct_change(df: DataFrame, column: str, order, by=(), out: str = "pct_change") -> DataFrame:
    before = F.lag(column).over(_window(order, by))
    return df.withColumn(out, F.try_divide(F.col(column) - before, before))


def moving_avg(df: DataFrame, column: str, order, by=(), width: int = 3, out: str = "moving_avg") -> DataFrame:
    w = _window(order, by).rowsBetween(-(width - 1), 0)
    return df.withColumn(out, F.avg(F.coalesce(F.col(column), F.lit(0))).over(w))


def rank(df: DataFrame, column: str, by=(), out: str = "rank") -> DataFrame:
    """1 for the greatest; nulls have none."""
    w = Window.partitionBy(*by).orderBy(F.col(column).desc_nulls_last())
    return df.withColumn(out, F.when(F.col(column).isNotNull(), F.rank().over(w)))


def fill_missing(df: DataFrame, column: str, order, by=(), how="forward", out: str | None = None) -> DataFrame:
    w = _window(order, by)
    if how == "forward":
        filled = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    elif how == "backward":
        filled = F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    else:
        filled = F.coalesce(F.col(column), F.lit(how))
    return df.withColumn(out or column, filled)


def dedupe(df: DataFrame, columns: Sequence[str], order, by=()) -> DataFrame:
    """Without rows equal in columns to the one before."""
    w = _window(order, by)
    same = F.struct(*columns).eqNullSafe(F.lag(F.struct(*columns)).over(w))
    return df.withColumn("_same", same).where("not _same").drop("_same")


def distinct_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key. Tasks keep one row a key before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    least = F.min(F.struct(*order, *[c for c in rest if c not in order]))
    return df.groupBy(*keys).agg(least.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def group_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rows") -> DataFrame:
    """A row for each key with its rows, in order, as an array. A key's rows must fit into memory: aggregate where you can."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in rest if c not in order]))).alias(out))


def mode(df: DataFrame, column: str, order: str, by=()) -> DataFrame:
    """The most frequent value; of those, the one that came first."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = F.max(F.struct("n", (-F.col("first")).alias("first"), column))
    return counts.groupBy(*by).agg(best.alias("best")).select(*by, F.col(f"best.{column}").alias("mode"), F.col("best.n").alias("n"))


def pivot(df: DataFrame, by: Sequence[str], key: str, value: str, order: str, keys: Sequence | None = None) -> DataFrame:
    """A column for each key; of several values the last counts. Without `keys` Spark looks for them first."""
    grouped = df.groupBy(*by)
    return (grouped.pivot(key, list(keys)) if keys else grouped.pivot(key)).agg(F.max_by(value, order))


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], key: str = "key", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(columns), key, value)


def chunks(df: DataFrame, order: Sequence, size: int, by=(), out: str = "chunk") -> DataFrame:
    return df.withColumn(out, F.floor((F.row_number().over(_window(order, by)) - 1) / size))


def zip_rows(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Rows of equal rank side by side, nulls where one is shorter."""
    return row_numbers(left, left_order, "_n").join(row_numbers(right, right_order, "_n"), "_n", "full").withColumnRenamed("_n", "position")


def _settled(df: DataFrame, order: Sequence[str], partitions: int | None) -> DataFrame:
    """df in order over partitions, each row with the number of its partition (_part) and its place there (_place, from 0).

    Ranges are sampled anew whenever such a frame is computed, and plans may merge its partitions differently. So it is
    written once, as a reliable checkpoint, and all that follows reads that copy."""
    checkpoints(df.sparkSession)
    ordered = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    fixed = ordered.sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    # in each partition of the copy these numbers grow by one from row to row
    return fixed.withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))


def _offsets(df: DataFrame, total: Column) -> DataFrame:
    """_part, _before: the sum of `total` over the partitions before. A row for each partition, so one task is enough."""
    sums = df.groupBy("_part").agg(total.alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return sums.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))


def row_numbers(df: DataFrame, order: Sequence[str], out: str = "row_number", start: int = 1, partitions: int | None = None) -> DataFrame:
    """Gapless numbers in order, without one task that sees all rows: a row's place in its partition, and the rows before that."""
    rows = _settled(df, order, partitions)
    before = F.broadcast(_offsets(rows, F.count(F.lit(1))))
    return rows.join(before, "_part").withColumn(out, F.col("_before") + F.col("_place") + start).select(*[c for c in df.columns if c != out], out)


def prefix_sum(df: DataFrame, value: str | Column, order: Sequence[str], out: str = "prefix_sum", partitions: int | None = None) -> DataFrame:
    """A running total over the whole frame, partition by partition; a null adds nothing. Rows that tie in order have any order among them."""
    v = F.col(value) if isinstance(value, str) else value
    rows = _settled(df.withColumn("_v", v), order, partitions)
    before = F.broadcast(_offsets(rows, F.sum("_v")))
    own = F.coalesce(F.sum("_v").over(Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return rows.join(before, "_part").withColumn(out, own + F.col("_before")).select(*[c for c in df.columns if c != out], out)


def sequence(df: DataFrame, order: Sequence[str], out: str = "sequence", start: int = 0) -> DataFrame:
    """A counter from 0, or from where it was reset to."""
    return row_numbers(df, order, out, start)


def lookup_join(df: DataFrame, table: DataFrame, on: dict[str, str], value: str, out: str, default=None, order: str | None = None, table_bytes: int | None = None) -> DataFrame:
    """df with the value of the table's first row whose keys match as text. on: column of df -> column of table.

    The table is broadcast only if table_bytes says that it is small; else Spark decides by its own statistics."""
    keys = list(on.values())
    first = F.min_by(value, order) if order else F.first(value)
    rows = table.groupBy(*[F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(keys)]).agg(first.alias("_value"))
    if table_bytes is not None and table_bytes <= BROADCAST_BYTES:
        rows = F.broadcast(rows)
    match = [df[c].cast("string") == F.col(f"_k{i}") for i, c in enumerate(on)]
    joined = df.join(rows, match, "left")
    return joined.withColumn(out, F.coalesce("_value", F.lit(default))).drop("_value", *[f"_k{i}" for i in range(len(keys))])


def as_of_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """left with the right's latest values at or before its time: one shuffle, by union and a window."""
    rows = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values])
    other = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), *[F.col(v).alias(f"_{v}") for v in values])
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("_side") == 0, F.struct(*[f"_{v}" for v in values])), ignorenulls=True).over(w)
    out = rows.unionByName(other).withColumn("_latest", latest).where("_side = 1")
    return out.select("_row.*", *[F.col(f"_latest._{v}").alias(v) for v in values])


#: Rows of a side in a block of an interval join, and pairs that a task of it should look at.
INTERVAL_BLOCK, INTERVAL_PAIRS = 4_096, 1 << 25


def interval_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, block: int = INTERVAL_BLOCK, pairs: int = INTERVAL_PAIRS) -> DataFrame:
    """Points in [low, high]: both sides meet in bins of `width`, ranges in each bin that they reach into.

    A bin with more than `block` rows of a side is cut into blocks, and each block of points meets each block of ranges.
    The bins' counts are looked at first; as many tasks share the blocks as the pairs call for."""
    bins = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    left = points.withColumn("_bin", F.floor(F.col(point) / width))
    right = ranges.where(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(bins))
    counts = left.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n")).join(right.groupBy("_bin").agg(F.count(F.lit(1)).alias("_m")), "_bin")
    total = counts.agg(F.sum(F.col("_n").cast("double") * F.col("_m"))).first()[0] or 0.0
    match = F.col(point).between(F.col(low), F.col(high))
    if total <= pairs:
        return left.join(right, "_bin").where(match).drop("_bin")
    # bins of several blocks: no more than rows / block
    blocks = F.broadcast(counts.select("_bin", F.ceil(F.col("_n") / block).alias("_ps"), F.ceil(F.col("_m") / block).alias("_rs")).where("_ps > 1 or _rs > 1"))

    def dealt(df: DataFrame, own: str, other: str, sort: str, copy: str) -> DataFrame:
        """Each row in a block of its own side, once for each block of the other."""
        plain = [f.name for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        rows = df.join(blocks, "_bin", "left").withColumn(sort, F.pmod(F.xxhash64(*plain), F.coalesce(own, F.lit(1)))).withColumn(copy, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other, F.lit(1)) - 1)))
        return rows.drop("_ps", "_rs").repartition(tasks, "_bin", "_p", "_r")

    tasks = int(-(-total // pairs))
    return dealt(left, "_ps", "_rs", "_p", "_r").join(dealt(right, "_rs", "_ps", "_r", "_p"), ["_bin", "_p", "_r"]).where(match).drop("_bin", "_p", "_r")


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: str = "") -> DataFrame:
    """n rows, those of the least hashes."""
    return df.withColumn("_h", F.xxhash64(F.lit(seed), *keys)).orderBy("_h", *keys).limit(n).drop("_h")
