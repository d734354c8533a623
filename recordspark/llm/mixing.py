"""Operator 8 [native]: sources mixed to target weights by Poisson replication.

A source's rate is what its documents must be repeated on average for the source to reach its target share of the
output. Each document's count is the Poisson quantile at a uniform number hashed from seed and doc_id: the same in any
run, on any partitioning. The copies are dealt out anew by a hash and sorted by it within partitions.

Rows of equal doc_id have equal counts. Rows without doc_id go by their text, so that each text has a draw of its own.
Rows of an equal hash are dealt out by the partition that they come from, too, so that no task gets them all. A null
source is a source of its own; null text is allowed. An empty table gives no rows. Columns of the documents are kept,
whatever their names, but for those that mix() adds (n_copies, copy, shuffle_key), which take the place of such columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordspark.llm.common import whole_row, written

SEED = "mix-1"
#: Target share of a source: in proportion to its documents to this power.
TEMPERATURE = 0.7


def own_key() -> Column:
    """What a document's draw goes by: doc_id, or without one the text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.col("text"))), F.lit("null"))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of an md5."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """_source, rate, cdf: the mean number of copies and the cumulative Poisson probabilities 0, 1, ...

    weights: target share by source (a source that isn't named gets none); none: by TEMPERATURE. total: documents wanted
    (as many as there are)."""
    counts = written(docs.groupBy(F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("_n")), "sources")
    if weights is None:
        share = F.pow(F.col("_n").cast("double"), F.lit(TEMPERATURE))
    else:
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "_name string, _weight double")
        counts = counts.join(table, F.col("_source").eqNullSafe(F.col("_name")), "left").drop("_name")
        share = F.coalesce(F.col("_weight"), F.lit(0.0))
    counts = counts.withColumn("_share", share)
    sums = counts.agg(F.sum("_share"), F.sum("_n")).first()  # one row
    wanted = float(total if total is not None else sums[1] or 0)
    rate = F.col("_share") * F.lit(wanted / sums[0] if sums[0] else 0.0) / F.col("_n")
    rated = counts.select("_source", rate.alias("rate"))
    # terms beyond this hold less than 1e-15 of the mass
    last = F.when(F.col("rate") > 0, F.ceil(F.col("rate") + 9 * F.sqrt("rate") + 25)).otherwise(F.lit(0)).cast("int")
    terms = rated.select("_source", "rate", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    till = Window.partitionBy("_source").orderBy("k")
    logs = terms.withColumn("log_factorial", F.sum(F.log(F.greatest(F.col("k"), F.lit(1)).cast("double"))).over(till))
    p = F.when(F.col("rate") > 0, F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.col("log_factorial"))).otherwise(F.lit(1.0))
    sums = logs.withColumn("p", p).withColumn("sum", F.sum("p").over(till))
    return written(sums.groupBy("_source", "rate").agg(F.array_sort(F.collect_list("sum")).alias("cdf")), "rates")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: str = SEED) -> DataFrame:
    """docs with n_copies, copy (1, 2, ...) and shuffle_key, a row for each copy, in random order."""
    rates = source_rates(docs.select("source"), weights, total)
    rows = docs.select(whole_row(docs), "source", own_key().alias("own"))
    drawn = rows.join(rates, rows["source"].eqNullSafe(rates["_source"]), "left").withColumn("u", uniform(F.lit(seed), F.col("own")))
    counted = drawn.select("row", "own", F.spark_partition_id().alias("part"), F.size(F.filter("cdf", lambda c: c < F.col("u"))).cast("long").alias("n_copies")).where("n_copies > 0")
    copies = counted.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n_copies")).alias("copy"))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), "own", F.col("copy").cast("string"))))
    added = ("n_copies", "copy", "shuffle_key")
    own = [F.col("row.`" + c.replace("`", "``") + "`") for c in docs.columns if c not in added]
    return keyed.repartition("shuffle_key", "part").sortWithinPartitions("shuffle_key").select(*own, *added)


ORACLE = f"""
with counts as (select source, count(*) as n from documents group by source),
rates as (select source, pow(n, {TEMPERATURE}) * (select sum(n) from counts) / (select sum(pow(n, {TEMPERATURE})) from counts) / n as rate from counts),
drawn as (select d.*, r.rate, (('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), 'null')), 1, 13))::bigint + 0.5) / 4503599627370496.0 as u
  from documents d join rates r on d.source is not distinct from r.source),
terms as (select source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over (partition by source order by k) as cdf from rates, range(0, 60) t(k)),
counted as (select d.doc_id, d.text, d.lang, d.source, d.n_chars, d.u, (select count(*) from terms t where t.source is not distinct from d.source and t.cdf < d.u) as n_copies from drawn d)
select doc_id, text, lang, source, n_chars, n_copies, c as copy, md5('{SEED}:' || coalesce(cast(doc_id as varchar), 'null') || ':' || c) as shuffle_key
from counted, unnest(range(1, n_copies + 1)) as x(c)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's rate has it."""
    return mix(docs.select(whole_row(docs), "doc_id", "source", "text")).select("row.*")
