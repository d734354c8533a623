"""Operator 5: quality rules of documents and of the hosts they come from.

Each document is measured by itself (words, symbols, repeated lines and three-word windows). Hosts (`source`) gather how
many of their documents fail each soft rule; a beta prior fitted to all hosts by moments shrinks the rates of small
hosts towards the common rate. A failed soft rule alone is no reason to reject a document: on a host where it hardly
happens, it is an exception. On a host whose shrunk rate is over HOST_RATE it is a habit, and the rule is held against
those of its documents that fail it. Documents that fail nothing stay, wherever they come from.

Null and empty texts have no words and fail the base rules. A null source is a host of its own. Equal rows count each.
Columns of the documents are kept, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordspark.llm.common import Steps, slice_arrays, whole_row

SYMBOLS = b"#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"
MIN_WORDS = 50
#: A host's shrunk failure rate above which a rule is held against its failing documents: one document in fifty.
HOST_RATE = 0.02
#: Soft rules, over a struct of STATS.
RULES = {
    "repeats": lambda s: 100 * s["n_repeat_words"] > 20 * s["n_words"],
    "lines": lambda s: 100 * s["n_dup_lines"] > 30 * s["n_lines"],
    "symbols": lambda s: 100 * s["n_symbols"] > 30 * s["n_words"],
    "word_length": lambda s: (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 15 * s["n_words"]),
}


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    # Python's own 64-bit hashes: they are compared within the text alone
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + h[2:]
    order = np.argsort(windows, kind="stable")
    s = windows[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """STATS of a text in UTF-8."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    joined = b"".join(words)
    continuation = 0 if joined.isascii() else int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80))
    return (len(words), len(joined) - continuation, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), len(lines), repeated_words(words))


@F.arrow_udf(T.StructType([T.StructField(x.split()[0], T.LongType()) for x in STATS.split(", ")]))
def stats_of(texts: pa.Array) -> pa.Array:
    """STATS of each text, in a struct."""
    rows = [measure(x or b"") for part in slice_arrays(texts.cast(pa.binary())) for x in part.to_pylist()]
    names = [x.split()[0] for x in STATS.split(", ")]
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(names), names)


def host_verdicts(rows: DataFrame, steps: Steps) -> DataFrame:
    """A row for each source that a rule is held against: host, bad_<rule>. rows: source and stats."""
    # Spark sums within each task first, so a host with a third of all rows costs a row from each task
    counts = steps.write("hosts", rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.when(rule(F.col("stats")), 1).otherwise(0)).alias(k) for k, rule in RULES.items())))
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("n") * F.col("n")).alias("nn"), *(F.sum(k).alias(k) for k in RULES), *(F.sum(F.col(k) * F.col(k) / F.col("n")).alias(f"{k}_sq") for k in RULES)).first()
    bad = {}
    for k in RULES:
        a, b = beta_prior(sums["n"] or 0, sums["hosts"], sums["nn"] or 0, sums[k] or 0, sums[f"{k}_sq"] or 0.0)
        bad[k] = (F.col(k) + F.lit(a)) / (F.col("n") + F.lit(a + b)) > HOST_RATE
    out = counts.select(F.col("source").alias("host"), *(c.alias(f"bad_{k}") for k, c in bad.items()))
    return steps.write("host-verdicts", out.where(" or ".join(f"bad_{k}" for k in RULES)))


def beta_prior(n: int, hosts: int, squares: int, failures: int, weighted_squares: float) -> tuple[float, float]:
    """Beta parameters by moments. weighted_squares: sum over hosts of failures^2 / documents."""
    if not n:
        return 1.0, 1.0
    p = failures / n
    if p in (0.0, 1.0) or hosts < 2:
        return p * 2 + 0.5, (1 - p) * 2 + 0.5
    # between-host variance, after taking off what chance alone gives
    between = (weighted_squares - n * p * p - (hosts - 1) * p * (1 - p)) / (n - squares / n) if n > squares / n else 0.0
    size = min(1e6, max(1.0, p * (1 - p) / between - 1)) if between > 0 else 1e6
    return p * size, (1 - p) * size


def judged(docs: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """row (all columns of docs, in a struct), stats, base_failed, kept. docs: text and source, besides any others.

    With `keep`, row has only these columns, and the measures are written beside them; else texts are measured twice,
    for hosts and for verdicts, which takes less than another copy of all rows."""
    steps = Steps(docs.sparkSession)
    rows = docs.select(whole_row(docs.select(*keep) if keep else docs), "source", stats_of("text").alias("stats"))
    rows = steps.write("quality", rows) if keep else rows
    verdicts = host_verdicts(rows.select("source", "stats"), steps)
    held = F.lit(False)
    for k, rule in RULES.items():
        held = held | (F.coalesce(F.col(f"bad_{k}"), F.lit(False)) & rule(F.col("stats")))
    # the verdicts are a written table: Spark broadcasts it if its size allows, else both sides are shuffled and split
    joined = rows.join(verdicts, F.col("source").eqNullSafe(F.col("host")), "left")
    return joined.select("row", "stats", base_failed(F.col("stats")).alias("base_failed"), (~base_failed(F.col("stats")) & ~held).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"), ("doc_id",))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return out.select("row.doc_id", *(F.col(f"stats.{x}") for x in names), "base_failed", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return judged(docs).where("kept").select("row.*")
