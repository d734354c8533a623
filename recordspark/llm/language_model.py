"""Operator 4: log probabilities of texts under a hashed maximum-entropy model with class-factored softmax.

Tokens are the words of a text (A-Z in lower case), then one end. A word's class and, in it, its subclass are hashes of
its last and first letters; the end has a class of its own. P(word | before) = P(class | before) * P(subclass | class,
before) * P(word | subclass). The first two are softmaxes over sums of weights of hashed features: the word before, the
two before, and, skipping, the second and the third before. The last is the word's smoothed share of its subclass's
tokens; a word that training has not seen has the share that smoothing sets aside. So probabilities of all words,
unseen ones as one, add up to 1.

Weights are trained on all training documents, which a hash deals to ROUNDS rounds. In a round all tasks sum up the
gradient of the round's documents at the same weights; the sum over all tasks moves the weights once, by a diagonal
Newton step. So scores depend on the documents, not on how they are partitioned (but for the last digits of sums). The
weights have a fixed size (2 * BUCKETS * 16 numbers, 4 MB); the table of the most frequent words that tasks are sent has
MOST_KNOWN at most. Counts of all other words stay in Spark and meet the documents by a join.

Training documents are those whose crc32(doc_id as text) mod 10 isn't 0; a row without doc_id is one. Null and empty texts
are an end alone. Equal rows count each. Without training documents all tokens are unseen. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordspark.llm.common import sliced, written

CLASSES, SUBCLASSES, BUCKETS, FEATURES = 16, 16, 1 << 15, 4
ROUNDS, BATCH = 6, 1 << 15
#: A step is the gradient over CURVED times the variance of its output in as many tokens, and LEVELLED; LONGEST at most.
CURVED, LEVELLED, LONGEST = 2.5, 4.0, 1.5
MOST_KNOWN = 100_000
#: The end is no word: words hold no blanks.
END = b" "
BLOCK = 1 << 12
#: Bytes of texts whose words are told apart at once.
SLICE = 8_000_000
SMOOTHING = 0.1


def cell(word: bytes) -> int:
    """class * SUBCLASSES + subclass; the end has class 0 to itself."""
    if word == END:
        return 0
    return (1 + zlib.crc32(word[-2:]) % (CLASSES - 1)) * SUBCLASSES + zlib.crc32(word[:2], len(word) > 5) % SUBCLASSES


#: crc32 of two letters, by their number (the first is the higher byte); of one. Those of a word's first letters start from 0 or 1.
_TWO = np.array([[zlib.crc32(bytes(divmod(k, 256)), start) for k in range(1 << 16)] for start in (0, 1)])
_ONE = np.array([zlib.crc32(bytes([k])) for k in range(256)])


def cells_of(words: list[bytes]) -> np.ndarray:
    """cell() of each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    # a zero before and after, so that one-letter words have neighbours
    raw = np.frombuffer(b"\0" + b"".join(words) + b"\0", np.uint8).astype(np.int64)
    one, last, first = sizes == 1, raw[ends], raw[ends - sizes + 1]
    last = np.where(one, _ONE[last], _TWO[0][raw[ends - 1] << 8 | last])
    two = _TWO[(sizes > 5).astype(np.int64), first << 8 | raw[ends - sizes + 2]]
    out = (1 + last % (CLASSES - 1)) * SUBCLASSES + np.where(one, _ONE[first], two) % SUBCLASSES
    out[one & (first == END[0])] = 0
    return out


def words_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return [*raw.lower().split(), END]


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """words_of() of all texts in one array: numbers of tokens, where each text's begin (and the last's end), and the distinct words by number."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    words, numbers, bounds = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    empty = pc.index(words, b"").as_py()
    if empty >= 0:  # beside blanks at a text's bounds
        keep = numbers != empty
        numbers, bounds = numbers[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]
        numbers = numbers - (numbers > empty)
        words = pa.concat_arrays([words.slice(0, empty), words.slice(empty + 1)])
    numbers = np.insert(numbers, bounds[1:], len(words))
    return numbers, bounds + np.arange(len(bounds)), pa.concat_arrays([words, pa.array([END], pa.binary())])


def training(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 10 != 0, F.lit(True))


class Words(dict):
    """word -> number; a bounded cache. codes: by number, hash and cell in one. logs: log10 of a word's smoothed count, nan if it isn't known."""

    LIMIT = 400_000

    def __init__(self, known: dict[bytes, float] | None = None):
        self.known = known or {}
        self.codes, self.logs = np.zeros(self.LIMIT + 1, np.int64), np.zeros(self.LIMIT + 1)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers that hold until the next call of room()."""
        new = list(dict.fromkeys([w for w in words if w not in self]))
        if new:
            n = len(self)
            self.update(zip(new, range(n, n + len(new)), strict=True))
            self.codes[n : len(self)] = np.fromiter(map(zlib.crc32, new), np.int64, len(new)) << 8 | cells_of(new)
            self.logs[n : len(self)] = list(map(self.known.get, new, itertools.repeat(math.nan))) if self.known else math.nan
            if len(new) == len(words):
                return np.arange(n, len(self))
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def room(self, n: int) -> None:
        """Makes room for n words more."""
        if len(self) + n > self.LIMIT:
            self.clear()
        if n > len(self.codes):
            self.codes, self.logs = np.zeros(n + 1, np.int64), np.zeros(n + 1)


def features(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For texts of coded words: buckets (a row for each feature) and cells."""
    start = np.zeros(3, np.int64)
    flat = np.concatenate([x for c in codes for x in (start, c)])
    keep = np.ones(len(flat), bool)
    at = np.cumsum([0, *[len(c) + 3 for c in codes[:-1]]])
    keep[at] = keep[at + 1] = keep[at + 2] = False
    i = np.flatnonzero(keep)
    h = (flat >> 8).astype(np.uint64)
    one, two, three = h[i - 1], h[i - 2], h[i - 3]
    # what lies before a text's start is 0
    mixed = np.stack([one, one * np.uint64(0x9E3779B97F4A7C15) ^ two, two + np.uint64(1 << 40), three + np.uint64(1 << 41)])
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - 15)).astype(np.int32), (flat[i] & 255).astype(np.int32)


#: Logits stay within this, so that exp() needs no look at the largest of each row.
STEEPEST = 40.0
_ONES = np.ones(CLASSES, np.float32)


class Model:
    """Weights of both softmaxes."""

    def __init__(self, weights: np.ndarray | None = None):
        self.w = np.zeros((2, BUCKETS, CLASSES), np.float32) if weights is None else weights

    def logits(self, buckets: np.ndarray, cells: np.ndarray):
        """For each softmax: buckets (a row for each feature), wanted output, logits, exp(logits) and their sums."""
        classes = cells // SUBCLASSES
        for level, (at, wanted) in enumerate(((buckets, classes), ((buckets * 31 + classes * 2053 + 7) & (BUCKETS - 1), cells % SUBCLASSES))):
            total = self.w[level].take(at[0], 0)
            for k in range(1, FEATURES):
                total += self.w[level].take(at[k], 0)
            np.clip(total, -STEEPEST, STEEPEST, out=total)
            z = np.exp(total)
            yield at, wanted, total, z, z @ _ONES

    def gradient(self, buckets: np.ndarray, cells: np.ndarray, sums: np.ndarray) -> None:
        """Adds to sums (by softmax, output and bucket) wanted less expected outputs, and, as a last output, how many tokens have the bucket."""
        n, weights, by_output = np.arange(len(cells)), np.empty((FEATURES, len(cells))), np.empty((CLASSES, len(cells)))
        for level, (at, wanted, _, p, total) in enumerate(self.logits(buckets, cells)):
            np.divide(p.T, -total, out=by_output)
            by_output[wanted, n] += 1
            flat = at.ravel().astype(np.intp)
            for c in range(CLASSES):
                weights[:] = by_output[c]
                sums[level, c] += np.bincount(flat, weights.ravel(), BUCKETS)
            sums[level, CLASSES] += np.bincount(flat, minlength=BUCKETS)

    def step(self, sums: np.ndarray, shares: np.ndarray) -> None:
        """Moves the weights by sums of gradient(). shares: of the outputs of each softmax."""
        variance = (shares * (1 - shares) + 0.01)[:, None, :]
        self.w = self.w + np.clip(sums[:, :, :CLASSES] / (CURVED * sums[:, :, CLASSES:] * variance + LEVELLED), -LONGEST, LONGEST).astype(np.float32)

    def scores(self, buckets: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """log10 P(class, subclass) of each token."""
        n, out = np.arange(len(cells)), np.zeros(len(cells))
        for level, (_, wanted, total, _, sums) in enumerate(self.logits(buckets, cells)):
            chosen = (total[n, wanted] - np.log(sums)) / math.log(10)
            # the end's class has one subclass
            out += chosen if level == 0 else np.where(cells == 0, 0.0, chosen)
        return out


def _coded(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """tokens_of(), with words' numbers for those of the distinct words between."""
    numbers, bounds, distinct = tokens_of(texts)
    words.room(len(distinct))
    return numbers, bounds, words.numbers(distinct.to_numpy(zero_copy_only=False).tolist()), distinct


def _batches(texts: pa.Array, words: Words):
    """Codes of texts in groups of about BATCH tokens; a long text is cut."""
    numbers, bounds, own, _ = _coded(texts, words)
    codes = words.codes[own][numbers]
    held, n = [], 0
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        for k in range(i, j, BATCH):
            held.append(codes[k : min(j, k + BATCH)])
            n += len(held[-1])
            if n >= BATCH:
                yield held
                held, n = [], 0
    if held:
        yield held


def trained(docs: DataFrame, shares: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights, from docs (doc_id, text). shares: of the outputs of each softmax."""
    spark, model = docs.sparkSession, Model()
    dealt = docs.withColumn("round", F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)))
    # what each task sends has a fixed size, so there are no more of them than keep all cores busy
    tasks = max(1, min(docs.rdd.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism))
    groups = max(1, math.isqrt(tasks))
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(model.w)  # of a fixed size

        def run(batches, sent=sent):
            own, words, sums, n = Model(sent.value), Words(), np.zeros((2, CLASSES + 1, BUCKETS)), 0
            for batch in sliced(batches, "text", SLICE):
                for codes in _batches(batch.column("text"), words):
                    buckets, cells = features(codes)
                    for i in range(0, len(cells), BATCH):
                        own.gradient(buckets[:, i : i + BATCH], cells[i : i + BATCH], sums)
                    n += len(cells)
            if n:
                flat, task = sums.transpose(0, 2, 1).astype(np.float32).reshape(-1, BLOCK), TaskContext.get().partitionId()
                yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(flat)), pa.int32()), "part": pa.array([task % groups] * len(flat), pa.int32()), "sums": pa.array([x.tobytes() for x in flat], pa.binary())})

        def total(group: pd.DataFrame) -> pd.DataFrame:
            own = np.zeros(BLOCK)
            for x in group["sums"]:
                own += np.frombuffer(x, np.float32)
            return pd.DataFrame({"block": group["block"].iloc[:1], "part": group["part"].iloc[:1], "sums": [own.astype(np.float32).tobytes()]})

        schema = "block int, part int, sums binary"
        texts = dealt.where(F.col("round") == k).select("text").coalesce(tasks)
        summed = texts.mapInArrow(run, schema).groupBy("block", "part").applyInPandas(total, schema).groupBy("block").applyInPandas(total, schema)
        rows = written(summed, "gradient").orderBy("block").collect()  # of a fixed size
        if rows:
            model.step(np.concatenate([np.frombuffer(r.sums, np.float32) for r in rows]).reshape(2, BUCKETS, CLASSES + 1).astype(np.float64), shares)
        sent.destroy()
    return model.w


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), n, cell, from docs (text). Tasks sum up what they read first."""

    def run(batches):
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        for batch in sliced(batches, "text", SLICE):
            numbers, _, words = tokens_of(batch.column("text"))
            held.append(pa.table({"word": words, "n": np.bincount(numbers, minlength=len(words))}))
            if sum(map(len, held)) > 1_000_000:
                held = [summed()]
                if len(held[0]) > 500_000:
                    yield from held[0].to_batches()
                    held = []
        if held:
            yield from summed().to_batches()

    sums = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))

    @F.pandas_udf(T.IntegerType())
    def cells(words: pd.Series) -> pd.Series:
        return pd.Series(cells_of([bytes(w) for w in words]), words.index)

    return sums.withColumn("cell", cells("word"))


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The words (of counts) of the greatest counts, at most `most`: all that have more than some bound."""
    octave = F.floor(F.log2("n") * 8).cast("int")
    bins = counts.groupBy(octave.alias("bin")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("bin")).collect()  # some hundreds at most
    total, least = 0, 1 << 30
    for r in bins:
        total += r.k
        if total > most:
            break
        least = r.bin
    return counts.where(octave >= least).select("word", "n")


def scored(docs: DataFrame, rounds: int = ROUNDS, most_known: int = MOST_KNOWN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    learn = rows.where(training("doc_id"))
    counts = written(word_counts(learn), "word-counts")
    sums = counts.groupBy("cell").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()  # a row for each cell
    total, distinct = sum(r.n for r in sums), sum(r.v for r in sums)
    room = np.full(CLASSES * SUBCLASSES, SMOOTHING)
    for r in sums:
        room[r.cell] = r.n + SMOOTHING * (r.v + (r.cell != 0))  # no end is unseen
    base_room = total + SMOOTHING * (distinct + 1)
    known = {bytes(r.word): math.log10(r.n + SMOOTHING) for r in most_frequent(counts, most_known).collect()}
    shares = np.zeros((2, CLASSES))
    for r in sums:
        shares[0, r.cell // SUBCLASSES] += r.n / total
        shares[1, r.cell % SUBCLASSES] += r.n / total
    weights = trained(learn, shares, rounds)
    sent = spark.sparkContext.broadcast((weights, known))
    log_room, log_base = np.log10(room), math.log10(base_room)

    def run(batches):
        weights, known = sent.value
        model, words = Model(weights), Words(known)
        for batch in sliced(batches, "text", SLICE):
            numbers, bounds, own, distinct = _coded(batch.column("text"), words)
            codes, logs = words.codes[own], words.logs[own]
            known_ones = ~np.isnan(logs)
            logs[~known_ones] = 0
            for i, j in _parts(np.diff(bounds)):
                first, last = bounds[i], bounds[j]
                some, at = numbers[first:last], bounds[i : j + 1] - first
                buckets, cells = features([codes[some[x:y]] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                token = np.concatenate([model.scores(buckets[:, x : x + BATCH], cells[x : x + BATCH]) for x in range(0, len(cells), BATCH)]) - log_room[cells]
                found = known_ones[some]
                # words without a logarithm: each once for each text, with how often it comes
                rare = np.flatnonzero(~found)
                pairs, times = np.unique((np.searchsorted(at, rare, "right") - 1) * len(distinct) + some[rare], return_counts=True)
                entries = pa.StructArray.from_arrays([distinct.take(pa.array(pairs % len(distinct))), pa.array(times)], ["word", "tf"])
                entries = pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs, np.arange(j - i + 1) * len(distinct)), pa.int32()), entries)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(at)), *(pa.array(np.add.reduceat(x, at[:-1])) for x in (found.astype(np.int64), logs[some], token)), entries],
                    ["doc_id", "n_tokens", "n_found", "found", "cells", "rare"],
                )

    schema = "doc_id long, n_tokens long, n_found long, found double, cells double, rare array<struct<word: binary, tf: bigint>>"
    # rows get a key of their own, since rows may be equal; it is written with them
    first = written(rows.mapInArrow(run, schema).withColumn("_row", F.expr("uuid()")), "scores")
    rare = first.select("_row", F.explode("rare").alias("r")).select("_row", "r.word", "r.tf")
    n = F.coalesce("n", F.lit(0))
    looked = rare.join(counts.select("word", "n"), "word", "left")
    more = looked.groupBy("_row").agg(F.sum(F.col("tf") * F.log10(n + F.lit(SMOOTHING))).alias("more"), F.sum(F.when(n > 0, F.col("tf")).otherwise(0)).alias("more_known"))
    out = first.drop("rare").join(more, "_row", "left")
    words = F.col("found") + F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", (~training("doc_id")).alias("held_out"), "n_tokens", (F.col("n_found") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (words - F.col("n_tokens") * F.lit(log_base)).alias("base_score"), (words + F.col("cells")).alias("score"),
    )


def _parts(sizes: np.ndarray, most: int = 1 << 16):
    """Bounds of runs of texts of about `most` tokens."""
    start = n = 0
    for i, x in enumerate(sizes.tolist()):
        if i > start and n + x > most:
            yield start, i
            start, n = i, 0
        n += x
    if start < len(sizes):
        yield start, len(sizes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
