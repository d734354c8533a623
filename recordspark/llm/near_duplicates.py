"""Operator 6: near duplicates by weighted minwise darts.

A text is the set of its five-word shingles (all its words, if it has fewer), each of weight 1, however often it comes:
that is the measure that links are decided by. Each shingle throws darts, hashed from the shingle alone, into its region
of weight and rank; a dart that falls within the shingle's weight counts, at a coordinate that is hashed too. The
earliest dart of each coordinate is the text's signature there: two texts agree at a coordinate as often as their
Jaccard similarity has it (the weighted one, were there other weights). Only so many darts are thrown as fill the
coordinates, however long the text.

Bands of the signature give buckets. Texts of equal words are one class. A class is compared with the least class of its
buckets first. Where a bucket then still holds several groups, its residual classes (those outside its largest group)
meet all its other classes in blocks: signatures tell which classes have a partner to be looked at, only those bring
their texts, and a block gives the links that join its groups, never its pairs. A pair meets in the first band that it
has in common. A pair is linked if the Jaccard similarity of its shingle sets, counted on the whole texts, is 0.8 or
more; within a group that is joined already no pair needs a look.

Null texts and texts without words are in no group. Rows of equal doc_id are one document for the query, whose texts may
join groups; a row without doc_id is in no group there. The stage goes by rows: of equal rows and of rows without
doc_id, too, one of each group stays. Columns other than doc_id and text don't matter. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordspark.llm.common import Steps, sliced, whole_row
from recordspark.llm.components import components

SHINGLE, SIMILARITY = 5, (4, 5)
BANDS, ROWS = 24, 5
COORDINATES = BANDS * ROWS
#: Of pairs of SIMILARITY, fewer than five in a million have signatures that agree at a lesser share (binomial tail).
FAR = 0.6
BLOCK = 1024
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (public constants of splitmix64)"""
    x = x + U(0x9E3779B97F4A7C15)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class WordHashes(dict):
    """word -> 64-bit hash, kept for words that come again"""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingle_sets(texts: list[list[bytes]], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Of texts (their words): the distinct shingle hashes of each, sorted, one text after the other, and how many each has."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ids = np.fromiter((hashes[w] for words in texts for w in words), U, int(sizes.sum()))
    five = np.full(max(0, len(ids) - SHINGLE + 1), SHINGLE, U)
    for k in range(SHINGLE):
        five = mix(five * U(31) + ids[k : k + len(five)])
    sets, start = [], 0
    for n in sizes.tolist():
        if n >= SHINGLE:
            own = np.sort(five[start : start + n - SHINGLE + 1])
        else:
            own = np.full(min(n, 1), n, U)
            for k in range(n):
                own = mix(own * U(31) + ids[start + k])
        if len(own) > 1:
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        sets.append(own)
        start += n
    return np.concatenate(sets) if sets else np.empty(0, U), np.fromiter(map(len, sets), np.int64, len(sets))


def signatures(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """For texts of so many elements each (one at least): the earliest dart at each of k coordinates."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    strips = np.ceil(weights).astype(np.int64)
    element = np.repeat(np.arange(len(elements)), strips)
    strip = np.arange(len(element)) - np.repeat(np.cumsum(strips) - strips, strips)
    seeds = mix(elements[element] ^ mix(strip.astype(U)))
    room, owners = weights[element] - strip, owner[element]
    out, left = np.zeros((len(sizes), k), U), np.arange(len(sizes))
    reach = k * (math.log(k) + 2) / np.bincount(owner, weights, len(sizes))
    while len(left):
        state, own, ahead, rank = seeds, owners, room, np.zeros(len(seeds))
        darts, ranks, at = [], [], []
        while len(state):
            # arrival times of a Poisson process along each strip's rank axis
            state = mix(state)
            rank = rank - np.log(((state >> U(11)).astype(np.float64) + 0.5) / (1 << 53))
            near = rank <= reach[own]
            state, rank, own, ahead = state[near], rank[near], own[near], ahead[near]
            dart = mix(state ^ U(0xD1B54A32D192ED03))
            inside = (ahead >= 1) | ((mix(dart) >> U(11)).astype(np.float64) / (1 << 53) < ahead)
            darts.append(dart[inside])
            ranks.append(rank[inside])
            at.append(own[inside] * k + (dart[inside] % U(k)).astype(np.int64))
        dart, rank, where = np.concatenate(darts), np.concatenate(ranks), np.concatenate(at)
        first = np.full(len(sizes) * k, np.inf)
        np.minimum.at(first, where, rank)
        won = rank == first[where]
        signs = np.zeros(len(first), U)
        signs[where[won]] = dart[won]
        full = np.isfinite(first).reshape(-1, k).all(1)
        done = left[full[left]]
        out[done] = signs.reshape(-1, k)[done]
        # the others throw more darts
        left = left[~full[left]]
        reach *= 2
        again = np.isin(owners, left)
        seeds, owners, room = seeds[again], owners[again], room[again]
    return out


def bands(signs: np.ndarray) -> np.ndarray:
    """Bucket numbers: a row for each text."""
    rows = signs.reshape(len(signs), BANDS, ROWS)
    out = np.tile(np.arange(BANDS).astype(U), (len(signs), 1))
    for i in range(ROWS):
        out = mix(out * U(31) + rows[:, :, i])
    return out


def keyed(docs: DataFrame, steps: Steps) -> DataFrame:
    """docs (doc_id, text, and any others) with node: doc_id, or where a doc_id has several texts or is null, a number of the text far below zero."""
    texts = docs.select(F.col("doc_id").alias("_several"), F.xxhash64("text").alias("x")).where("_several is not null")
    several = steps.write("several-texts", texts.groupBy("_several").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo < hi").select("_several"))
    odd = F.lit(-(1 << 62)) - F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 61))
    rows = docs.join(several, F.col("doc_id") == F.col("_several"), "left")
    return rows.withColumn("node", F.when(F.col("doc_id").isNotNull() & F.col("_several").isNull(), F.col("doc_id")).otherwise(odd)).drop("_several")


SIGNED = "doc_id long, node long, digest binary, bands array<long>, sketch binary"


def signed(rows: DataFrame) -> DataFrame:
    """SIGNED for each row of rows (doc_id, node, text) that has words; digest is the words'."""

    def run(batches):
        hashes = WordHashes()
        for batch in sliced(batches, "text", 1_000_000):
            texts = [(x or b"").split() for x in batch.column("text").cast(pa.binary()).to_pylist()]
            some = [i for i, words in enumerate(texts) if words]
            if not some:
                continue
            texts = [texts[i] for i in some]
            digests = [hashlib.blake2b(b" ".join(words), digest_size=16).digest() for words in texts]
            elements, sizes = shingle_sets(texts, hashes)
            signs = signatures(elements, np.ones(len(elements)), sizes)
            sketch = (signs >> U(32)).astype("<u4")
            buckets = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(bands(signs).view(np.int64).ravel()))
            own = batch.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("node"), pa.array(digests, pa.binary()), buckets, pa.array([x.tobytes() for x in sketch], pa.binary())], ["doc_id", "node", "digest", "bands", "sketch"])

    return rows.select("doc_id", "node", "text").mapInArrow(run, SIGNED)


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDINATES)


@F.arrow_udf(T.DoubleType())
def _likeness(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array((_sketches(a) == _sketches(b)).mean(axis=1), pa.float64())


def alike(common, a, b):
    """Are sets of a and b elements, so many in common, similar?"""
    return SIMILARITY[1] * common >= SIMILARITY[0] * (a + b - common)


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose shingle sets are similar. texts: node, text, a row for each node. Texts stream past the
    text that they are compared with; one that many are compared with is there in as many copies as keep its groups at BLOCK texts."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("groups"))
    heads = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.col("a").alias("node"), F.lit(0).alias("member"))
    members = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("g"), F.col("b").alias("node"), F.lit(1).alias("member"))
    rows = heads.union(members).join(texts, "node")

    def run(batches):
        hashes, key, head = WordHashes(), None, np.empty(0, U)
        for batch in sliced(batches, "text", 1_000_000):
            found, start = [], 0
            flat, sizes = shingle_sets([x.split() for x in batch.column("text").cast(pa.binary()).to_pylist()], hashes)
            for a, g, node, member, n in zip(*(batch.column(c).to_pylist() for c in ("a", "g", "node", "member")), sizes.tolist(), strict=True):
                own = flat[start : start + n]
                start += n
                if not member:
                    key, head = (a, g), own.copy()
                elif key == (a, g):
                    at = np.searchsorted(head, own)
                    at[at == len(head)] = 0
                    if alike(int((head[at] == own).sum()), len(head), n):
                        found.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.repartition("a", "g").sortWithinPartitions("a", "g", "member").select("a", "g", "node", "member", "text").mapInArrow(run, "a long, b long")


def _grouped(batches, keys: tuple[str, ...]):
    """Batches that are sorted by keys, as a table for each group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((cols[:, 1:] != cols[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(cols[:, i].tolist())
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def candidates(sketch: np.ndarray, label: np.ndarray, residual: np.ndarray, member: np.ndarray, node: np.ndarray, band: int):
    """Pairs (row of a residual class, row of a member, share of agreement) of different groups that aren't far apart and
    have no band in common before this one. A pair of residual classes is given once."""
    res, mem = np.flatnonzero(residual), np.flatnonzero(member)
    twin = np.isin(node[mem], node[res])
    for s in range(0, len(res), step := max(1, (1 << 15) // max(1, len(mem)))):
        i = res[s : s + step]
        equal = sketch[i][:, None, :] == sketch[mem][None, :, :]
        share = equal.mean(2)
        fit = (share >= FAR) & (label[i][:, None] != label[mem][None]) & ~(twin[None] & (node[i][:, None] > node[mem][None]))
        x, y = np.nonzero(fit)
        if len(x):
            first = equal[x, y].reshape(-1, BANDS, ROWS).all(2).argmax(1) == band
            yield i[x[first]], mem[y[first]], share[x[first], y[first]]


BLOCK_KEYS = ("band", "bucket", "g", "k")
FLAGGED = "band int, bucket long, g int, k int, node long, label long, residual boolean, member boolean"


def flagged(parts: DataFrame) -> DataFrame:
    """FLAGGED: rows of a block that have a partner to be looked at. parts: FLAGGED and sketch."""
    names = [x.split()[0] for x in FLAGGED.split(", ")]

    def run(batches):
        for t in _grouped(batches, BLOCK_KEYS):
            sketch = _sketches(t.column("sketch"))
            label, residual, member, node = (t.column(c).to_numpy() for c in ("label", "residual", "member", "node"))
            rows = [np.concatenate([i, j]) for i, j, _ in candidates(sketch, label, residual, member, node, t.column("band")[0].as_py())]
            if rows:
                yield from t.take(pa.array(np.unique(np.concatenate(rows)))).select(names).to_batches()

    return parts.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS).mapInArrow(run, FLAGGED)


def joined_groups(parts: DataFrame) -> DataFrame:
    """a, b: links that join the groups of a block as all its links do. parts: FLAGGED, sketch and text of flagged rows."""

    def run(batches):
        hashes = WordHashes()
        for t in _grouped(batches, BLOCK_KEYS):
            label, residual, member, node = (t.column(c).to_numpy() for c in ("label", "residual", "member", "node"))
            flat, sizes = shingle_sets([x.as_py().split() for x in t.column("text").cast(pa.binary())], hashes)
            ends = np.cumsum(sizes)
            number = np.unique(flat, return_inverse=True)[1]
            sets = np.split(number, ends[:-1])
            mark = np.zeros(int(number.max()) + 1, bool)
            at = np.unique(label, return_inverse=True)[1].tolist()
            above = list(range(len(at)))

            def root(i, above=above):
                while above[i] != i:
                    above[i] = i = above[above[i]]
                return i

            found = []
            for i, j, share in candidates(_sketches(t.column("sketch")), label, residual, member, node, t.column("band")[0].as_py()):
                for x in np.unique(i).tolist():
                    mine = i == x
                    partners = j[mine][np.argsort(-share[mine], kind="stable")]
                    mark[sets[x]] = True
                    for s in range(0, len(partners), 64):
                        some = [y for y in partners[s : s + 64].tolist() if root(at[y]) != root(at[x])]
                        if not some:
                            continue
                        n = sizes[some]
                        common = np.add.reduceat(mark[np.concatenate([sets[y] for y in some])], np.cumsum(n) - n)
                        for y in np.array(some)[alike(common, n, sizes[x])].tolist():
                            if (p := root(at[x])) != (q := root(at[y])):
                                above[max(p, q)] = min(p, q)
                                found.append((node[x], node[y]))
                    mark[sets[x]] = False
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    names = [x.split()[0] for x in FLAGGED.split(", ")]
    return parts.repartition(*BLOCK_KEYS).sortWithinPartitions(*BLOCK_KEYS).select(*names, "sketch", "text").mapInArrow(run, "a long, b long")


def residual_blocks(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """FLAGGED for the blocks of those buckets (rows: band, bucket, node) that hold several groups (labels: node, label)."""
    labelled = rows.join(labels, "node", "left").select("band", "bucket", "node", F.coalesce("label", "node").alias("label"))
    sizes = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    opened = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    opened = opened.select("bucket", F.col("top.label").alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("ks"), F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("gs"))
    own = labelled.join(opened, "bucket").withColumn("residual", F.col("label") != F.col("main"))
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # a class is a member of one block of each g and, if it is residual, one of group g in each block
    as_member = F.transform(each("gs"), lambda g: F.struct(g.alias("g"), deal("ks").alias("k"), F.lit(True).alias("member"), (F.col("residual") & (g == deal("gs"))).alias("residual")))
    as_residual = F.transform(F.filter(each("ks"), lambda k: F.col("residual") & (k != deal("ks"))), lambda k: F.struct(deal("gs").alias("g"), k.alias("k"), F.lit(False).alias("member"), F.lit(True).alias("residual")))
    return own.select("band", "bucket", "node", "label", F.explode(F.concat(as_member, as_residual)).alias("p")).select("band", "bucket", "p.g", "p.k", "node", "label", "p.residual", "p.member")


def groups(docs: DataFrame, steps: Steps) -> DataFrame:
    """doc_id, node, label for each distinct row of docs (doc_id, node, text) that has words: rows of equal label are near duplicates, directly or by others."""
    signs = steps.write("signatures", signed(docs))
    classes = steps.write("classes", signs.groupBy("digest").agg(F.min("node").alias("rep")))
    members = steps.write("members", signs.select("doc_id", "node", "digest").join(classes, "digest").select("doc_id", "node", "rep").distinct())
    # a node has one text, so its digest is given by it
    reps = signs.join(classes.select(F.col("rep").alias("node")), "node", "left_semi").dropDuplicates(["node"])
    reps = steps.write("representatives", reps.select("node", "bands", "sketch"))
    steps.drop("signatures", "classes")
    rows = reps.select("node", F.posexplode("bands").alias("band", "bucket"))
    buckets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("head")).where("n > 1").drop("n")
    rows = steps.write("buckets", rows.join(buckets, "bucket").select("band", "bucket", "node", "head"))
    # what shares no bucket is done with; ids and texts are dealt alike at any size
    shared = rows.select("node").distinct().hint("merge")
    sketches = steps.write("sketches", reps.select("node", "sketch").join(shared, "node", "left_semi"))
    texts = steps.write("texts", docs.select("node", "text").where("text is not null").join(shared, "node", "left_semi").dropDuplicates(["node"]))
    steps.drop("representatives")
    likely = rows.where("node <> head").select("node", "head").distinct()
    likely = likely.join(sketches, "node").join(sketches.toDF("head", "head_sketch"), "head").where(_likeness("sketch", "head_sketch") >= FAR)
    pairs = steps.write("pairs", likely.groupBy("node").agg(F.min("head").alias("a")).select("a", F.col("node").alias("b")))
    links = steps.write("links", similar(pairs, texts))
    # heads may be linked to heads: two jumps join most of what belongs together, and the end joins all
    labels = links.select(F.col("b").alias("node"), F.col("a").alias("label"))
    for _ in range(2):
        labels = labels.join(labels.toDF("label", "further"), "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    labels = steps.write("labels", labels)
    parts = residual_blocks(rows, labels).join(sketches, "node")
    some = steps.write("flagged", flagged(parts))
    steps.drop("buckets", "labels", "pairs")
    more = steps.write("more-links", joined_groups(some.join(sketches, "node").join(texts, "node")))
    steps.drop("flagged", "sketches", "texts")
    # the texts of one doc_id belong together
    spread = members.where("doc_id <> node").groupBy("doc_id").agg(F.min("rep").alias("a"))
    spread = members.where("doc_id <> node").join(spread, "doc_id").select("a", F.col("rep").alias("b"))
    comps = components(links.union(more).union(spread))
    out = members.join(comps, F.col("rep") == comps["node"], "left").select("doc_id", members["node"], F.coalesce("component", "rep").alias("label"))
    return steps.write("groups", out)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, component_id (the least doc_id of its group), kept (doc_id = component_id), a row for each doc_id that isn't null."""
    steps = Steps(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    found = groups(keyed(known, steps), steps)
    least = found.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    ids = found.join(least, "label").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = known.select("doc_id").distinct().join(ids, "doc_id", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: one with the least doc_id, of several such rows any one. Rows without words stay."""
    steps = Steps(spark)
    rows = keyed(docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("doc_id"), "text"), steps)
    found = groups(rows.select("doc_id", "node", "text"), steps)
    best = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("best"))
    gone = steps.write("dropped", found.join(best, "label").where("node <> best.node").select(F.col("node").alias("gone")).distinct())
    left = rows.join(gone, F.col("node") == F.col("gone"), "left_anti")
    again = rows.where(F.length("text") > 0).groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("node").alias("copied"))
    again = steps.write("copied", again.join(found, F.col("copied") == F.col("node"), "left_semi"))
    once = left.join(again, F.col("node") == F.col("copied"), "left_semi").dropDuplicates(["node"])
    return left.join(again, F.col("node") == F.col("copied"), "left_anti").unionByName(once).select("row.*")
