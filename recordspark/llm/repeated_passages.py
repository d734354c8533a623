"""Operator 10: passages that documents share, found by suffix arrays of shards and removed from all but the first.

A byte goes if a string of `least` bytes that covers it also starts in a document with a smaller doc_id. Each such string
(a window) has an anchor: the least hash of the strings of ANCHOR bytes in it. What anchor a window has depends on the
window alone, so all equal windows have one anchor. A place is a run of windows of a document with one anchor; the bytes
that they cover are its stretch.

1. Documents are gathered in chunks of CHUNK bytes (one document, if it is longer), with which all goes on.
2. Chunks send the distinct hashes of their anchors, five bytes each, to parts of the range of hashes, and learn which of
   them another document may have too. (A hash's head may be another one's: such a place is just looked at.)
3. The places of these anchors meet by anchor, a row for each stretch and chunk, and are told apart by hashes of their
   stretches. Equal stretches are one, with the least doc_id; so a passage that very many documents have is a row a chunk.
   An anchor at a passage's edge has a stretch for each surroundings: its rows are sorted in one task, which may spill.
4. An anchor with a single stretch is settled: each of its windows has the stretch's least doc_id. The stretches of
   other anchors come to shards, once each. Those without a window whose hash comes again in the shard have nothing to
   share; the others get a suffix array by induced sorting and the permuted common prefixes (suffix_arrays.py); neighbours in it that share `least` bytes are equal windows, and the least doc_id among
   them is the window's. Anchors with more stretches than a shard should hold are dealt over several shards, whose
   windows' least doc_ids are merged by a further aggregation.
5. Places get their windows' least doc_ids back, and chunks lose what windows of smaller doc_ids cover.

Texts are their UTF-8 bytes; null counts as empty. Rows of equal doc_id don't take from each other. A row without doc_id
neither loses nor takes anything. Equal rows stay rows of their own. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordspark.llm.common import Steps, sliced
from recordspark.llm.suffix_arrays import permuted_common, suffix_array

LEAST, ANCHOR = 50, 24
#: Bytes of text in a chunk, and for each part of the range of hashes.
CHUNK, PART = 2_000_000, 8_000_000
#: Bytes of stretches that a shard should hold, and stretches of an anchor beyond which it is dealt over shards.
SHARD_BYTES, SHARD_STRETCHES = 400_000, 3_000
#: Windows of a place at most: a longer run is several places.
RUN = 32
#: Bits of a hash that are compared within a part.
BITS = 39
U = np.uint64
#: The first so many bytes of a little-endian number.
FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def _mix(x: np.ndarray) -> np.ndarray:
    """Mixes x, a new array, in place."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _words(a: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a little-endian number: a view of a, which lies in one piece."""
    return np.ndarray((max(0, len(a) - 7),), "<u8", a, strides=(1,))


#: Windows that are hashed at once, so that what one step leaves is near for the next.
NEAR = 1 << 14


def _least_hashes(a: np.ndarray, least: int) -> np.ndarray:
    """For each window of `least` bytes: the least hash of the strings of ANCHOR bytes in it."""
    width, out = least - ANCHOR + 1, np.empty(len(a) - least + 1, U)
    for s in range(0, len(out), NEAR):
        words = _words(a[s : s + NEAR + least - 1]).astype(U)
        m = len(words) - ANCHOR + 8
        low = _mix(_mix(_mix(words[:m].copy()) ^ words[8 : 8 + m]) * U(0x9E3779B97F4A7C15) ^ words[16 : 16 + m])
        size = 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if width > size:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        out[s : s + len(low)] = low
    return out


def anchors(a: np.ndarray, ends: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of texts that lie one after the other in a: the anchor's hash, the first window, the number of windows."""
    none = np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    if len(a) < least:
        return none
    low = _least_hashes(a, least)
    k = len(low)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    first = np.union1d(first, ends[ends < k])  # a text's first window opens a place
    last = ends[np.searchsorted(ends, first, "right")] - least + 1
    stop = np.minimum(np.append(first[1:], k), last)
    some = stop > first
    first, stop = first[some], stop[some]
    pieces = -(-(stop - first) // RUN)
    at = np.repeat(first, pieces) + RUN * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return low[at], at, np.minimum(RUN, np.repeat(stop, pieces) - at)


def stretch_keys(a: np.ndarray, at: np.ndarray, n: np.ndarray, least: int) -> np.ndarray:
    """A hash of the bytes that each place covers."""
    width = -(-(RUN - 1 + least) // 8) * 8
    words, out = _words(np.concatenate([a, np.zeros(width, np.uint8)])), np.empty(len(at), U)
    for s in range(0, len(at), NEAR):
        here, size = at[s : s + NEAR], n[s : s + NEAR] - 1 + least
        h = size.astype(U)
        for i in range(0, width, 8):
            h = _mix(h * U(0x9E3779B97F4A7C15) ^ words[here + i] & FIRST[np.clip(size - i, 0, 8)])
        out[s : s + len(here)] = h
    return out


CHUNKS = "chunk long, docs binary, ends binary, text binary"


def chunks(docs: DataFrame) -> DataFrame:
    """CHUNKS: doc_ids and known (1, or 0 for null) of the documents, where their texts end, and the texts, compressed."""

    def run(batches):
        pack, number = zstandard.ZstdCompressor(level=3).compress, TaskContext.get().partitionId() << 32
        for batch in sliced(batches, "text", CHUNK):
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            ids = batch.column("doc_id")
            docs = np.stack([pc.fill_null(ids, 0).to_numpy(), pc.is_valid(ids).to_numpy(zero_copy_only=False).astype(np.int64)])
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int64()), "docs": pa.array([docs.tobytes()], pa.binary()), "ends": pa.array([ends.tobytes()], pa.binary()), "text": pa.array([pack(b"".join(texts))], pa.binary())})
            number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CHUNKS)


class Chunk:
    """A chunk with its texts unpacked."""

    def __init__(self, row: dict):
        self.number = row["chunk"]
        self.docs, self.known = np.frombuffer(row["docs"], np.int64).reshape(2, -1)
        self.ends = np.frombuffer(row["ends"], np.int64)
        # an empty frame holds no size
        self.text = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"]) if self.ends[-1] else b"", np.uint8)

    def places(self, least: int):
        """Hash, first window, number of windows and document (its place in the chunk) of each place of the documents that have a doc_id, sorted by hash."""
        h, at, n = anchors(self.text, self.ends, least)
        owner = np.searchsorted(self.ends, at, "right")
        order = np.argsort(h)
        order = order[self.known[owner[order]] == 1]
        return h[order], at[order], n[order], owner[order]


def _heads(h: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))


def _sent(h: np.ndarray, doc: np.ndarray, log_parts: int):
    """Of sorted hashes: the part and value (BITS of the hash, and whether several doc_ids have it) of each distinct one, and its places' number."""
    heads = _heads(h)
    several = np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads)
    own = h[heads]
    value = (own >> U(64 - log_parts - BITS) & U((1 << BITS) - 1)) << U(1) | several.astype(U)
    return (own >> U(64 - log_parts)).astype(np.int64), value, np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(h))))


def asked(parts: DataFrame, log_parts: int, least: int) -> DataFrame:
    """part, chunk, values (five bytes each) of the chunks' anchors."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = Chunk(row)
                h, _, _, owner = own.places(least)
                if not len(h):
                    continue
                part, value, _ = _sent(h, own.docs[owner], log_parts)
                raw = value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                heads = _heads(part)
                cuts = (np.append(heads, len(part)) * 5).tolist()
                yield pa.RecordBatch.from_pydict({"part": pa.array(part[heads], pa.int32()), "chunk": pa.array([own.number] * len(heads), pa.int64()), "values": pa.array([raw[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    return parts.mapInArrow(run, "part int, chunk long, values binary")


def answered(questions: DataFrame) -> DataFrame:
    """part, chunk, bits: which of the values that a chunk asked for are shared; no row where none is."""

    def run(batches):
        part, rows = None, []

        def answers():
            sizes = np.array([len(v) // 5 for _, v in rows])
            raw = np.zeros((int(sizes.sum()), 8), np.uint8)
            raw[:, :5] = np.frombuffer(b"".join(v for _, v in rows), np.uint8).reshape(-1, 5)
            value = raw.view("<u8").ravel()
            order = np.argsort(value)
            own = value[order] >> U(1)
            heads = _heads(own)
            count = np.diff(np.append(heads, len(own)))
            shared = np.empty(len(value), bool)
            shared[order] = np.repeat((count > 1) | (np.maximum.reduceat(value[order] & U(1), heads) == 1), count)
            out = [(chunk, np.packbits(x).tobytes()) for (chunk, _), x in zip(rows, np.split(shared, np.cumsum(sizes)[:-1]), strict=True) if x.any()]
            return pa.RecordBatch.from_pydict({"part": pa.array([part] * len(out), pa.int32()), "chunk": pa.array([x[0] for x in out], pa.int64()), "bits": pa.array([x[1] for x in out], pa.binary())})

        for batch in batches:
            for p, chunk, values in zip(*(batch.column(c).to_pylist() for c in ("part", "chunk", "values")), strict=True):
                if p != part and rows:
                    yield answers()
                    rows = []
                part = p
                rows.append((chunk, values))
        if rows:
            yield answers()

    return questions.repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, chunk long, bits binary")


PLACES = "h long, k long, chunk long, n int, at int, lo long, hi long, places binary"


def shared_places(parts: DataFrame, answers: DataFrame, log_parts: int, least: int) -> DataFrame:
    """PLACES: a row for each stretch (k is its hash) of a chunk whose anchor is shared: how many windows, where one lies,
    least and greatest doc_id, and all its places there (32-bit: first window, document)."""

    def run(chunk: pa.Table, bits: pa.Table) -> pa.Table:
        names, kinds = [x.split()[0] for x in PLACES.split(", ")], [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.binary()]
        nothing = pa.table([pa.array([], k) for k in kinds], names)
        if not chunk.num_rows or not bits.num_rows:
            return nothing
        own = Chunk(chunk.to_pylist()[0])
        h, at, n, owner = own.places(least)
        part, value, place = _sent(h, own.docs[owner], log_parts)
        shared = np.zeros(len(value), bool)
        for p, b in zip(bits.column("part").to_pylist(), bits.column("bits").to_pylist(), strict=True):
            i, j = np.searchsorted(part, [p, p + 1])
            shared[i:j] = np.unpackbits(np.frombuffer(b, np.uint8), count=j - i).astype(bool)
        some = shared[place]
        if not some.any():
            return nothing
        h, at, n, owner = h[some], at[some], n[some], owner[some]
        k = stretch_keys(own.text, at, n, least)
        order = np.lexsort((k, h))
        h, k, at, n, owner = (x[order] for x in (h, k, at, n, owner))
        heads = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])]))
        doc = own.docs[owner]
        packed = np.stack([at, owner], 1).astype("<i4")
        offsets = pa.py_buffer((np.append(heads, len(h)) * 8).astype(np.int32))
        places = pa.Array.from_buffers(pa.binary(), len(heads), [None, offsets, pa.py_buffer(packed)])
        cols = [h[heads].view(np.int64), k[heads].view(np.int64), np.full(len(heads), own.number), n[heads], at[heads], np.minimum.reduceat(doc, heads), np.maximum.reduceat(doc, heads)]
        return pa.table([*(pa.array(x, kind) for x, kind in zip(cols, kinds, strict=False)), places], names)

    return parts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, PLACES)


def compared(places: DataFrame) -> DataFrame:
    """Those of PLACES that may lose something or are needed to tell, with lo as the least doc_id anywhere and several
    (has the anchor other stretches?); h, k, at and hi only where it has. One shuffle and one sort."""
    same, anchor = Window.partitionBy("h", "k"), Window.partitionBy("h")
    rows = places.repartition("h").withColumn("lo", F.min("lo").over(same)).withColumn("several", F.min("k").over(anchor) < F.max("k").over(anchor))
    rows = rows.where("several or lo < hi")
    return rows.select("chunk", "n", "lo", "places", "several", *(F.when(F.col("several"), F.col(c)).alias(c) for c in ("h", "k", "at", "hi")))


def stretches(contested: DataFrame) -> DataFrame:
    """h, k, lo, hi (least and greatest doc_id), chunk, at, n (of one place) of each stretch."""
    return contested.groupBy("h", "k").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("chunk").alias("chunk"), F.min_by("at", "chunk").alias("at"), F.min("n").alias("n"))


def contents(parts: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """h, k, lo, hi, bytes of wanted stretches."""

    def run(chunk: pa.Table, rows: pa.Table) -> pa.Table:
        texts = []
        if chunk.num_rows and rows.num_rows:
            text = Chunk(chunk.to_pylist()[0]).text
            texts = [text[i : i + n - 1 + least].tobytes() for i, n in zip(rows.column("at").to_pylist(), rows.column("n").to_pylist(), strict=True)]
        rows = rows.slice(0, len(texts))
        return pa.table([*(rows.column(c) for c in ("h", "k", "lo", "hi")), pa.array(texts, pa.binary())], ["h", "k", "lo", "hi", "bytes"])

    return parts.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(run, "h long, k long, lo long, hi long, bytes binary")


def candidates(texts: list[bytes], least: int) -> np.ndarray:
    """Which texts have a window of `least` bytes whose hash comes again. All others have no window that comes again."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner, i = _spread(lengths - least + 1)
    words, at = _words(np.frombuffer(b"".join(texts), np.uint8)), (np.cumsum(lengths) - lengths)[owner] + i
    h = np.zeros(len(at), U)
    for k in [*range(0, least - 8, 8), least - 8]:
        h = _mix(h * U(0x9E3779B97F4A7C15) ^ words[at + k])
    order = np.argsort(h)
    again = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    out = np.zeros(len(texts), bool)
    out[owner[order[again]]] = out[owner[order[again + 1]]] = True
    return np.flatnonzero(out)


def window_minima(texts: list[bytes], docs: np.ndarray, least: int) -> list[np.ndarray]:
    """For each text and each window of `least` bytes in it: the least of `docs` among the texts that have the window."""
    out = [np.full(len(t) - least + 1, d) for t, d in zip(texts, docs.tolist(), strict=True)]
    some = candidates(texts, least)
    if len(some):
        for i, low in zip(some.tolist(), sorted_minima([texts[i] for i in some.tolist()], docs[some], least), strict=True):
            out[i] = low
    return out


def sorted_minima(texts: list[bytes], docs: np.ndarray, least: int) -> list[np.ndarray]:
    """window_minima() by a suffix array of all texts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"\x00".join(texts), np.uint8)
    starts = np.cumsum(lengths + 1) - lengths - 1
    # characters one up, so that 0 stands for an end alone
    s = flat.astype(np.uint16) + np.uint16(1)
    s[starts[1:] - 1] = 0
    order = suffix_array(s, 257)
    owner = np.repeat(np.arange(len(texts)), lengths + 1)[: len(s)]
    inside = np.arange(len(s)) - starts[owner] + least <= lengths[owner]
    # a window of one text isn't equal to what runs over an end
    same = (permuted_common(flat, order, least)[order] >= least) & inside[order] & np.concatenate([[False], inside[order[:-1]]])
    heads = np.flatnonzero(~same)
    low = np.minimum.reduceat(docs[owner[order]], heads)
    minima = np.empty(len(s), np.int64)
    minima[order] = np.repeat(low, np.diff(np.append(heads, len(s))))
    return [minima[a : a + n - least + 1] for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]


#: Minima of a stretch's windows, as runs of equal ones.
RUNS = np.dtype([("n", "<i4"), ("low", "<i8")])


def in_runs(m: np.ndarray) -> bytes:
    heads = _heads(m)
    out = np.empty(len(heads), RUNS)
    out["n"], out["low"] = np.diff(np.append(heads, len(m))), m[heads]
    return out.tobytes()


def _shard(least: int, merged: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        texts, h, k = [bytes(x) for x in group["bytes"]], group["h"].tolist(), group["k"].tolist()
        minima = window_minima(texts, group["lo"].to_numpy(), least)
        if not merged:
            # of use only where some document has a window that a smaller one has too
            some = [(x, y, in_runs(m)) for x, y, m, hi in zip(h, k, minima, group["hi"].tolist(), strict=True) if m.min() < hi]
            return pd.DataFrame(some, columns=["h", "k", "minima"])
        rows = [(x, y, i, hashlib.blake2b(t[i : i + least], digest_size=16).digest(), m) for x, y, t, own in zip(h, k, texts, minima, strict=True) for i, m in enumerate(own.tolist())]
        return pd.DataFrame(rows, columns=["h", "k", "i", "w", "m"])

    return run


def least_documents(rows: DataFrame, least: int, shard_bytes: int, shard_stretches: int, steps: Steps) -> DataFrame:
    """h, k, minima (RUNS) of stretches (h, k, lo, hi, bytes)."""
    total = rows.agg(F.sum(F.length("bytes") + 1)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    many = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > shard_stretches)
    many = steps.write("frequent-anchors", many.select(F.col("h").alias("_h"), F.ceil(F.col("c") / shard_stretches).cast("int").alias("parts")))
    known = F.col("h") == F.col("_h")
    plain = rows.join(many, known, "left_anti").withColumn("shard", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(shards)))
    out = plain.groupBy("shard").applyInPandas(_shard(least, False), "h long, k long, minima binary")
    if many.isEmpty():
        return out
    dealt = rows.join(many, known).withColumn("part", F.pmod(F.xxhash64("k"), F.col("parts")))
    windows = steps.write("windows", dealt.groupBy("h", "part").applyInPandas(_shard(least, True), "h long, k long, i int, w binary, m long"))
    low = windows.groupBy("w").agg(F.min("m").alias("low"))
    pairs = windows.join(low, "w").groupBy("h", "k").agg(F.array_sort(F.collect_list(F.struct("i", "low"))).alias("m"))

    def packed(batches):
        for batch in batches:
            low = [in_runs(np.array([x["low"] for x in m])) for m in batch.column("m").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("k"), pa.array(low, pa.binary())], ["h", "k", "minima"])

    return out.unionByName(pairs.mapInArrow(packed, "h long, k long, minima binary"))


KEPT = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long"


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For things that come so many times each: which thing, and the how manieth time."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def covered(marks: pa.Table, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of runs that smaller documents have. marks: n, lo, places, minima; docs: doc_ids of the chunk."""
    n, lo = (marks.column(c).to_numpy().astype(np.int64) for c in ("n", "lo"))
    places, minima = (marks.column(c).to_pylist() for c in ("places", "minima"))
    # a settled stretch is one run
    runs = np.frombuffer(b"".join(b"\0" * RUNS.itemsize if x is None else x for x in minima), RUNS).copy()
    counts = np.array([1 if x is None else len(x) // RUNS.itemsize for x in minima], np.int64)
    starts = np.cumsum(counts) - counts
    settled = np.array([x is None for x in minima])
    runs["n"][starts[settled]], runs["low"][starts[settled]] = n[settled], lo[settled]
    before = np.cumsum(runs["n"].astype(np.int64)) - runs["n"]
    before -= np.repeat(before[starts], counts)
    row, _ = _spread(np.array([len(x) // 8 for x in places], np.int64))
    at, owner = np.frombuffer(b"".join(places), "<i4").reshape(-1, 2).astype(np.int64).T
    place, i = _spread(counts[row])
    run = starts[row[place]] + i
    gone = runs["low"][run] < docs[owner[place]]
    return (at[place] + before[run])[gone], runs["n"][run][gone].astype(np.int64)


def cut(chunk: Chunk, marks: pa.Table, least: int) -> pa.Table:
    """KEPT of a chunk's documents."""
    text, ends = chunk.text, chunk.ends
    starts = np.concatenate([[0], ends[:-1]])
    gone = np.zeros(len(text), bool)
    if marks.num_rows:
        at, n = covered(marks, chunk.docs)
        steps = np.bincount(at, minlength=len(text) + 1) - np.bincount(at + (n - 1 + least), minlength=len(text) + 1)
        gone = np.cumsum(steps)[: len(text)] > 0
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    opens[starts[starts < len(text)]] = gone[starts[starts < len(text)]]
    removed, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, opens))
    removed, spans = removed[ends] - removed[starts], spans[ends] - spans[starts]
    kept = [text[i:j].tobytes() if not r else text[i:j][~gone[i:j]].tobytes() for i, j, r in zip(starts.tolist(), ends.tolist(), removed.tolist(), strict=True)]
    cols = [pa.array(chunk.docs, pa.int64(), mask=chunk.known == 0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (ends - starts, removed, spans))]
    return pa.table(cols, [x.split()[0] for x in KEPT.split(", ")])


def without_repeats(docs: DataFrame, least: int = LEAST, shard_bytes: int = SHARD_BYTES, shard_stretches: int = SHARD_STRETCHES) -> DataFrame:
    """doc_id, kept (binary: what stays of the text), n_bytes, n_removed, n_spans for each row of docs (doc_id, text)."""
    if not 2 * ANCHOR - 8 <= least:
        raise ValueError(f"least must be {2 * ANCHOR - 8} or more")
    steps = Steps(docs.sparkSession)
    parts = steps.write("chunks", chunks(docs))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    log_parts = max(1, min(64 - BITS, (size // PART).bit_length()))
    answers = steps.write("answers", answered(asked(parts, log_parts, least)))
    judged = steps.write("compared", compared(shared_places(parts, answers, log_parts, least)))
    steps.drop("answers")
    contested = judged.where("several")
    texts = steps.write("contents", contents(parts, stretches(contested), least))
    low = steps.write("least-documents", least_documents(texts, least, shard_bytes, shard_stretches, steps))
    steps.drop("contents")
    settled = judged.where("not several").select("chunk", "n", "lo", "places", F.lit(None).cast("binary").alias("minima"))
    marks = settled.unionByName(contested.join(low, ["h", "k"]).select("chunk", "n", "lo", "places", "minima"))

    def run(chunk: pa.Table, own: pa.Table) -> pa.Table:
        return pa.concat_tables([cut(Chunk(row), own, least) for row in chunk.to_pylist()])

    return parts.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(run, KEPT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
