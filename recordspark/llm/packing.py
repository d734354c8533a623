"""Operator 9: documents packed into sequences of bounded length with balanced attention cost.

A piece of n tokens costs a*n + b*n*n (attention stays within a piece). Documents of a full sequence's length or more
are cut into full sequences and a rest. The rests of a block of documents go, in descending length, each to the
lowest-cost sequence with room for it; a rest that fits nowhere is cut over the sequences with room, lowest cost first.
A block has just as many sequences as its tokens need, so at most one sequence's worth of padding.

A block is what one task reads in a row, up to a fixed number of tokens: no shuffle, bounded memory, and the same plan at
any size. Null and empty texts hold the end id alone. Equal rows are packed as rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordspark.llm.common import sliced
from recordspark.llm.tokens import SLICE, encoder

LINEAR, QUADRATIC = 1.0, 1.0 / 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for documents of these lengths."""
    lengths = np.asarray(lengths, dtype=np.int64)
    out, full = [], lengths // capacity
    sequence = 0
    for i in np.flatnonzero(full).tolist():
        for k in range(int(full[i])):
            out.append((i, k * capacity, capacity, sequence, 0))
            sequence += 1
    rests = lengths - full * capacity
    count = -(-int(rests.sum()) // capacity)
    used, cost = np.zeros(count, np.int64), np.zeros(count)

    def put(i: int, start: int, n: int, s: int) -> None:
        out.append((i, start, n, sequence + s, int(used[s])))
        used[s] += n
        cost[s] += LINEAR * n + QUADRATIC * n * n

    for i in np.argsort(-rests, kind="stable").tolist():
        n, start = int(rests[i]), int(full[i]) * capacity
        if not n:
            break
        fit = np.where(used <= capacity - n, cost, np.inf)
        if np.isfinite(fit[s := int(fit.argmin())]):
            put(i, start, n, s)
            continue
        for s in np.argsort(np.where(used < capacity, cost, np.inf), kind="stable").tolist():
            take = min(n, capacity - int(used[s]))
            put(i, start, take, s)
            start, n = start + take, n - take
            if not n:
                break
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, block_tokens: int = 2_000_000, with_ids: bool = False, slice_bytes: int = SLICE) -> DataFrame:
    """A row for each piece of docs (doc_id, text); `ids` (32-bit, little-endian) too if asked for. slice_bytes: of texts encoded at once."""

    def block(keys, texts, task, number, own):
        ends = np.array([end_id], dtype=f"<u{own.width}").tobytes()
        ids = [np.frombuffer(x + ends, f"<u{own.width}").astype("<u4") for x in texts]
        plan = pack(np.array([len(x) for x in ids]), capacity)
        rows = [(keys[d], start, n, zlib.crc32(part := ids[d][start : start + n].tobytes()), len(ids[d]), number + s, at, *([part] if with_ids else [])) for d, start, n, s, at in plan]
        kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
        names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names), max(x[3] for x in plan) + 1

    def run(batches):
        own, task = encoder(tokenizer), TaskContext.get().partitionId()
        number = task << 36
        keys, texts, held = [], [], 0
        for batch in sliced(batches, "text", slice_bytes):
            ids = own.encode(batch.column("text"))
            keys, texts, held = keys + batch.column("doc_id").to_pylist(), texts + ids, held + sum(map(len, ids)) // own.width + len(ids)
            if held >= block_tokens:
                out, n = block(keys, texts, task, number, own)
                number, keys, texts, held = number + n, [], [], 0
                yield out
        if keys:
            yield block(keys, texts, task, number, own)[0]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA + ", ids binary" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
