"""Operator 3: token ids in flat binary files.

A folder holds, for each partition, `.bin` (ids, little-endian unsigned 16 or 32 bits), `.idx` (64-bit offsets of the
documents, one more than documents), `.doc` (64-bit doc_id and then a byte for each that is 1 where doc_id is present).
Documents lie in ascending doc_id order (nulls first; equal ids by text), within a file and over the files. Only where a
partition starts in the whole needs all partitions: the prefix sums of their sizes.

Null and empty texts hold the end id alone. Rows of equal doc_id stay rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordspark.llm.common import new_path, scan_partitions, sliced, written
from recordspark.llm.tokens import SLICE, encoder

MANIFEST = "part int, file string, width int, n_docs long, n_tokens long"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, partitions: int | None = None) -> DataFrame:
    """Writes docs (doc_id, text) to folder. The manifest that returns has a row for each file, with `base`, the ids before it."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    fs, at = _open(folder)
    fs.create_dir(at, recursive=True)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = partitions or scan_partitions(rows)
    ordered = rows.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def write(batches):
        own, context = encoder(tokenizer), TaskContext.get()
        end = np.array([end_id], dtype=f"<u{own.width}").tobytes()
        # each attempt has files of its own; the manifest names those of the attempt that was committed
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}"
        fs, at = _open(folder)
        offset = n_docs = 0
        bin_, idx, doc, there = (fs.open_output_stream(f"{at}/{name}.{x}") for x in ("bin", "idx", "doc", "nul"))
        idx.write(np.zeros(1, "<u8").tobytes())
        for batch in sliced(batches, "text", SLICE):
            ids = own.encode(batch.column("text"))
            bin_.write(b"".join([y for x in ids for y in (x, end)]))
            ends = offset + np.cumsum([len(x) // own.width + 1 for x in ids], dtype="<u8")
            idx.write(ends.tobytes())
            offset = int(ends[-1])
            keys = batch.column("doc_id")
            doc.write(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            there.write(np.asarray(keys.is_valid()).astype("u1").tobytes())
            n_docs += len(keys)
        for x in (bin_, idx, doc, there):
            x.close()
        if n_docs:
            yield pa.RecordBatch.from_pydict({"part": pa.array([context.partitionId()], pa.int32()), "file": [f"{folder}/{name}"], "width": pa.array([own.width], pa.int32()), "n_docs": [n_docs], "n_tokens": [offset]})

    manifest = written(ordered.mapInArrow(write, MANIFEST), "tokens-manifest")
    # a row for each file, not for each document
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


class TokenFile:
    """A part of a token folder; local files are memory-mapped."""

    def __init__(self, file: str, width: int):
        self.fs, self.at = _open(file)
        self.width = width
        self.offsets, self.doc_ids, self.present = (np.frombuffer(self._whole(x), kind) for x, kind in (("idx", "<u8"), ("doc", "<i8"), ("nul", "u1")))
        self._ids = np.memmap(f"{self.at}.bin", f"<u{width}", "r") if isinstance(self.fs, pafs.LocalFileSystem) else None

    def _whole(self, kind: str):
        with self.fs.open_input_file(f"{self.at}.{kind}") as f:
            return f.read()

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids of documents first to last, the last one excluded."""
        a, b = int(self.offsets[first]), int(self.offsets[last])
        if self._ids is not None:
            return self._ids[a:b]
        with self.fs.open_input_file(f"{self.at}.bin") as f:
            f.seek(a * self.width)
            return np.frombuffer(f.read((b - a) * self.width), f"<u{self.width}")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """A row for each document, from the files: doc_id, start, n_tokens, ids_crc32, file, position in the file."""
    files = scan_partitions(manifest)

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens, n = TokenFile(row["file"], row["width"]), row["n_docs"]
                for i in range(0, n, 4096):
                    j = min(n, i + 4096)
                    bounds = tokens.offsets[i : j + 1].astype("i8")
                    ids = memoryview(np.ascontiguousarray(tokens.ids(i, j), "<u4")).cast("B")
                    at = (bounds - bounds[0]) * 4
                    yield pa.RecordBatch.from_arrays([
                        pa.array(tokens.doc_ids[i:j].astype("i8"), mask=tokens.present[i:j] == 0),
                        pa.array(bounds[:-1] + row["base"]), pa.array(np.diff(bounds)),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()),
                        pa.array([row["file"]] * (j - i)), pa.array(range(i, j), pa.int64()),
                    ], ["doc_id", "start", "n_tokens", "ids_crc32", "file", "position"])

    spread = manifest.repartition(max(files, manifest.sparkSession.sparkContext.defaultParallelism), "part")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, position long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(manifest).drop("file", "position")
