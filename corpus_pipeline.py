"""The corpus pipeline: documents judged, freed of near copies and secrets, mixed and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordspark.llm import mixing, near_duplicates, packing, quality, secrets
from recordspark.llm.common import written


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # small slices: workers keep less memory for the stages that come after in the same session
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, slice_bytes=3_000_000)


STAGES = [("quality", quality.stage), ("near_duplicates", near_duplicates.stage), ("secrets", secrets.stage), ("mixing", mixing.stage), ("packing", packed)]
#: Tokens and shingle hashes are beyond SQL; tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
