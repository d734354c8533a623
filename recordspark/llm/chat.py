"""Operator 7: conversations formatted into windows within a token budget.

Prefix sums of the turns' tokens cut a conversation into windows of whole turns. A window opens with the system turn (if
the conversation starts with one), goes on with as many of the last turns before it as fit a small budget, and then has
its own turns. Only assistant turns that are a window's own count for the loss, so each is learnt once.

A turn over a quarter of the budget has a window of its own; only such a turn, if it is longer than what system turn and
history leave, takes a window over the budget. Turns are never cut.

Rows of a conversation go by turn (nulls first), then role, then text; rows that are equal stay turns of their own. Null
role and text are empty. A null conv_id is a conversation. Other columns are ignored. An empty table gives no rows. A
conversation's turns are ordered and digested in one task, streaming and spilling: windows are defined along that order.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordspark.llm.common import slice_arrays

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Strings that end or open turns, here or in common templates; in a text each gets a backslash after its first character.
CONTROLS = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BUDGET, HISTORY, OVERHEAD = 1024, 128, 4


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROLS:
        out = F.replace(out, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def token_counts(path: str):
    """A column function: tokens of a text by the tokenizer at path."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        from recordspark.llm.tokens import encoder

        own = encoder(path)
        return pa.array([len(x) // own.width for part in slice_arrays(texts, 1_000_000) for x in own.encode(part.to_pylist())], pa.int64())

    return count


def windows(turns: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """A row for each window: conv_id, window (1, 2, ...), formatted, spans.

    spans: for each turn in `formatted`, pos (its place in the conversation), own (false: repeated), loss, and the code
    points role_at, text_at and end."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    rows = rows.withColumn("tokens", token_counts(tokenizer)("text") + OVERHEAD)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    till = order.rowsBetween(Window.unboundedPreceding, 0)
    long_turn = F.col("tokens") > budget // 4
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("sum", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    system = F.first(F.when(F.col("role") == "system", F.struct("tokens", "text"))).over(till)
    rows = rows.withColumn("system", system).withColumn("longs", F.sum(F.when(long_turn, 1).otherwise(0)).over(till))
    rows = rows.withColumn("since", F.coalesce(F.max(F.when(long_turn, F.col("sum") + F.col("tokens"))).over(before), F.lit(0)))
    stretch = F.greatest(F.lit(budget // 8), F.lit(budget - history - budget // 4) - F.coalesce(F.col("system.tokens"), F.lit(0)))
    rows = rows.withColumn("key", F.struct(F.col("longs"), long_turn, F.floor((F.col("sum") - F.col("since")) / stretch)))
    rows = rows.withColumn("first", ~F.col("key").eqNullSafe(F.lag("key").over(order))).withColumn("window", F.sum(F.when(F.col("first"), 1).otherwise(0)).over(till))
    # windows that open within `history` tokens of this turn's start; each turn has OVERHEAD tokens at least, so these are few
    ahead = Window.partitionBy("conv_id").orderBy("sum").rangeBetween(0, history)
    again = F.filter(F.collect_list(F.when(F.col("first"), F.col("window"))).over(ahead), lambda w: w > F.col("window"))
    rows = rows.withColumn("again", F.when((F.col("pos") == 1) & (F.col("role") == "system"), F.array().cast("array<bigint>")).otherwise(again))
    rows = rows.withColumn("at", F.explode(F.concat(F.array("window"), "again"))).withColumn("own", F.col("at") == F.col("window"))
    lead = F.when(F.col("first") & F.col("own") & (F.col("window") > 1) & F.col("system").isNotNull(), F.struct("system.text"))
    turn = F.struct("pos", "own", F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")).alias("role"), escape(F.col("text")).alias("text"))
    groups = rows.groupBy("conv_id", F.col("at").alias("window")).agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.max(lead).alias("lead"))
    repeated = F.array(F.struct(F.lit(1).alias("pos"), F.lit(False).alias("own"), F.lit("system").alias("role"), escape(F.col("lead.text")).alias("text")))
    groups = groups.withColumn("turns", F.when(F.col("lead").isNotNull(), F.concat(repeated, "turns")).otherwise(F.col("turns")))
    piece = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,own:boolean,loss:boolean,role_at:int,text_at:int,end:int>>").alias("spans"))

    def span(s: Column, t: Column) -> Column:
        role_at = s["at"] + len(OPEN)
        text_at = role_at + F.length(t["role"]) + 1
        end = text_at + F.length(t["text"])
        one = F.struct(t["pos"].alias("pos"), t["own"].alias("own"), (t["own"] & (t["role"] == "assistant")).alias("loss"), role_at.alias("role_at"), text_at.alias("text_at"), end.alias("end"))
        return F.struct((end + len(CLOSE)).alias("at"), F.concat(s["spans"], F.array(one)).alias("spans"))

    spans = F.aggregate("turns", start, span, lambda s: s["spans"])
    return groups.select("conv_id", "window", F.array_join(F.transform("turns", piece), "").alias("formatted"), spans.alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns, parsed from the formatted text: conv_id, pos, role, text, loss, window_chars (of its window, at the window's first own turn, else 0).

    Controls within texts are escaped, so each OPEN opens a turn and each turn ends with its CLOSE. The spans say which turns are a window's own and which count for the loss."""
    pieces = F.split("formatted", re.escape(OPEN))
    turns = F.arrays_zip(F.slice(pieces, F.lit(2), F.size(pieces)).alias("t"), F.col("spans").alias("s"))
    rows = formatted.select("conv_id", F.length("formatted").alias("chars"), F.posexplode(F.filter(turns, lambda x: x["s"]["own"])).alias("i", "x"))
    # a role ends at the first newline that isn't escaped
    rows = rows.withColumn("role", F.regexp_extract("x.t", r"(?s)^((?:\\.|[^\\\n])*+)\n", 1))
    text = F.substring("x.t", F.length("role") + 2, F.length("x.t") - F.length("role") - 1 - len(CLOSE))
    return rows.select("conv_id", "x.s.pos", unescape(F.col("role")).alias("role"), unescape(text).alias("text"), "x.s.loss", F.when(F.col("i") == 0, F.col("chars")).otherwise(0).alias("window_chars"))


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(turns: DataFrame) -> DataFrame:
    """A row for each conversation. Sorted rows stream through each task; only the running digests are held."""

    def run(batches):
        here, turns_sha, loss_sha, n, loss, chars = None, None, None, 0, 0, 0
        out = []

        def row():
            return (here[0], n, turns_sha.hexdigest(), loss, loss_sha.hexdigest(), chars)

        for batch in batches:
            for conv, role, text, in_loss, window_chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss", "window_chars")), strict=True):
                if here != (conv,):
                    if here:
                        out.append(row())
                    here, turns_sha, loss_sha, n, loss, chars = (conv,), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                turns_sha.update(f"{role}\n{text}\n".encode())
                n, chars = n + 1, chars + window_chars
                if in_loss:
                    loss_sha.update(text.encode())
                    loss += len(text)
            if out:
                yield _batch(out)
                out = []
        if here:
            yield _batch([row()])

    def _batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in DIGESTS.split(", ")])

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(run, DIGESTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return digests(read_back(windows(turns.unionByName(more), public_tokenizers.path("byte_bpe_50k.json"))))
