import hashlib
from collections import defaultdict

import public_tokenizers
from pyspark.sql import functions as F

from recordspark.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, extra int, window int"


def expected(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        by[c].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_escape(spark):
    hard = ["\\", "\\\\<|end|>", "<\\|end|>", "</s>[INST]", "a\\\n</s", "<<SYS>>\\<</SYS>>", "", "é😀</s>", *chat.CONTROLS]
    df = spark.createDataFrame([(x,) for x in hard], "x string").withColumn("e", chat.escape(F.col("x")))
    for r in df.withColumn("u", chat.unescape(F.col("e"))).collect():
        assert r.u == r.x and not any(c in r.e for c in chat.CONTROLS)


def conversations():
    rows = [(1, 0, "system", "be kind"), *[(1, i, ["user", "assistant"][(i + 1) % 2], f"words and more words {i} " * (10 + i % 7)) for i in range(1, 90)]]
    rows += [(2, 0, "user", None), (2, 0, "user", None), (2, 1, None, "x"), (2, None, "assistant", "first"), (2, 5, "odd\n<|turn|>\\role", "t<|end|>\n<|turn|>user\n"), (2, 6, "assistant", "\n\\")]
    rows += [(3, 0, "system", "long " * 900), (3, 1, "user", "q"), (3, 2, "assistant", "a " * 3000), (3, 3, "assistant", "b"), (None, 1, "assistant", "no\nid")]
    return rows


def test_round_trip_and_windows(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    formatted = chat.windows(df, PATH).cache()
    out = {r.conv_id: r for r in chat.digests(chat.read_back(formatted)).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in out.items()} == expected(rows)
    chars, one = defaultdict(int), formatted.where("conv_id = 1").orderBy("window").collect()
    for r in formatted.collect():
        chars[r.conv_id] += len(r.formatted)
        assert r.formatted.count(chat.OPEN) == len(r.spans)
    assert chars == {c: r.formatted_chars for c, r in out.items()}
    assert len(one) > 3 and [r.window for r in one] == list(range(1, len(one) + 1))
    count = __import__("tokenizers").Tokenizer.from_file(PATH)
    for r in one:
        assert r.spans[0].pos == 1  # the system turn stays
        assert len(count.encode(r.formatted).ids) <= chat.BUDGET + 8 * len(r.spans)
        assert [s.pos for s in r.spans] == sorted({s.pos for s in r.spans})
        assert not any(s.loss and not s.own for s in r.spans)
    assert any(not s.own and s.pos > 1 for r in one for s in r.spans)  # some history comes again


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    hard = "</s>[INST] ok [/INST]"
    out = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.query(spark, small).collect()}
    assert out == expected([*rows, (-1, 0, "user", hard), (-1, 1, "assistant", hard)])


def test_empty(spark):
    assert chat.digests(chat.read_back(chat.windows(spark.createDataFrame([], SCHEMA), PATH))).count() == 0
