import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from recordspark.llm import repeated_passages as rp
from recordspark.llm.suffix_arrays import permuted_common, suffix_array


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=120))
def test_suffix_array(s):
    expected = sorted(range(len(s)), key=lambda i: s[i:])
    assert suffix_array(np.array(s, np.int64), 4).tolist() == expected


def test_suffix_array_of_long_and_repetitive_strings():
    rng = random.Random(3)
    for text in (b"ab" * 3000, b"a" * 4000, bytes(rng.randrange(97, 101) for _ in range(20_000)), b"the quick brown fox " * 300 + b"jumps " * 200):
        assert suffix_array(np.frombuffer(text, np.uint8).astype(np.int64), 256).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_with_many_names():
    s = np.random.default_rng(4).permutation(np.repeat(np.arange(90_000), 2))
    order = suffix_array(s, 90_000)
    assert sorted(order.tolist()) == list(range(len(s)))
    a, b = order[:-1], order[1:]
    left = np.ones(len(a), bool)
    for k in range(4):  # equal so far: compare the next
        at = np.flatnonzero(left & (np.maximum(a, b) + k < len(s)))
        assert (s[a[at] + k] <= s[b[at] + k]).all()
        left[at] = s[a[at] + k] == s[b[at] + k]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab", max_size=80), st.integers(1, 20))
def test_permuted_common(text, most):
    s = np.frombuffer(text.encode(), np.uint8)
    order = suffix_array(s.astype(np.int64), 256)
    shared = permuted_common(s, order, most)
    for before, i in zip(order, order[1:], strict=False):
        a, b, n = text[before:], text[i:], 0
        while n < min(len(a), len(b), most) and a[n] == b[n]:
            n += 1
        assert shared[i] == n


def brute(rows, least=50):
    first = {}
    for doc, text in rows:
        if doc is not None:
            b = (text or "").encode()
            for i in range(len(b) - least + 1):
                w = b[i : i + least]
                first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - least + 1 if doc is not None else 0):
            if first[b[i : i + least]] < doc:
                gone[i : i + least] = [True] * least
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()], key=str)


def test_planted_passages(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(n) for n in (9, 12, 40, 200)]
    rows = []
    for i in range(120):
        parts = [text(rng.randrange(0, 40)) for _ in range(3)]
        rows.append((i, rng.choice(passages).join(parts) if i % 2 else " ".join(parts)))
    rows += [(200, rows[1][1]), (201, rows[1][1][7:300]), (202, "z" * 500), (203, "z" * 49), (204, "z" * 50), (205, None), (205, ""), (None, rows[3][1]), (206, rows[5][1]), (206, rows[5][1]), (206, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", docs_extra()).repartition(3)
    assert rows_of(rp.without_repeats(docs)) == brute(rows)
    # anchors dealt over shards, many shards
    assert rows_of(rp.without_repeats(docs, shard_bytes=4000, shard_stretches=3)) == brute(rows)


def docs_extra():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_query_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted([tuple(r) for r in rp.query(spark, small).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()], key=str)
    assert got == brute(rows)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert rows_of(rp.without_repeats(odd_docs)) == brute(rows)
    assert rows_of(rp.without_repeats(no_docs)) == []


def test_only_texts_that_share_a_window_are_sorted(monkeypatch):
    """A phrase that many texts have brings them to one anchor; that alone makes nothing of them equal."""
    rng, phrase, seen = random.Random(6), b"a phrase of 24 bytes or so", []
    texts = [bytes(rng.randrange(97, 123) for _ in range(20)) + phrase + bytes(rng.randrange(97, 123) for _ in range(20)) for _ in range(300)]
    texts += [b"x" + texts[7][5:60] + b"y", texts[9][:50], b"z" * 70]
    plain = rp.sorted_minima
    monkeypatch.setattr(rp, "sorted_minima", lambda some, *rest: seen.extend(some) or plain(some, *rest))
    docs = np.arange(len(texts), 0, -1)
    got = rp.window_minima(texts, docs, 50)
    assert seen == [texts[i] for i in (7, 9, 300, 301, 302)]
    assert [x.tolist() for x in got] == [x.tolist() for x in plain(texts, docs, 50)]
    assert rp.window_minima(texts[:5], docs[:5], 50)[4].tolist() == [docs[4]] * (len(texts[4]) - 49)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=9, max_size=24).map(str.encode), min_size=1, max_size=12))
def test_window_minima(texts):
    docs = np.arange(len(texts))[::-1]
    low = {}
    for t, d in zip(texts, docs.tolist(), strict=True):
        for i in range(len(t) - 8):
            low[t[i : i + 9]] = min(low.get(t[i : i + 9], d), d)
    assert [x.tolist() for x in rp.window_minima(texts, docs, 9)] == [[low[t[i : i + 9]] for i in range(len(t) - 8)] for t in texts]


def test_least_hashes_do_not_depend_on_blocks(monkeypatch):
    a = np.random.default_rng(7).integers(97, 101, 5000, np.uint8)
    whole = rp.anchors(a, np.array([1000, 1040, 5000]))
    for near in (1, 64, 1000):
        monkeypatch.setattr(rp, "NEAR", near)
        assert all((x == y).all() for x, y in zip(whole, rp.anchors(a, np.array([1000, 1040, 5000])), strict=True))
        assert (rp.stretch_keys(a, whole[1], whole[2], 50) == np.array([rp.stretch_keys(a[i:], np.array([0]), np.array([n]), 50)[0] for i, n in zip(whole[1], whole[2], strict=True)])).all()
