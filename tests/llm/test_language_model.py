import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from recordspark.llm import language_model as lm


def brute(rows):
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    counts = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        own = tokens(t)
        out.append((d, held(d), len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)))
    return sorted(out, key=str)


def same(got, rows):
    got = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], key=str)
    expected = brute(rows)
    assert [x[:5] for x in got] == [x[:5] for x in expected]
    for g, e in zip(got, expected, strict=True):
        assert math.isclose(g[5], e[5], rel_tol=1e-9)


def test_query_against_brute_force_and_held_out_likelihood(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = lm.query(spark, small).collect()
    same(got, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in got if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert held and gain > 0.1  # log10 a token


def test_scores_do_not_depend_on_partitions(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    one, many = ({r.doc_id: r.score for r in lm.scored(docs.repartition(n), rounds=2).collect()} for n in (1, 7))
    assert one.keys() == many.keys()
    for k, v in one.items():
        assert math.isclose(v, many[k], rel_tol=1e-4)


def plain_scores(rows, deal):
    """log10 probabilities by loops over tokens. deal: doc_id -> round"""
    wrap = (1 << 64) - 1
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    texts = {d: [*(w.encode() for w in t.lower().split()), b" "] for d, t in rows}

    def events(words):
        before = [0, 0, 0]
        for w in words:
            one, two, three = before
            raw = [one, (one * 0x9E3779B97F4A7C15 & wrap) ^ two, two + (1 << 40), three + (1 << 41)]
            mixed = [((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & wrap) >> 49 for x in raw]
            cell = lm.cell(w)
            yield w, cell, (mixed, [(b * 31 + cell // 16 * 2053 + 7) % lm.BUCKETS for b in mixed]), (cell // 16, cell % 16)
            before = [zlib.crc32(w), one, two]

    counts = Counter(w for d, ws in texts.items() if not held(d) for w in ws)
    total, shares, room = sum(counts.values()), np.zeros((2, 16)), Counter()
    for w, n in counts.items():
        shares[0, lm.cell(w) // 16] += n / total
        shares[1, lm.cell(w) % 16] += n / total
        room[lm.cell(w)] += n + 0.1
    weights = {}

    def chances(level, buckets):
        z = sum((weights.get((level, b), np.zeros(16)) for b in buckets), np.zeros(16))
        e = np.exp(np.clip(z, -40, 40))
        return e / e.sum()

    for k in range(lm.ROUNDS):
        sums, n = {}, Counter()
        for d, ws in texts.items():
            if not held(d) and deal[d] == k:
                for _, _, at, wanted in events(ws):
                    for level in (0, 1):
                        g = -chances(level, at[level])
                        g[wanted[level]] += 1
                        for b in at[level]:
                            sums[level, b] = sums.get((level, b), 0) + g
                            n[level, b] += 1
        for (level, b), g in sums.items():
            move = g / (lm.CURVED * n[level, b] * (shares[level] * (1 - shares[level]) + 0.01) + lm.LEVELLED)
            weights[level, b] = weights.get((level, b), np.zeros(16)) + np.clip(move, -lm.LONGEST, lm.LONGEST)
    out = {}
    for d, ws in texts.items():
        out[d] = 0.0
        for w, cell, at, wanted in events(ws):
            out[d] += math.log10(chances(0, at[0])[wanted[0]]) + (math.log10(chances(1, at[1])[wanted[1]]) if cell else 0.0)
            out[d] += math.log10(counts[w] + 0.1) - math.log10(room[cell] + 0.1 * (cell != 0) if cell in room else 0.1)
    return out


def test_scores_against_loops(spark):
    rng = np.random.default_rng(3)
    words = ["the", "a", "cat", "dog", "sat", "ran", "on", "mat", "Tree", "x1", "longer", "words"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F

    deal = {r.doc_id: r.k for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", "text"), F.lit(lm.ROUNDS)).alias("k")).collect()}
    expected = plain_scores(rows, deal)
    for r in lm.scored(docs).collect():
        assert math.isclose(r.score, expected[r.doc_id], rel_tol=1e-4), r.doc_id


def test_words_beyond_the_table_are_looked_up(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    few, many = (lm.scored(odd_docs, rounds=1, most_known=k).collect() for k in (2, 1000))
    same(few, rows)
    same(many, rows)
    for a, b in zip(sorted(few, key=str), sorted(many, key=str), strict=True):
        assert math.isclose(a.score, b.score, rel_tol=1e-6)
    assert lm.scored(no_docs, rounds=1).collect() == []


def coded(text):
    words = lm.Words()
    return words.codes[words.numbers(lm.words_of(text))]


def test_probabilities_add_up():
    rng = np.random.default_rng(1)
    model = lm.Model(rng.normal(size=(2, lm.BUCKETS, lm.CLASSES)).astype(np.float32))
    buckets, _ = lm.features([coded("a few words")])
    total = 0.0
    for c in range(lm.CLASSES * lm.SUBCLASSES):
        if c == 0 or c >= lm.SUBCLASSES:  # the end's class has one subclass
            total = total + 10 ** model.scores(buckets, np.full(buckets.shape[1], c, np.int32))
    np.testing.assert_allclose(total, 1, rtol=1e-5)


def test_features_do_not_cross_texts():
    a, b = coded("one two three"), coded("four")
    np.testing.assert_array_equal(lm.features([a, b])[0][:, len(a) :], lm.features([b])[0])


def test_the_cache_starts_anew():
    words = lm.Words({b"a": 1.0})
    words.LIMIT = 4
    for text in ("a b c", "d e f", "a " + " ".join(map(str, range(500_000)))):
        own = lm.words_of(text)
        words.room(len(own))
        numbers = words.numbers(own)
        assert [int(x) for x in words.codes[numbers][:3]] == [zlib.crc32(w) << 8 | lm.cell(w) for w in own[:3]]
        assert (words.logs[numbers[0]] == 1.0) == (own[0] == b"a")


def test_tokens_of_many_texts_at_once():
    texts = [None, "", " ", "a A\x0bb", "".join(map(chr, range(1, 300))), " lead", "trail \n", "É é \x1c x\xa0y", "a"]
    numbers, bounds, words = lm.tokens_of(pa.array(["before", *texts, "after"]).slice(1, len(texts)))
    words = words.to_pylist()
    assert len(set(words)) == len(words) and b"" not in words
    assert [[words[k] for k in numbers[i:j]] for i, j in zip(bounds[:-1], bounds[1:], strict=True)] == [lm.words_of(t) for t in texts]
    assert lm.cells_of(words).tolist() == [lm.cell(w) for w in words]


def test_a_word_is_hashed_once_for_all_its_tokens(monkeypatch):
    hashed = []
    monkeypatch.setattr(lm, "cells_of", lambda words, of=lm.cells_of: hashed.extend(words) or of(words))
    words = lm.Words()
    for _ in range(2):
        groups = list(lm._batches(pa.array(["b a b", None, "a b " * 20_000]), words))
    assert sum(len(c) for g in groups for c in g) == 4 + 1 + 40_001
    assert sorted(hashed) == [lm.END, b"a", b"b"]


def test_cells_are_looked_up_for_all_words_at_once(monkeypatch):
    words = [lm.END, b"a", b"\xff", b"ab", b"a\0", b"\0", "é".encode(), b"abcde", b"abcdef", b"b", b"a" * 70, *(bytes([i, j]) for i in range(0, 256, 5) for j in range(0, 256, 7))]
    expected = [lm.cell(w) for w in words]
    hashed = []
    monkeypatch.setattr(lm.zlib, "crc32", lambda *x: hashed.append(x) or 0)
    assert lm.cells_of(words).tolist() == expected and lm.cells_of([]).tolist() == [] and not hashed
