import random

import numpy as np
import pytest

from recordspark.llm import near_duplicates as nd
from recordspark.llm.components import components


def brute(rows, exact=True):
    """doc_id -> least doc_id of its group, by all pairs"""
    sets = {}
    for doc, text in rows:
        words = (text or "").split()
        if words:
            n = min(5, len(words))
            sets[doc] = {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}
    at = {doc: doc for doc, _ in rows}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    docs, by = sorted(sets), {}
    for d in docs:
        for s in sets[d]:
            by.setdefault(s, []).append(d)
    pairs = {(a, b) for v in by.values() for a in v for b in v if a < b}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 5 * common >= 4 * (len(sets[a]) + len(sets[b]) - common):
            x, y = root(a), root(b)
            at[max(x, y)] = min(x, y)
    return {d: root(d) for d, _ in rows}


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(500, x) for x in range(501, 700)] + [(900, 900)]
    out = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    at = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            at[a] = at[b] = min(at[a], at[b])
    assert out == {k: v for k, v in at.items() if k != 900}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("share", [0.3, 0.6, 0.8, 0.95])
def test_signatures_agree_as_often_as_weighted_jaccard_has_it(share):
    r = np.random.default_rng(5)
    agree, sim = [], []
    for _ in range(40):
        common, a, b = (nd.mix(r.integers(0, 1 << 62, n).astype(np.uint64)) for n in (int(400 * share), int(400 * (1 - share) / 2), int(400 * (1 - share) / 2)))
        weight = {int(x): w for x, w in zip(np.concatenate([common, a, b]), r.choice([1.0, 1.7, 3.2], len(common) + len(a) + len(b)))}
        x, y = np.concatenate([common, a]), np.concatenate([common, b])
        sx, sy = nd.signatures(np.concatenate([x, y]), np.array([weight[int(e)] for e in (*x, *y)]), np.array([len(x), len(y)]))
        agree.append((sx == sy).mean())
        c = sum(weight[int(e)] for e in common)
        sim.append(c / sum(weight.values()))
    assert abs(np.mean(agree) - np.mean(sim)) < 0.025


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("block", [1024, 16])
def test_groups_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    r, rows = random.Random(4), []
    for _ in range(60):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([1, 3, 5, 8, 60, 200]))]
        rows += [edited(r, base, r.choice([0, 0, 1, 2, 6])) for _ in range(r.choice([1, 1, 2, 6]))]
    base = [f"h{i}" for i in range(300)]
    rows += [edited(r, base, r.choice([0, 3, 6, 9])) for _ in range(120)]  # a large group, not all of it alike
    rows += [None, "", " \n ", "same text here", "same text here", "same  text here"]
    rows = list(enumerate(rows))
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, kept int, bucket int")
    out = {x.doc_id: x.component_id for x in nd.near_duplicates(df).collect()}
    assert out == brute(rows)


def test_passages_repeated_a_different_number_of_times(spark):
    r, rows = random.Random(6), []
    for times in (2, 3, 10, 40):
        for _ in range(12):
            base = [f"p{r.randrange(10**6)}" for _ in range(r.choice([100, 150]))]
            block = base[:20]
            rows += [" ".join(base), " ".join(base * times), edited(r, base, 1), " ".join(base + block * times), " ".join(block * times + base)]
    rows = list(enumerate(rows))
    out = {x.doc_id: x.component_id for x in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == brute(rows)


def test_query(spark, small):
    rows = [tuple(x) for x in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    out = {x.doc_id: x.component_id for x in nd.query(spark, small).collect()}
    assert out == brute(rows)


def test_odd(spark, odd_docs, no_docs):
    out = {x.doc_id: x.component_id for x in nd.near_duplicates(odd_docs).collect()}
    assert out == {1: 1, 2: 2, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 9}
    kept = nd.stage(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns and sorted((x.doc_id or 0) for x in kept.collect()) == [0, 1, 2, 2, 5, 6, 7, 8, 9]
    assert nd.near_duplicates(no_docs).count() == 0


def test_rows_of_one_doc_id_and_rows_without(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(7, a), (7, b), (3, a + " more"), (9, b), (9, b), (None, c), (None, c), (12, c + " more"), (None, "alone"), (None, None), (4, None)]
    df = spark.createDataFrame([(*x, i, "k") for i, x in enumerate(rows)], "doc_id long, text string, node long, row string")
    out = {x.doc_id: x.component_id for x in nd.near_duplicates(df).collect()}
    assert out == {7: 3, 3: 3, 9: 3, 12: 12, 4: 4}
    kept = nd.stage(spark, df, "")
    assert kept.columns == df.columns
    assert sorted((x.doc_id or 0, x.text or "") for x in kept.collect()) == [(0, ""), (0, "alone"), (3, a + " more"), (4, ""), (12, c + " more")]
    same = spark.createDataFrame([(5, c, 1), (5, c, 2), (5, c, 3)], "doc_id long, text string, n long")
    assert nd.stage(spark, same, "").count() == 1
