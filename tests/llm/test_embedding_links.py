import math

import numpy as np

from recordspark.llm import embedding_links as el


def brute(rows, least=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    at = {i: i for i, _ in rows}
    links = dict.fromkeys(at, 0)

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for k, (i, x) in enumerate(good):
        for j, y in good[:k]:
            if len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                at[max(a, b)] = min(a, b)
    return {i: (links[i], root(i), root(i) == i) for i, _ in rows}


def result(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def near(r, x, cosine):
    y = r.normal(size=len(x))
    y -= x * (x @ y) / (x @ x)
    y *= np.linalg.norm(x) / np.linalg.norm(y)
    return x * cosine + y * math.sqrt(1 - cosine * cosine)


def test_recall_and_precision(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(1500, 32))
    rows = [*base.tolist()]
    for cosine in (0.999, 0.98, 0.96, 0.9505, 0.949, 0.93):
        rows += [near(r, base[i], cosine).tolist() for i in range(0, 1500, 10)]
    rows += [base[3].tolist()] * 50 + [near(r, base[5], 0.99).tolist() for _ in range(300)] + [(base[7] * 3).tolist()]
    order = r.permutation(len(rows))
    rows = [(int(k), rows[i]) for k, i in enumerate(order)]
    out, right = result(el.linked_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))), brute(rows)
    found, there = sum(v[0] for v in out.values()), sum(v[0] for v in right.values())
    assert found >= 0.99 * there and all(out[i][0] <= right[i][0] for i in out)
    assert np.mean([out[i] == right[i] for i in out]) > 0.98


def test_recall_with_many_lists_and_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(el, "LIST_SIZE", 10)  # some 300 lists
    r = np.random.default_rng(2)
    axes, middles = r.normal(size=(6, 48)), r.normal(size=(40, 6)) * 2
    base = np.concatenate([(m + r.normal(size=(50, 6)) * 0.6) @ axes + r.normal(size=(50, 48)) * 0.02 for m in middles])
    rows = [*base.tolist(), *(near(r, base[i], c).tolist() for c in (0.99, 0.955) for i in range(0, 2000, 4))]
    rows = [(int(k), np.float32(rows[i]).tolist()) for k, i in enumerate(r.permutation(len(rows)))]
    out, right = result(el.linked_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))), brute(rows)
    found, there = sum(v[0] for v in out.values()), sum(v[0] for v in right.values())
    assert there > 10_000 and found >= 0.99 * there and all(out[i][0] <= right[i][0] for i in out)
    assert np.mean([out[i][1] == right[i][1] for i in out]) > 0.98


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.01]), (11, [0.0, 1.0])]
    df = spark.createDataFrame([(*x, 5, "t") for x in rows], "vec_id long, embedding array<float>, n int, v string")
    assert result(el.linked_embeddings(df)) == brute(rows)
    assert el.linked_embeddings(df.limit(0)).count() == 0


def test_query(spark, small):
    rows = [tuple(x) for x in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert result(el.query(spark, small)) == brute(rows)
