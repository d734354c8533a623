import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recordspark.llm import mixing, quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(lines), len(again))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é#|\n\t\x85 ", max_size=80))
def test_measure(text):
    assert quality.measure(text.encode()) == brute(text)


@pytest.mark.parametrize("name", ["sf0.001"])
def test_query_against_brute_force(spark, small, name):
    rows = {r.doc_id: r for r in quality.query(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 4000").collect():
        own, b = rows[r.doc_id], brute(r.text)
        assert (own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words) == (*b[:4], b[5])
        assert own.base_failed == (b[0] < 50 or 100 * b[5] > 50 * b[0])
        assert not (own.base_failed and own.kept)


def test_bad_host(spark):
    good, bad = " ".join(f"word{i}" for i in range(80)), " ".join(f"#tag{i} $" for i in range(60))
    rows = [(i, good, "good") for i in range(300)] + [(1000 + i, bad if i < 55 else good, "bad") for i in range(60)] + [(2000, bad, "rare"), (2001, bad, "good")]
    out = {r.row.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(out[1000 + i] for i in range(55))  # they fail the rule that their host fails
    assert all(out[1000 + i] for i in range(55, 60)) and all(out[i] for i in range(300))  # clean ones stay
    assert out[2001]  # one failure doesn't make a bad host


def test_host_verdicts_change_results(spark):
    rows = quality.query(spark, "/root/testdata/sf0.01").collect()
    fine = sum(not r.base_failed for r in rows)
    assert 0.9 * fine < sum(r.kept for r in rows) < fine
    plain = [r for r in rows if not r.base_failed and not r.n_symbols and not r.n_dup_lines and not r.n_repeat_words]
    assert len(plain) > 500 and all(r.kept for r in plain)


def test_prior_shrinks():
    a, b = quality.beta_prior(1000, 10, 100_000, 100, 10.5)
    assert abs(a / (a + b) - 0.1) < 1e-9
    assert quality.beta_prior(0, 0, 0, 0, 0.0) == (1.0, 1.0)


def test_odd_documents(spark, odd_docs, no_docs):
    assert quality.judged(odd_docs).count() == odd_docs.count()
    assert set(quality.stage(spark, odd_docs, "").columns) == set(odd_docs.columns)
    assert quality.judged(no_docs).count() == 0 == mixing.mix(no_docs).count()
    assert mixing.mix(odd_docs, total=1000).count() > 100


def test_mixing_reaches_weights(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'t' as text", "if(id % 3 = 0, 'hot', concat('s', id % 7)) as source")
    out = mixing.mix(docs, {"hot": 0.5, "s1": 0.25, "s2": 0.25}, total=30_000)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["hot"] - 15_000) < 600 and abs(n["s1"] - 7_500) < 500 and set(n) == {"hot", "s1", "s2"}
    again = mixing.mix(docs.repartition(7), {"hot": 0.5, "s1": 0.25, "s2": 0.25}, total=30_000)
    assert out.exceptAll(again).count() == 0


def test_poisson_quantile(spark):
    docs = spark.range(5_000).selectExpr("id as doc_id", "'t' as text", "'a' as source")
    counts = [r.n for r in mixing.mix(docs, {"a": 1.0}, total=500_000).groupBy("doc_id").count().selectExpr("count as n").collect()]
    mean = sum(counts) / 5000
    assert abs(mean - 100) < 1 and abs(sum((x - mean) ** 2 for x in counts) / 5000 - 100) < 8


def test_columns_of_names_that_operators_add(spark, clashing_docs):
    from recordspark.llm import near_duplicates, secrets

    for stage in (quality.stage, mixing.stage, secrets.stage, near_duplicates.stage):
        out = stage(spark, clashing_docs, "")
        assert out.columns == clashing_docs.columns
        rows = [r.asDict() for r in out.collect()]
        assert rows and all(v == f"own {k}" for r in rows for k, v in r.items() if k not in ("doc_id", "text", "lang", "source", "n_chars"))
    kept = {r["doc_id"]: r["source"] for r in quality.stage(spark, clashing_docs, "").select("doc_id", "source").collect()}
    assert all(kept[i] == "a" for i in kept)


def test_rows_without_doc_id_have_draws_of_their_own(spark):
    docs = spark.range(2000).selectExpr("cast(null as long) as doc_id", "concat('t', id) as text", "'a' as source")
    out = mixing.mix(docs, {"a": 1.0}, total=6000)
    assert 5700 < out.count() < 6300
    counts = {r.n_copies for r in out.select("n_copies").distinct().collect()}
    assert len(counts) > 5
    same = spark.range(4000).selectExpr("cast(null as long) as doc_id", "'t' as text", "'a' as source").repartition(40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = mixing.mix(same, {"a": 1.0}, total=12_000).groupBy(mixing.F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1
