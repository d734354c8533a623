"""run() of the pipeline against plain Python, on documents made here."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from recordspark.llm import mixing, quality
from tests.llm.test_near_duplicates import brute as groups_of
from tests.llm.test_quality_mixing import brute as measures_of
from tests.llm.test_secrets import brute as spans_of


def documents():
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = []
    for i in range(160):
        source = r.choice(["hot", "hot", "hot", "a", "b", None])
        base = text(r.randint(55, 200))
        if i % 8 == 1:
            base = " ".join(f"{w}###" for w in base.split())  # symbols, on every host
        if i % 8 == 2:
            base += " password: hunter22hunter and token=abcdefgh1234"
        if i % 8 == 3:
            base = text(20)
        if i % 8 == 4:
            base = "again and again " * 40
        rows.append((i * 3, base, "en", source, len(base)))
        if i % 5 == 0:
            rows.append((i * 3 + 1, base + " more", "en", source, len(base) + 5))
        if i % 10 == 0:
            rows.append((i * 3 + 2, base, "en", source, len(base)))
    rows += [(1000, None, "en", "a", 0), (1001, "", None, None, 0), next(x for x in rows if x[0] == 30)]
    r.shuffle(rows)
    return rows


def after_quality(rows):
    stats = {i: measures_of(r[1]) for i, r in enumerate(rows)}
    names = [x.split()[0] for x in quality.STATS.split(", ")]
    fails = {i: {k: bool(rule(dict(zip(names, s, strict=True)))) for k, rule in quality.RULES.items()} for i, s in stats.items()}
    n, bad = Counter(r[3] for r in rows), defaultdict(Counter)
    for i, r in enumerate(rows):
        for k in quality.RULES:
            bad[k][r[3]] += fails[i][k]
    held = set()
    for k in quality.RULES:
        a, b = quality.beta_prior(len(rows), len(n), sum(x * x for x in n.values()), sum(bad[k].values()), sum(bad[k][h] ** 2 / n[h] for h in n))
        held |= {(k, h) for h in n if (bad[k][h] + a) / (n[h] + a + b) > quality.HOST_RATE}
    failed = lambda s: s[0] < 50 or 100 * s[5] > 50 * s[0]
    return [r for i, r in enumerate(rows) if not failed(stats[i]) and not any(fails[i][k] and (k, r[3]) in held for k in quality.RULES)]


def after_near_duplicates(rows):
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[1])
    assert all(len(x) == 1 for x in texts.values())
    group = groups_of([(d, next(iter(x))) for d, x in texts.items()])
    out = {}
    for r in rows:
        if group[r[0]] == r[0]:
            out.setdefault(r[0], r)
    return list(out.values())


def after_secrets(rows):
    out = []
    for d, text, lang, source, _ in rows:
        for kind, a, b in reversed(spans_of(text)[0]):  # here none overlap
            assert kind == "assign"
            text = text[:a] + "[SECRET]" + text[b:]
        out.append((d, text, lang, source, len(text)))
    return out


def after_mixing(rows):
    n = Counter(r[3] for r in rows)
    whole = sum(x**mixing.TEMPERATURE for x in n.values())
    out = []
    for r in rows:
        rate = n[r[3]] ** mixing.TEMPERATURE * len(rows) / whole / n[r[3]]
        u = (int(hashlib.md5(f"{mixing.SEED}:{r[0]}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        copies, cdf = 0, math.exp(-rate)
        while cdf < u:
            copies += 1
            cdf += math.exp(-rate + copies * math.log(rate) - math.lgamma(copies + 1))
        out += [r] * copies
    return out


def test_run_against_plain_python(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    steps = [after_quality(rows)]
    for step in (after_near_duplicates, after_secrets, after_mixing):
        steps.append(step(steps[-1]))
    assert len(rows) > len(steps[0]) > len(steps[1]) and any("[SECRET]" in r[1] for r in steps[2])
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for r in steps[-1]:
        expected[r[0], tuple(tokenizer.encode(r[1], add_special_tokens=False).ids) + (1,)] += 1
    copies = Counter({d: n for (d, _), n in expected.items()})
    ids = {d: np.array(x, "<u4") for d, x in expected}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = Counter()
    for p in pieces:
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes())
        tokens.update((p.doc_id, p.start + i) for i in range(p.length))
    assert tokens == Counter({(d, i): copies[d] for d, x in ids.items() for i in range(len(x))})
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_an_empty_table(spark, tmp_path, no_docs):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
