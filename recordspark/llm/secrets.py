"""Operator 2 [native]: secrets in texts, by patterns and by a battery of randomness tests.

Patterns give base spans. Beside them, each run of 20 or more characters of a secret's alphabet is a candidate. One
that no encoding fits, such as a path with dashes, is split at slashes, then at dashes and underscores. The
encoding is inferred from the characters it has; its characters' places in that alphabet are a sequence of numbers. The
chi-squared statistic of its character counts is held against what words of natural language of that length would give:
a small p-value says that the text is more even than language. The runs test about the alphabet's middle and the serial
correlation give a likelihood ratio each: of their deviate in a random sequence (standard normal) against that in
language (SPREAD times as wide). A p-value over such ratios is one p-value for the whole battery. Besides, chi-squared
must not be beyond what a uniform sequence would give. Whether a p-value is small enough is settled over the whole table,
by the Benjamini-Hochberg rule within strata of encoding and length: short candidates, of which there are many and whose
p-values can't be small, don't spoil long ones and don't pass for them.

Positions are code points, ends exclusive. Null and empty texts have no spans. Equal rows are scanned each. An empty
table gives no rows. Only the columns named are read; others pass through redact() as they are, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordspark.llm.common import whole_row, written

#: kind -> (pattern, group whose length counts, least length); spans sort by start, then in this order.
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]+", 0, 32),
}
KINDS = (*PATTERNS, "random")
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Candidate pattern of the text's hex runs that need no look at shorter runs: same matches, fewer of them.
LONG_HEX = r"[0-9a-f]{32,}"
LONG_ACCESS = r"AKIA[A-Z0-9]{12,}"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: encoding -> (characters it may have, alphabet); the first that fits is inferred.
ENCODINGS = {
    "hex": ("^(?:[0-9a-f]+|[0-9A-F]+)$", DIGITS + "abcdef"),
    "letters": ("^(?:[a-z]+|[A-Z]+)$", LOWER),
    "base32": ("^[A-Z2-7]+$", UPPER.lower() + "234567"),
    "alphanumeric": ("^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
    "base64": ("^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    "base64url": ("^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
}
ONE_CASE = ("hex", "letters", "base32")
#: Chance that two characters of a word are equal, and that three are: for letters and, in hex, for digits.
EQUAL2, EQUAL3 = 0.066, 0.0056
#: Bounds of the length strata.
BANDS = (32, 48, 80)
#: Share of false discoveries, bound of chi-squared's deviate, p-values' bins a decade.
Q, DEVIATES, PER_DECADE = 0.05, 3.3, 8
#: Standard deviation of the runs' and serial correlation's deviates in language, and a bound that keeps exp() finite.
SPREAD, STEEPEST = 3.0, 12.0


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def prefix_sums(a: Column) -> Column:
    """Sums of the elements before each. An element sums up its own block of 64, and each block the blocks of its own block: long arrays cost little more than in proportion."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + y)
    block = lambda i: F.floor(i / 64).cast("int")
    totals = lambda a: F.transform(F.sequence(F.lit(0), block(F.size(a))), lambda b: total(F.slice(a, b * 64 + 1, F.lit(64))))
    in_block = lambda a, i: total(F.slice(a, block(i) * 64 + 1, i % 64))

    def sums(a: Column) -> Column:
        before = lambda own: let(totals(own), lambda larger: F.transform(own, lambda x, i: total(F.slice(larger, F.lit(1), block(i))) + in_block(own, i)))
        return let(let(totals(a), before), lambda own: F.transform(a, lambda x, i: F.get(own, block(i)) + in_block(a, i)))

    return let(a, sums)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """An array of start, end, match (of the group) for the leftmost non-overlapping matches."""
    p = F.lit(pattern)

    def spans(m: Column) -> Column:
        found, between = m["found"], m["between"]
        lengths = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, x: F.length(b) + F.length(x))
        parts = F.arrays_zip(prefix_sums(lengths).alias("sum"), found.alias("all"), m["group"].alias("group"), F.slice(between, F.lit(1), F.size(found)).alias("before"))
        at = lambda x: x["sum"] + F.length(x["before"])
        return F.transform(parts, lambda x: F.struct(at(x).alias("start"), (at(x) + F.length(x["all"])).alias("end"), x["group"].alias("match")))

    whole = F.struct(F.regexp_extract_all(text, p, 0).alias("found"), F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, p, group).alias("group"))
    # most texts have none: one search settles that
    return F.when(F.rlike(text, p), let(whole, spans)).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))


def base_spans(text: Column) -> Column:
    """start, kind (its place in KINDS), end, sorted."""
    def of(kind: int, pattern: str, group: int, least: int) -> Column:
        quick = {"access": LONG_ACCESS, "hex": LONG_HEX}.get(KINDS[kind], pattern)  # greedy runs: the same spans
        fit = F.filter(matches(text, quick, group), lambda m: F.length(m["match"]) >= least)
        return F.transform(fit, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    out = [of(i, *x) for i, x in enumerate(PATTERNS.values())]
    return F.array_sort(F.concat(*out))


def upper_tail(z: Column) -> Column:
    """An upper bound of the normal upper tail, close for z > 0; 1 below."""
    return F.when(z > 0, 4 * F.exp(-z * z / 2) / (3 * z + F.sqrt(z * z + 8)) / 2.5066282746310002).otherwise(F.lit(1.0))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def unmixed(m: Column) -> Column:
    """m (start, end, match), or its parts of 20 characters or more if no encoding fits it: those between slashes, and
    where these are still mixed or too short, those between dashes and underscores."""
    mixed = lambda x: F.rlike(x["match"], F.lit("[+/]")) & F.rlike(x["match"], F.lit("[_-]"))

    def parts(x: Column, pattern: str) -> Column:
        return F.transform(matches(x["match"], pattern), lambda p: F.struct((x["start"] + p["start"]).alias("start"), (x["start"] + p["end"]).alias("end"), p["match"].alias("match")))

    def finer(found: Column) -> Column:
        own = F.flatten(F.transform(found, lambda x: F.when(mixed(x), parts(x, "[A-Za-z0-9+]{20,}")).otherwise(F.array(x))))
        return F.when(F.size(found) > 0, own).otherwise(parts(m, "[A-Za-z0-9+/]{20,}"))

    return F.when(mixed(m), let(parts(m, "[A-Za-z0-9+_-]{20,}"), finer)).otherwise(F.array(m))


def candidates(text: Column) -> Column:
    """start, end, stratum, bin (of the p-value), random (chi-squared is not beyond a uniform sequence) of each candidate."""
    found = F.filter(F.flatten(F.transform(matches(text, CANDIDATE), unmixed)), lambda m: ~F.rlike(m["match"], F.lit(r"^(.)\1*$")))

    def encoded(m: Column) -> Column:
        t = m["match"]
        number = F.lit(-1)  # none fits
        for i, (pattern, _) in reversed(list(enumerate(ENCODINGS.values()))):
            number = F.when(F.rlike(t, F.lit(pattern)), i).otherwise(number)
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), t.alias("t"), number.alias("e"))

    def counted(m: Column) -> Column:
        alphabet, folded = F.lit(""), m["t"]
        for i, (_, letters) in enumerate(ENCODINGS.values()):
            alphabet = F.when(m["e"] == i, letters).otherwise(alphabet)
        one_case = m["e"].isin([list(ENCODINGS).index(x) for x in ONE_CASE])
        folded = F.when(one_case, F.lower(m["t"])).otherwise(m["t"])
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["e"].alias("e"), folded.alias("t"), alphabet.alias("a"))

    def numbered(m: Column) -> Column:
        n = F.length(m["t"])
        squares = F.transform(F.sequence(F.lit(1), F.length(m["a"])), lambda i: F.pow((n - F.length(F.replace(m["t"], F.substring(m["a"], i, F.lit(1)), F.lit("")))).cast("double"), F.lit(2.0)))
        half = F.length(m["a"]).cast("double") / 2
        values = F.transform(F.sequence(F.lit(1), n), lambda i: F.instr(m["a"], F.substring(m["t"], i, F.lit(1))) - 0.5 - half)
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["e"].alias("e"), n.cast("double").alias("n"), F.length(m["a"]).cast("double").alias("k"), _sum(squares).alias("sq"), values.alias("v"))

    def summed(m: Column) -> Column:
        v, n = m["v"], m["n"]
        mean = _sum(v) / n
        pairs = F.zip_with(F.slice(v, F.lit(1), n.cast("int") - 1), F.slice(v, F.lit(2), n.cast("int") - 1), lambda x, y: F.struct((x * y).alias("xy"), F.when((x > 0) != (y > 0), 1.0).otherwise(0.0).alias("turn"), (x + y).alias("s")))
        high = _sum(F.transform(v, lambda x: F.when(x > 0, 1.0).otherwise(0.0)))
        return F.struct(*(m[x].alias(x) for x in ("start", "end", "e", "n", "k", "sq")), mean.alias("mean"), _sum(F.transform(v, lambda x: x * x)).alias("vv"), _sum(F.transform(pairs, lambda p: p["xy"])).alias("xy"), _sum(F.transform(pairs, lambda p: p["s"])).alias("s"), (_sum(F.transform(pairs, lambda p: p["turn"])) + 1).alias("runs"), high.alias("high"))

    def tested(m: Column) -> Column:
        n, k = m["n"], m["k"]
        chi = k / n * m["sq"] - n
        equal2 = F.when(m["e"] == 0, 0.1).otherwise(EQUAL2)
        expected = k + k * (n - 1) * equal2 - n
        deviation = k / n * F.sqrt(4 * n * (n - 1) * (n - 2) * (EQUAL3 - EQUAL2**2) + 2 * n * (n - 1) * (equal2 - equal2 * equal2))
        even = upper_tail((expected - chi) / deviation)
        uneven = (chi - (k - 1)) / F.sqrt(2 * (k - 1))
        variance = m["vv"] - n * m["mean"] * m["mean"]
        serial = F.when(variance > 0, (m["xy"] - m["mean"] * m["s"] + (n - 1) * m["mean"] * m["mean"]) / variance * F.sqrt(n)).otherwise(F.lit(99.0))
        low = n - m["high"]
        expected_runs = 2 * m["high"] * low / n + 1
        spread = (expected_runs - 1) * (expected_runs - 2) / (n - 1)
        turns = F.when(spread > 0, (m["runs"] - expected_runs) / F.sqrt(spread)).otherwise(F.lit(99.0))
        # p over the likelihood ratios of both deviates
        unlike = lambda z: F.exp(F.pow(F.least(F.abs(z), F.lit(STEEPEST)), F.lit(2.0)) / 2 * (1 - 1 / SPREAD**2)) / SPREAD
        p = F.least(F.lit(1.0), even * unlike(serial) * unlike(turns))
        band = reduce(lambda x, y: x + y, [F.when(n >= b, 1).otherwise(0) for b in BANDS])
        return F.struct(
            m["start"].alias("start"), m["end"].alias("end"), (m["e"] * 10 + band).alias("stratum"),
            F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-50))) * PER_DECADE), F.lit(50 * PER_DECADE)).cast("int").alias("bin"),
            (uneven < DEVIATES).alias("random"),
        )

    out = found
    for step in (encoded, counted, numbered, summed, tested):
        out = F.transform(out, step)
        out = F.filter(out, lambda m: m["e"] >= 0) if step is encoded else out
    return out


def scanned(docs: DataFrame) -> DataFrame:
    """docs with _base and _candidates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn("_base", base_spans(text)).withColumn("_candidates", candidates(text))


def thresholds(scans: DataFrame) -> dict[int, int]:
    """stratum -> least bin that is a discovery. A row for each stratum and bin at most leaves Spark's tasks."""
    tests = scans.select(F.explode("_candidates").alias("c")).select("c.*")
    bins = tests.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    ranked = bins.withColumn("found", F.sum("n").over(down)).withColumn("tests", F.sum("n").over(Window.partitionBy("stratum")))
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / PER_DECADE) * F.col("tests") / F.col("found") <= Q)
    return {r.stratum: r.bin for r in passed.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def all_spans(least: dict[int, int]) -> Column:
    """_base and the candidates that are discoveries and lie in no base span, sorted."""
    found = F.col("_candidates")
    if least:
        table = F.create_map(*[F.lit(x) for k, v in least.items() for x in (k, v)])
        bound = lambda c: F.coalesce(F.try_element_at(table, c["stratum"]), F.lit(1 << 30))
        fit = F.filter(found, lambda c: c["random"] & (c["bin"] >= bound(c)) & ~F.exists("_base", lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"])))
        more = F.transform(fit, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end")))
        return F.array_sort(F.concat("_base", more))
    return F.col("_base")


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scans = written(scanned(docs).drop("text"), "secrets")
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return scans.select("doc_id", *(count(k) for k in PATTERNS), F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(all_spans(thresholds(scans))).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with `mark` in the place of each secret of `text`; spans that overlap count as one."""
    scans = written(scanned(docs.select(whole_row(docs), "text")).drop("text"), "secrets")
    spans = all_spans(thresholds(scans))
    # from the end on, so that positions hold; [start, end] of what is merged so far comes first
    merged = F.aggregate(
        "spans", F.array().cast("array<struct<start:int,end:int>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.get(done, F.lit(0))["end"] > s["start"]),
            F.concat(F.array(F.struct(F.get(done, F.lit(0))["start"].alias("start"), F.greatest(F.get(done, F.lit(0))["end"], s["end"]).alias("end"))), F.slice(done, F.lit(2), F.greatest(F.size(done) - 1, F.lit(0)))))
        .otherwise(F.concat(F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))), done)),
    )
    clean = F.aggregate("merged", F.col("row.text"), lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), F.lit(mark), F.substring(t, s["end"] + 1, F.lit(2147483647))))
    own = scans.select("row", spans.alias("spans")).withColumn("merged", merged)
    text = F.when(F.size("merged") > 0, clean).otherwise(F.col("row.text")).alias("text")
    return own.select(*(text if c == "text" else F.col("row.`" + c.replace("`", "``") + "`") for c in docs.columns))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; n_chars follows the text."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))
