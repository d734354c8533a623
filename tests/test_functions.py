import datetime as dt

import pytest
from pyspark.sql import functions as F

from recordspark.functions import VERBS, call, register
from recordspark.operators import documents, frames, mapping, schema_text, validation
from recordspark.sources import formats
from recordspark.streaming import windows

CASES = [
    ("soundex", ["Ashcraft"], "A226"), ("soundex", ["123"], "0000"), ("mask", ["5551234567", "(###) ###-####"], "(555) 123-4567"), ("mask", ["12", "#-#-#"], "1-2"),
    ("formatPhone", ["1 555 123 4567", "US"], "(555) 123-4567"), ("formatPhone", ["12", "US"], "12"), ("camelCase", ["hello_world-foo barBaz"], "helloWorldFooBarBaz"), ("slugify", [" Crème Brûlée! "], "creme-brulee"),
    ("stripAccents", ["Ünïcödé"], "Unicode"), ("pad", ["ab", 5, "*"], "*ab**"), ("truncate", ["abcdefgh", 5, "..."], "ab..."), ("split", ["a,b,c", ",", -1], "c"), ("titleCase", ["hello\tbIG world"], "Hello BIG World"),
    ("substring", ["hello", -2, 2], "he"), ("formatDuration", ["P1Y2DT3H"], "1 year, 2 days, 3 hours"), ("formatDuration", ["PT0S"], "0 seconds"), ("convertUnit", [100, "C", "F"], 212.0), ("convertUnit", [1, "kg", "m"], None),
    ("round", [-2.5], -3.0), ("mod", [-7.5, 2], -1.5), ("parseInt", ["12.7"], 12), ("coerceBoolean", [" No "], False), ("crc32", ["hello"], "3610a686"), ("urlEncode", ["a b~*"], "a%20b~%2A"), ("urlDecode", ["a+b%20c"], "a+b c"),
    ("base64Decode", ["aGVsbG8="], "hello"), ("jsonPath", ['{"a":{"b":[1,2]}}', "a.b[1]"], "2"), ("isLeapYear", [2000], True), ("dateDiff", ["2024-01-31", "2024-03-01", "months"], 2), ("businessDays", ["2024-06-14", 1], dt.date(2024, 6, 17)),
    ("businessDays", ["2024-06-17", -1], dt.date(2024, 6, 14)), ("businessDays", ["2024-06-15", -1], dt.date(2024, 6, 14)), ("nextBusinessDay", ["2024-06-15"], dt.date(2024, 6, 17)), ("weekOfYear", ["2024-12-31"], 53), ("addMonths", ["2024-01-31", 1], dt.date(2024, 2, 29)),
    ("isValidDate", ["2023-02-29"], False), ("ageFromDate", ["2000-06-16", "2024-06-15"], 23), ("eq", ["1", 1.0], True), ("eq", [None, None], True), ("ne", ["a", "b"], True), ("not", [""], True), ("xor", [True, False], True), ("ifEmpty", ["", "x"], "x"),
    ("coalesce", [None, "", "z"], "z"), ("typeOf", [3], "integer"), ("isString", ["a"], True), ("isArray", ["[1]"], True), ("pmt", [1000, 0, 10], 100.0), ("nper", [0, 10, -100], 10.0), ("isFinite", [1], True), ("isNaN", ["x"], True),
    ("padLeft", ["abcdef", 3, "0"], "abcdef"), ("extract", ["a1-b2", r"(\w)(\d)"], ["a", "1"]), ("clamp", [5, 0, 3], 3.0), ("formatPercent", [0.256, 1], "25.6%"), ("hexDecode", ["68656c6c6f"], "hello"), ("rightOf", ["a=b=c", "="], "b=c"),
]


@pytest.mark.parametrize("name,args,expected", CASES)
def test_values(spark, name, args, expected):
    out = spark.range(1).select(call(name, *args).alias("x")).first().x
    assert out == pytest.approx(expected) if isinstance(expected, float) else out == expected


ARRAYS = [
    ("movingAvg", [2], [1.0, 2.0, 3.5, 2.5]), ("rank", [], [3, 2, 1, 3]), ("slice", [-2], [4, 1]), ("slice", [1, 3], [3, 4]), ("at", [-1], 1), ("at", [9], None), ("chunk", [3], [[1, 3, 4], [1]]), ("mode", [], 1), ("median", [], 2.0),
    ("cumprod", [], [1.0, 3.0, 12.0, 12.0]), ("diff", [], [None, 2.0, 1.0, -3.0]), ("shift", [-1], [3, 4, 1, None]), ("indexOf", [7], -1), ("findIndex", [None, ">", 2], 1), ("partition", [None, ">", 2], [[3, 4], [1, 1]]), ("dedupe", [], [1, 3, 4, 1]),
    ("percentile", [30], 1.0), ("stdSample", [], 1.5), ("take", [-1], []), ("distinct", [], [1, 3, 4]), ("sortDesc", [], [4, 3, 1, 1]), ("pctChange", [], [None, 2.0, pytest.approx(1 / 3), -0.75]),
]


@pytest.mark.parametrize("name,args,expected", ARRAYS)
def test_arrays(spark, name, args, expected):
    assert spark.sql("select array(1, 3, 4, 1) a").select(call(name, F.col("a"), *args).alias("x")).first().x == expected


def test_ranges_maps_and_gaps(spark):
    row = spark.sql("select array(named_struct('k','a','v',1), named_struct('k','b','v',2), named_struct('k','a','v',3)) r, array(null, 1, null) g, map('a', 1) m, map('a', 2, 'b', 3) n")
    out = row.select(
        call("range", 5).alias("up"), call("range", 3, 0, -1).alias("down"), call("range", 0).alias("none"), call("pivot", F.col("r"), "k", "v").alias("p"), call("groupBy", F.col("r"), "k").alias("by"), call("fillMissing", F.col("g"), "forward").alias("f"),
        call("fillMissing", F.col("g"), "backward").alias("b"), call("merge", F.col("m"), F.col("n")).alias("mn"), call("sortBy", F.col("r"), "v").alias("s"), call("entries", F.col("m")).alias("e"),
    ).first()
    assert (out.up, out.down, out.none, out.p, out.f, out.b, out.mn) == ([0, 1, 2, 3, 4], [3, 2, 1], [], {"b": 2, "a": 3}, [None, 1, 1], [1, 1, None], {"a": 2, "b": 3})
    assert [len(x) for x in out["by"].values()] == [2, 1] and [x.v for x in out.s] == [1, 2, 3] and out.e == [["a", "1"]]


def test_seeds_and_own_functions(spark):
    register("shout", lambda s: F.concat(F.upper(s), F.lit("!")))
    try:
        row = spark.range(1).select(call("uuid", "x").alias("a"), call("uuid", "x").alias("b"), call("nanoid", 10).alias("n"), call("shout", F.lit("hi")).alias("s"), call("unknown", "same").alias("u"), call("random", 1, 6, "s").alias("r")).first()
    finally:
        del VERBS["shout"]
    assert row.a == row.b and row.a[14] == "5" and len(row.n) == 10 and row.s == "HI!" and row.u == "same" and 1 <= row.r <= 6


def test_specification_errors_and_loops(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id long, xs array<string>")
    rows = mapping.apply(df, "{Out[]}\n_loop = @xs\n_ = %upper @_item\n{One}\nmissing = @nope\nnested.a = ##1", keep=["id"]).orderBy("id").collect()
    assert rows[0].Out == ["A", "B"] and rows[1].Out == [] and rows[0].One.missing is None and rows[0].One.nested.a == 1
    with pytest.raises(ValueError, match="in no section"):
        mapping.parse("a = b")
    with pytest.raises(ValueError, match="function"):
        mapping.apply(df, "{X}\na = %nothing @id")


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"', 1.5, True), (2, None, None, False)], "id long, name string, x double, ok boolean")
    for form in ("json", "csv", "native", "flat"):
        formats.write(df, str(tmp_path / form), form)
    assert {tuple(r) for r in formats.read_json(spark, str(tmp_path / "json"), "id long, name string, x double, ok boolean").collect()} == {tuple(r) for r in df.collect()}
    assert {tuple(r) for r in formats.read_csv(spark, str(tmp_path / "csv"), "id long, name string, x double, ok boolean").collect()} == {tuple(r) for r in df.collect()}
    flat = formats.read_flat(spark, str(tmp_path / "flat")).select("path", "type", "value").collect()
    assert ("x", "number", "1.5") in [tuple(r) for r in flat]
    formats.write(df.select("id", "x"), str(tmp_path / "fixed"), "fixed-width", columns="id:0:4;x:6:5")
    assert sorted(tuple(r) for r in formats.read_fixed_width(spark, str(tmp_path / "fixed"), "id:0:4;x:6:5").collect()) == [("1", "  1.5"[2:]), ("2", "")]
    (tmp_path / "a.yaml").write_text("person:\n  name: Alice # her\n  age: 30\n  tags:\n    - x\n    - k: 1\n      m: ~\n")
    rows = {(r.path, r.type, r.value) for r in formats.read_yaml(spark, str(tmp_path / "a.yaml")).collect()}
    assert rows == {("person.name", "string", "Alice"), ("person.age", "integer", "30"), ("person.tags[0]", "string", "x"), ("person.tags[1].k", "integer", "1"), ("person.tags[1].m", "null", None)}
    (tmp_path / "a.xml").write_text('<r><p id="1"><n>A</n></p><p id="2"><n>B</n></p></r>')
    assert sorted(r["n"] for r in formats.read_xml(spark, str(tmp_path / "a.xml"), "p").collect()) == ["A", "B"]


def test_violations(spark):
    df = spark.createDataFrame([(1, "a@b.co", [1, 1]), (2, "nope", []), (2, None, None)], "id long, mail string, xs array<int>")
    schema = validation.Schema([validation.Field("id", "integer", unique=True), validation.Field("mail", required=True, format="email"), validation.Field("xs", unique=True, min_items=1), validation.Field("gone", required=True)], strict=True)
    found = sorted((r.id, r.code, r.path) for r in validation.violations(df, schema, "id").collect())
    assert found == sorted([(1, "V001", "gone"), (2, "V001", "gone"), (2, "V001", "gone"), (1, "V007", "xs"), (2, "V004", "mail"), (2, "V006", "xs"), (2, "V001", "mail"), (2, "V007", "id"), (2, "V007", "id")])
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "e")], "n string, t string")
    assert {r.node for r in validation.circular(edges, "n", "t").collect()} == {"b", "c"}
    many = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a"), ("c", "d"), *((f"x{i}", f"x{i + 1}") for i in range(300)), ("p", "q"), ("q", "r"), ("r", "p"), ("r", "s"), ("z", "z")], "n string, t string")
    assert {r.node for r in validation.circular(many, "n", "t").collect()} == {"a", "b", "p", "q", "r", "z"}


SCHEMA_TEXT = """
; people
{$}
strict = true
@Address
city = !""
zip = "" :format zip
@Home : Address
since = date
{Person}
name = !"" :(1..40)
age = ##:(0..150)
score = # | ""
kind = (one, two)
code = :/^[A-Z]{3}$/
home = @Home
phone = "" :if kind = one
:invariant age >= 0
:exactly_one (name, phone)
:of (1..) (age, kind)
{Person.tags[]}
:(1..5) :unique
"""


def test_schema_text(spark):
    schema = schema_text.parse_schema(SCHEMA_TEXT)
    assert schema.strict and schema.types["Home"].parents == ["Address"]
    by = {f.path: f for f in schema.fields}
    assert by["Person.name"].required and (by["Person.age"].low, by["Person.age"].high) == (0, 150) and by["Person.kind"].enum == ["one", "two"]
    assert by["Person.score"].type == "number|string" and by["Person.phone"].when == [("Person.kind", "=", "one")] and by["Person.code"].pattern == "^[A-Z]{3}$"
    assert by["Person.tags"].unique and by["Person.tags"].max_items == 5 and schema.cardinality[0] == (["Person.name", "Person.phone"], 1, 1)
    assert schema_text.parse_schema(schema_text.schema_text(schema)) == schema
    flat = {f.path for f in schema_text.flattened(schema).fields}
    assert {"Person.home.city", "Person.home.zip", "Person.home.since"} <= flat
    rows = [(1, ("Ann", 30, "one", "ABC", ("X", "12345", None), "123", ["a"])), (2, (None, -1, "three", "abc", (None, "1", None), None, ["a", "a"])), (3, ("Bob", 3, "one", "ABC", ("Y", "12345", None), None, []))]
    df = spark.createDataFrame(rows, "id long, Person struct<name string, age int, kind string, code string, home struct<city string, zip string, extra string>, phone string, tags array<string>>")
    found = sorted((r.id, r.code, r.path) for r in validation.violations(df, schema_text.flattened(schema), "id").collect())
    strict = [(i, "V011", p) for i in (1, 2, 3) for p in ("id", "Person.home.extra")]
    assert found == sorted([*strict, (1, "V009", "Person.name,Person.phone"), (2, "V001", "Person.name"), (2, "V003", "Person.age"), (2, "V005", "Person.kind"), (2, "V004", "Person.code"), (2, "V004", "Person.home.zip"), (2, "V008", "Person.age >= 0"),
        (2, "V009", "Person.name,Person.phone"), (2, "V007", "Person.tags"), (3, "V010", "Person.phone"), (3, "V006", "Person.tags")])


def test_schema_imports():
    files = {"a": "@import b as x\n@Own : x.Base\nown = ##", "b": "@Base\nid = !##", "c": "@import d", "d": "@import c"}
    schema = schema_text.parse_schema("@import a\n{T}\nv = @Own", files.__getitem__)
    assert set(schema.types) == {"x.Base", "Own"} and [f.path for f in schema_text.flattened(schema).fields] == ["T.v.id", "T.v.own"]
    with pytest.raises(ValueError, match="circle"):
        schema_text.parse_schema("@import c", files.__getitem__)
    with pytest.raises(ValueError, match="within itself"):
        schema_text.flattened(schema_text.parse_schema("@A\nx = @A\n{T}\na = @A"))
    with pytest.raises(ValueError, match="isn't known"):
        schema_text.flattened(schema_text.parse_schema("{T}\na = @Nope"))


def test_formats_and_patterns(spark):
    good = {"currency-code": "EUR", "country-alpha2": "DE", "country-alpha3": "DEU", "state-us": "TX", "email": "a@b.co", "url": "https://a.b/c", "uuid": "123e4567-e89b-12d3-a456-426614174000", "ssn": "123-45-6789", "vin": "1HGCM82633A004352", "phone": "+1 (555) 123-4567",
        "zip": "12345-6789", "ipv4": "192.168.0.1", "ipv6": "2001:db8::1", "creditcard": "4111 1111 1111 1111", "date-iso": "2024-02-29", "naic": "12345", "fein": "12-3456789"}
    bad = {"currency-code": "ZZZ", "country-alpha2": "QQ", "country-alpha3": "QQQ", "state-us": "ZZ", "email": "a.b", "url": "ftp:/x", "uuid": "123", "ssn": "000-45-6789", "vin": "IOQ", "phone": "12", "zip": "1234", "ipv4": "256.1.1.1", "ipv6": "1::2::3", "creditcard": "4111111111111112",
        "date-iso": "2023-02-29", "naic": "1", "fein": "1"}
    row = spark.range(1).select(*(validation.matches_format(F.lit(v), k).alias(f"good {k}") for k, v in good.items()), *(validation.matches_format(F.lit(v), k).alias(f"bad {k}") for k, v in bad.items())).first().asDict()
    assert len(good) == 17 and {k for k, v in row.items() if v != k.startswith("good")} == set()
    assert validation.risky("(a+)+b") and validation.risky("a" * 2000) and validation.risky("(" * 11 + ")" * 11) and not validation.risky(r"^Customer#\d+$")


def test_moves_and_patches(spark):
    old = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "k long, path string, value string")
    new = spark.createDataFrame([(1, "c", "x"), (1, "b", "z")], "k long, path string, value string")
    changes = documents.difference(old, new, "k")
    assert {(r.op, r.path) for r in changes.collect()} == {("moved", "c"), ("changed", "b")}
    assert {tuple(r) for r in documents.patch(old, changes, "k").collect()} == {tuple(r) for r in new.collect()}


def test_streams_agree_with_tables(spark, tmp_path):
    rows = [(f"2024-01-01 0{i % 6}:10:00", i % 3, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "ts string, k int, v double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    total = [F.sum("v").alias("v")]
    q = windows.windowed(stream, "ts", "1 hour", total, ["k"]).writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("hours").collect()} == {tuple(r) for r in windows.windowed(df, "ts", "1 hour", total, ["k"]).collect()}
    q = windows.accumulate(stream, "k", "v").writeStream.outputMode("update").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.k, r.n, r.total) for r in spark.table("sums").collect()} == {(r.k, r.n, r.total) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total")).collect()}


def test_frames_by_hand(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 7)
    rows = frames.row_numbers(df, ["g", "id"], partitions=5).orderBy("row_number").collect()
    assert [r.row_number for r in rows] == list(range(1, 1001)) and [(r.g, r.id) for r in rows] == sorted((i % 7, i) for i in range(1000))
    assert frames.sample_rows(df, 10, ["id"], "s").count() == 10
    small = spark.range(3).select((F.col("id") * 10).alias("x"))
    zipped = frames.zip_rows(small, small.where("x > 0").withColumnRenamed("x", "y"), ["x"], ["y"]).orderBy("position").collect()
    assert [(r.x, r.y) for r in zipped] == [(0, 10), (10, 20), (20, None)]


@pytest.mark.parametrize("partitions", [None, 16])
def test_numbers_of_wide_rows_have_no_gaps(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.range(120_000).select(F.xxhash64("id").alias("k"), "id", F.repeat(F.sha2(F.col("id").cast("string"), 512), 6).alias("payload"))
        out = frames.row_numbers(df, ["k"], partitions=partitions)
        sums = out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_number").alias("d"), F.min("row_number").alias("lo"), F.max("row_number").alias("hi"), F.sum(F.length("payload")).alias("p")).first()
        assert tuple(sums) == (120_000, 120_000, 1, 120_000, 120_000 * 768)
        wrong = out.join(out.select((F.col("row_number") + 1).alias("row_number"), F.col("k").alias("earlier")), "row_number").where("earlier >= k")
        assert wrong.count() == 0
        total = frames.prefix_sum(df, "id", ["k"], partitions=partitions).agg(F.max("prefix_sum"), F.countDistinct("prefix_sum"), F.count(F.lit(1))).first()
        assert (total[0], total[2]) == (sum(range(120_000)), 120_000) and total[1] >= 119_999  # id 0 adds nothing
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def soundex(word):
    code = {c: str(n) for n, cs in enumerate(("BFPV", "CGJKQSXZ", "DT", "L", "MN", "R"), 1) for c in cs}
    out, last = word[0], code.get(word[0])
    for c in word[1:]:
        if code.get(c) and code[c] != last:
            out += code[c]
        last = code.get(c)
    return (out + "000")[:4]


def test_digests_and_sounds_against_plain_python(spark):
    import hashlib
    import zlib

    rows = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.001/customer.parquet").select("c_name", "c_mktsegment").select(
        "*", call("crc32", F.col("c_name")).alias("crc"), call("sha512", F.col("c_name")).alias("sha"), call("soundex", F.col("c_mktsegment")).alias("sound")).collect()]
    assert rows
    for r in rows:
        assert r["crc"] == f"{zlib.crc32(r['c_name'].encode()):08x}" and r["sha"] == hashlib.sha512(r["c_name"].encode()).hexdigest() and r["sound"] == soundex(r["c_mktsegment"])


def test_builder(spark):
    rows = documents.Builder().set("a.b", 1).set("a.c", "x", "confidential").set("a.b", True).set("n", None).frame(spark)
    assert {tuple(r)[:3] for r in rows.collect()} == {("a.b", "boolean", "true"), ("a.c", "string", "x"), ("n", "null", None)}
