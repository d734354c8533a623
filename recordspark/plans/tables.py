"""Queries over written copies of tables in each format, validation, and what Spark's SQL brings along."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from recordspark.functions import call as v
from recordspark.functions import register
from recordspark.operators import documents, schema_text, validation
from recordspark.plans.values import query, table
from recordspark.sources import formats
from recordspark.storage import checkpoints
from recordspark.streaming import windows

SUPPLIERS = "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier"


def place(spark) -> str:
    return f"{checkpoints(spark).rstrip('/')}/copy-{uuid.uuid4().hex}"


def suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("long").alias("s_nationkey"), "s_acctbal")


SUPPLIER = "s_suppkey long, s_name string, s_nationkey long, s_acctbal double"


@query("csv_copy", SUPPLIERS)
def csv_copy(spark, sf_dir):
    at = place(spark)
    formats.write(suppliers(spark, sf_dir), at, "csv", delimiter="|")
    return formats.read(spark, at, "csv", schema=SUPPLIER, delimiter="|")


@query("json_copy", SUPPLIERS)
def json_copy(spark, sf_dir):
    at = place(spark)
    formats.write(suppliers(spark, sf_dir), at, "json", nulls="omit")
    return formats.read(spark, at, "json", schema=SUPPLIER)


@query("xml_copy", "select s_suppkey, s_name, s_nationkey, case when s_suppkey % 3 = 0 then null else s_acctbal end as s_acctbal from supplier")
def xml_copy(spark, sf_dir):
    at = place(spark)
    t = suppliers(spark, sf_dir).withColumn("s_acctbal", F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal"))).withColumnRenamed("s_suppkey", "@key")
    formats.write(t, at, "xml", row_tag="supplier")
    out = formats.read(spark, at, "xml", schema="`@key` long, s_name string, s_nationkey long, s_acctbal double", row_tag="supplier")
    return out.withColumnRenamed("@key", "s_suppkey")


@query("fixed_width_copy", "select s_suppkey, s_name, s_nationkey from supplier")
def fixed_width_copy(spark, sf_dir):
    at, columns = place(spark), "s_suppkey:0:10:leftPad=0;s_name:10:25;s_nationkey:36:4"
    formats.write(suppliers(spark, sf_dir), at, "fixed-width", columns=columns)
    out = formats.read(spark, at, "fixed-width", columns=columns)
    return out.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_nationkey").cast("long").alias("s_nationkey"))


@query("flat_copy", "select s_suppkey || ':' || key as k, value from (select s_suppkey, unnest(['s_suppkey', 's_name', 's_nationkey']) as key, unnest([s_suppkey::varchar, s_name, s_nationkey::varchar]) as value from supplier)")
def flat_copy(spark, sf_dir):
    at = place(spark)
    t = suppliers(spark, sf_dir).drop("s_acctbal")
    keyed = t.select(*[F.col(c).alias(f"{c}") for c in t.columns])
    # the key goes into the path, so that lines of all rows can be told apart
    lines = keyed.select(F.explode(F.array(*[F.struct(F.concat(F.col("s_suppkey").cast("string"), F.lit(f":{c}")).alias("k"), F.col(c).cast("string").alias("value")) for c in t.columns])).alias("a")).select("a.*")
    lines.select(F.concat_ws("=", "k", "value").alias("value")).write.text(at)
    return formats.read(spark, at, "flat").select(F.col("path").alias("k"), "value")


@query("native_copy", SUPPLIERS)
def native_copy(spark, sf_dir):
    at = place(spark)
    formats.write(suppliers(spark, sf_dir), at, "native")
    rows = formats.read(spark, at, "native")
    return rows.groupBy("document").agg(*[F.max(F.when(F.col("path") == c, F.col("value"))).cast(k).alias(c) for c, k in (x.split() for x in SUPPLIER.split(", "))]).drop("document")


@query("native_sections", "select s_suppkey as id, s_name as name, s_nationkey as code, s_suppkey * 2 as second, 'x' as first_tag, s_name as second_tag, 'v1' as version from supplier")
def native_sections(spark, sf_dir):
    t = suppliers(spark, sf_dir)
    text = F.concat(F.lit('{$}\nversion = "v1"\n{Supplier}\nname = "'), F.col("s_name"), F.lit('"\n{.Nation}\ncode = ##'), F.col("s_nationkey").cast("string"), F.lit('\n{Supplier.rows[] : key, .part}\n##1, "a, b"\n##'), (F.col("s_suppkey") * 2).cast("string"), F.lit(', ~\n{Supplier.tags[] : ~}\n"x"\n"'), F.col("s_name"), F.lit('"'))
    rows = formats.native_documents(t.select("s_suppkey", text.alias("text")), ["s_suppkey"], "text")
    at = lambda p: F.max(F.when(F.col("path") == p, F.col("value")))
    out = rows.groupBy("s_suppkey").agg(at("Supplier.name").alias("name"), at("Supplier.Nation.code").cast("int").alias("code"), at("Supplier.rows[1].key").cast("long").alias("second"), at("Supplier.tags[0]").alias("first_tag"), at("Supplier.tags[1]").alias("second_tag"), at("$.version").alias("version"))
    return out.withColumnRenamed("s_suppkey", "id")


@query("yaml_copy", "select s_suppkey, s_name, s_nationkey from supplier")
def yaml_copy(spark, sf_dir):
    at = place(spark)
    formats.write(suppliers(spark, sf_dir).drop("s_acctbal"), at, "flat", style="yaml")
    rows = formats.read(spark, at, "yaml")
    return rows.groupBy("document").agg(*[F.max(F.when(F.col("path") == c, F.col("value"))).cast(k).alias(c) for c, k in (("s_suppkey", "long"), ("s_name", "string"), ("s_nationkey", "int"))]).drop("document")


@query("exports", """
select s_suppkey, '{"type":"integer","value":' || s_suppkey || '}' as key, '{"type":"string","value":"' || s_name || '"}' as name, s_suppkey || ',"' || s_name || '"' as line from supplier""")
def exports(spark, sf_dir):
    t = suppliers(spark, sf_dir).select("s_suppkey", "s_name")
    typed = F.from_json(formats.export_json(t, types=True), "s_suppkey string, s_name string")
    return t.select("s_suppkey", typed["s_suppkey"].alias("key"), typed["s_name"].alias("name"), formats.export_csv(t, quote_all=True).alias("line"))


@query("ranking", """
select o_orderkey, dense_rank() over w as dense, ntile(4) over w as quarter, round(percent_rank() over w, 9) as share, round(cume_dist() over w, 9) as part, first_value(o_orderkey) over w as opened, nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as second
from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def ranking(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.dense_rank().over(w).alias("dense"), F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("share"), F.round(F.cume_dist().over(w), 9).alias("part"), F.first("o_orderkey").over(w).alias("opened"), F.nth_value("o_orderkey", 2).over(whole).alias("second"),
    )


@query("cube", "select l_returnflag, l_linestatus, count(*) as n, count(distinct l_suppkey) as suppliers from lineitem group by cube (l_returnflag, l_linestatus)")
def cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("grouping_sets", "select l_returnflag, l_linestatus, grouping(l_linestatus) as total, sum(l_quantity) as q from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    sets = t.groupingSets([[F.col("l_returnflag")], [F.col("l_linestatus")], []], "l_returnflag", "l_linestatus")
    return sets.agg(F.grouping("l_linestatus").cast("long").alias("total"), F.sum("l_quantity").alias("q"))


@query("approximate_distinct", "select l_returnflag, true as near from lineitem group by 1")
def approximate_distinct(spark, sf_dir):
    """An estimate within five hundredths of the exact number (relative standard deviation 0.01)."""
    # beside a countDistinct, Spark would keep a sketch for each pair of flag and key; distinct keys give the same sketch
    keys = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey").distinct()
    g = keys.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.01).alias("a"), F.count("l_orderkey").alias("e"))
    return g.select("l_returnflag", (F.abs(F.col("a") - F.col("e")) <= 0.05 * F.col("e")).alias("near"))


@query("sql_subqueries", """
with big as (select c_custkey, c_nationkey, c_acctbal from customer where c_acctbal > (select avg(c_acctbal) from customer))
select c_custkey, n_name, exists(select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000) as rich, (select count(*) from orders where o_custkey = c_custkey) as n from big join nation on n_nationkey = c_nationkey where c_nationkey in (select s_nationkey from supplier)""")
def sql_subqueries(spark, sf_dir):
    views = {x: table(spark, sf_dir, x) for x in ("customer", "orders", "nation", "supplier")}
    return spark.sql("""
        with big as (select c_custkey, c_nationkey, c_acctbal from {customer} where c_acctbal > (select avg(c_acctbal) from {customer}))
        select c_custkey, n_name, exists(select 1 from {orders} where o_custkey = c_custkey and o_totalprice > 300000) as rich, (select count(*) from {orders} where o_custkey = c_custkey) as n
        from big join {nation} on n_nationkey = c_nationkey where c_nationkey in (select s_nationkey from {supplier})""", **views)


@query("own_functions", "select c_custkey, upper(c_mktsegment) || '!' as loud, length(c_name) * 2 as doubled, c_custkey as passed from customer")
def own_functions(spark, sf_dir):
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("long")
    def double_length(s):  # whole batches at once
        return s.str.len() * 2

    register("shout", lambda s: F.concat(F.upper(s), F.lit("!")))
    register("doubleLength", lambda s: double_length(s))
    return table(spark, sf_dir, "customer").select("c_custkey", v("shout", F.col("c_mktsegment")).alias("loud"), v("doubleLength", F.col("c_name")).alias("doubled"), v("unknownName", F.col("c_custkey")).alias("passed"))


@query("table_function", "select p_partkey, unnest(string_split(p_name, ' ')) as word, generate_subscripts(string_split(p_name, ' '), 1) - 1 as at from part")
def table_function(spark, sf_dir):
    @udtf(returnType="at: int, word: string")
    class Words:
        def eval(self, s: str):
            yield from enumerate(s.split(" "))

    t = table(spark, sf_dir, "part")
    return t.lateralJoin(Words(F.col("p_name").outer())).select("p_partkey", "word", "at")


@query("own_aggregate", "select o_custkey, round(exp(avg(ln(o_totalprice))), 4) as geometric from orders group by 1")
def own_aggregate(spark, sf_dir):
    """An aggregate of one's own, from Spark's: partial sums before the shuffle."""
    geometric = lambda c: F.exp(F.avg(F.ln(c)))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(geometric(F.col("o_totalprice")), 4).alias("geometric"))


CUSTOMERS = """
{$}
strict = true
c_custkey = !##
c_name = !"" :(1..18) :/^Customer#/
c_nationkey = ##:(0..20)
c_acctbal = #
c_mktsegment = (BUILDING, MACHINERY)
c_note = "" :unless c_nationkey >= 10
c_code = "" :format country-alpha2
c_mixed = ## | ?
c_first = !""
{c_tags[]}
:(1..2) :unique
"""


@query("schema_validation", """
with c as (select c_custkey as k, c_nationkey as n, c_mktsegment as s, c_custkey % 5 as m from customer)
select k, 'V003' as code, 'c_nationkey' as path from c where n > 20 union all select k, 'V005', 'c_mktsegment' from c where s not in ('BUILDING', 'MACHINERY') union all select k, 'V010', 'c_note' from c where n < 10
union all select k, 'V004', 'c_code' from c where m = 0 union all select k, 'V002', 'c_mixed' from c where m = 1 union all select k, 'V001', 'c_first' from c where m = 2 union all select k, 'V006', 'c_tags' from c where m = 3 union all select k, 'V007', 'c_tags' from c where m = 4
union all select k, 'V011', 'c_extra.inner' from c union all select k, 'V003', 'c_name' from c where length('Customer#') + 9 > 18""")
def schema_validation(spark, sf_dir):
    m = F.col("c_custkey") % 5
    c = table(spark, sf_dir, "customer").withColumn("c_note", F.lit(None).cast("string")).withColumn("c_code", F.when(m == 0, "QQ").otherwise("DE")).withColumn("c_mixed", F.when(m == 1, "word").when(m == 2, "true").otherwise("12"))
    c = c.withColumn("c_first", F.when(m != 2, "x")).withColumn("c_tags", F.when(m == 3, F.array().cast("array<string>")).when(m == 4, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a")))).withColumn("c_extra", F.struct(F.lit(1).alias("inner")))
    text = CUSTOMERS.replace("{$}\nstrict = true\n", "")
    schema = schema_text.parse_schema(text)
    schema.strict = True
    return validation.violations(c, schema, "c_custkey").select(F.col("c_custkey").alias("k"), "code", "path")


@query("circular", "select n_nationkey as node, 'V012' as code from nation where n_nationkey < 8")
def circular(spark, sf_dir):
    """Nations 0 to 3 and 4 to 7 refer in circles, the others to a chain that starts there."""
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    ring = F.when(F.col("n_nationkey") < 8, F.floor(F.col("n_nationkey") / 4) * 4 + (F.col("n_nationkey") + 1) % 4)
    edges = n.select("n_nationkey", ring.cast("int").alias("to")).union(n.select("n_nationkey", F.when(F.col("n_nationkey") != 7, F.col("n_nationkey") + 1))).where("not (n_nationkey = 3 and to = 4)")
    return validation.circular(edges, "n_nationkey", "to").drop("message")


@query("typed_difference", """
with o as (select c_custkey as k, unnest(['c_name', 'c_nationkey', 'c_mktsegment']) as path, unnest([c_name, c_nationkey::varchar, c_mktsegment]) as old from customer)
select k, case path when 'c_nationkey' then 'changed' else 'modified' end as op, path, 'integer' as old_type, 'string' as new_type from o where path = 'c_nationkey' union all select k, 'modified', path, 'string', 'string' from o where path = 'c_name' and k % 7 = 0""")
def typed_difference(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_nationkey", "c_mktsegment")
    old = documents.typed_assignments(c, "k")
    new = documents.typed_assignments(c.withColumn("c_nationkey", F.col("c_nationkey").cast("string")), "k")
    new = new.withColumn("modifiers", F.when((F.col("path") == "c_name") & (F.col("k") % 7 == 0), F.array(F.lit("!"))).otherwise(F.col("modifiers")))
    return documents.typed_difference(old, new, "k").select("k", "op", "path", "old_type", "new_type")


@query("patch_errors", "select c_custkey as k, 'c_other' as path, 'no such path' as message from customer where c_custkey % 5 = 0")
def patch_errors(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    old = documents.assignments(c, "k")
    path = F.when(F.col("k") % 5 == 0, "c_other").otherwise("c_name")
    changes = old.select("k", F.lit("changed").alias("op"), path.alias("path"), F.lit(None).cast("string").alias("from_path"), F.col("value").alias("old"), F.lit("new").alias("new"))
    return documents.patch_errors(old, changes, "k")


@query("stream_windows", "select user_id, count(*) as n, sum(value_cents)::bigint as total from (select user_id, round(value * 100)::bigint as value_cents from events) group by 1")
def stream_windows(spark, sf_dir):
    """A stream over the events, read file by file to its end, as keyed running totals: the last row of each key."""
    at = place(spark)
    events = table(spark, sf_dir, "events").select("user_id", F.round(F.col("value") * 100).cast("long").alias("value"))
    events.repartition(3).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")

    def keep(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{at}/out")

    q = windows.accumulate(stream, "user_id", "value").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(f"{at}/out").groupBy("user_id").agg(F.max(F.struct("batch", "n", "total")).alias("x"))
    return last.select("user_id", "x.n", F.col("x.total").cast("long").alias("total"))


@query("native_stream", SUPPLIERS)
def native_stream(spark, sf_dir):
    """Documents as a stream of texts, parsed batch by batch."""
    at = place(spark)
    formats.write(suppliers(spark, sf_dir), f"{at}/in", "native")
    formats.stream_native(spark, f"{at}/in", lambda rows, number: rows.write.mode("append").parquet(f"{at}/out"), f"{at}/state").awaitTermination()
    rows = spark.read.parquet(f"{at}/out")
    return rows.groupBy("document").agg(*[F.max(F.when(F.col("path") == c, F.col("value"))).cast(k).alias(c) for c, k in (x.split() for x in SUPPLIER.split(", "))]).drop("document")


@query("paths", """
select o_orderkey as k, 'a.' || o_orderstatus || '[' || o_orderkey % 3 || ']' as parent, 'x' as leaf, '[' || o_orderkey % 3 || ']' as inner_leaf, 'a|' || o_orderstatus || '|[' || o_orderkey % 3 || ']|x' as steps, o_orderstatus = 'O' as within_, 'a.' || o_orderstatus || '[' || o_orderkey % 3 || '].x' as built, '' as top from orders""")
def paths(spark, sf_dir):
    status, place_ = F.col("o_orderstatus"), F.concat(F.lit("["), (F.col("o_orderkey") % 3).cast("string"), F.lit("]"))
    path = F.concat(F.lit("a."), status, place_, F.lit(".x"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), documents.parent(path).alias("parent"), documents.leaf(path).alias("leaf"), documents.leaf(documents.parent(path)).alias("inner_leaf"), F.array_join(documents.steps(path), "|").alias("steps"), documents.under(path, "a.O").alias("within_"),
        documents.joined_path(F.lit("a"), status, place_, F.lit("x")).alias("built"), documents.parent(F.lit("a")).alias("top"),
    )
