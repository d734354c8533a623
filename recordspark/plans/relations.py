"""Queries over whole frames: windows, joins, pivots, mappings, validation, documents, event time."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordspark.operators import documents, frames, mapping, validation
from recordspark.plans.values import Q, SQL, query, table
from recordspark.streaming import windows

ORDER = ["ts", "event_id"]


@query("running", """
select event_id, sum(value) over w as s, lag(value) over o as before, lead(value) over o as after, value - lag(value) over o as diff, rank() over (partition by user_id order by value desc) as rank,
  round(avg(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row), 6) as mean3, count(value) over w as n, min(value) over w as lo, max(value) over w as hi
from (select event_id, user_id, ts, round(value * 100)::bigint as value from events)
window o as (partition by user_id order by ts, event_id), w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)""")
def running(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("value", F.round(F.col("value") * 100).cast("long"))
    by = ["user_id"]
    e = frames.cumsum(e, "value", ORDER, by, out="s")
    e = frames.diff(frames.lead(frames.lag(e, "value", ORDER, by, out="before"), "value", ORDER, by, out="after"), "value", ORDER, by)
    e = frames.moving_avg(frames.rank(e, "value", by), "value", ORDER, by, out="mean3").withColumn("mean3", F.round("mean3", 6))
    for out, op in (("n", "count"), ("lo", "min"), ("hi", "max")):
        e = frames.running(e, out, "value", ORDER, by, op)
    return e.select("event_id", "s", "before", "after", "diff", "rank", "mean3", "n", "lo", "hi")


@query("fill_missing", """
with g as (select event_id, user_id, ts, case when event_id % 3 = 0 then null else value end as v from events)
select event_id, last_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as forward,
  first_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following) as backward, coalesce(v, -1) as constant from g""")
def fill_missing(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    for how, out in (("forward", "forward"), ("backward", "backward"), (-1.0, "constant")):
        e = frames.fill_missing(e, "v", ORDER, ["user_id"], how, out)
    return e.select("event_id", "forward", "backward", "constant")


@query("whole_order", """
select event_id, row_number() over (order by ts, event_id) as row_number, row_number() over (order by ts, event_id) - 1 as sequence, sum(round(value * 100)::bigint) over (order by ts, event_id) as prefix_sum from events""")
def whole_order(spark, sf_dir):
    """Counters and running totals over all rows, in parallel."""
    e = table(spark, sf_dir, "events").withColumn("v", F.round(F.col("value") * 100).cast("long"))
    e = frames.row_numbers(frames.prefix_sum(e, "v", ORDER), ORDER)
    return e.select("event_id", "row_number", (F.col("row_number") - 1).alias("sequence"), "prefix_sum")


@query("accumulators", "select count(*) as n, sum(round(o_totalprice * 100)::bigint) as total, min(o_orderkey) as lo, max(o_orderkey) as hi, arg_min(o_orderstatus, o_orderkey) as first, arg_max(o_orderstatus, o_orderkey) as last from orders")
def accumulators(spark, sf_dir):
    spec = """
    {_totals}
    n = count @o_orderkey
    total = sum @cents
    lo = min @o_orderkey
    hi = max @o_orderkey
    first = first @o_orderstatus
    last = last @o_orderstatus
    """
    return mapping.accumulators(table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("long")), spec, "o_orderkey")


@query("distinct_first", "select o_custkey, min(o_orderkey) as o_orderkey, arg_min(o_orderstatus, o_orderkey) as o_orderstatus from orders group by 1")
def distinct_first(spark, sf_dir):
    return frames.distinct_first(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])


@query("dedupe", "select event_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as b, row_number() over (partition by user_id order by ts, event_id) as n from events) where n = 1 or b is distinct from event_type")
def dedupe(spark, sf_dir):
    return frames.dedupe(table(spark, sf_dir, "events"), ["event_type"], ORDER, ["user_id"]).select("event_id", "event_type")


@query("mode", "with c as (select user_id, event_type, count(*) as n, min(event_id) as f from events group by 1, 2) select user_id, event_type as mode, n from (select *, row_number() over (partition by user_id order by n desc, f) as r from c) where r = 1")
def mode(spark, sf_dir):
    return frames.mode(table(spark, sf_dir, "events"), "event_type", "event_id", ["user_id"])


@query("pivot", "select l_returnflag, arg_max(l_quantity, (l_orderkey * 1000 + l_linenumber) * 1000000 + l_partkey) filter (l_linestatus = 'O') as O, arg_max(l_quantity, (l_orderkey * 1000 + l_linenumber) * 1000000 + l_partkey) filter (l_linestatus = 'F') as F from lineitem group by 1")
def pivot(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").withColumn("at", (F.col("l_orderkey") * 1000 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey"))
    return frames.pivot(t, ["l_returnflag"], "l_linestatus", "l_quantity", "at", ["O", "F"])


@query("unpivot", "select c_custkey, 'nation' as field, c_nationkey::varchar as value from customer union all select c_custkey, 'segment', c_mktsegment from customer")
def unpivot(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return frames.unpivot(t, ["c_custkey"], ["nation", "segment"], "field")


@query("chunks", "select user_id, (n - 1) // 5 as chunk, count(*) as n from (select user_id, row_number() over (partition by user_id order by ts, event_id) as n from events) group by 1, 2")
def chunks(spark, sf_dir):
    return frames.chunks(table(spark, sf_dir, "events"), ORDER, 5, ["user_id"]).groupBy("user_id", "chunk").agg(F.count(F.lit(1)).alias("n"))


@query("group_rows", "select o_custkey, array_to_string(list(o_orderkey order by o_orderkey), ',') as orders from orders group by 1")
def group_rows(spark, sf_dir):
    g = frames.group_rows(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])
    return g.select("o_custkey", F.array_join(F.transform("rows", lambda r: r["o_orderkey"].cast("string")), ",").alias("orders"))


@query("filters", "select p_partkey, p_size from part where p_size >= 10 and p_type like '%PROMO%'")
def filters(spark, sf_dir):
    return frames.filter_rows(frames.filter_rows(table(spark, sf_dir, "part"), "p_size", ">=", 10), "p_type", "contains", "PROMO").select("p_partkey", "p_size")


@query("lookup_join", "select c_custkey, coalesce(n_name, 'none') as nation from customer left join (select * from nation where n_nationkey < 20) on c_nationkey = n_nationkey")
def lookup_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_nationkey < 20")
    return frames.lookup_join(table(spark, sf_dir, "customer"), n, {"c_nationkey": "n_nationkey"}, "n_name", "nation", "none", order="n_nationkey").select("c_custkey", "nation")


@query("as_of_join", """
select l.event_id, r.event_id as last_view from events l asof left join (select * from events where event_type = 'view') r on l.user_id = r.user_id and l.ts >= r.ts where l.event_type = 'purchase'""")
def as_of_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("last_view"))
    return frames.as_of_join(left, right, ["user_id"], "ts", "ts", ["last_view"]).select("event_id", "last_view")


@query("interval_join", "select p_partkey, s_suppkey from part join supplier on p_retailprice between s_acctbal and s_acctbal + 50")
def interval_join(spark, sf_dir):
    ranges = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 50).alias("high"))
    return frames.interval_join(table(spark, sf_dir, "part"), ranges, "p_retailprice", "low", "high", 50.0).select("p_partkey", "s_suppkey")


@query("semi_anti", "select c_custkey, exists(select 1 from orders where o_custkey = c_custkey) as has from customer")
def semi_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders")
    on = c["c_custkey"] == o["o_custkey"]
    return c.join(o, on, "left_semi").withColumn("has", F.lit(True)).unionByName(c.join(o, on, "left_anti").withColumn("has", F.lit(False)))


@query("rollup", "select l_returnflag, l_linestatus, count(*) as n, count(distinct l_suppkey) as suppliers, sum(l_quantity) as q from lineitem group by rollup (l_returnflag, l_linestatus)")
def rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.sum("l_quantity").alias("q"))


@query("top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("set_operations", "(select c_nationkey as n from customer intersect select s_nationkey from supplier) union all (select n_nationkey from nation except select c_nationkey from customer)")
def set_operations(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n")), table(spark, sf_dir, "supplier").select("s_nationkey")
    return c.intersect(s).union(table(spark, sf_dir, "nation").select("n_nationkey").subtract(c))


SPEC = """
{$}
enforceConfidential = "mask"
{$const}
rate = #1.1
{$table.status[code, name]}
"O", "open"
"F", "filled"
{Order}
_pass = ##1
Id = "@o_orderkey :type integer"
Priority = "%upper @o_orderpriority :trim :truncate ##8"
Gross = "%multiply @o_totalprice $const.rate :decimals ##2"
Status = %lookupDefault "status.name" @o_orderstatus "other"
Owner.Code = "@o_orderpriority :confidential"
Owner.Number = "@o_custkey :type integer :confidential"
{Large}
_if = %gt @o_totalprice #200000
Price = @o_totalprice
{Lines[]}
_loop = @lines
Part = @_item.part
Index = @_index
{Summary}
_pass = ##2
Label = %concat @Order.Status "/" %length @Order.Owner.Code
"""


@query("mapping", """
select o_orderkey as id, upper(trim(o_orderpriority))[:8] as priority, round(cast((o_totalprice * 1.1)::varchar as decimal(38, 15)), 2)::double as gross, case o_orderstatus when 'O' then 'open' when 'F' then 'filled' else 'other' end as status, repeat('*', length(o_orderpriority)) as owner, null::varchar as owner_number,
  case when o_totalprice > 200000 then o_totalprice end as large, coalesce(n, 0) as n_lines, coalesce(s, 0) as parts, case o_orderstatus when 'O' then 'open' when 'F' then 'filled' else 'other' end || '/' || length(o_orderpriority) as label
from orders left join (select l_orderkey, count(*) as n, sum(l_partkey)::bigint as s from lineitem group by 1) on l_orderkey = o_orderkey""")
def mapped(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("part"))).alias("lines"))
    out = mapping.apply(o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left"), SPEC)
    return out.select(
        F.col("Order.Id").alias("id"), F.col("Order.Priority").alias("priority"), F.col("Order.Gross").alias("gross"), F.col("Order.Status").alias("status"), F.col("Order.Owner.Code").alias("owner"), F.col("Order.Owner.Number").alias("owner_number"), F.col("Large.Price").alias("large"),
        F.size("Lines").alias("n_lines"), F.aggregate("Lines", F.lit(0).cast("bigint"), lambda s, x: s + x["Part"]).alias("parts"), F.col("Summary.Label").alias("label"),
    )


@query("routing", "select 'A' as kind, count(*) as n, sum(o_orderkey) as total from orders where o_orderstatus in ('O', 'P') union all select 'B', count(*), sum(o_orderkey) from orders where o_orderstatus = 'F'")
def routing(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").select(F.concat("o_orderstatus", F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("line"))
    spec = '{_root}\nkey = "@line :pos ##1 :len ##12 :type integer"'
    parts = mapping.route(lines, F.substring("line", 1, 1), {"O,P": spec, "F": spec})
    sums = [df.agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("total")).select(F.lit(k).alias("kind"), "n", "total") for k, df in zip("AB", parts.values(), strict=True)]
    return sums[0].union(sums[1])


SCHEMA = validation.Schema(
    [
        validation.Field("c_custkey", "integer", required=True, unique=True), validation.Field("c_name", pattern=r"^Customer#\d+$", high=18), validation.Field("c_acctbal", "number", low=0, high=9000),
        validation.Field("c_mktsegment", enum=["BUILDING", "MACHINERY"]), validation.Field("c_phone", when=[("c_nationkey", "<", 5)]), validation.Field("c_nationkey", "integer"),
    ],
    invariants=["c_acctbal + 100 >= c_custkey"],
    cardinality=[(["c_phone", "c_name"], 2, 2)],
)


@query("validation", """
with c as (select * from customer) select c_custkey, 'V003' as code, 'c_acctbal' as path from c where c_acctbal < 0 or c_acctbal > 9000 union all select c_custkey, 'V005', 'c_mktsegment' from c where c_mktsegment not in ('BUILDING', 'MACHINERY')
union all select c_custkey, 'V004', 'c_name' from c where not regexp_matches(c_name, '^Customer#\\d+$') union all select c_custkey, 'V003', 'c_name' from c where length(c_name) > 18
union all select c_custkey, 'V010', 'c_phone' from c where c_nationkey < 5 union all select c_custkey, 'V008', 'c_acctbal + 100 >= c_custkey' from c where c_acctbal + 100 < c_custkey union all select c_custkey, 'V009', 'c_phone,c_name' from c""")
def validated(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("c_phone", F.lit(None).cast("string"))
    return validation.violations(c, SCHEMA, "c_custkey").drop("message")


@query("unresolved", "select o_orderkey, 'V013' as code, 'o_custkey' as path from orders where o_custkey not in (select c_custkey from customer where c_custkey % 10 <> 0)")
def unresolved(spark, sf_dir):
    targets = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0")
    return validation.unresolved(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", targets, "c_custkey").drop("message")


def _versions(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    new = c.select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 5 != 0, F.col("nation")).alias("nation"), F.col("segment").alias("market"))
    return documents.assignments(c, "c_custkey"), documents.assignments(new, "c_custkey")


@query("difference", """
select c_custkey, 'changed' as op, 'c_name' as path, null::varchar as from_path, c_name as old, c_name || '!' as new from customer where c_custkey % 7 = 0
union all select c_custkey, 'removed', 'nation', null, c_nationkey::varchar, null from customer where c_custkey % 5 = 0 union all select c_custkey, 'moved', 'market', 'segment', c_mktsegment, c_mktsegment from customer""")
def difference(spark, sf_dir):
    return documents.difference(*_versions(spark, sf_dir), "c_custkey")


@query("patch", """
select c_custkey, 'c_name' as path, case when c_custkey % 7 = 0 then c_name || '!' else c_name end as value from customer union all select c_custkey, 'nation', c_nationkey::varchar from customer where c_custkey % 5 <> 0 union all select c_custkey, 'market', c_mktsegment from customer""")
def patch(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return documents.patch(old, documents.difference(old, new, "c_custkey"), "c_custkey")


@query("digests", "select n_nationkey, sha256('n_name = ' || n_name || chr(10) || 'n_regionkey = ' || n_regionkey) as digest from nation")
def digests(spark, sf_dir):
    return documents.digests(table(spark, sf_dir, "nation"), "n_nationkey")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("cents", F.round(F.col("value") * 100).cast("long"))


@query("tumbling", "select time_bucket(interval 1 hour, ts) as window_start, event_type, count(*) as n, sum(round(value * 100)::bigint) as cents from events group by 1, 2")
def tumbling(spark, sf_dir):
    out = windows.windowed(_events(spark, sf_dir), "ts", "1 hour", [F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")], ["event_type"])
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).drop("window_end")


@query("sliding", "select w as window_start, count(*) as n from (select unnest([time_bucket(interval 30 minutes, ts), time_bucket(interval 30 minutes, ts) - interval 30 minutes]) as w from events) group by 1")
def sliding(spark, sf_dir):
    out = windows.windowed(_events(spark, sf_dir), "ts", "1 hour", [F.count(F.lit(1)).alias("n")], slide="30 minutes")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).drop("window_end")


@query("sessions", """
with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 2 hour then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts, event_id) as s from g)
select user_id, min(ts) as session_start, count(*) as n from s group by user_id, s""")
def sessions(spark, sf_dir):
    out = windows.sessions(_events(spark, sf_dir), "ts", "2 hours", [F.count(F.lit(1)).alias("n")], ["user_id"])
    return out.withColumn("session_start", F.col("session_start").cast("timestamp_ntz")).drop("session_end")


@query("pricing", """
select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2""")
def pricing(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("typed_text", "select n_nationkey, 'nation.' || k as path, t as type, v as value from nation, unnest([{'k': 'key', 't': 'integer', 'v': n_nationkey::varchar}, {'k': 'name', 't': 'string', 'v': n_name}, {'k': 'gone', 't': 'null', 'v': null}]) as u(x), (select x.k, x.t, x.v)")
def typed_text(spark, sf_dir):
    """The typed key-path format, written and read back."""
    from recordspark.sources import formats

    n = table(spark, sf_dir, "nation")
    doc = F.concat(F.lit("{nation}\nkey = ##"), F.col("n_nationkey").cast("string"), F.lit('\nname = "'), F.col("n_name"), F.lit('"\ngone = ~'))
    lines = n.select("n_nationkey", F.posexplode(F.split(doc, "\n")).alias("line", "value"))
    return formats.native_assignments(lines, ["n_nationkey"], "line").select("n_nationkey", "path", "type", "value")


__all__ = ["Q", "SQL"]


NESTED = """
{$}
const.sizes[0] = "small"
const.sizes[1] = "large"
{table.status[] : code, name}
O, open
F, filled
{Order}
Id = @o_orderkey
Tags[] = @o_orderstatus
Tags[] = %lower @o_orderpriority
Slots[2] = $const.sizes[1]
Both = {key = @o_custkey, state = {name = %lookup "status.name" @o_orderstatus, size = $const.sizes[0]}}
{.Customer}
Key = @o_custkey
{.Customer.Price}
Total = @o_totalprice
{Points[0]}
Label = "key"
Value = @o_orderkey
{Points[1]}
Label = "customer"
Value = @o_custkey
Extra = @o_orderstatus
{Lines[]}
_loop = @lines
Text = %concat @_index "/" @_length
{Single[]}
_loop = @o_orderstatus
_ = %lower @_item
{Large}
_if = %gt @o_totalprice #200000
Price = @o_totalprice
{Large}
Always = ##1
"""


@query("mapping_nested", """
select o_orderkey as id, o_orderstatus || ',' || lower(o_orderpriority) as tags, '-,-,large' as slots, o_custkey as key, case o_orderstatus when 'O' then 'open' when 'F' then 'filled' end as name, 'small' as size, o_custkey as customer, o_totalprice as total,
  'key:' || o_orderkey || ':- customer:' || o_custkey || ':' || o_orderstatus as points, coalesce(array_to_string(list_transform(generate_series(0, n - 1), lambda i: i || '/' || n), ','), '') as lines, lower(o_orderstatus) as single, case when o_totalprice > 200000 then o_totalprice end as large, 1 as always
from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey""")
def mapping_nested(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("lines"))
    out = mapping.apply(o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left"), NESTED)
    point = lambda p: F.concat_ws(":", p["Label"], p["Value"].cast("string"), F.coalesce(p["Extra"], F.lit("-")))
    return out.select(
        F.col("Order.Id").alias("id"), F.array_join("Order.Tags", ",").alias("tags"), F.array_join("Order.Slots", ",", "-").alias("slots"), F.col("Order.Both.key").alias("key"), F.col("Order.Both.state.name").alias("name"), F.col("Order.Both.state.size").alias("size"),
        F.col("Order.Customer.Key").alias("customer"), F.col("Order.Customer.Price.Total").alias("total"), F.array_join(F.transform("Points", point), " ").alias("points"), F.array_join(F.transform("Lines", lambda x: x["Text"]), ",").alias("lines"),
        F.array_join("Single", ",").alias("single"), F.col("Large.Price").alias("large"), F.col("Large.Always").alias("always"),
    )


@query("mapping_errors", """
select o_orderkey as id, case when o_orderkey % 2 = 0 then o_orderkey end as number, case when o_orderkey % 2 = 0 then 'Out.Wrong' else 'Out.Number,Out.Wrong' end as errors from orders""")
def mapping_errors(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("mixed", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey").cast("string")).otherwise("word"))
    out = mapping.apply(o, '{Out}\nNumber = "@mixed :type integer"\nWrong = %nothing @mixed', keep=["o_orderkey"], errors="errors")
    return out.select(F.col("o_orderkey").alias("id"), F.col("Out.Number").alias("number"), F.array_join(F.transform("errors", lambda e: F.concat_ws(".", e["section"], e["field"])), ",").alias("errors"))


@query("routed_merge", """
select o_custkey, count(case when o_orderstatus = 'O' then 1 end) as opened, coalesce(string_agg(case when o_orderstatus <> 'O' then o_orderkey::varchar end, ',' order by o_orderkey), '') as others, max(case when o_orderstatus = 'O' then o_orderkey end) as last_open from orders group by 1""")
def routed_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    specs = {"O": "{Open[]}\nkey = @o_orderkey\n{Last}\nkey = @o_orderkey", "F,P": "{Others[]}\nkey = @o_orderkey"}
    out = mapping.route_and_merge(o, F.col("o_orderstatus"), specs, ["o_custkey"], "o_orderkey")
    return out.select("o_custkey", F.size("Open").cast("long").alias("opened"), F.array_join(F.transform("Others", lambda x: x["key"]), ",").alias("others"), F.col("Last.key").alias("last_open"))


@query("accumulator_passes", "select sum(case when o_orderstatus = 'O' then 1 else 0 end)::bigint as reset, (count(*) + sum(case when o_orderstatus = 'O' then 1 else 0 end))::bigint as kept from orders")
def accumulator_passes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("one", F.lit(1)).withColumn("open", F.when(F.col("o_orderstatus") == "O", 1).otherwise(0))
    spec = "{$}\naccumulator.kept._persist = true\n{_first}\n_pass = ##1\nreset = sum @one\nkept = sum @one\n{_second}\n_pass = ##2\nreset = sum @open\nkept = sum @open"
    return mapping.accumulators(o, spec, "o_orderkey")


@query("head_discriminator", "select o_orderstatus as kind, count(*) as n from orders group by 1")
def head_discriminator(spark, sf_dir):
    spec = '{$source}\ndiscriminator.type = "position"\ndiscriminator.pos = "0"\ndiscriminator.len = "1"'
    lines = table(spark, sf_dir, "orders").select(F.concat("o_orderstatus", F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("line"))
    return lines.groupBy(mapping.discriminator(spec).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
