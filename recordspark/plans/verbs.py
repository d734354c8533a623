"""Queries over the value functions that the other queries don't use."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordspark.functions import call as v
from recordspark.plans.values import ARRAYS, quantities, query, shown, table


def _listed(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",", "-")


@query("text_parts", """
with c as (select c_custkey as k, c_name as n, c_mktsegment as s, case c_custkey % 3 when 0 then '' when 1 then null else 'x' end as f, lpad((c_custkey * 7919 % 10000000000)::varchar, 10, '0') as digits from customer)
select k, ltrim('  ' || n || ' ') as left_trimmed, rtrim(' ' || n || '  ') as right_trimmed, coalesce(nullif(f, ''), n) as filled, case when f is null or f = '' then 'none' else f end as shown,
  repeat('*', (24 - length(n)) // 2) || n || repeat('*', 24 - length(n) - (24 - length(n)) // 2) as padded, repeat(' ', (25 - length(s)) // 2) || s || repeat(' ', 25 - length(s) - (25 - length(s)) // 2) as centered,
  split_part(n, '#', 2) as second, n || '||' || s as joined, regexp_extract(n, '(\\w+)#0*(\\d+)', 1) || ',' || regexp_extract(n, '(\\w+)#0*(\\d+)', 2) as groups, n as cleaned, s || ',b,c' as tokens,
  '(' || digits[:3] || ') ' || digits[4:6] || '-' || digits[7:] as masked, '(' || digits[:3] || ') ' || digits[4:6] || '-' || digits[7:] as phone, lower(s) || 'PartTwo' as camel, s || 'ea' as plain, n = n as same
from c""")
def text_parts(spark, sf_dir):
    n, s, k = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey")
    f = F.when(k % 3 == 0, "").when(k % 3 == 2, "x")
    digits = F.lpad((k * 7919 % 10000000000).cast("string"), 10, "0")
    return table(spark, sf_dir, "customer").select(*shown(
        k=k, left_trimmed=v("trimLeft", F.concat(F.lit("  "), n, F.lit(" "))), right_trimmed=v("trimRight", F.concat(F.lit(" "), n, F.lit("  "))), filled=v("coalesce", f, n), shown=v("ifEmpty", f, "none"),
        padded=v("pad", n, 24, "*"), centered=v("center", s, 25), second=v("split", n, "#", 1), joined=v("join", F.array(n, F.lit(None), s), "|"), groups=_listed(v("extract", n, r"(\w+)#0*(\d+)")),
        cleaned=v("clean", F.concat(n, F.lit("\x07"))), tokens=_listed(v("tokenize", F.concat(s, F.lit("  b c")))), masked=v("mask", digits, "(###) ###-####"), phone=v("formatPhone", F.concat(F.lit("1"), digits), "US"),
        camel=v("camelCase", F.concat(F.lower(s), F.lit("_part two"))), plain=v("stripAccents", F.concat(s, F.lit("éà"))), same=v("eq", n, n),
    ))


@query("logic_parts", """
select p_partkey as k, p_size > 10 and p_retailprice > 1000 as both, p_size > 40 or p_retailprice > 1500 as either, p_size % 4 = 0 as nothing, true as is_string, true as is_number, false as is_text_number, true as is_boolean, true as is_array, false as no_array,
  true as is_object, p_size <> 7 as unlike, p_size < 9 as less, p_size <= 9 as at_most, p_size >= 9 as at_least, p_size as checked, p_size::varchar as tried, case when p_size % 2 = 0 then 'true' else 'word' end as tried_text, p_size::varchar as one, p_brand as held,
  case p_size % 3 when 0 then 'zero' when 1 then 'one' end as found, case p_size % 3 when 0 then 'zero' when 1 then 'one' else 'none' end as found_or, '1995-03-01 10:00:00' as at, case when p_size % 4 = 0 then 'null' else 'integer' end as kind from part""")
def logic_parts(spark, sf_dir):
    s, b, names = F.col("p_size"), F.col("p_brand"), {"0": "zero", "1": "one"}
    return table(spark, sf_dir, "part").select(*shown(
        k=F.col("p_partkey"), both=v("and", s > 10, F.col("p_retailprice") > 1000), either=v("or", s > 40, F.col("p_retailprice") > 1500), nothing=v("isNull", F.when(s % 4 != 0, s)), is_string=v("isString", b), is_number=v("isNumber", s),
        is_text_number=v("isNumber", s.cast("string")), is_boolean=v("isBoolean", s > 3), is_array=v("isArray", F.array(s)), no_array=v("isArray", b), is_object=v("isObject", F.struct(s)), unlike=v("ne", s, "7"), less=v("lt", s, 9), at_most=v("lte", s, 9),
        at_least=v("gte", s, 9), checked=v("assert", s, "a size"), tried=v("tryCoerce", s).cast("string"), tried_text=v("tryCoerce", F.when(s % 2 == 0, "TRUE").otherwise("word")).cast("string"), one=_listed(v("toArray", s)),
        held=v("get", v("toObject", F.array(F.array(F.lit("a"), F.lit("x")), F.array(F.lit("a"), b))), "a"), found=v("lookup", names, s % 3), found_or=v("lookupDefault", names, s % 3, "none"),
        at=v("formatTimestamp", v("coerceTimestamp", "1995-03-01 10:00:00"), "YYYY-MM-DD HH:mm:ss"), kind=v("typeOf", F.when(s % 4 != 0, s)),
    ))


@query("number_parts", """
select p_partkey as k, printf('%.2f', p_retailprice) as shown, printf('%.2f', p_retailprice) as money, printf('%d%%', p_size) as share, -p_size::double as negated, p_retailprice - p_size as less, p_size * 3.0::double as more, round(ln(p_size) / ln(2), 9) as log2, round(exp(p_size / 50.0), 9) as grown,
  10 + 0.25::double * p_size as between_, true as finite, p_size % 2 = 0 as no_number, p_size as whole, replace(replace(replace(format('{:,.2f}', p_retailprice * 10), ',', '_'), '.', ','), '_', '.') as german, true as drawn, true as seeded, round(p_size * 0.3048, 6) as metres from part where p_size > 0""")
def number_parts(spark, sf_dir):
    s, p = F.col("p_size"), F.col("p_retailprice")
    return table(spark, sf_dir, "part").where("p_size > 0").select(*shown(
        k=F.col("p_partkey"), shown=v("formatNumber", p, 2), money=v("formatCurrency", p), share=v("formatPercent", s / 100), negated=v("negate", s), less=v("subtract", p, s), more=v("multiply", s, 3), log2=F.round(v("log", s, 2), 9), grown=F.round(v("exp", s / 50), 9),
        between_=v("interpolate", 10, 10.25, s), finite=v("isFinite", p), no_number=v("isNaN", F.when(s % 2 == 1, s)), whole=v("parseInt", F.concat(s.cast("string"), F.lit(".9"))), german=v("formatLocaleNumber", p * 10, "de-DE", 2),
        drawn=v("between", v("random", 1, 6, F.col("p_name")), 1, 6), seeded=v("eq", v("random", 1, 6, "a"), v("random", 1, 6, "a")), metres=v("convertUnit", s, "ft", "m"),
    ))


@query("date_parts", """
select o_orderkey as k, true as today, strftime(current_date, '%Y') as year, strftime(o_orderdate, '%H:%M:%S') as time, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') as iso, o_orderdate::date as parsed, strftime(o_orderdate + interval 5 hour, '%Y-%m-%d %H:%M:%S') as hours,
  strftime(o_orderdate + interval 90 minute, '%Y-%m-%d %H:%M:%S') as minutes, strftime(o_orderdate + interval 3661 second, '%Y-%m-%d %H:%M:%S') as seconds, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d %H:%M:%S') as opening, strftime(o_orderdate, '%Y-%m-%d 23:59:59') as closing,
  o_orderdate > timestamp '1995-01-01' as later, o_orderdate between timestamp '1995-01-01' and timestamp '1996-01-01' as within_, strftime(o_orderdate, '%Y-%m-%d') as unix, strftime(o_orderdate, '%d.%m.%Y') as german, strftime(o_orderdate, '%A, %B %-d, %Y') as long_,
  2024 - year(o_orderdate) - case when strftime(o_orderdate, '%m%d') > '0615' then 1 else 0 end as age, 2000 - year(o_orderdate) as years from orders""")
def date_parts(spark, sf_dir):
    d, form = F.col("o_orderdate"), "YYYY-MM-DD HH:mm:ss"
    shown_at = lambda c: v("formatTimestamp", c, form)
    return table(spark, sf_dir, "orders").select(*shown(
        k=F.col("o_orderkey"), today=v("today") == F.current_date(), year=v("formatDate", v("now"), "YYYY"), time=v("formatTime", d), iso=v("formatTimestamp", d), parsed=v("parseDate", v("formatDate", d, "DD.MM.YYYY"), "DD.MM.YYYY"), hours=shown_at(v("addHours", d, 5)),
        minutes=shown_at(v("addMinutes", d, 90)), seconds=shown_at(v("addSeconds", d, 3661)), opening=shown_at(v("startOfDay", v("parseTimestamp", d))), closing=shown_at(v("endOfDay", d)), later=v("isAfter", d, "1995-01-01"), within_=v("isBetween", d, "1995-01-01", "1996-01-01"),
        unix=v("formatDate", v("fromUnix", v("toUnix", d)), "YYYY-MM-DD"), german=v("formatLocaleDate", d, "de-DE"), long_=v("formatLocaleDate", d, "en-US", "long"), age=v("ageFromDate", d, "2024-06-15"), years=v("dateDiff", d, "2000-01-01", "years"),
    ))


@query("codec_parts", """
select c_custkey as k, '"' || c_name || '"' as encoded, c_custkey as decoded, c_name as back, true as uuid_form, true as same_uuid, true as nanoid_form, 128 as sha512_length, round(degrees(c_custkey / 100.0), 9) as degrees_,
  round((c_custkey % 80 + 10) / 2.0, 6) as half_way, true as seed_repeats from customer""")
def codec_parts(spark, sf_dir):
    n, k = F.col("c_name"), F.col("c_custkey")
    form = "^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
    return table(spark, sf_dir, "customer").select(*shown(
        k=k, encoded=v("jsonEncode", n), decoded=F.variant_get(v("jsonDecode", F.concat(F.lit('{"a": '), k.cast("string"), F.lit("}"))), "$.a", "bigint"), back=v("hexDecode", v("hexEncode", n)), uuid_form=v("matches", v("uuid", n), form), same_uuid=v("eq", v("uuid", n), v("uuid", n)),
        nanoid_form=v("matches", v("nanoid", 12), "^[A-Za-z0-9_-]{12}$"), sha512_length=v("length", v("sha512", n)), degrees_=F.round(v("toDegrees", k / 100), 9), half_way=F.round(F.get(v("midpoint", 10, 20, k % 80, 20), 0), 6), seed_repeats=v("eq", v("random", "x"), v("random", "x")),
    ))


@query("array_parts", ARRAYS + """, s as (select l_orderkey as k, q, generate_series(1, len(q)) as i, list_transform(q, lambda x: case when x % 3 <> 0 then x end) as g from a)
select k, array_to_string(q || q, ',') as flat, array_to_string(list_sort(list_distinct(q)), ',') as once, array_to_string(q, ',') as plucked, list_filter(q, lambda x: x > 30)[1] as found, coalesce(list_position(list_transform(q, lambda x: x > 30), true), 0) - 1 as found_at,
  array_to_string(list_transform(q, lambda x: 2 * x), ',') as zipped, array_to_string(list_filter(q, lambda x: x > 20) || list_filter(q, lambda x: x <= 20), ',') as parted, array_to_string(list_filter(g, lambda x: x is not null), ',') as compact_, array_to_string(list_sort(q), ',') as by_q,
  q[-1] as last_, array_to_string(q[2:3], ',') as middle, array_to_string(list_transform(i, lambda x: x - 1), ',') as numbers, least(2, len(q)) as sampled, array_to_string(q[:2], ',') as limited, array_to_string(list_filter(q, lambda x, j: j = 1 or x <> q[j - 1]), ',') as deduped,
  list_aggregate(q, 'product')::double as product, array_to_string(list_transform(i, lambda j: coalesce((q[j] - q[j - 1])::varchar, '-')), ',') as steps, round(q[2]::double / q[1] - 1, 9) as change, array_to_string(list_transform(i, lambda j: coalesce(q[j - 1]::varchar, '-')), ',') as shifted,
  array_to_string(list_transform(i, lambda j: coalesce(list_filter(g[:j], lambda x: x is not null)[-1]::varchar, '-')), ',') as filled, list_max(list_transform(q, lambda x: len(list_filter(q, lambda y: y = x)))) as mode_count, round(list_sum(list_transform(i, lambda j: list_avg(q[greatest(j - 1, 1):j]))), 6) as smooth from s""")
def array_parts(spark, sf_dir):
    q, rows = F.col("q"), F.col("rows")
    g = F.transform(q, lambda x: F.when(x % 3 != 0, x))
    parted = v("partition", q, None, ">", 20)
    return quantities(spark, sf_dir).select(*shown(
        k=F.col("l_orderkey"), flat=_listed(v("flatten", F.array(q, q))), once=_listed(v("sort", v("unique", v("distinct", q)))), plucked=_listed(v("pluck", v("map", rows), "q")), found=v("find", q, None, ">", 30), found_at=v("findIndex", q, None, ">", 30),
        zipped=_listed(F.transform(v("zip", q, q), lambda z: z["0"] + z["1"])), parted=_listed(v("flatten", parted)), compact_=_listed(v("compact", g)), by_q=_listed(v("pluck", v("sortBy", rows, "q"), "q")), last_=v("at", q, -1), middle=_listed(v("slice", q, 1, 3)),
        numbers=_listed(v("range", 0, F.size(q))), sampled=F.size(v("sample", q, 2, "s")), limited=_listed(v("limit", q, 2)), deduped=_listed(v("dedupe", q)), product=v("last", v("cumprod", q)), steps=_listed(F.transform(v("diff", q), lambda x: x.cast("int"))),
        change=F.round(v("at", v("pctChange", q), 1), 9), shifted=_listed(v("shift", q, 1)), filled=_listed(v("fillMissing", g, "forward")), mode_count=F.size(F.filter(q, lambda x: x == v("mode", q))), smooth=F.round(v("sum", v("movingAvg", q, 2)), 6),
    ))


@query("array_spread", """
select l_orderkey as k, round(stddev_samp(l_quantity::int), 6) as sd, round(quantile_cont(l_quantity::int::double, 0.3), 6) as q30, round(case when isnan(corr(l_quantity::int, l_linenumber)) then null else corr(l_quantity::int, l_linenumber) end, 6) + 0.0 as corr_ from lineitem group by 1""")
def array_spread(spark, sf_dir):
    q, lines = F.col("q"), F.transform("rows", lambda r: r["l_linenumber"])
    return quantities(spark, sf_dir).select(*shown(k=F.col("l_orderkey"), sd=F.round(v("stdSample", q), 6), q30=F.round(v("quantile", q, 0.3), 6), corr_=F.round(v("correlation", q, lines), 6) + 0.0))


@query("object_parts", ARRAYS + """, s as (select l_orderkey as k, q, list_filter(q, lambda x: x % 3 = 1) as ones from a)
select k, ones[-1] as last_one, len(ones) > 0 as has_one, len(list_distinct(list_transform(q, lambda x: x % 3))) as n, len(list_distinct(list_transform(q, lambda x: x % 3))) as n_unpivoted, coalesce(ones[-1], -1) as one_or, 7 as merged, len(list_distinct(list_transform(q, lambda x: x % 3))) + 1 as n_merged from s""")
def object_parts(spark, sf_dir):
    held = v("pivot", F.transform("rows", lambda r: F.struct((r["q"] % 3).cast("string").alias("g"), r["q"].alias("q"))), "g", "q")
    both = v("merge", held, F.create_map(F.lit("new"), F.lit(1)), F.create_map(F.lit("new"), F.lit(7)))
    return quantities(spark, sf_dir).select(*shown(
        k=F.col("l_orderkey"), last_one=v("get", held, "1"), has_one=v("has", held, "1"), n=F.size(v("entries", held)), n_unpivoted=F.size(v("unpivot", held, "name", "value")), one_or=v("get", held, "1", -1), merged=v("get", both, "new"), n_merged=F.size(v("keys", both)),
    ))
