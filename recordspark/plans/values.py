"""Queries over value functions, row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordspark.functions import call as v

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shown(*columns, **named):
    return [*columns, *[c.alias(k) for k, c in named.items()]]


@query("text_basics", """
select c_custkey, upper(c_name) as up, lower(c_mktsegment) as low, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as cap, reverse(c_name) as rev,
  length(c_name) as n, substr(c_name, 3, 4) as sub, c_name || '/' || c_mktsegment as joined, lpad(c_custkey::varchar, greatest(length(c_custkey::varchar), 6)::int, '0') as padded,
  rpad(c_mktsegment, greatest(length(c_mktsegment), 12)::int, '.') as right_padded, case when length(c_name) <= 8 then c_name else c_name[:5] || '...' end as cut,
  replace(c_name, 'Customer', 'C') as replaced, split_part(c_name, '#', 1) as l, case when instr(c_name, '#') > 0 then c_name[instr(c_name, '#') + 1:] else c_name end as r,
  contains(c_name, '1') as has, starts_with(c_name, 'Cust') as starts, ends_with(c_name, '7') as ends_, repeat(c_mktsegment[1], 3) as thrice,
  '<' || c_name || '>' as wrapped, regexp_replace('  ' || c_name || chr(9), '^\\s+|\\s+$', '', 'g') as trimmed, levenshtein(c_name, c_mktsegment) as distance
from customer""")
def text_basics(spark, sf_dir):
    n, s, k = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(*shown(
        k, up=v("upper", n), low=v("lower", s), cap=v("capitalize", s), rev=v("reverseString", n), n=v("length", n), sub=v("substring", n, 2, 4),
        joined=v("concat", n, "/", s), padded=v("padLeft", k, 6, "0"), right_padded=v("padRight", s, 12, "."), cut=v("truncate", n, 8, "..."),
        replaced=v("replace", n, "Customer", "C"), l=v("leftOf", n, "#"), r=v("rightOf", n, "#"), has=v("contains", n, "1"), starts=v("startsWith", n, "Cust"),
        ends_=v("endsWith", n, "7"), thrice=v("repeat", v("substring", s, 0, 1), 3), wrapped=v("wrap", n, "<", ">"), trimmed=v("trim", F.concat(F.lit("  "), n, F.lit("\t"))), distance=v("levenshtein", n, s),
    ))


@query("text_words", """
with w as (select p_partkey, p_type, p_name, list_filter(regexp_split_to_array(p_name, '[ \\t_-]+'), lambda x: x <> '') as words from part)
select p_partkey, array_to_string(list_transform(words, lambda x: lower(x)), '_') as snake, array_to_string(list_transform(words, lambda x: lower(x)), '-') as kebab,
  array_to_string(list_transform(words, lambda x: upper(x[1]) || lower(x[2:])), '') as pascal, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') as title,
  len(list_filter(regexp_split_to_array(p_name, '\\s+'), lambda x: x <> '')) as n_words, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as slug,
  regexp_extract(p_name, '[a-z]+', 0) as matched, regexp_matches(p_type, 'S.*L') as found, regexp_replace(p_name, '([a-z])([a-z])', '\\2\\1', 'g') as swapped,
  trim(regexp_replace(p_name || '  x ', '\\s+', ' ', 'g')) as spaced
from w""")
def text_words(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select(*shown(
        F.col("p_partkey"), snake=v("snakeCase", F.lower(n)), kebab=v("kebabCase", F.lower(n)), pascal=v("pascalCase", F.lower(n)), title=v("titleCase", n), n_words=v("wordCount", n), slug=v("slugify", n),
        matched=F.coalesce(v("match", n, "[a-z]+"), F.lit("")), found=v("matches", F.col("p_type"), "S.*L"), swapped=v("replaceRegex", n, "([a-z])([a-z])", "$2$1"), spaced=v("normalizeSpace", F.concat(n, F.lit("  x "))),
    ))


@query("text_codes", """
with recursive t(n, k, c) as (select n, 0, n::bigint from range(256) r(n) union all select n, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from t where k < 8),
w(key, s, i, c) as (select c_custkey, c_name, 0, 4294967295::bigint from customer union all select w.key, w.s, w.i + 1, xor(w.c >> 8, t.c) from w join t on t.k = 8 and t.n = xor(w.c & 255, ascii(w.s[w.i + 1])::bigint) where w.i < length(w.s))
select c_custkey, case c_mktsegment when 'BUILDING' then 'B435' when 'MACHINERY' then 'M256' when 'AUTOMOBILE' then 'A351' when 'HOUSEHOLD' then 'H243' when 'FURNITURE' then 'F653' end as soundex, c_name[1:2] || '-' || c_name[3:4] || '-' || c_name[5] as masked,
  '(555) ' || lpad(c_custkey::varchar, 7, '0')[1:3] || '-' || lpad(c_custkey::varchar, 7, '0')[4:] as phone, lower(lpad(to_hex(xor(c, 4294967295)), 8, '0')) as crc, c_mktsegment || 'eAn' as plain, lower(c_mktsegment) as camel,
  repeat('*', (14 - length(c_mktsegment)) // 2) || c_mktsegment || repeat('*', 14 - length(c_mktsegment) - (14 - length(c_mktsegment)) // 2) as centred, true as id_form, true as drawn, replace(replace(replace(format('{:,.2f}', c_acctbal), ',', '_'), '.', ','), '_', '.') as number
from customer join w on key = c_custkey and i = length(s)""")
def text_codes(spark, sf_dir):
    n, s = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(*shown(
        F.col("c_custkey"), soundex=v("soundex", s), masked=v("mask", n, "##-##-A"), phone=v("formatPhone", F.format_string("555%07d", "c_custkey"), "US"), crc=v("crc32", n), plain=v("stripAccents", F.concat(s, F.lit("éÅñ"))),
        camel=v("camelCase", s), centred=v("center", s, 14, "*"), id_form=v("matches", v("uuid", n), "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), drawn=v("between", v("random", n), 0, 1), number=v("formatLocaleNumber", F.col("c_acctbal"), "de-DE", 2),
    ))


@query("codecs", """
select c_custkey, md5(c_name) as md5, sha256(c_name) as sha256, sha1(c_name) as sha1, base64(encode(c_name)) as b64, lower(hex(encode(c_name))) as hex,
  url_encode(c_name) as url, c_name as back, c_name as back2 from customer""")
def codecs(spark, sf_dir):
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select(*shown(
        F.col("c_custkey"), md5=v("md5", n), sha256=v("sha256", n), sha1=v("sha1", n), b64=v("base64Encode", n), hex=v("hexEncode", n), url=v("urlEncode", n),
        back=v("base64Decode", v("base64Encode", n)), back2=v("urlDecode", v("urlEncode", n)),
    ))


@query("json_paths", "select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.missing') as missing from events")
def json_paths(spark, sf_dir):
    p = F.col("props")
    return table(spark, sf_dir, "events").select(*shown(F.col("event_id"), k=v("jsonPath", p, "k"), missing=v("jsonPath", p, "missing")))


@query("number_basics", """
select c_custkey, floor(c_acctbal)::bigint as lo, ceil(c_acctbal)::bigint as hi, round(c_acctbal, 1) as r1, abs(c_acctbal) as a, sign(c_acctbal)::int as s, trunc(c_acctbal)::bigint as t,
  round(c_acctbal - 7 * trunc(c_acctbal / 7), 6) as m, round(c_acctbal / nullif(c_nationkey, 0), 6) as q, case when c_nationkey = 0 then -1 else round(c_acctbal / c_nationkey, 6) end as safe,
  greatest(least(c_acctbal, 5000), 0) as clamped, least(c_acctbal, c_custkey) as lowest, greatest(c_acctbal, c_custkey) as highest, round(c_acctbal * 12, 2) as inches,
  round((c_acctbal - 32) * 5 / 9, 4) as celsius, round(sqrt(abs(c_acctbal)), 6) as root, round(ln(abs(c_acctbal) + 1), 6) as ln, round(log10(abs(c_acctbal) + 1), 6) as l10, round(pow(c_nationkey, 2), 6) as sq,
  trunc(c_acctbal)::bigint::varchar as whole, round((c_acctbal - 4500) / 3000, 6) as z
from customer""")
def number_basics(spark, sf_dir):
    x, n, k = F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_custkey")
    r = lambda c, d=6: F.round(c, d)
    up = v("add", v("abs", x), 1)
    return table(spark, sf_dir, "customer").select(*shown(
        k, lo=v("floor", x), hi=v("ceil", x), r1=v("round", x, 1), a=v("abs", x), s=v("sign", x), t=v("trunc", x), m=r(v("mod", x, 7)), q=r(v("divide", x, n)), safe=r(v("safeDivide", x, n, -1)), clamped=v("clamp", x, 0, 5000),
        lowest=v("minOf", x, k), highest=v("maxOf", x, k), inches=r(v("convertUnit", x, "ft", "in"), 2), celsius=r(v("convertUnit", x, "F", "C"), 4), root=r(v("sqrt", v("abs", x))), ln=r(v("ln", up)), l10=r(v("log10", up)), sq=r(v("pow", n, 2)),
        whole=v("formatInteger", x), z=r(v("zscore", x, 4500, 3000)),
    ))


@query("finance", """
with t as (select o_orderkey, o_totalprice as p, 0.05::double as r, (o_orderkey % 30 + 5)::double as n from orders)
select o_orderkey, round(p * pow(1 + r, n), 4) as compound, round(p / pow(1 + r, n), 4) as discount, round(p * r * pow(1 + r, n) / (pow(1 + r, n) - 1), 4) as pmt, round(p * (pow(1 + r, n) - 1) / r, 4) as fv,
  round(p * (1 - pow(1 + r, -n)) / r, 4) as pv, round((p - 100) / n, 7) as depreciation, round(-p + p / 2 / (1 + r) + p / pow(1 + r, 2), 4) as npv, round(ln(1000 / (1000 + r * 5000)) / ln(1 + r), 6) as nper from t""")
def finance(spark, sf_dir):
    p, r, n = F.col("o_totalprice"), F.lit(0.05), F.col("o_orderkey") % 30 + 5
    d = lambda c, k=4: F.round(c, k)
    return table(spark, sf_dir, "orders").select(*shown(
        F.col("o_orderkey"), compound=d(v("compound", p, r, n)), discount=d(v("discount", p, r, n)), pmt=d(v("pmt", p, r, n)), fv=d(v("fv", p, r, n)), pv=d(v("pv", p, r, n)), depreciation=d(v("depreciation", p, 100, n), 7),
        npv=d(v("npv", r, F.array(-p, p / 2, p))), nper=d(v("nper", r, 1000, 5000), 6),
    ))


@query("yields", """
select o_orderkey, round((1 + sqrt(1 + 16.0)) / 4 - 1, 6) as irr, 0.05 as rate from orders""")
def yields(spark, sf_dir):
    """irr of -2, 1, 2 (times the price), and the rate that gave a payment."""
    p = F.col("o_totalprice")
    n = F.col("o_orderkey") % 30 + 2
    return table(spark, sf_dir, "orders").select(*shown(F.col("o_orderkey"), irr=F.round(v("irr", F.array(-2 * p, p, 2 * p)), 6), rate=F.round(v("rate", n, -v("pmt", p, 0.05, n), p), 6)))


@query("conditions", """
select p_partkey, coalesce(nullif(p_brand, 'Brand#1'), 'none') as filled, case when p_size > 25 then 'large' when p_size > 10 then 'middle' else 'small' end as size,
  case p_brand when 'Brand#1' then 'first' when 'Brand#2' then 'second' else 'other' end as brand, p_size between 10 and 20 as mid, p_size = 7 as seven, not (p_size % 2 <> 0) as even, (p_size > 10) <> (p_retailprice > 1000) as either,
  case when p_size % 3 <> 0 then 'no' else 'yes' end as third, 'integer' as kind, regexp_matches(p_name, '^\\d{4}-\\d{2}-\\d{2}') as dated from part""")
def conditions(spark, sf_dir):
    s, b = F.col("p_size"), F.col("p_brand")
    return table(spark, sf_dir, "part").select(*shown(
        F.col("p_partkey"), filled=v("ifNull", F.nullif(b, F.lit("Brand#1")), "none"), size=v("cond", v("gt", s, 25), "large", v("gt", s, 10), "middle", "small"), brand=v("switch", b, "Brand#1", "first", "Brand#2", "second", "other"),
        mid=v("between", s, 10, 20), seven=v("eq", s, "7"), even=v("not", s % 2), either=v("xor", s > 10, F.col("p_retailprice") > 1000), third=v("ifElse", s % 3, "no", "yes"), kind=v("typeOf", s), dated=v("isDate", F.col("p_name")),
    ))


@query("coercions", """
select event_id, (case when event_id % 4 = 0 then 'x' else event_id::varchar end) as s, try_cast(case when event_id % 4 = 0 then 'x' else event_id::varchar end as double) as num, trunc(value)::bigint as whole,
  event_id % 3 <> 0 as b, (ts::date) as d, try_cast('12.7' as double) as p from events""")
def coercions(spark, sf_dir):
    s = F.when(F.col("event_id") % 4 == 0, "x").otherwise(F.col("event_id").cast("string"))
    t = table(spark, sf_dir, "events")
    return t.select(*shown(F.col("event_id"), s=v("coerceString", s), num=v("coerceNumber", s), whole=v("coerceInteger", F.col("value")), b=v("coerceBoolean", F.col("event_id") % 3), d=v("coerceDate", F.col("ts").cast("string")), p=v("coerceNumber", " 12.7 ")))


@query("dates", """
select o_orderkey, strftime(o_orderdate, '%Y/%m/%d') as f, (o_orderdate::date + 10) as d10, (o_orderdate::date + interval 1 month)::date as m1, (o_orderdate::date + interval 2 year)::date as y2,
  date_diff('day', o_orderdate::date, date '2000-01-01') as days, (2000 - year(o_orderdate)) * 12 + 1 - month(o_orderdate) as months, date_trunc('month', o_orderdate)::date as som, last_day(o_orderdate::date) as eom,
  date_trunc('year', o_orderdate)::date as soy, make_date(year(o_orderdate), 12, 31) as eoy, dayofweek(o_orderdate) as dow, quarter(o_orderdate) as q, (year(o_orderdate) % 4 = 0 and year(o_orderdate) % 100 <> 0) or year(o_orderdate) % 400 = 0 as leap,
  o_orderdate < timestamp '1995-01-01' as early, epoch(o_orderdate)::bigint as unix, abs(date_diff('day', o_orderdate::date, date '1995-06-01')) as apart, true as valid,
  case when month(o_orderdate) = 12 and weekofyear(o_orderdate) = 1 then 53 else weekofyear(o_orderdate) end as week, o_orderdate::date + (case dayofweek(o_orderdate) when 6 then 2 when 0 then 1 else 0 end) as business,
  o_orderdate::date + 7 + (case isodow(o_orderdate) when 6 then -1 when 7 then -2 else 0 end)::int as five
from orders""")
def dates(spark, sf_dir):
    d = F.col("o_orderdate")
    t = table(spark, sf_dir, "orders")
    return t.select(*shown(
        F.col("o_orderkey"), f=v("formatDate", d, "YYYY/MM/DD"), d10=v("addDays", d, 10), m1=v("addMonths", d, 1), y2=v("addYears", d, 2), days=v("dateDiff", d, "2000-01-01"), months=v("dateDiff", d, "2000-01-01", "months"),
        som=v("startOfMonth", d), eom=v("endOfMonth", d), soy=v("startOfYear", d), eoy=v("endOfYear", d), dow=v("dayOfWeek", d), q=v("quarter", d), leap=v("isLeapYear", d), early=v("isBefore", d, "1995-01-01"), unix=v("toUnix", d),
        apart=v("daysBetweenDates", d, "1995-06-01"), valid=v("isValidDate", F.date_format(d, "yyyy-MM-dd")), week=v("weekOfYear", d), business=v("nextBusinessDay", d),
        five=v("businessDays", d, 5),
    ))


@query("durations", "select o_orderkey, (o_orderkey % 3 + 1) || case when o_orderkey % 3 = 0 then ' year, ' else ' years, ' end || (o_orderkey % 5 + 2) || ' hours' as s from orders")
def durations(spark, sf_dir):
    k = F.col("o_orderkey")
    iso = F.concat(F.lit("P"), (k % 3 + 1).cast("string"), F.lit("YT"), (k % 5 + 2).cast("string"), F.lit("H"))
    return table(spark, sf_dir, "orders").select(*shown(k, s=v("formatDuration", iso)))


@query("geo", """
with p as (select s_suppkey, (s_suppkey % 170 - 85)::double as a, (s_suppkey * 7 % 340 - 170)::double as b, 48.85 as c, 2.35 as d from supplier)
select s_suppkey, round(2 * 6371 * asin(sqrt(pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2))), 3) as km,
  a between 0 and 50 and b between -20 and 60 as inside, round(radians(a), 9) as rad, round(fmod(degrees(atan2(sin(radians(d - b)) * cos(radians(c)), cos(radians(a)) * sin(radians(c)) - sin(radians(a)) * cos(radians(c)) * cos(radians(d - b)))) + 360, 360), 4) as bearing from p""")
def geo(spark, sf_dir):
    k = F.col("s_suppkey")
    a, b = k % 170 - 85, k * 7 % 340 - 170
    return table(spark, sf_dir, "supplier").select(*shown(k, km=F.round(v("distance", a, b, 48.85, 2.35), 3), inside=v("inBoundingBox", a, b, 0, -20, 50, 60), rad=F.round(v("toRadians", a), 9), bearing=F.round(v("bearing", a, b, 48.85, 2.35), 4)))


def quantities(spark, sf_dir):
    """Each order's quantities and prices as arrays in a fixed order."""
    t = table(spark, sf_dir, "lineitem")
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"), F.col("l_extendedprice").alias("p"))))
    return t.groupBy("l_orderkey").agg(rows.alias("rows")).select("l_orderkey", "rows", F.transform("rows", lambda r: r["q"]).alias("q"), F.transform("rows", lambda r: r["p"]).alias("p"))


ARRAYS = "with a as (select l_orderkey, list(l_quantity::int order by l_linenumber, l_partkey, l_suppkey, l_quantity::int, l_extendedprice) as q, list(l_extendedprice order by l_linenumber, l_partkey, l_suppkey, l_quantity::int, l_extendedprice) as p from lineitem group by 1) "


@query("array_statistics", """
select l_orderkey, sum(l_quantity::int)::double as total, count(*) as n, min(l_quantity::int)::double as lo, max(l_quantity::int)::double as hi, round(avg(l_quantity::int), 6) as mean, round(var_pop(l_quantity::int), 6) as var, round(stddev_pop(l_quantity::int), 6) as sd,
  round(var_samp(l_quantity::int), 6) as var_s, round(quantile_cont(l_quantity::int::double, 0.5), 6) as med, round(quantile_cont(l_quantity::int::double, 0.3), 6) as p30, round(covar_pop(l_quantity::int, l_extendedprice), 6) as cov,
  sum(l_quantity::int * l_quantity::int) / sum(l_quantity::int) as weighted from lineitem group by 1""")
def array_statistics(spark, sf_dir):
    q, p, r = F.col("q"), F.col("p"), lambda c, d=6: F.round(c, d)
    return quantities(spark, sf_dir).select(*shown(
        F.col("l_orderkey"), total=v("sum", q), n=v("count", q), lo=v("min", q), hi=v("max", q), mean=r(v("avg", q)), var=r(v("variance", q)), sd=r(v("std", q)), var_s=r(v("varianceSample", q)), med=r(v("median", q)), p30=r(v("percentile", q, 30)),
        cov=r(v("covariance", q, p)), weighted=v("weightedAvg", q, q),
    ))


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("array_collections", ARRAYS + """, s as (select l_orderkey, q, generate_series(1, len(q)) as i from a)
select l_orderkey, array_to_string(list_filter(q, lambda x: x > 20), ',') as big, array_to_string(list_sort(q), ',') as sorted, array_to_string(list_reverse_sort(q), ',') as down, array_to_string(list_reverse(q), ',') as rev, array_to_string(q[:2], ',') as two,
  array_to_string(q[3:], ',') as rest, coalesce(list_position(q, 10), 0) - 1 as ten, list_contains(q, 10) as has, q[1] as f, q[-1] as l, array_to_string(list_transform(i, lambda k: coalesce(q[k - 1]::varchar, '-')), ',') as lagged,
  array_to_string(list_transform(i, lambda k: coalesce(q[k + 1]::varchar, '-')), ',') as led, array_to_string(list_transform(i, lambda k: list_sum(q[:k])::int), ',') as sums, array_to_string(list_transform(i, lambda k: len(list_filter(q, lambda y: y > q[k])) + 1), ',') as ranks,
  len(list_filter(q, lambda x: x > 40)) = len(q) as all_big, len(list_filter(q, lambda x: x > 40)) > 0 as any_big, ceil(len(q) / 2)::int as n_chunks, array_to_string(q || [0], ',') as more, list_sum(q)::double as folded from s""")
def array_collections(spark, sf_dir):
    q = F.col("q")
    dash = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",")
    return quantities(spark, sf_dir).select(*shown(
        F.col("l_orderkey"), big=_joined(v("filter", q, None, ">", 20)), sorted=_joined(v("sort", q)), down=_joined(v("sortDesc", q)), rev=_joined(v("reverse", q)), two=_joined(v("take", q, 2)), rest=_joined(v("drop", q, 2)), ten=v("indexOf", q, 10),
        has=v("includes", q, 10), f=v("first", q), l=v("last", q), lagged=dash(v("lag", q)), led=dash(v("lead", q)), sums=_joined(F.transform(v("cumsum", q), lambda x: x.cast("int"))), ranks=_joined(v("rank", q)), all_big=v("every", q, None, ">", 40),
        any_big=v("some", q, None, ">", 40), n_chunks=F.size(v("chunk", q, 2)), more=_joined(v("concatArrays", q, F.array(F.lit(0)))), folded=v("reduce", q, "add", 0),
    ))


@query("array_objects", """
with r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::int as q, l_extendedprice as p, l_quantity::int % 3 as g from lineitem),
g as (select l_orderkey, g, count(*) as n from r group by 1, 2)
select l_orderkey, count(*) as groups, max(n) as largest, array_to_string(list(g order by g), ',') as keys from g group by 1""")
def array_objects(spark, sf_dir):
    rows = F.transform("rows", lambda r: F.struct((r["q"] % 3).alias("g"), r["q"].alias("q")))
    grouped = quantities(spark, sf_dir).select("l_orderkey", v("groupBy", rows, "g").alias("m"))
    sizes = F.transform(v("values", F.col("m")), lambda a: F.size(a))
    return grouped.select(*shown(F.col("l_orderkey"), groups=F.size("m").cast("long"), largest=F.array_max(sizes), keys=_joined(F.array_sort(v("keys", F.col("m"))))))
