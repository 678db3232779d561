"""Train-versus-test drift: cleaning, coercion and the separate drift checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from querybook.book import query
from querybook.inputs import Inputs
from querybook.metrics_queries import SHUFFLED, SHUFFLED_SQL, auc_sql
from tabflow.functions import temporal as tm
from tabflow.functions import text as tx
from tabflow.operators import drift, metrics, schema, side_tests

NUMBERS = ("price", "cust", "train_only", "const_one_side", "shifted")


# values of the second side lie above nine tenths of the first: the AUC is close to 0.95
CLOSE = "case when is_test=1 then 900+id%100 else id%1000 end"
BOUNDED = (*NUMBERS, "close")


def close_columns(rows):
    return rows.withColumn("close", F.expr(CLOSE))


def long_sql(columns=NUMBERS) -> str:
    return " union all ".join(f"select '{c}' as feature, cast({CLOSE if c == 'close' else c} as double) as v, is_test from ab where {CLOSE if c == 'close' else c} is not null" for c in columns)


@query("auc_univariate", "feature:s auc:d", f"""
select feature, coalesce(greatest(auc,1-auc),5e-1) as auc from (select feature, case when n_pos*n_neg>0 then auc end as auc
 from ({auc_sql(f'({long_sql()})', 'v', 'is_test', 'feature').replace('/(sum(n1)*cast(sum(n0) as double))', '/nullif(sum(n1)*cast(sum(n0) as double),0)')}))""")
def _(d: Inputs):
    return metrics.separability(d.sides, features=NUMBERS, label="is_test")


@query("drift_separable", "feature:s auc:d drifted:i", f"""
select feature, a as auc, case when a>=995e-3 then 1 else 0 end as drifted from (select feature, coalesce(greatest(auc,1-auc),5e-1) as a from (select feature, case when n_pos*n_neg>0 then auc end as auc
 from ({auc_sql(f'({long_sql()})', 'v', 'is_test', 'feature').replace('/(sum(n1)*cast(sum(n0) as double))', '/nullif(sum(n1)*cast(sum(n0) as double),0)')})))""")
def _(d: Inputs):
    return drift.separable(drift.value_table(d.sides, NUMBERS))


@query("drift_separable_bounded", "feature:s low:d high:d drifted:i ranked:i", f"""
with l as ({long_sql(BOUNDED)}), r as (select feature, min(v) as lo, max(v) as hi, count(*) filter (where is_test=0) as c0, count(*) filter (where is_test=1) as c1 from l group by feature),
b as (select l.feature, least(floor((v-lo)/((hi-lo)/64)),63) as cell, cast(count(*) filter (where is_test=0) as double) as n0, cast(count(*) filter (where is_test=1) as double) as n1 from l join r on l.feature=r.feature where c0>0 and c1>0 and hi>lo group by 1,2),
w as (select *, coalesce(sum(n0) over (partition by feature order by cell rows between unbounded preceding and 1 preceding),0) as below from b),
s as (select feature, sum(n1*below)/(sum(n1)*sum(n0)) as a, (sum(n1*below)+sum(n1*n0))/(sum(n1)*sum(n0)) as z from w group by feature),
f as (select r.feature, case when a is null then 5e-1 when a>=5e-1 then a when z<=5e-1 then 1-z else 5e-1 end as low, case when a is null then 5e-1 else greatest(z,1-a) end as high from r left join s on r.feature=s.feature),
e as (select feature, coalesce(greatest(auc,1-auc),5e-1) as auc from (select feature, case when n_pos*n_neg>0 then auc end as auc
 from ({auc_sql(f'({long_sql(BOUNDED)})', 'v', 'is_test', 'feature').replace('/(sum(n1)*cast(sum(n0) as double))', '/nullif(sum(n1)*cast(sum(n0) as double),0)')})))
select f.feature, low, high, case when auc>=95e-2 then 1 else 0 end as drifted, case when high+1e-12>=95e-2 and low-1e-12<95e-2 then 1 else 0 end as ranked from f join e on f.feature=e.feature""")
def _(d: Inputs):
    rows = close_columns(d.sides)
    found = side_tests.separable_bounded(rows, BOUNDED, limit=0.95, cells=64)
    return found.withColumn("ranked", F.col("auc").isNotNull())


@query("drift_disjoint_filters", "feature:s n_shared_found:i drifted:i", "select feature, case when count(*) filter (where k=2)>0 then 1 else 0 end as n_shared_found, case when count(*) filter (where k=2)=0 then 1 else 0 end as drifted from (" + " union all ".join(
    f"select '{c}' as feature, coalesce({x},'nan') as v, count(distinct is_test) as k from ab group by 2" for c, x in (("cat", "cat"), ("disjoint_cat", "disjoint_cat"), ("mostly_placeholder", "mostly_placeholder"), ("ids", "concat(cast(id as varchar),'-',cast(is_test as varchar))"))) + ") group by feature")
def _(d: Inputs):
    rows = d.sides.withColumn("ids", F.concat(F.col("id").cast("string"), F.lit("-"), F.col("is_test").cast("string")))
    found = side_tests.disjoint_by_filters(rows, ["cat", "disjoint_cat", "mostly_placeholder", "ids"])
    return found.withColumn("n_shared_found", (~F.col("drifted")).cast("int"))


PROFILED = ("price", "cat", "train_only", "const_one_side", "text_num", "disjoint_cat")


@query("drift_null_const", "feature:s null_0:d null_1:d constant_0:i constant_1:i drifted:i", "select *, case when abs(null_0-null_1)>=95e-2 or constant_0<>constant_1 then 1 else 0 end as drifted from (" + " union all ".join(
    f"""select '{c}' as feature, avg(case when {c} is null then 1e0 else 0e0 end) filter (where is_test=0) as null_0, avg(case when {c} is null then 1e0 else 0e0 end) filter (where is_test=1) as null_1,
 case when count(distinct {c}) filter (where is_test=0)<=1 then 1 else 0 end as constant_0, case when count(distinct {c}) filter (where is_test=1)<=1 then 1 else 0 end as constant_1 from ab""" for c in PROFILED) + ")")
def _(d: Inputs):
    return drift.null_or_constant(d.sides, PROFILED)


SIDE_STATS = f"""select feature, {', '.join(
    f"quantile_cont(v,1e-2) filter (where is_test={s}) as q_low_{s}, quantile_cont(v,99e-2) filter (where is_test={s}) as q_high_{s}, min(v) filter (where is_test={s}) as min_{s}, max(v) filter (where is_test={s}) as max_{s}"
    for s in (0, 1))} from ({long_sql()}) group by feature"""


@query("drift_quantile", "feature:s q_low_0:d q_high_0:d q_low_1:d q_high_1:d drifted:i", f"select *, coalesce(cast(q_high_0+1e-12<q_low_1 or q_high_1+1e-12<q_low_0 as int),0) as drifted from ({SIDE_STATS})")
def _(d: Inputs):
    return drift.quantile_disjoint(drift.range_profile(drift.value_table(d.sides, NUMBERS)))


@query("drift_ranges_selected", "feature:s q_low_0:d q_high_0:d q_low_1:d q_high_1:d drifted:i", f"select feature, q_low_0, q_high_0, q_low_1, q_high_1, coalesce(cast(q_high_0+1e-12<q_low_1 or q_high_1+1e-12<q_low_0 as int),0) as drifted from ({SIDE_STATS})")
def _(d: Inputs):
    return drift.quantile_disjoint(side_tests.quantile_ranges(d.sides, NUMBERS, small=500))


@query("drift_minmax", "feature:s min_0:d max_0:d min_1:d max_1:d drifted:i", f"select *, coalesce(cast(max_0<min_1 or max_1<min_0 as int),0) as drifted from ({SIDE_STATS})")
def _(d: Inputs):
    return drift.minmax_disjoint(drift.side_ranges(d.sides, NUMBERS))


@query("drift_hist_overlap", "feature:s lo:d hi:d overlap:d drifted:i", f"""
with l as ({long_sql()}), r as (select feature, greatest(min(v) filter (where is_test=0), min(v) filter (where is_test=1)) as lo, least(max(v) filter (where is_test=0), max(v) filter (where is_test=1)) as hi,
 count(*) filter (where is_test=0) as c0, count(*) filter (where is_test=1) as c1 from l group by feature),
b as (select l.feature, least(floor((v-lo)/((hi-lo)/32)),31) as bin, count(*) filter (where is_test=0) as n0, count(*) filter (where is_test=1) as n1
 from l join r on l.feature=r.feature where c0>0 and c1>0 and v>=lo and v<=hi and hi>lo group by 1,2),
o as (select feature, sum(least(n0/t0, n1/t1)) as overlap from (select *, cast(sum(n0) over (partition by feature) as double) as t0, cast(sum(n1) over (partition by feature) as double) as t1 from b) group by feature)
select r.feature, lo, hi, overlap, case when coalesce(overlap,0)<=2e-2 then 1 else 0 end as drifted from r left join o on r.feature=o.feature where c0>0 and c1>0""")
def _(d: Inputs):
    return drift.histogram_overlap(d.sides, NUMBERS)


@query("drift_disjoint_cats", "feature:s n_values:i n_shared:i drifted:i", "select feature, count(*) as n_values, count(*) filter (where k=2) as n_shared, case when count(*) filter (where k=2)=0 then 1 else 0 end as drifted from (" + " union all ".join(
    f"select '{c}' as feature, coalesce({c},'nan') as v, count(distinct is_test) as k from ab group by 2" for c in ("cat", "disjoint_cat", "mostly_placeholder")) + ") group by feature")
def _(d: Inputs):
    return drift.disjoint_categories(d.sides, ["cat", "disjoint_cat", "mostly_placeholder"])


PLACEHOLDERS = "('-','—','–','','NaN','nan','없음','무','None','none')"
KEPT = "try_cast(regexp_replace({0}, '[^0-9.\\-]+', '', 'g') as double)"


@query("placeholder_clean", "id:i text_num:s mostly_placeholder:s cat:s", f"""
select id, {', '.join(f"case when trim({c}) not in {PLACEHOLDERS} then trim({c}) end as {c}" for c in ('text_num', 'mostly_placeholder', 'cat'))} from ab""")
def _(d: Inputs):
    return schema.clean_placeholders(d.sides.select("id", "text_num", "mostly_placeholder", "cat"))


@query("numeric_coercion", "id:i text_num:d mostly_placeholder:s cat:s", f"""
select id, {KEPT.format('text_num')} as text_num, case when trim(mostly_placeholder) not in {PLACEHOLDERS} then mostly_placeholder end as mostly_placeholder, cat from ab""")
def _(d: Inputs):
    return schema.coerce_numeric_like(schema.clean_placeholders(d.sides.select("id", "text_num", "mostly_placeholder", "cat")))


@query("numeric_shares", "text_num:d mostly_placeholder:d cat:d", "select " + ", ".join(
    f"avg(case when {c} not in ('-','','NaN','nan') and {KEPT.format(c)} is not null then 1e0 else 0e0 end) as {c}" for c in ("text_num", "mostly_placeholder", "cat")) + " from ab")
def _(d: Inputs):
    return schema.numeric_shares(d.sides, ["text_num", "mostly_placeholder", "cat"])


@query("forced_numeric", "id:i n:d", f"select id, {KEPT.format('mostly_placeholder')} as n from ab")
def _(d: Inputs):
    rows = d.sides.select("id", F.col("mostly_placeholder").alias("n"))
    return schema.coerce_numeric_like(rows, forced=["n"])


@query("split_combined_key", "id:i num:i date_time:s", "select id, cast(split_part(num_date_time,'_',1) as bigint) as num, split_part(num_date_time,'_',2) as date_time from ab")
def _(d: Inputs):
    return schema.split_key_columns(d.sides.select("id", "num_date_time"), "num_date_time")[0]


@query("text_to_number", "id:i n:d missing:d", "select id, try_cast(case when id%3=0 then concat('v',cast(cust as varchar)) else cast(cust as varchar) end as double) as n, coalesce(try_cast(case when id%3=0 then 'v' else cast(cust as varchar) end as double),-1e0) as missing from ab")
def _(d: Inputs):
    cell = F.when(F.col("id") % 3 == 0, F.concat(F.lit("v"), F.col("cust"))).otherwise(F.col("cust").cast("string"))
    return d.sides.select("id", tx.to_number(cell).alias("n"), tx.to_number(cell, -1).alias("missing"))


@query("aligned_union", "cat:s cust:i extra:d id:i is_test:i", """
select cat, cust, train_only as extra, id, 0 as is_test from ab where is_test=0 union all select cat, cust, null, id, 1 from ab where is_test=1""")
def _(d: Inputs):
    rows = d.sides
    left = rows.filter("is_test = 0").select("id", "cat", "cust", F.col("train_only").alias("extra"))
    return schema.aligned_union(left, rows.filter("is_test = 1").select("cust", "id", "cat"))


def drift_input(d: Inputs, *, compact: bool = False, label: bool = False):
    rows = d.sides
    if compact:  # the key as "<num>_<yyyyMMdd HH>"
        num, day = F.split_part("num_date_time", F.lit("_"), F.lit(1)), F.split_part("num_date_time", F.lit("_"), F.lit(2))
        rows = rows.withColumn("num_date_time", F.concat(num, F.lit("_"), F.replace(day, F.lit("-"), F.lit("")), F.lit(" "), F.lpad((F.col("id") % 24).cast("string"), 2, "0")))
    if label:
        rows = rows.withColumn("power_label", F.col("id") % 2)
    train, test = (rows.filter(F.col("is_test") == s).drop("is_test") for s in (0, 1))
    dim = d.table("customer").select(F.col("c_custkey").alias("num"), "c_mktsegment", "c_acctbal")
    return drift.drift_frame(train, test.drop("train_only", "power_label"), dim, key="id")


@query("drift_union", "__row:i is_test:i num:i price:d cust:i cat:s text_num:d c_mktsegment:s c_acctbal:d dow:i day:i month:i mostly_placeholder:s", f"""
select id as __row, is_test, cust as num, price, cust, cat, {KEPT.format('text_num')} as text_num, c_mktsegment, c_acctbal, isodow(t)-1 as dow, day(t) as day, month(t) as month,
 case when trim(mostly_placeholder) not in {PLACEHOLDERS} then mostly_placeholder end as mostly_placeholder
from (select *, cast(split_part(num_date_time,'_',2) as timestamp) as t from ab) left join customer on cust=c_custkey""")
def _(d: Inputs):
    return drift_input(d).table


@query("drift_union_compact", "__row:i is_test:i num:i hour:i dow:i day:i month:i", """
select id as __row, is_test, cust as num, id%24 as hour, isodow(t)-1 as dow, day(t) as day, month(t) as month from (select *, cast(split_part(num_date_time,'_',2) as timestamp) as t from ab)""")
def _(d: Inputs):
    return drift_input(d, compact=True).table


# by name: ids, target-like columns (power_label, which only train has), the raw time, one-sided columns; the rest from the data
@query("drift_dropped", "column:s reason:s", """
with s as (select *, hour(cast(split_part(num_date_time,'_',2) as timestamp)) as h from ab),
c as (select count(distinct const_one_side) filter (where is_test=0) as c0, count(distinct const_one_side) filter (where is_test=1) as c1,
 max(shifted) filter (where is_test=0) as s0, min(shifted) filter (where is_test=1) as s1, max(h)-min(h) as hours from s),
k as (select count(*) as n from (select disjoint_cat from ab group by 1 having count(distinct is_test)=2))
select "column", reason from (select * from (values ('id','target or id'),('num_date_time','target or id'),('train_only','only in one table'),('date_time','raw time'),('power_label','named like a target')) v("column", reason)
 union all select 'const_one_side','nulls or constant on one side' from c where (c0<=1)<>(c1<=1)
 union all select 'shifted','disjoint quantile ranges' from c where s0<s1
 union all select 'hour','histograms hardly overlap' from c where hours=0
 union all select 'disjoint_cat','no common category' from k where n=0)""")
def _(d: Inputs):
    return d.spark.createDataFrame(sorted(drift_input(d, label=True).dropped.items()), "column string, reason string")


@query("date_text", "id:i form:i hour:i dow:i month:i day:i is_weekend:i unix:d", """
select o_orderkey as id, o_orderkey%8 as form, hour(t) as hour, isodow(t)-1 as dow, month(t) as month, day(t) as day, case when isodow(t)>=6 then 1 else 0 end as is_weekend, epoch(t) as unix
from (select o_orderkey, case o_orderkey%8 when 7 then null when 3 then date_trunc('day', x) when 1 then date_trunc('hour', x) else date_trunc('minute', x) end as t
 from (select o_orderkey, o_orderdate + to_hours(cast(o_orderkey%24 as integer)) + to_minutes(cast(o_orderkey%60 as integer)) as x from orders))""")
def _(d: Inputs):
    t = F.expr("timestampadd(minute, cast(o_orderkey%60 as int), timestampadd(hour, cast(o_orderkey%24 as int), o_orderdate))")
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyyMMdd HH", "yyyy/MM/dd HH:mm", "yyyyMMdd", "yyyy.MM.dd HH:mm", "MM/dd/yyyy HH:mm", "yyyyMMddHHmmss"]
    k, text = F.col("id") % 8, F.lit("20241")  # bare digits of another length are no date
    for i, form in enumerate(forms):
        minute = F.date_trunc("minute", F.col("t"))
        text = F.when(k == i, F.date_format(minute, form)).otherwise(text)
    rows = d.table("orders").select(F.col("o_orderkey").alias("id"), t.alias("t")).withColumn("text", text)
    at = tm.to_time(F.col("text"), "string")
    return rows.select("id", (F.col("id") % 8).alias("form"), *[c.alias(n) for n, c in tm.date_parts(at).items()], tm.unix_seconds(at).alias("unix"))


@query("drift_balanced_sample", "id:i is_test:i", f"""
select id, is_test from (select id, is_test, row_number() over (partition by is_test order by {SHUFFLED_SQL.format('id')}, id) as k from ab) where k<=2500""")
def _(d: Inputs):
    from tabflow.operators import folds

    return folds.balanced_sample(d.sides, "id", "is_test", n=5000, order=SHUFFLED("id"))
