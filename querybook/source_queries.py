"""Round trips through files and documents, and the deterministic parts of model jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querybook.book import query
from querybook.drift_queries import drift_input
from querybook.episode_queries import STEPS
from querybook.inputs import MODELS, Inputs
from querybook.metrics_queries import ERRORS, SHUFFLED, SHUFFLED_SQL, auc_sql
from querybook.survey_queries import clean_sql, squeeze_sql
from tabflow.functions import text as tx
from tabflow.operators import ensemble, folds, metrics, schema
from tabflow.operators import episodes as ep
from tabflow.operators.ranking import row_positions
from tabflow.plans import blend, cv, drift_model
from tabflow.scratch import materialize, scratch_root
from tabflow.sources import cache, tables


def folder(d: Inputs, name: str) -> str:
    """A new folder in the shared scratch space."""
    return f"{scratch_root(d.spark)}/{name}-{uuid.uuid4().hex}"


ORDER_SQL = "select o_orderkey as id, o_custkey as cust, o_orderstatus as status, o_totalprice as price from orders"


def orders(d: Inputs) -> DataFrame:
    return d.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


@query("csv_round_trip", "id:i cust:i status:s price:d", ORDER_SQL)
def _(d: Inputs):
    path = folder(d, "csv")
    tables.write_table(orders(d), path, fmt="csv")
    return tables.read_csv(d.spark, path, "id long, cust long, status string, price double")


@query("typed_csv_round_trip", "id:i price:d", "select o_orderkey as id, o_totalprice as price from orders")
def _(d: Inputs):
    path = folder(d, "typed")
    tables.write_table(orders(d), path, fmt="csv")
    return tables.read_typed_csv(d.spark, path, {"id": "bigint", "cust": "int", "status": "string", "price": "double"}, columns=["id", "price"])


@query("parquet_round_trip", "id:i cust:i status:s price:d", ORDER_SQL)
def _(d: Inputs):
    path = folder(d, "table")
    tables.write_table(orders(d), path, partition_by=["status"])
    return d.spark.read.parquet(path)


@query("entity_files", "game_episode:s action_id:i start_x:d", "select game_episode, action_id, start_x from ep")
def _(d: Inputs):
    base = folder(d, "entities")
    # one file per episode, those without a name in one of their own
    rows = d.episodes.select(F.coalesce("game_episode", F.lit("__HIVE_DEFAULT_PARTITION__")).alias("game_episode"), "action_id", "start_x")
    # listed as they would be beside the data: relative to the folder
    meta = tables.write_entity_files(rows, base)
    return tables.read_entity_files(d.spark, meta, f"{base}/*", "action_id long, start_x double", base=base)


@query("labelled_tables", "part:s id:i cust:i price:d label:s", """
select 'train' as part, o_orderkey as id, o_custkey as cust, o_totalprice as price, o_orderstatus as label from orders where o_orderkey%3>0
union all select 'test', o_orderkey, o_custkey, o_totalprice, null from orders where o_orderkey%3=0 union all select 'template', o_orderkey, null, null, '0.5' from orders where o_orderkey%3=0""")
def _(d: Inputs):
    rows, base = orders(d).withColumnRenamed("status", "label"), folder(d, "labelled")
    parts = {"train": rows.filter("id%3 > 0"), "test": rows.filter("id%3 = 0").drop("label"), "template": rows.filter("id%3 = 0").select("id", F.lit(0.5).alias("label"))}
    for name, part in parts.items():
        tables.write_table(part, f"{base}/{name}", fmt="csv")
    types = {"id": "bigint", "cust": "bigint", "label": "string", "price": "double"}
    found = tables.read_labelled_tables(d.spark, *[f"{base}/{name}" for name in parts], types=types, target="label")
    wide = [t.select(F.lit(name).alias("part"), *[F.col(c).cast(k).alias(c) if c in t.columns else F.lit(None).cast(k).alias(c) for c, k in types.items()]) for name, t in zip(parts, found)]
    return wide[0].unionByName(wide[1]).unionByName(wide[2])


@query("metrics_document", "auc:d n_rows:i n_positive:i columns:i best:s", f"""
select auc, n_pos+n_neg as n_rows, n_pos as n_positive, 4 as columns, 'pred_m1_cat_42' as best from ({auc_sql('cv', 'p', 'y')})""")
def _(d: Inputs):
    r = metrics.roc_auc(d.scores, score="p", label="y").first()
    weights = {m: 0.25 for m in MODELS}
    fields = {**blend.base_document(weights, r["auc"]), "rows": F.struct(F.lit(r["n_pos"] + r["n_neg"]).alias("all"), F.lit(r["n_pos"]).alias("positive"))}
    path = folder(d, "document")
    tables.write_document(d.spark, fields, path)
    doc = tables.read_document(d.spark, path)
    return doc.select(F.col("selected_auc").alias("auc"), F.col("rows.all").alias("n_rows"), F.col("rows.positive").alias("n_positive"), F.size("selected_columns").alias("columns"), F.col("selected_columns")[0].alias("best"))


@query("text_report", "value:s", """
with s as (select c_mktsegment as f, count(*)/1e4 as m from customer group by 1)
select 'Adversarial Validation AUC: 0.5000' as value union all select '' union all select 'Top 20 permuted features (by mean AUC drop):'
union all select concat(rpad(f,30,' '),'  ',printf('%.6f',m),'  ','0.000000') from s""")
def _(d: Inputs):
    shares = d.table("customer").groupBy(F.col("c_mktsegment").alias("feature")).agg((F.count(F.lit(1)) / 1e4).alias("importance_mean"), F.lit(0.0).alias("importance_std"))
    path = folder(d, "report")
    tables.write_report(tables.importance_report(0.5, shares), path)
    return d.spark.read.text(path)


@query("shared_cache", "variant:s n_rows:i n_builds:i", """
select v as variant, count(*) as n_rows, 2 as n_builds from orders, (select unnest(['a','b','c']) as v) where v<>'c' or o_orderstatus='F' group by v""")
def _(d: Inputs):
    built = []

    def build(params):
        built.append(params)
        return orders(d) if params["status"] is None else orders(d).filter(F.col("status") == params["status"])

    root, stamp = folder(d, "cache"), cache.table_fingerprint(orders(d))
    variants = {"a": {"status": None, "input": stamp}, "b": {"status": None, "input": stamp}, "c": {"status": "F", "input": stamp}}
    cache.cached_datasets(d.spark, root, variants, build)
    found = cache.cached_datasets(d.spark, root, variants, build)  # all three are loaded
    rows = [t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(v).alias("variant"), "n_rows", F.lit(len(built)).alias("n_builds")) for v, t in sorted(found.items())]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


LAST_PASS = """select game_episode, start_x/105e0 as ax, end_x/105e0-start_x/105e0 as dx
 from (select *, row_number() over (partition by game_episode order by action_id desc) as back from {0} where type_name='Pass') where back=1 and end_x is not null and end_y is not null"""
MOVED = "(select * replace (case when game_episode=(select min(game_episode) from ep) then start_x/2 else start_x end as start_x) from ep)"


@query("incremental_cache", "run:i rebuilt:s n_rows:i sum_ax:d sum_dx:d", " union all ".join(
    f"select {run} as run, '{rebuilt}' as rebuilt, count(*) as n_rows, sum(ax) as sum_ax, sum(dx) as sum_dx from ({LAST_PASS.format(t)})"
    for run, rebuilt, t in ((1, "all", "ep"), (2, "none", "ep"), (3, "one", MOVED))))
def _(d: Inputs):
    rows = d.episodes
    first = rows.agg(F.min("game_episode")).first()[0]
    moved = rows.withColumn("start_x", F.when(F.col("game_episode") == first, F.col("start_x") / 2).otherwise(F.col("start_x")))
    root, out = folder(d, "parts"), None

    def build(part):
        return ep.sample_targets(ep.targets(ep.order_steps(part), "last_pass")).select("game_episode", "anchor_x", "target_dx")

    for run, source in enumerate((rows, rows, moved), 1):
        found = cache.incremental_dataset(d.spark, root, {"policy": "last_pass"}, source, ["game_episode"], build)
        rebuilt = {0: "none", 1: "one"}.get(len(found.rebuilt), "some" if found.kept else "all")
        row = found.data.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("anchor_x").alias("sum_ax"), F.sum("target_dx").alias("sum_dx"))
        row = materialize(row.select(F.lit(run).alias("run"), F.lit(rebuilt).alias("rebuilt"), "*"), "runs")
        out = row if out is None else out.unionByName(row)
    return out


@query("content_signature", "n_rows:i same:i changed:i", "select count(*) as n_rows, 1 as same, 1 as changed from orders")
def _(d: Inputs):
    rows = orders(d)
    stamp = cache.table_fingerprint(rows)
    same = stamp == cache.table_fingerprint(rows.repartition(3, "id"))
    changed = stamp != cache.table_fingerprint(rows.withColumn("price", F.when(F.col("id") == 1, F.col("price") + 1).otherwise(F.col("price"))))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(int(same)).alias("same"), F.lit(int(changed)).alias("changed"))


# ---------------------------------------------------------------- parts of model jobs

SEARCHED = MODELS[:3]
CANDIDATES = [[1 / 3] * 3, *blend.neighbours([1 / 3] * 3, 0.125)]
MIXED = "(select c.cand, y, " + "+".join(f"p{i}*w{i}" for i in range(3)) + " as s from (select id, y, " + ", ".join(
    f"max(case when model='{m}' then pred end) as p{i}" for i, m in enumerate(SEARCHED)) + " from pm group by id, y), (values " + ", ".join(
    f"({k}, {', '.join(repr(float(x)).replace('e', 'E') + ('' if 'e' in repr(float(x)) else 'E0') for x in w)})" for k, w in enumerate(CANDIDATES)) + ") c(cand, w0, w1, w2))"


@query("simplex_round", "cand:i auc:d", f"select cand, auc from ({auc_sql(MIXED, 's', 'y', 'cand')})")
def _(d: Inputs):
    aucs = blend.blend_aucs(blend.prediction_patterns(d.predictions, SEARCHED), CANDIDATES, bounded=False)
    return d.spark.createDataFrame(list(enumerate(aucs)), "cand int, auc double")


BOUND_CELLS = f"""select cand, cell, sum(y) as n1, sum(1-y) as n0 from (select cand, y, cast(greatest(0, least(floor((s-lo)/((hi-lo)/64)), 63)) as int) as cell from {MIXED},
 (select min(pred) as lo, max(pred) as hi from pm where model in ({', '.join(f"'{m}'" for m in SEARCHED)}))) group by all"""


@query("simplex_bounds", "cand:i low:d high:d ranked:i", f"""
with b as (select cand, sum(n1*below) as sure, sum(n1*cast(n0 as double)) as tied, sum(n1)*cast(sum(n0) as double) as pairs
 from (select *, coalesce(sum(n0) over (partition by cand order by cell rows between unbounded preceding and 1 preceding),0) as below from ({BOUND_CELLS})) group by cand)
select cand, sure/pairs as low, (sure+tied)/pairs as high, case when (sure+tied)/pairs >= (select max(sure/pairs) from b)-1e-9 then 1 else 0 end as ranked from b""")
def _(d: Inputs):
    bounds = blend.auc_bounds(blend.prediction_patterns(d.predictions, SEARCHED), CANDIDATES, cells=64)
    left = blend.survivors(bounds, 0.0)
    return d.spark.createDataFrame([(c, low, high, int(c in left)) for c, (low, high) in enumerate(bounds)], "cand int, low double, high double, ranked int")


@query("common_models", "model:s n:i", "select model, count(*) as n from pm where model<>'pred_m4_cat_42' group by model")
def _(d: Inputs):
    rows = d.predictions
    names = ensemble.common_models(rows, rows.filter("model <> 'pred_m4_cat_42'"))
    return rows.filter(F.col("model").isin(names)).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("wrong_first", "id:i place:i", f"select id, row_number() over (order by (error_type<>'OK') desc, confidence desc, id) as place from ({ERRORS})")
def _(d: Inputs):
    errors = cv.error_frame(d.scores.select("id", "fold", "y", "p"), prob="p", label="y", threshold=0.5)
    return row_positions(errors.select("id", "error_type", "confidence"), order=cv.wrong_first_order(), name="place").select("id", "place")


@query("one_hot_features", "id:i x:d x__missing:i n_flags:i first:i rare:i", """
with r as (select id, case when id%7=0 then null else x end as x, case when id%997=0 then 'odd' else cat end as c from cv),
k as (select c from r group by c having count(*)>=1e-2*(select count(*) from r)),
m as (select median(x) as m from r)
select id, coalesce(x,m) as x, case when x is null then 1 else 0 end as x__missing, 1 as n_flags, case when c=(select min(c) from k) then 1 else 0 end as first, case when c not in (select c from k) then 1 else 0 end as rare from r, m""")
def _(d: Inputs):
    rows = d.scores.select("id", F.when(F.col("id") % 7 != 0, F.col("x")).alias("x"), F.when(F.col("id") % 997 == 0, "odd").otherwise(F.col("cat")).alias("cat"))
    encoder = cv.fit_one_hot(rows, ["x"], ["cat"])
    n = len(encoder.names())
    v = cv.vector_to_array("features")
    flags = F.slice(v, 3, n - 2)
    return encoder.apply(rows).select("id", v[0].alias("x"), v[1].alias("x__missing"), F.aggregate(flags, F.lit(0.0), lambda a, x: a + x).alias("n_flags"), flags[0].alias("first"), flags[n - 3].alias("rare"))


SAMPLE_SQL = f"(select * from (select *, row_number() over (partition by is_test order by {SHUFFLED_SQL.format('id')}, id) as k from ab) where k<=2500)"
PLACED = "row_number() over (partition by f, r order by (id*7919+(f*2+r)*104729+{s}*611953)%100003, id)"
PERMUTED = f"""(select f*10+r as run, a.is_test as y, case when f=0 then o.price else a.price end*1e-3 + case when f=1 then o.cust else a.cust end*1e0 as s
 from (select id, f, r, {PLACED.format(s=0)} as pos from smp, (values (0),(1)) ff(f), (values (0),(1)) rr(r)) x
 join (select id as other, f, r, {PLACED.format(s=1)} as pos from smp, (values (0),(1)) ff(f), (values (0),(1)) rr(r)) z using (f, r, pos)
 join smp a on a.id=x.id join smp o on o.id=z.other)"""


@query("permutation_linear", "feature:s importance_mean:d importance_std:d", f"""
with smp as {SAMPLE_SQL}, base as (select auc as b from ({auc_sql('(select is_test as y, price*1e-3+cust*1e0 as s from smp)', 's', 'y')})),
p as (select run, auc from ({auc_sql(PERMUTED, 's', 'y', 'run')}))
select case run//10 when 0 then 'price' else 'cust' end as feature, avg(b-auc) as importance_mean, stddev_pop(b-auc) as importance_std from p, base group by 1""")
def _(d: Inputs):
    rows = d.sides.select(F.col("id").alias("__row"), "is_test", "price", "cust")
    sample = folds.balanced_sample(rows, "__row", "is_test", n=5000, order=SHUFFLED("__row"))
    linear = lambda df: df.withColumn("score", F.col("price") * 1e-3 + F.col("cust") * 1.0)
    order = lambda row, i, r, s: (row * 7919 + (i * 2 + r) * 104729 + s * 611953) % 100003
    return drift_model.permuted_losses(sample, ["price", "cust"], linear, repeats=2, order=order)


@query("text_preparation", "id:i raw:s clean:s", f"select id, {squeeze_sql('c')} as raw, {clean_sql('c')} as clean from (select id, coalesce(interested,'') as c from sv)")
def _(d: Inputs):
    rows = d.survey.select("id", F.col("interested").alias("raw"))
    return schema.prepare_text(rows, ["raw"]).withColumn("clean", tx.clean_token(tx.text("raw")))


@query("padded_sequences", "game_episode:s points_length:i n:i sum_x:d tail:d", f"""
with s as ({STEPS.format('ep')}), e as (select game_episode as g from s where pos=n_steps and n_steps>=2),
p as (select game_episode, start_x/105e0 as x from s join e on game_episode=g union all select game_episode, end_x/105e0 from s join e on game_episode=g where pos<n_steps)
select game_episode, count(*) as points_length, 64 as n, sum(x) as sum_x, 0e0*count(*) as tail from p group by game_episode""")
def _(d: Inputs):
    # an episode of any length: pieces of up to 64 points, each padded, none left out
    pieces = ep.sequence_pieces(ep.simple_sequences(d.episodes, order=["action_id"]), "points", 64)
    points = ep.pad_sequences(pieces, "points", 64, 2, fill=0.0)
    add = lambda a, p: a + F.coalesce(p[0], F.lit(0.0))
    padding = F.slice("points", F.col("points_length") + 1, 64)
    each = points.select("game_episode", "points_length", F.size("points").alias("n"), F.aggregate("points", F.lit(0.0), add).alias("sum_x"), F.aggregate(padding, F.lit(0.0), add).alias("tail"))
    whole = each.groupBy("game_episode").agg(F.sum("points_length").cast("int").alias("points_length"), F.max("n").alias("n"), F.sum("sum_x").alias("sum_x"), F.sum("tail").alias("tail"))
    return whole.select("game_episode", "points_length", "n", "sum_x", "tail")


@query("drift_likeness_range", "is_test:i n:i in_range:i", "select is_test, count(*) as n, count(*) as in_range from ab group by is_test")
def _(d: Inputs):
    frame = drift_input(d)
    likeness = drift_model.test_likeness(drift_model.fit_drift_model(frame, max_iter=2, max_depth=2), frame.table)
    return likeness.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("test_likeness").between(0, 1)).alias("in_range"))
