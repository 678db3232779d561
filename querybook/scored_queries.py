"""Model jobs with a fixed scorer in the model's place: what they do around a model has one right answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from querybook.book import query
from querybook.drift_queries import drift_input
from querybook.inputs import Inputs
from querybook.metrics_queries import COUNTS, FOLD_AUC, GRID, SHUFFLED, SHUFFLED_SQL, auc_sql
from querybook.source_queries import folder
from querybook.survey_queries import AUTO_MEAN, FOLDED
from tabflow.operators import ensemble, folds, metrics
from tabflow.operators.ranking import row_positions
from tabflow.plans import blend, cv, drift_model
from tabflow.sources import tables


@query("run_document", "target:s n:i fold:s auc:d fold_mean:d fold_std:d oof:d public_score:d gap:d splits:s weight_a:d", f"""
with f as ({FOLD_AUC}), o as (select auc from ({auc_sql('cv', 'p', 'y')})), t as (select cast(y as varchar) as target, count(*) as n from cv group by y)
select target, n, cast(fold as varchar) as fold, f.auc, (select avg(auc) from f) as fold_mean, (select stddev_pop(auc) from f) as fold_std, o.auc as oof, 9e-1 as public_score, 9e-1-o.auc as gap, '5' as splits, 75e-2 as weight_a from t, f, o""")
def _(d: Inputs):
    rows = d.scores
    detail = rows.select("fold", F.floor("x").alias("best_iteration"))
    summary = ensemble.fold_summary(detail, metrics.roc_auc(rows, score="p", label="y", group=["fold"]), metrics.roc_auc(rows, score="p", label="y").first()["auc"])
    path = folder(d, "run")
    tables.write_document(d.spark, cv.run_document(rows, "y", summary, {"a": 0.75, "b": 0.25}, public_score=0.9, n_splits=5, seed=42), path)
    schema = """target_distribution map<string,double>, weights map<string,double>, oof_auc double, fold_auc_mean double, fold_auc_std double, fold_auc map<string,double>,
        public_score double, oof_public_gap double, settings map<string,string>"""
    doc = tables.read_document(d.spark, path, schema)
    each = doc.select("*", F.explode("target_distribution").alias("target", "n")).select("*", F.explode("fold_auc").alias("fold", "auc"))
    return each.select("target", "n", "fold", "auc", F.col("fold_auc_mean").alias("fold_mean"), F.col("fold_auc_std").alias("fold_std"), F.col("oof_auc").alias("oof"), "public_score", F.col("oof_public_gap").alias("gap"), F.col("settings")["n_splits"].alias("splits"), F.col("weights")["a"].alias("weight_a"))


# one model ranks every row right, the other backwards: their equal blend knows nothing, and one
# step towards the first model is the best there is
TWO = """select o_orderkey as id, case when o_orderstatus='F' then 1 else 0 end as y, case when o_orderstatus='F' then 5e-1 else 0e0 end + (o_orderkey%64)/1.28e2 as p from {orders}"""
SIDES_SQL = TWO.format(orders="orders")


@query("blend_document", "strategy:s model:s weight:d candidate:d selected:d converged:i step:d", f"""
with b as ({SIDES_SQL}), c as (select m, auc from (select 'pred_a' as m, auc from ({auc_sql('b', 'p', 'y')}) union all select 'pred_b', auc from ({auc_sql('(select y, 1-p as q from b)', 'q', 'y')}))),
w as (select auc from ({auc_sql('(select y, p*625e-3+(1-p)*375e-3 as s from b)', 's', 'y')}))
select 'prob' as strategy, m as model, case m when 'pred_a' then 625e-3 else 375e-3 end as weight, c.auc as candidate, w.auc as selected, 1 as converged, 125e-3 as step from c, w""")
def _(d: Inputs):
    rows = d.spark.sql(TWO, orders=d.table("orders"))
    oof = rows.select("id", "y", F.explode(F.array(F.struct(F.lit("pred_a").alias("model"), F.col("p").alias("pred")), F.struct(F.lit("pred_b").alias("model"), (1 - F.col("p")).alias("pred")))).alias("m")).select("id", "y", "m.*")
    patterns = blend.prediction_patterns(oof, ["pred_a", "pred_b"])
    weights, auc, converged = blend.simplex_search(patterns, 2, step=0.125, eliminate=True)
    names = ["pred_a", "pred_b"]
    aucs = {r["model"]: r["auc"] for r in blend.model_aucs(oof).collect()}
    found = blend.Blend("prob", names, weights, auc, {"prob_auc": auc}, aucs, oof, oof, converged)
    path = folder(d, "blend")
    tables.write_document(d.spark, blend.blend_document(found, requested="oof_opt", step=0.125, top_k=2), path)
    schema = "selected_strategy string, selected_auc double, step double, weights map<string,double>, converged boolean, top_candidates map<string,double>"
    doc = tables.read_document(d.spark, path, schema).select("*", F.explode("weights").alias("model", "weight"))
    return doc.select(F.col("selected_strategy").alias("strategy"), "model", "weight", F.col("top_candidates")[F.col("model")].alias("candidate"), F.col("selected_auc").alias("selected"), "converged", "step")


BEST = f"""(select t from (select t, row_number() over (order by case when 2*tp+fp+fn>0 then 2*tp/cast(2*tp+fp+fn as double) else 0e0 end desc, t) as k
 from (select t, {COUNTS.format('t')} from cv cross join (select {GRID} as t from range(181) r(i)) group by t)) where k=1)"""


@query("error_report", "place:i id:i y:i y_pred:i margin_to_threshold:d error_type:s confidence:d cat:s x:d", f"""
with b as {BEST}, e as (select id, y, p, t, case when p>=t then 1 else 0 end as y_pred, cat, x from cv, b),
r as (select *, case when y=0 and y_pred=1 then 'FP' when y=1 and y_pred=0 then 'FN' else 'OK' end as error_type, case when y_pred=1 then p else 1-p end as confidence from e)
select row_number() over (order by confidence desc, id) as place, id, y, y_pred, abs(p-t) as margin_to_threshold, error_type, confidence, cat, x from r where error_type<>'OK'""")
def _(d: Inputs):
    rows = d.scores
    oof = rows.select("id", "fold", "y", "p")
    tuned = metrics.best_threshold_by_f1(oof, prob="p", label="y").first()["best_threshold"]
    errors = cv.error_frame(oof.drop("fold"), prob="p", label="y", threshold=tuned, extras=rows.select("id", "cat", "x"))
    return row_positions(cv.confident_errors(errors, 0), order=cv.wrong_first_order(), name="place")


MEANS = f"""b as ({FOLDED}), c as (select v, f, count(*) as n, sum(y) as s from b group by v, f),
k as (select v, f, sum(n) over (partition by v) - n as n, sum(s) over (partition by v) - s as s from c),
w as (select f, (select count(*) from b) - count(*) as n, (select sum(y) from b) - sum(y) as s from b group by f),
e as (select k.v, k.f, k.n, k.s/cast(nullif(k.n,0) as double) as m, w.s/cast(w.n as double) as g, (w.s/cast(w.n as double))*(1-w.s/cast(w.n as double)) as vg,
 (k.s/cast(nullif(k.n,0) as double))*(1-k.s/cast(nullif(k.n,0) as double)) as vi from k join w on k.f=w.f)"""


@query("forest_inputs", "id:i major2_te:d time_input:d weight:d", f"""
with {MEANS}, n as (select y, count(*) as n from b group by y)
select b.id, {AUTO_MEAN.replace('n is null or n=0', 'e.n is null or e.n=0').replace('vg*n', 'vg*e.n')} as major2_te, coalesce(sv.time_input, (select median(time_input) from sv)) as time_input,
 (select count(*) from b)/((select count(*) from n)*cast(n.n as double)) as weight from b join e on b.v=e.v and b.f=e.f join n on n.y=b.y join sv on sv.id=b.id""")
def _(d: Inputs):
    rows = d.survey
    assigned = rows.select("id", (F.col("id") % 5).alias("fold"))
    return cv.forest_inputs(rows, rows.drop("completed"), assigned, key="id", label="completed", categorical=["major2"], numeric=["time_input"])[0]


@query("fold_split_rows", "id:i g:i is_valid:i", f"""
with f as (select g, case when k < r*(q+1) then k//(q+1) else r + (k-r*(q+1))//q end as fold
 from (select g, row_number() over (order by {SHUFFLED_SQL.format('g')}, g)-1 as k, count(*) over ()//5 as q, count(*) over ()%5 as r from (select distinct o_custkey as g from orders)))
select o_orderkey as id, g, case when fold=2 then 1 else 0 end as is_valid from orders join f on o_custkey=g""")
def _(d: Inputs):
    rows = d.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("g"))
    assigned = folds.group_folds(rows, "g", 5, order=SHUFFLED("g"))
    train, valid = folds.split_by_groups(rows, assigned, "g", 2)
    return train.withColumn("is_valid", F.lit(0)).unionByName(valid.withColumn("is_valid", F.lit(1)))


# a scorer that reads two columns of the drift table
SCORER = "1e0/(1e0+exp(-(price-1.2e5)/5e4-(cust%7)/3e0))"


def scored(df):
    return df.withColumn("score", 1.0 / (1.0 + F.exp(-(F.col("price") - 1.2e5) / 5e4 - (F.col("num") % 7) / 3.0)))


@query("drift_likeness", "__row:i is_test:i test_likeness:d", f"select id as __row, is_test, {SCORER} as test_likeness from ab")
def _(d: Inputs):
    return drift_model.test_likeness(scored, drift_input(d).table)


@query("drift_judged", "n_train:i n_valid:i auc:d", f"""
with v as (select id, is_test, {SCORER} as s, row_number() over (partition by is_test order by {SHUFFLED_SQL.format('id')}, id) as k, count(*) over (partition by is_test) as n from ab),
j as (select *, k <= floor(n*3e-1+5e-1) as is_valid from v)
select (select count(*) from j where not is_valid) as n_train, n_pos+n_neg as n_valid, auc from ({auc_sql('(select * from j where is_valid)', 's', 'is_test')})""")
def _(d: Inputs):
    train, valid = drift_model.split_sides(drift_input(d), order=SHUFFLED("__row"))
    return d.spark.createDataFrame([(train.count(), valid.count(), drift_model.judged(valid, scored))], "n_train long, n_valid long, auc double")
