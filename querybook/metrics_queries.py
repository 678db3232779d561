"""Metrics, ranks, folds, blends, errors, validation and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from querybook.book import query
from querybook.inputs import MODELS, Inputs
from tabflow.operators import encode, ensemble, folds, metrics, profile, ranking, schema, selection, validate
from tabflow.plans import blend, cv

# the oracle orders keys by this arithmetic instead of a hash
SHUFFLED = lambda key: (F.col(key) * 7919 + 42) % 100003
SHUFFLED_SQL = "({0}*7919+42)%100003"

AUC_SQL = """select {g} sum(n1*(below + n0/2e0))/(sum(n1)*cast(sum(n0) as double)) as auc, sum(n1) as n_pos, sum(n0) as n_neg
from (select {g} n1, n0, coalesce(sum(n0) over ({p} order by v rows between unbounded preceding and 1 preceding),0) as below
      from (select {g} {v} as v, count(*) filter (where {y}=1) as n1, count(*) filter (where {y}=0) as n0 from {t} group by all)) {e}"""


def auc_sql(table: str, value: str, label: str, group: str = "") -> str:
    return AUC_SQL.format(t=table, v=value, y=label, g=f"{group}, " if group else "", p=f"partition by {group}" if group else "", e=f"group by {group}" if group else "")


@query("auc_exact", "auc:d n_pos:i n_neg:i", auc_sql("cv", "p", "y"))
def _(d: Inputs):
    rows = d.scores
    validate.require_unique_key(rows, "id", "scores")
    return metrics.roc_auc(rows, score="p", label="y")


@query("auc_by_model", "model:s auc:d n_pos:i n_neg:i", auc_sql("pm", "pred", "y", "model"))
def _(d: Inputs):
    return metrics.roc_auc(d.predictions, score="pred", label="y", group=["model"])


@query("pct_rank_avg", "id:i model:s pct_rank:d", """
select id, model, (rank() over (partition by model order by pred) + (count(*) over (partition by model, pred) - 1)/2e0)
 / count(*) over (partition by model) as pct_rank from pm""")
def _(d: Inputs):
    return ranking.percent_rank_avg(d.predictions.select("id", "model", "pred"), "pred", group=["model"])


@query("quantiles_by_class", "y:i q0:d q1:d q2:d", """
select y, quantile_cont(x, 1e-2) as q0, quantile_cont(x, 5e-1) as q1, quantile_cont(x, 99e-2) as q2 from cv group by y""")
def _(d: Inputs):
    return ranking.exact_quantiles(d.scores, "x", [0.01, 0.5, 0.99], group=["y"])


@query("quantiles_selected", "y:i feature:s q0:d q1:d q2:d", " union all ".join(
    f"select y, '{c}' as feature, quantile_cont({c}, 1e-2) as q0, quantile_cont({c}, 5e-1) as q1, quantile_cont({c}, 99e-2) as q2 from cv group by y" for c in ("x", "p", "id")))
def _(d: Inputs):
    return selection.select_quantiles(d.scores, ["x", "p", "id"], [0.01, 0.5, 0.99], group=["y"], small=1000)


COUNTS = """count(*) as n, count(*) filter (where p>={0} and y=1) as tp, count(*) filter (where p<{0} and y=0) as tn,
 count(*) filter (where p>={0} and y=0) as fp, count(*) filter (where p<{0} and y=1) as fn"""
RATES = """(tp+tn)/cast(tp+tn+fp+fn as double) as accuracy, case when tp+fp>0 then tp/cast(tp+fp as double) else 0e0 end as prec,
 case when tp+fn>0 then tp/cast(tp+fn as double) else 0e0 end as recall, case when 2*tp+fp+fn>0 then 2*tp/cast(2*tp+fp+fn as double) else 0e0 end as f1"""
GRID = "case when i=180 then 95e-2 else 5e-2+i*((95e-2-5e-2)/180) end"


@query("confusion_at_threshold", "fold:i n:i tp:i tn:i fp:i fn:i accuracy:d prec:d recall:d f1:d",
       f"select fold, n, tp, tn, fp, fn, {RATES} from (select fold, {COUNTS.format('5e-1')} from cv group by fold)")
def _(d: Inputs):
    return metrics.threshold_metrics(d.scores, prob="p", label="y", group=["fold"]).withColumnRenamed("precision", "prec")


@query("threshold_sweep", "threshold:d tp:i tn:i fp:i fn:i accuracy:d prec:d recall:d f1:d",
       f"""select t as threshold, tp, tn, fp, fn, {RATES} from (select t, {COUNTS.format('t')} from cv
 cross join (select {GRID} as t from range(181) r(i)) group by t)""")
def _(d: Inputs):
    return metrics.threshold_sweep(d.scores, prob="p", label="y").withColumnRenamed("precision", "prec")


@query("best_threshold_f1", "fold:i best_threshold:d best_f1:d",
       f"""select fold, t as best_threshold, f1 as best_f1 from (select fold, t, {RATES}, row_number() over (partition by fold order by
 case when 2*tp+fp+fn>0 then 2*tp/cast(2*tp+fp+fn as double) else 0e0 end desc, t) as k
 from (select fold, t, {COUNTS.format('t')} from cv cross join (select {GRID} as t from range(181) r(i)) group by fold, t)) where k=1""")
def _(d: Inputs):
    return metrics.best_threshold_by_f1(d.scores, prob="p", label="y", group=["fold"])


WEIGHTS = {MODELS[0]: 0.4, MODELS[1]: 0.3, MODELS[2]: 0.2, MODELS[3]: 0.1}
WEIGHTED = "sum(pred*case model when 'pred_m1_cat_42' then 4e-1 when 'pred_m2_cat_42' then 3e-1 when 'pred_m3_cat_42' then 2e-1 else 1e-1 end)"
RANKED = "select *, (rank() over (partition by model order by pred) + (count(*) over (partition by model, pred) - 1)/2e0) / count(*) over (partition by model) as r from pm"


@query("weighted_blend", "id:i y:i blend:d", f"select id, y, {WEIGHTED} as blend from pm group by id, y")
def _(d: Inputs):
    return ensemble.weighted_blend(d.predictions, WEIGHTS, keep=["y"])


@query("prob_blend", "id:i blend:d", "select id, avg(pred) as blend from pm group by id")
def _(d: Inputs):
    return ensemble.equal_blend(d.predictions, MODELS)


@query("rank_blend", "id:i blend:d", f"select id, avg(r) as blend from ({RANKED}) group by id")
def _(d: Inputs):
    return ensemble.equal_blend(d.predictions, MODELS, space="rank")


@query("rank_average", "id:i pred:d", f"""
select id, sum(r * case model when 'pred_m1_cat_42' then 6e-1 else 4e-1 end) as pred from ({RANKED}) where model in ('pred_m1_cat_42','pred_m3_cat_42') group by id""")
def _(d: Inputs):
    one = lambda m: d.predictions.filter(F.col("model") == m).select("id", "pred")
    return ensemble.rank_average([one(MODELS[0]), one(MODELS[2])], weights=[3, 2])


@query("top_models_by_auc", "model:s auc:d", f"select model, auc from ({auc_sql('pm', 'pred', 'y', 'model')}) order by auc desc, model limit 3")
def _(d: Inputs):
    return blend.top_models(d.predictions, 3)


@query("simplex_blend_search", "model:s weight:d auc:d")
def _(d: Inputs):
    found = blend.optimised_blend(d.predictions, d.predictions.drop("y"), step=0.05, models=MODELS)
    return d.spark.createDataFrame([(m, w, found.auc) for m, w in zip(found.models, found.weights)], "model string, weight double, auc double")


@query("fold_group", "g:i fold:i", f"""
select g, case when k < r*(q+1) then k//(q+1) else r + (k-r*(q+1))//q end as fold
from (select g, row_number() over (order by {SHUFFLED_SQL.format('g')}, g)-1 as k, count(*) over ()//5 as q, count(*) over ()%5 as r
 from (select distinct o_custkey as g from orders))""")
def _(d: Inputs):
    return folds.group_folds(d.table("orders").select(F.col("o_custkey").alias("g")), "g", 5, order=SHUFFLED("g"))


@query("fold_group_holdout", "g:i is_valid:i", f"""
select g, case when k <= ceil(n*2e-1) then 1 else 0 end as is_valid
from (select g, row_number() over (order by {SHUFFLED_SQL.format('g')}, g) as k, count(*) over () as n from (select distinct o_custkey as g from orders))""")
def _(d: Inputs):
    return folds.group_holdout(d.table("orders").select(F.col("o_custkey").alias("g")), "g", order=SHUFFLED("g"))


@query("fold_stratified", "id:i fold:i", f"select id, (row_number() over (partition by y order by {SHUFFLED_SQL.format('id')}, id)-1)%5+1 as fold from cv")
def _(d: Inputs):
    return folds.stratified_folds(d.scores, "id", "y", 5, order=SHUFFLED("id"))


@query("fold_plain", "id:i fold:i", f"select id, (row_number() over (order by {SHUFFLED_SQL.format('id')}, id)-1)%5+1 as fold from cv")
def _(d: Inputs):
    return folds.plain_folds(d.scores, "id", 5, order=SHUFFLED("id"))


@query("split_stratified", "id:i is_valid:i", f"""
select id, case when k <= floor(n*3e-1+5e-1) then 1 else 0 end as is_valid
from (select id, row_number() over (partition by y order by {SHUFFLED_SQL.format('id')}, id) as k, count(*) over (partition by y) as n from cv)""")
def _(d: Inputs):
    return folds.random_split(d.scores, "id", share=0.3, stratify="y", order=SHUFFLED("id"))


@query("balanced_sample", "id:i y:i", f"""
select id, y from (select id, y, row_number() over (partition by y order by {SHUFFLED_SQL.format('id')}, id) as k from cv) where k <= 2500""")
def _(d: Inputs):
    return folds.balanced_sample(d.scores, "id", "y", n=5000, order=SHUFFLED("id"))


@query("fold_group_overlap", "n_train:i n_valid:i n_both:i", """
select count(*) filter (where t=1) as n_train, count(*) filter (where v=1) as n_valid, count(*) filter (where t=1 and v=1) as n_both
from (select o_custkey, max(case when o_orderkey%5>0 then 1 else 0 end) as t, max(case when o_orderkey%5=0 then 1 else 0 end) as v from orders group by 1)""")
def _(d: Inputs):
    o = d.table("orders")
    return folds.fold_overlap(o.filter("o_orderkey%5 > 0"), o.filter("o_orderkey%5 = 0"), "o_custkey")


FOLD_AUC = f"select fold, auc from ({auc_sql('cv', 'p', 'y', 'fold')})"


@query("fold_summary", "fold:s scope:s auc:d best_iteration_mean:d best_iteration_median:d best_iteration_min:i best_iteration_max:i n_models:i", f"""
with f as ({FOLD_AUC}), m as (select fold, x as it from (select fold, floor(x) as x from cv)),
s as (select fold, avg(it) as a, median(it) as b, min(it) as c, max(it) as d, count(*) as e from m group by fold)
select cast(f.fold as varchar) as fold, 'fold_ensemble' as scope, auc, a as best_iteration_mean, b as best_iteration_median, c as best_iteration_min,
 d as best_iteration_max, e as n_models from f join s on f.fold=s.fold
union all select 'mean','cv_summary',avg(auc),null,null,null,null,null from f
union all select 'std','cv_summary',stddev_pop(auc),null,null,null,null,null from f
union all select 'oof','cv_summary',(select auc from ({auc_sql('cv', 'p', 'y')})),null,null,null,null,null""")
def _(d: Inputs):
    rows = d.scores
    detail = rows.select("fold", F.floor("x").alias("best_iteration"))
    per_fold = metrics.roc_auc(rows, score="p", label="y", group=["fold"])
    return ensemble.fold_summary(detail, per_fold, metrics.roc_auc(rows, score="p", label="y").first()["auc"])


@query("oof_assembly", "id:i fold:i model:s pred:d", """
select id, f as fold, model, pred*(1+f)/1e1 as pred from (select id, model, pred, unnest([1,2,3]) as f from pm) where f=id%3+1""")
def _(d: Inputs):
    each = d.predictions.select("id", "model", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("fold"), "pred")
    predictions = each.withColumn("pred", F.col("pred") * (1 + F.col("fold")) / 10.0)
    assignment = d.scores.select("id", (F.col("id") % 3 + 1).cast("int").alias("fold"))
    return ensemble.assemble_oof(predictions, assignment)


@query("test_prediction_mean", "id:i model:s pred:d", "select id, model, avg(pred*f/3e0) as pred from (select id, model, pred, unnest([1,2,3]) as f from pm) group by id, model")
def _(d: Inputs):
    each = d.predictions.select("id", "model", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("fold"), "pred")
    return ensemble.mean_over_folds(each.withColumn("pred", F.col("pred") * F.col("fold") / 3.0))


@query("model_oof_wide", "id:i y:i m1:d m2:d m3:d m4:d", """
select id, y, max(pred) filter (where model='pred_m1_cat_42') as m1, max(pred) filter (where model='pred_m2_cat_42') as m2,
 max(pred) filter (where model='pred_m3_cat_42') as m3, max(pred) filter (where model='pred_m4_cat_42') as m4 from pm group by id, y""")
def _(d: Inputs):
    wide = ensemble.to_wide(d.predictions, MODELS, keep=["y"])
    return wide.select("id", "y", *[F.col(m).alias(f"m{i}") for i, m in enumerate(MODELS, start=1)])


@query("importance_table", "feature:s importance_mean:d importance_std:d n_models:i", """
select l_returnflag as feature, avg(l_discount) as importance_mean, stddev_pop(l_discount) as importance_std, count(*) as n_models from lineitem group by 1""")
def _(d: Inputs):
    return ensemble.importance_table(d.table("lineitem").select(F.col("l_returnflag").alias("feature"), F.col("l_discount").alias("importance")))


ERRORS = """select id, fold, y, p, case when p>=5e-1 then 1 else 0 end as y_pred,
 case when y=0 and p>=5e-1 then 'FP' when y=1 and p<5e-1 then 'FN' else 'OK' end as error_type,
 case when p>=5e-1 then p else 1-p end as confidence, abs(p-5e-1) as margin_to_threshold, cat, x from cv"""


@query("error_frame", "id:i fold:i y:i p:d y_pred:i error_type:s confidence:d margin_to_threshold:d cat:s x:d", ERRORS)
def _(d: Inputs):
    rows = d.scores
    return cv.error_frame(rows.select("id", "fold", "y", "p"), prob="p", label="y", threshold=0.5, extras=rows.select("id", "cat", "x"))


@query("confident_wrong_topn", "id:i fold:i error_type:s confidence:d", f"""
select id, fold, error_type, confidence from (select *, row_number() over (partition by fold order by confidence desc, id) as k
 from ({ERRORS}) where error_type<>'OK') where k<=10""")
def _(d: Inputs):
    return cv.confident_errors(cv.error_frame(d.scores.select("id", "fold", "y", "p"), prob="p", label="y", threshold=0.5), 10, within="fold")


@query("error_type_counts", "fold:i error_type:s n:i", f"select fold, error_type, count(*) as n from ({ERRORS}) where error_type<>'OK' group by 1,2")
def _(d: Inputs):
    return metrics.error_counts(cv.error_frame(d.scores, prob="p", label="y", threshold=0.5), ["fold"])


@query("submission_labels", "id:i pred:d fixed:i tuned:i", """
with b as (select avg(pred) as blend, id from pm group by id)
select o_orderkey as id, blend as pred, case when blend>=5e-1 then 1 else 0 end as fixed, case when blend>=45e-2 then 1 else 0 end as tuned
from orders left join b on o_orderkey=b.id""")
def _(d: Inputs):
    template = d.table("orders").select(F.col("o_orderkey").alias("id"))
    s = cv.submission(template, ensemble.equal_blend(d.predictions, MODELS))
    return cv.label_columns(s, "pred", {"fixed": 0.5, "tuned": 0.45})


@query("class_weights", "cat:s n:i weight:d", "select cat, n, sum(n) over ()/(count(*) over ()*cast(n as double)) as weight from (select cat, count(*) as n from cv group by cat)")
def _(d: Inputs):
    return encode.class_weights(d.scores, "cat")


@query("median_impute", "id:i time_input:d", "select id, coalesce(time_input, (select median(time_input) from sv)) as time_input from sv")
def _(d: Inputs):
    rows = d.survey.select("id", "time_input")
    return encode.impute_medians(rows, encode.fit_medians(rows, ["time_input"]))


@query("key_uniqueness", "n_rows:i n_null:i n_keys:i n_duplicates:i", """
select sum(n) as n_rows, coalesce(sum(n) filter (where k is null),0) as n_null, count(k) as n_keys, sum(n-1) filter (where k is not null) as n_duplicates
from (select case when l_linenumber=7 then null else l_orderkey end as k, count(*) as n from lineitem group by 1)""")
def _(d: Inputs):
    return validate.key_report(d.table("lineitem").select(F.when(F.col("l_linenumber") != 7, F.col("l_orderkey")).alias("k")), "k")


@query("duplicate_key_examples", "l_orderkey:i n:i", "select l_orderkey, count(*) as n from lineitem group by 1 having count(*)>1 order by 1 limit 10")
def _(d: Inputs):
    return validate.duplicate_keys(d.table("lineitem"), "l_orderkey")


@query("id_set_diff", "n_extra:i n_missing:i n_common:i", """
select (select count(distinct o_custkey) from orders where o_custkey not in (select c_custkey from customer where c_acctbal>0)) as n_extra,
 (select count(*) from customer where c_acctbal>0 and c_custkey not in (select o_custkey from orders)) as n_missing,
 (select count(*) from customer where c_acctbal>0 and c_custkey in (select o_custkey from orders)) as n_common""")
def _(d: Inputs):
    left = d.table("orders").select(F.col("o_custkey").alias("k"))
    return validate.key_set_report(left, d.table("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@query("label_domain", "label:s n:i", "select o_orderstatus as label, count(*) as n from orders where o_orderstatus not in ('F','O') group by 1")
def _(d: Inputs):
    return validate.unknown_labels(d.table("orders"), "o_orderstatus", {"F": 1, "O": 0})


@query("probability_range", "n_rows:i n_null:i low:d high:d", """
select count(*) as n_rows, count(*)-count(v) as n_null, min(v) as low, max(v) as high from (select case when id%17>0 then p end as v from cv)""")
def _(d: Inputs):
    return validate.range_report(d.scores.select(F.when(F.col("id") % 17 > 0, F.col("p")).alias("v")), "v")


@query("target_distribution", "t:i n:i share:d", """
select t, count(*) as n, count(*)/cast((select count(*) from cv) as double) as share from (select case when id%13>0 then y end as t from cv) group by t""")
def _(d: Inputs):
    return profile.target_distribution(d.scores.select(F.when(F.col("id") % 13 > 0, F.col("y")).alias("t")), "t")


NULLS = " union all ".join(f"select '{c}' as \"column\", count(*)-count({c}) as n_null, (count(*)-count({c}))/cast(count(*) as double) as null_ratio from sv" for c in (
    "id", "major1", "major2", "time_input", "completed_semester", "interested", "previous_class_3", "previous_class_4", "desired_job", "completed"))


@query("null_profile", "column:s n_null:i null_ratio:d", NULLS)
def _(d: Inputs):
    return profile.null_profile(d.survey)


@query("most_nulls", "column:s n_null:i", f"select \"column\", n_null from ({NULLS}) order by n_null desc, \"column\" limit 3")
def _(d: Inputs):
    return profile.most_nulls(d.survey, 3)


@query("sparse_columns", "column:s", f"select \"column\" from ({NULLS}) where null_ratio > 3e-1 and \"column\" <> 'previous_class_4'")
def _(d: Inputs):
    gone = schema.sparse_columns(d.survey, ["previous_class_4"], share=0.3)
    return d.spark.createDataFrame([(c,) for c in gone], "column string")


@query("dup_profile", "n_rows:i n_distinct:i n_duplicates:i", """
select sum(n) as n_rows, count(*) as n_distinct, sum(n-1) as n_duplicates from (select l_orderkey, l_linenumber, l_returnflag, count(*) as n from lineitem group by 1,2,3)""")
def _(d: Inputs):
    return profile.duplicate_rows(d.table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_tax"), ["l_tax"])


@query("dup_documents", "n_rows:i n_distinct:i n_duplicates:i", """
select sum(n) as n_rows, count(*) as n_distinct, sum(n-1) as n_duplicates from (select text, lang, source, n_chars, count(*) as n from documents group by 1,2,3,4)""")
def _(d: Inputs):
    return profile.duplicate_rows(d.table("documents"), ["doc_id"])


@query("column_summary", "column:s count:i mean:d std:d min:d max:d", " union all ".join(
    f"select '{c}' as \"column\", count({c}) as count, avg({c}) as mean, stddev({c}) as std, min({c}) as min, max({c}) as max from ep" for c in ("time_seconds", "start_x", "end_x")))
def _(d: Inputs):
    return profile.summary(d.episodes, ["time_seconds", "start_x", "end_x"])


@query("distinct_types", "type_name:s", "select distinct type_name from ep")
def _(d: Inputs):
    return profile.distinct_values(d.episodes, "type_name")


@query("histogram_fixed", "is_test:i bin:i n:i", """
select is_test, least(floor((price-1e4)/((4e5-1e4)/32)),31) as bin, count(*) as n from ab where price>=1e4 and price<=4e5 group by 1,2""")
def _(d: Inputs):
    return profile.histogram(d.sides, "price", 1e4, 4e5, 32, side="is_test")


@query("column_histograms", "column:s bin:i n:i", " union all ".join(
    f"select '{c}' as \"column\", least(floor(({c}-lo)/((hi-lo)/10)),9) as bin, count(*) as n from ep cross join (select min({c}) as lo, max({c}) as hi from ep) where {c} is not null group by 1,2"
    for c in ("time_seconds", "start_x", "end_y")))
def _(d: Inputs):
    return profile.column_histograms(d.episodes, ["time_seconds", "start_x", "end_y"])


@query("side_ranges", "is_test:i low:d high:d null_ratio:d", "select is_test, min(train_only) as low, max(train_only) as high, avg(case when train_only is null then 1e0 else 0e0 end) as null_ratio from ab group by 1")
def _(d: Inputs):
    return profile.side_ranges(d.sides, "train_only", "is_test")


@query("dim_left_join", "c_custkey:i c_nationkey:i n_nationkey:i n_name:s", "select c_custkey, c_nationkey, n_nationkey, n_name from customer left join nation on c_nationkey=n_nationkey and n_regionkey<3")
def _(d: Inputs):
    return schema.join_dimension(d.table("customer"), d.table("nation").filter("n_regionkey < 3"), "c_nationkey")


