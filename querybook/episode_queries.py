"""Event sequences: order, targets, sequence features, vocabularies, fold ensembles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from querybook.book import query
from querybook.inputs import EPISODES, FOLD_DELTAS, Inputs
from tabflow.functions import fixed_values as fv
from tabflow.operators import encode, ensemble, metrics, profile, validate
from tabflow.operators import episodes as ep
from tabflow.operators import folds as fo
from tabflow.operators import prefixes
from tabflow.plans import episode_model
from tabflow.scratch import materialize, scratch_root
from tabflow.streaming import episode_tails

STEPS = """select *, row_number() over w as pos, time_seconds - lag(time_seconds) over w as dt_raw,
 count(*) over (partition by game_episode) as n_steps from {0} window w as (partition by game_episode order by action_id, time_seconds)"""


def tail_sql(k: int) -> str:
    return f"(select * from (select *, row_number() over (partition by game_episode order by action_id desc, time_seconds desc) as back from ep) where back<={k})"


@query("episode_steps", "game_episode:s action_id:i pos:i dt_raw:d dt:d clock:d", f"""
select game_episode, action_id, pos, dt_raw, ln(1+least(greatest(coalesce(dt_raw,0e0),0e0),6e1))/ln(61e0) as dt,
 ln(1+least(greatest(time_seconds,0e0),4e3))/ln(3601e0) as clock from ({STEPS.format('ep')})""")
def _(d: Inputs):
    from tabflow.functions import temporal as tm

    steps = ep.order_steps(d.episodes.select("game_episode", "action_id", "time_seconds"))
    return steps.withColumns({"dt": tm.step_time(F.col("dt_raw")), "clock": tm.clock_time(F.col("time_seconds"))})


@query("episode_tail", "game_episode:s action_id:i pos:i dt_raw:d", f"select game_episode, action_id, pos, dt_raw from ({STEPS.format(tail_sql(5))})")
def _(d: Inputs):
    return ep.order_steps(d.episodes.select("game_episode", "action_id", "time_seconds"), max_tail_k=5)


@query("episodes_min_rows", "game_episode:s action_id:i", """
select game_episode, action_id from (select *, count(*) over (partition by game_episode) as n from ep) where n>=12""")
def _(d: Inputs):
    return ep.drop_short_episodes(d.episodes, min_rows=12)


TARGETS = {
    "all_pass": "select * from s where type_name='Pass' and end_x is not null and end_y is not null",
    "last_pass": "select * from (select *, row_number() over (partition by game_episode order by pos desc) as back from s where type_name='Pass') where back=1 and end_x is not null and end_y is not null",
    "last_row": "select * from s where pos=n_steps",
}


def features_sql(policy: str, source: str = "ep", mask_target: bool = True) -> str:
    """All sequence features of one policy in plain SQL."""
    hide = "and pos<>t_pos" if mask_target else ""
    return f"""with s as ({STEPS.format(source)}),
t as (select game_episode as e, pos as t_pos, team_id as t_team, start_x as tsx, start_y as tsy, end_x as tex, end_y as tey from ({TARGETS[policy]})),
v as (select s.*, t.*, tsx/105e0 as ax, tsy/68e0 as ay,
  case when team_id<>t_team then 105-start_x else start_x end/105e0 as sx, case when team_id<>t_team then 68-start_y else start_y end/68e0 as sy,
  case when team_id<>t_team then 105-end_x else end_x end/105e0 as ex, case when team_id<>t_team then 68-end_y else end_y end/68e0 as ey
  from s join t on game_episode=e and pos<=t_pos),
m as (select *, case when end_x is not null and end_y is not null and type_name not in ('Take-On','Block') {hide} then 1e0 else 0e0 end as mask from v),
g as (select *, case when mask=1 then ex-sx else 0 end as gx, case when mask=1 then ey-sy else 0 end as gy from m),
h as (select *, sqrt(gx*105*gx*105+gy*68*gy*68) as len from g)
select game_episode, t_pos, pos, sx as sx_abs, sy as sy_abs, case when mask=1 then ex else sx end as ex_abs, case when mask=1 then ey else sy end as ey_abs,
 sx-ax as sx_rel, sy-ay as sy_rel, case when mask=1 then ex-ax else 0 end as ex_rel, case when mask=1 then ey-ay else 0 end as ey_rel, mask as end_mask,
 gx as dx, gy as dy, len/sqrt(105e0*105+68*68) as dist,
 case when mask=1 and len>1e-3 then gy*68/len else 0 end as angle_sin, case when mask=1 and len>1e-3 then gx*105/len else 0 end as angle_cos,
 ln(1+least(greatest(coalesce(dt_raw,0e0),0e0),6e1))/ln(61e0) as dt, ln(1+least(greatest(time_seconds,0e0),4e3))/ln(3601e0) as t_abs_log,
 case when period_id=2 then 1 else 0 end as is_second_half, case when t_pos>1 then (pos-1)/cast(t_pos-1 as double) else 0 end as idx_norm,
 case when t_pos>1 then (t_pos-pos)/cast(t_pos-1 as double) else 0 end as steps_to_target, ax as anchor_x, ay as anchor_y,
 player_id, team_id, type_name, case when pos=t_pos then 'None' else result_name end as result_name, tex/105e0-ax as target_dx, tey/68e0-ay as target_dy from h"""


FEATURES = "game_episode:s t_pos:i pos:i " + " ".join(f"{c}:d" for c in fv.SEQUENCE_NUMBERS) + " player_id:i team_id:i type_name:s result_name:s target_dx:d target_dy:d"


@query("episode_long_features", FEATURES, features_sql("last_pass"))
def _(d: Inputs):
    return ep.long_features(d.episodes, policy="last_pass")


@query("inference_features", FEATURES, features_sql("last_row", mask_target=False))
def _(d: Inputs):
    return ep.long_features(d.episodes, policy="last_row")


@query("stream_inference_features", FEATURES, features_sql("last_row", tail_sql(8), mask_target=False))
def _(d: Inputs):
    # the events come in six files dealt by a hash, so every episode's order is broken over the batches
    path = f"{scratch_root(d.spark)}/events-{uuid.uuid4().hex}"
    d.table("events").repartition(6, F.xxhash64("event_id")).write.parquet(path)
    events = d.spark.readStream.schema(d.table("events").schema).option("maxFilesPerTrigger", 2).parquet(path)
    return episode_tails.drain(episode_tails.inference_views(d.shaped(EPISODES, events=events), 8))


@query("pass_prefix_samples", FEATURES, features_sql("all_pass"))
def _(d: Inputs):
    return ep.long_features(d.episodes, policy="all_pass")


# of the pass itself, whose end is hidden, only these numbers differ
LAST = ("sx_abs", "sy_abs", "dt", "t_abs_log", "is_second_half", "anchor_x", "anchor_y")
SUMMARY = "game_episode:s t_pos:i length:i " + " ".join(f"last_{c}:d" for c in LAST) + " " + " ".join(f"mean_{c}:d" for c in fv.SEQUENCE_NUMBERS) + " target_dx:d target_dy:d"


@query("prefix_summaries", SUMMARY, "select game_episode, t_pos, count(*) as length, " + ", ".join(
    [f"arg_max({c}, pos) as last_{c}" for c in LAST] + [f"round(avg({c}), 9) as mean_{c}" for c in fv.SEQUENCE_NUMBERS]) + f", max(target_dx) as target_dx, max(target_dy) as target_dy from ({features_sql('all_pass')}) group by game_episode, t_pos")
def _(d: Inputs):
    # sums in another order differ in the last digits only
    return prefixes.prefix_summaries(d.episodes).withColumns({f"mean_{c}": F.round(f"mean_{c}", 9) for c in fv.SEQUENCE_NUMBERS})


@query("last_pass_target", "game_episode:s t_pos:i game_id:i anchor_x:d anchor_y:d target_dx:d target_dy:d", f"""
with s as ({STEPS.format('ep')}) select game_episode, pos as t_pos, game_id, start_x/105e0 as anchor_x, start_y/68e0 as anchor_y,
 end_x/105e0-start_x/105e0 as target_dx, end_y/68e0-start_y/68e0 as target_dy from ({TARGETS['last_pass']})""")
def _(d: Inputs):
    return ep.sample_targets(ep.targets(ep.order_steps(d.episodes), "last_pass"))


@query("sequence_lengths", "game_episode:s t_pos:i length:i n_numbers:i game_id:i", f"""
with s as ({STEPS.format('ep')}) select game_episode, pos as t_pos, pos as length, 21*pos as n_numbers, game_id from ({TARGETS['last_pass']})""")
def _(d: Inputs):
    return ep.sample_lengths(ep.long_features(d.episodes, policy="last_pass"))


@query("sequence_checks", "n_samples:i n_not_finite:i", f"""
with s as ({STEPS.format('ep')}), t as (select game_episode as e, pos as t_pos from ({TARGETS['last_pass']}))
select count(*) as n_samples, count(*) filter (where bad) as n_not_finite
from (select e, t_pos, max(case when action_id%41=0 then 1 else 0 end)=1 as bad from s join t on game_episode=e and pos<=t_pos group by e, t_pos)""")
def _(d: Inputs):
    # an infinite coordinate spoils every sample its step belongs to
    rows = d.episodes.withColumn("start_x", F.when(F.col("action_id") % 41 == 0, F.lit(float("inf"))).otherwise(F.col("start_x")))
    return ep.check_samples(ep.long_features(rows, policy="last_pass"))


@query("sequence_key_uniqueness", "n_samples:i n_keys:i n_duplicates:i", f"""
with s as ({STEPS.format('ep')}) select count(*) as n_samples, count(distinct game_episode) as n_keys, count(*)-count(distinct game_episode) as n_duplicates from ({TARGETS['all_pass']})""")
def _(d: Inputs):
    return fo.sample_key_report(ep.targets(ep.order_steps(d.episodes), "all_pass"), "game_episode")


@query("simple_points", "game_episode:s point:i x:d y:d target_x:d target_y:d", f"""
with s as ({STEPS.format('ep')}), e as (select game_episode as g, end_x/105e0 as target_x, end_y/68e0 as target_y from s where pos=n_steps and n_steps>=2)
select game_episode, 2*(pos-1) as point, start_x/105e0 as x, start_y/68e0 as y, target_x, target_y from s join e on game_episode=g
union all select game_episode, 2*pos-1, end_x/105e0, end_y/68e0, target_x, target_y from s join e on game_episode=g where pos<n_steps""")
def _(d: Inputs):
    return ep.simple_points(d.episodes, order=["action_id"])


VOCABULARY = " union all ".join(
    f"select '{c}' as field, v as value, count(*) as n, dense_rank() over (order by v)+1 as idx from (select coalesce(cast({c} as varchar),'None') as v from ep) group by v"
    for c in fv.SEQUENCE_CATEGORIES)


@query("vocab_table", "field:s value:s n:i idx:i", VOCABULARY)
def _(d: Inputs):
    return encode.fit_vocabulary(d.episodes, fv.SEQUENCE_CATEGORIES)


@query("vocab_sizes", "field:s size:i", f"select field, count(*)+2 as size from ({VOCABULARY}) group by field")
def _(d: Inputs):
    return encode.vocabulary_sizes(encode.fit_vocabulary(d.episodes, fv.SEQUENCE_CATEGORIES))


@query("vocab_encode", "action_id:i " + " ".join(f"{c}_idx:i" for c in fv.SEQUENCE_CATEGORIES), "select action_id, " + ", ".join(
    f"dense_rank() over (order by coalesce(cast({c} as varchar),'None'))+1 as {c}_idx" for c in fv.SEQUENCE_CATEGORIES) + " from ep")
def _(d: Inputs):
    rows = d.episodes
    return encode.apply_vocabulary(rows, encode.fit_vocabulary(rows, fv.SEQUENCE_CATEGORIES), fv.SEQUENCE_CATEGORIES)


LAST_SQL = "select * from (select *, row_number() over (partition by game_episode order by action_id desc) as back from ep) where back=1"
DELTAS_SQL = FOLD_DELTAS.format(last=f"select *, unnest([1,2,3,4,5]) as fold from ({LAST_SQL})")


def fold_deltas(d: Inputs):
    last = d.episodes.groupBy("game_episode").agg(F.max_by(F.struct("action_id", "start_x", "start_y"), "action_id").alias("r"))
    rows = last.select("game_episode", "r.*", F.explode(F.array(*[F.lit(i) for i in range(1, 6)])).alias("fold"))
    return d.spark.sql(FOLD_DELTAS.format(last="select * from {rows}"), rows=rows)


def ensemble_sql(inner: bool) -> str:
    value = lambda c: f"atanh(least(greatest({c},1e-6-1e0),1e0-1e-6))" if inner else c
    mean = lambda c: ("tanh({0})" if inner else "{0}").format(f"list_avg(list_sort(list({value(c)}))[2:4])")
    end = lambda c, size: f"least(greatest(max(anchor_{c})+{mean('delta_' + c)},0e0),1e0)*{size}"
    return f"select game_episode, {end('x', '105e0')} as end_x, {end('y', '68e0')} as end_y from ({DELTAS_SQL}) group by game_episode"


@query("trimmed_delta_ensemble", "game_episode:s end_x:d end_y:d", ensemble_sql(True))
def _(d: Inputs):
    return ensemble.delta_ensemble(fold_deltas(d), trim=1)


@query("plain_delta_ensemble", "game_episode:s end_x:d end_y:d", ensemble_sql(False))
def _(d: Inputs):
    return ensemble.delta_ensemble(fold_deltas(d), space="mean", trim=1)


@query("anchor_gap", "max_gap:d", f"select max(g) as max_gap from (select game_episode, greatest(max(anchor_x*fold)-min(anchor_x*fold), max(anchor_y)-min(anchor_y)) as g from ({DELTAS_SQL}) group by 1)")
def _(d: Inputs):
    return validate.anchor_report(fold_deltas(d).withColumn("anchor_x", F.col("anchor_x") * F.col("fold")), "game_episode", ["anchor_x", "anchor_y"])


@query("euclid_error", "fold:i mean_error_m:d", f"""
select fold, avg(sqrt(pow((delta_x-anchor_x)*105,2)+pow((delta_y-anchor_y)*68,2)+1e-9)) as mean_error_m from ({DELTAS_SQL}) group by fold""")
def _(d: Inputs):
    return metrics.euclidean_error(fold_deltas(d), pred=("delta_x", "delta_y"), truth=("anchor_x", "anchor_y"), group=["fold"])


@query("euclid_error_plain", "mean_error_m:d", f"select avg(sqrt(pow((delta_x-anchor_x)*105,2)+pow((delta_y-anchor_y)*68,2))) as mean_error_m from ({DELTAS_SQL})")
def _(d: Inputs):
    return metrics.euclidean_error(fold_deltas(d), pred=("delta_x", "delta_y"), truth=("anchor_x", "anchor_y"), eps=0.0)


@query("null_end_profile", "column:s n_null:i null_ratio:d", " union all ".join(
    f"select '{c}' as \"column\", count(*)-count({c}) as n_null, (count(*)-count({c}))/cast(count(*) as double) as null_ratio from ep" for c in ("end_x", "end_y", "result_name")))
def _(d: Inputs):
    return profile.null_profile(d.episodes, ["end_x", "end_y", "result_name"])


def scorer(fold: int) -> episode_model.MeanScorer:
    n = len(fv.SEQUENCE_NUMBERS)
    return episode_model.MeanScorer(tuple(((i * 7 + fold) % 11 - 5) / 8 for i in range(n)), tuple(((i * 5 + fold) % 13 - 6) / 8 for i in range(n)))


def scored_sql(weights) -> str:
    return "greatest(-1e0, least(1e0, " + " + ".join(f"avg(coalesce({c},0))*({w}e0)" for c, w in zip(fv.SEQUENCE_NUMBERS, weights)) + "))"


@query("episode_score_user", "game_episode:s fold:i anchor_x:d anchor_y:d delta_x:d delta_y:d", f"with f as ({features_sql('last_row', mask_target=False)}) " + " union all ".join(
    f"select game_episode, {k} as fold, max(anchor_x) as anchor_x, max(anchor_y) as anchor_y, {scored_sql(scorer(k).weights_x)} as delta_x, {scored_sql(scorer(k).weights_y)} as delta_y from f group by game_episode" for k in range(3)))
def _(d: Inputs):
    rows = d.episodes
    vocabulary = encode.fit_vocabulary(rows, fv.SEQUENCE_CATEGORIES)
    return episode_model.score_episodes(rows, vocabulary, [scorer(k) for k in range(3)], episode_model.mean_scores)


@query("episode_mean_error", "fold:i mean_error_m:d", f"""
with f as ({features_sql('last_pass')}), p as (select game_episode, any_value(target_dx) as tx, any_value(target_dy) as ty, {scored_sql(scorer(0).weights_x)} as dx, {scored_sql(scorer(0).weights_y)} as dy from f group by game_episode)
select 0 as fold, avg(sqrt(pow((dx-tx)*105,2)+pow((dy-ty)*68,2)+1e-9)) as mean_error_m from p""")
def _(d: Inputs):
    rows = d.episodes
    sequences = materialize(ep.train_sequences(rows, encode.fit_vocabulary(rows, fv.SEQUENCE_CATEGORIES), policy="last_pass"), "sequences")
    found = episode_model.predict_with(sequences, episode_model.mean_scores, model=scorer(0))
    return episode_model.mean_error(found.withColumn("fold", F.lit(0)), sequences)


@query("episode_score", "game_episode:s fold:i anchor_x:d anchor_y:d delta_x:d delta_y:d")
def _(d: Inputs):
    rows = d.episodes
    models = episode_model.train_fold_models(episode_model.sample_summary(ep.long_features(rows, policy="last_pass")), 3)
    return episode_model.predict_deltas(models, episode_model.sample_summary(ep.long_features(rows, policy="last_row")))
