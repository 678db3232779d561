"""Inputs shaped like the data the operators are made for, as SQL over the given tables.

The same text runs on Spark (tables as ``{name}`` placeholders) and in the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EPISODES = """
select event_id as action_id, user_id as game_id,
 concat(cast(user_id as string),'_',cast(cast(floor((day(ts)-1)/7e0) as bigint) as string)) as game_episode,
 case when hour(ts)<12 then 1 else 2 end as period_id,
 cast((hour(ts)%12)*3600+minute(ts)*60+floor(second(ts)) as double)/1.2e2 as time_seconds,
 event_id%2+100 as team_id, event_id%23 as player_id,
 case event_type when 'purchase' then 'Pass' when 'view' then 'Carry' when 'click' then 'Take-On' when 'signup' then 'Block' else 'Recovery' end as type_name,
 case event_type when 'purchase' then 'Successful' when 'click' then 'Unsuccessful' end as result_name,
 ((event_id*37)%1051)/1e1 as start_x, ((event_id*53)%681)/1e1 as start_y,
 case when event_type<>'error' and event_id%13<>0 then ((event_id*71)%1051)/1e1 end as end_x,
 case when event_type<>'error' and event_id%13<>0 then ((event_id*97)%681)/1e1 end as end_y
from {events}"""

SCORES = """
select o_orderkey as id, case when o_orderstatus='F' then 1 else 0 end as y,
 ((o_orderkey*7919)%1000)/1e3*8e-1 + case when o_orderstatus='F' then 2e-1 else 0e0 end as p,
 ((o_orderkey*7919+42)%100003)%5+1 as fold, o_orderpriority as cat, o_totalprice as x
from {orders}"""

MODELS = ("pred_m1_cat_42", "pred_m2_cat_42", "pred_m3_cat_42", "pred_m4_cat_42")
_PREDICTION = """
case model when 'pred_m1_cat_42' then ((o_orderkey*7919)%1000)/1e3*8e-1 + case when o_orderstatus='F' then 2e-1 else 0e0 end
  when 'pred_m2_cat_42' then ((o_orderkey*104729)%1000)/1e3*7e-1 + case when o_orderstatus='F' then 3e-1 else 0e0 end
  when 'pred_m3_cat_42' then ((o_orderkey*15485863)%500)/5e2 else 5e-1 end as pred"""
_MODEL_LIST = ", ".join(f"'{m}'" for m in MODELS)
PREDICTIONS = f"""
select o_orderkey as id, case when o_orderstatus='F' then 1 else 0 end as y, model, {_PREDICTION}
from (select o_orderkey, o_orderstatus, explode(array({_MODEL_LIST})) as model from {{orders}})"""
PREDICTIONS_ORACLE = f"""
select o_orderkey as id, case when o_orderstatus='F' then 1 else 0 end as y, model, {_PREDICTION}
from (select o_orderkey, o_orderstatus, unnest([{_MODEL_LIST}]) as model from {{orders}})"""

SIDES = """
select o_orderkey as id, case when o_orderdate < cast('1999-01-01' as timestamp) then 0 else 1 end as is_test,
 concat(cast(o_custkey as string),'_',cast(cast(o_orderdate as date) as string)) as num_date_time,
 o_totalprice as price, o_custkey as cust, o_orderpriority as cat,
 case when o_orderdate < cast('1999-01-01' as timestamp) then o_totalprice end as train_only,
 case when o_orderdate < cast('1999-01-01' as timestamp) then 1 else o_custkey end as const_one_side,
 case when o_orderdate < cast('1999-01-01' as timestamp) then o_orderkey else o_orderkey+10000000 end as shifted,
 case when o_orderkey%5=0 then '-' when o_orderkey%11=0 then ' ' else concat(cast(cast(floor(o_totalprice) as bigint) as string),' kWh') end as text_num,
 case when o_orderkey%5<3 then '-' else cast(o_custkey as string) end as mostly_placeholder,
 case when o_orderdate < cast('1999-01-01' as timestamp) then concat('a',o_orderstatus) else concat('b',o_orderstatus) end as disjoint_cat
from {orders}"""

SURVEY = """
select c_custkey as id, n_name as major1, case when c_custkey%3=0 then null else c_mktsegment end as major2,
 case when c_custkey%7=0 then null else c_acctbal/2e3 end as time_input, cast(floor(c_acctbal/4e2) as bigint) as completed_semester,
 case when c_custkey%4=0 then ' None. ' when c_custkey%4=1 then concat(n_name,', ',c_mktsegment,' / ',n_name) when c_custkey%4=2 then '' else c_mktsegment end as interested,
 case c_custkey%5 when 0 then '0003: intro' when 1 then '0007 advanced, 0003: intro' when 2 then 'none' when 3 then null else 'misc' end as previous_class_3,
 case c_custkey%3 when 0 then '0011: sql' when 1 then null else '' end as previous_class_4,
 case c_custkey%12 when 0 then 'A. x, C. y' when 1 then 'B. z; B. z' when 2 then 'K. other/A. x' when 3 then 'see D. here' when 4 then null when 5 then 'none'
  when 6 then 'E. e, F. f' when 7 then 'G. g|H. h' when 8 then 'I. i, J. j' when 9 then 'M. m, R. r / U. u' when 10 then 'O. o; P. p; Q. q' else 'C. c' end as desired_job,
 case when (c_custkey*31)%10<7 then 1 else 0 end as completed
from {customer} join {nation} on c_nationkey=n_nationkey"""

# one delta prediction per episode and fold, from the last action of the episode
FOLD_DELTAS = """
select game_episode, fold, start_x/1.05e2 as anchor_x, start_y/6.8e1 as anchor_y,
 ((action_id*(31+fold))%401-200)/2e2 as delta_x, ((action_id*(31+7*fold))%401-200)/2e2 as delta_y
from ({last}) l"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Inputs:
    """Given tables and shaped inputs of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _sql(self, text: str) -> DataFrame:
        used = {t: self.table(t) for t in TABLES if f"{{{t}}}" in text}
        return self.spark.sql(text, **used)

    def shaped(self, text: str, **tables: DataFrame) -> DataFrame:
        """A shape over other tables than the given ones, such as streams."""
        return self.spark.sql(text, **tables)

    @property
    def episodes(self) -> DataFrame:
        return self._sql(EPISODES)

    @property
    def scores(self) -> DataFrame:
        return self._sql(SCORES)

    @property
    def predictions(self) -> DataFrame:
        return self._sql(PREDICTIONS)

    @property
    def sides(self) -> DataFrame:
        return self._sql(SIDES)

    @property
    def survey(self) -> DataFrame:
        return self._sql(SURVEY)


def oracle_inputs() -> dict[str, str]:
    plain = {t: t for t in TABLES}
    return {
        "ep": EPISODES.format(**plain), "cv": SCORES.format(**plain), "pm": PREDICTIONS_ORACLE.format(**plain),
        "ab": SIDES.format(**plain), "sv": SURVEY.format(**plain),
    }
