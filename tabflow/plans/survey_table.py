"""The survey feature table: all builders in dependency order, fitted on train, for both tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from tabflow.functions import fixed_values as fv
from tabflow.operators import schema as sc
from tabflow.operators import survey as sv

TIME_PARTS = tuple(f"time_input_{p}" for p in ("hour", "dayofweek", "month", "day", "is_weekend", "unix"))


@dataclass(frozen=True)
class FittedMaps:
    """Frequency tables of schools, companies and majors."""

    majors: dict[str, DataFrame]
    school: DataFrame | None
    company: DataFrame


def fit_maps(train: DataFrame) -> FittedMaps:
    """All maps from one scan of the raw columns they need."""
    return FittedMaps(*sv.fit_frequencies(train))


def build_features(df: DataFrame, raw_columns: Sequence[str], maps: FittedMaps, *, target: str = "completed", key: str | None = None) -> DataFrame:
    """All builders except the time column.

    The lookups run first, while the rows carry raw columns only; everything after them is
    row-wise. Signatures read earlier columns and come last.
    """
    df = sv.apply_school(sv.apply_company(sv.companies(df), maps.company), maps.school)
    df = sv.majors(df, maps.majors)
    for step in (sv.it_major, sv.completed_semester, sv.certificates, sv.text_presence, sv.previous_classes, sv.desired_jobs, sv.lecture_reason):
        df = step(df)
    df = sv.engagement(df, raw_columns, exclude=[target, *([key] if key else [])])
    for step in (sv.oneday_topics, sv.expected_domain, sv.desired_certificates, sv.why_join, sv.want_to_gain, sv.signatures):
        df = step(df)
    return df


@dataclass(frozen=True)
class SurveyTables:
    train: DataFrame
    test: DataFrame
    features: list[str]
    categorical: list[str]
    time_mode: str


def feature_names(created: Sequence[str], time_mode: str) -> list[str]:
    """Model inputs: the raw answers in use, then everything the builders create."""
    unused = {"completed_semester_is_outlier", "major2_missing_but_double_major", "major2_present_but_single_major", "has_major2", "ic_primary"}
    raw = [c for c in fv.RAW_SURVEY_FEATURES if c != "time_input" or time_mode in ("numeric", "categorical")]
    # the time interactions exist in the tables but are not model inputs
    made = [c for c in created if c not in unused and not c.endswith("_time_bucket") and "_preparing" not in c]
    return list(dict.fromkeys([*raw, *made]))


def survey_tables(train: DataFrame, test: DataFrame, *, target: str = "completed", key: str | None = None, fit_on: str = "train") -> SurveyTables:
    """Feature tables of train and test. ``fit_on="self"`` counts majors on each table separately."""
    key = key or sc.survey_key(train.columns)
    raw = train.columns
    maps = fit_maps(train)
    left = build_features(train, raw, maps, target=target, key=key)
    right = build_features(test, raw, maps if fit_on == "train" else replace(maps, majors=sv.fit_majors(test)), target=target, key=key)
    mode = sv.time_strategy(train)
    left, right = (sv.time_interactions(sv.apply_time_strategy(t, mode)) for t in (left, right))
    features = feature_names([c for c in left.columns if c not in raw], mode)
    # features, target and key are protected, so only raw columns can be sparse
    gone = sc.sparse_columns(train, [*features, target, *([key] if key else [])])
    left, right = left.drop(*gone), right.drop(*gone)
    keep = [c for c in (key,) if c]
    prefixes = ("desired_job_has_", "desired_job_except_has_")
    features = sc.feature_list(left.columns, right.columns, features, prefixes)
    x_train = sc.select_features(left, features, keep=[*keep, target], prefixes=prefixes)
    x_test = sc.select_features(right, features, keep=keep, prefixes=prefixes)
    cats = sc.categorical_columns(x_train, features, fv.FORCED_CATEGORIES)
    return SurveyTables(sc.fill_categories(x_train, cats), sc.fill_categories(x_test, cats), features, cats, mode)
