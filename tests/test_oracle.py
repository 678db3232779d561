"""Every registered query with SQL gives the rows its SQL gives; names and coverage are stable."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from querybook.book import BOOK
from tests.oracle import compare, connect

QUERIES = {name: run for name, run in entry.queries().items() if name in BOOK}
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in BOOK}
# fitted models and searches: no SQL can say them
ROWS_ONLY = {
    "simplex_blend_search", "episode_score", "cv_train_oof", "cv_fold_summary", "cv_importances", "cv_early_stopping",
    "forest_on_target_means", "survey_model_errors", "drift_model_auc", "permutation_importance", "test_likeness",
}


@pytest.fixture(scope="module")
def oracle(data):
    return connect(data)


def test_only_models_lack_sql():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, oracle, name):
    problem = compare(QUERIES[name](spark, data), oracle, SQL[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", ["cv_early_stopping", "episode_score", "drift_model_auc"])
def test_model_query_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert 0.5 < entry.entry(spark).first()["auc"] < 1.0
