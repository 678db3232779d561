"""No registered flag is constant on the driver's data: a constant flag shows nothing."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from querybook.book import BOOK
from tests.oracle import connect

SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in BOOK}
# a model whose predictions are all equal (a case of its own), one month of events, a range check,
# one category flag a row, the padded length and the sum of the padding
CONSTANT = {("model_oof_wide", "m4"), ("time_parts", "month"), ("cv_oof_members", "in_range"), ("one_hot_features", "n_flags"), ("padded_sequences", "n"), ("padded_sequences", "tail")}
# one table, one run or one document behind all rows; three equal classes; a side without nulls; two builds for three names
CONSTANT |= {("auc_by_model", "n_pos"), ("auc_by_model", "n_neg"), ("common_models", "n"), ("value_counts", "n"), ("drift_null_const", "null_0"), ("shared_cache", "n_builds"), ("incremental_cache", "n_rows")}
CONSTANT |= {("run_document", c) for c in ("fold_mean", "fold_std", "oof", "public_score", "gap", "splits", "weight_a")} | {("blend_document", c) for c in ("strategy", "selected", "converged", "step")}


@pytest.fixture(scope="module")
def oracle(data):
    return connect(os.path.join(os.path.dirname(data.rstrip("/")), "sf0.01"))


@pytest.mark.parametrize("name", sorted(SQL))
def test_outputs_vary(oracle, name):
    cur = oracle.execute(SQL[name])
    columns, rows = [d[0] for d in cur.description], cur.fetchall()
    if len(rows) > 1:
        assert {c for i, c in enumerate(columns) if len({r[i] for r in rows}) <= 1} <= {c for n, c in CONSTANT if n == name}


def test_broken_samples_are_seen(oracle):
    n_samples, n_not_finite = oracle.execute(SQL["sequence_checks"]).fetchone()
    assert 0 < n_not_finite < n_samples
