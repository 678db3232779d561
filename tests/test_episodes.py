"""Sequence features against a plain per-episode calculation on hand-written rows."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tabflow.functions.fixed_values import NO_END_TYPES, SEQUENCE_NUMBERS
from tabflow.operators import encode, ensemble, validate
from tabflow.operators import episodes as ep

SCHEMA = ("game_episode string, action_id long, period_id long, time_seconds double, team_id long, player_id long, type_name string, result_name string, "
          "start_x double, start_y double, end_x double, end_y double")
ROWS = [
    # one row, one pass
    ("1_1", 1, 1, 0.0, 7, 1, "Pass", "Successful", 10.0, 20.0, 30.0, 40.0),
    # no pass
    ("1_2", 1, 1, 0.0, 7, 1, "Carry", None, 10.0, 20.0, 30.0, 40.0),
    # last action is not a pass; opponent rows; no-end type with an end; zero move; clock back and far ahead
    ("2_1", 5, 2, 100.0, 7, 1, "Carry", None, 50.0, 30.0, 50.0, 30.0),
    ("2_1", 6, 2, 90.0, 8, 2, "Block", "Successful", 60.0, 31.0, 61.0, 32.0),
    ("2_1", 7, 2, 200.0, 8, None, "Pass", "Unsuccessful", 40.0, 10.0, 80.0, 60.0),
    ("2_1", 8, 2, 5000.0, 7, 3, "Pass", "Successful", 20.0, 5.0, 70.0, 6.0),
    ("2_1", 9, 2, 5001.0, 8, 3, "Recovery", None, 20.0, 5.0, None, None),
    # the last pass has no end
    ("3_1", 1, 1, 0.0, 7, 1, "Pass", "Successful", 1.0, 2.0, 3.0, 4.0),
    ("3_1", 2, 1, 5.0, 7, 1, "Pass", None, 3.0, 4.0, None, None),
]


def expected(rows, policy, tail):
    """(episode, t_pos, pos) -> numbers, computed step by step in Python."""
    out = {}
    episodes = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        episodes.setdefault(r[0], []).append(r)
    for key, g in episodes.items():
        g = g[-tail:] if tail else g
        passes = [i for i, r in enumerate(g) if r[6] == "Pass"]
        if policy == "last_row":
            chosen = [len(g) - 1]
        else:
            chosen = passes if policy == "all_pass" else passes[-1:]
            chosen = [i for i in chosen if g[i][10] is not None and g[i][11] is not None]
        for t in chosen:
            ax, ay = g[t][8] / 105, g[t][9] / 68
            for i in range(t + 1):
                r = g[i]
                turn = r[4] != g[t][4]
                flip = lambda v, s: None if v is None else (s - v if turn else v) / s
                sx, sy, ex, ey = flip(r[8], 105), flip(r[9], 68), flip(r[10], 105), flip(r[11], 68)
                mask = ex is not None and ey is not None and r[6] not in NO_END_TYPES and (policy == "last_row" or i != t)
                dx, dy = (ex - sx, ey - sy) if mask else (0.0, 0.0)
                length = math.hypot(dx * 105, dy * 68)
                directed = mask and length > 1e-3
                gap = 0.0 if i == 0 else min(60.0, max(0.0, r[3] - g[i - 1][3]))
                out[key, t + 1, i + 1] = (
                    sx, sy, ex if mask else sx, ey if mask else sy, sx - ax, sy - ay, ex - ax if mask else 0.0, ey - ay if mask else 0.0, float(mask), dx, dy,
                    length / math.hypot(105, 68), dy * 68 / length if directed else 0.0, dx * 105 / length if directed else 0.0, math.log1p(gap) / math.log1p(60),
                    math.log1p(min(4000.0, max(0.0, r[3]))) / math.log1p(3600), float(r[2] == 2), i / t if t else 0.0, (t - i) / t if t else 0.0, ax, ay)
    return out


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("policy", ["all_pass", "last_pass", "last_row"])
@pytest.mark.parametrize("tail", [0, 2, 50])
def test_long_features(events, policy, tail, monkeypatch):
    monkeypatch.setattr(ep, "PAIR_BLOCK", 2)
    got = {(r["game_episode"], r["t_pos"], r["pos"]): r for r in ep.long_features(events.repartition(3), policy=policy, max_tail_k=tail).collect()}
    want = expected(ROWS, policy, tail)
    assert set(got) == set(want)
    for k, numbers in want.items():
        assert [got[k][c] for c in SEQUENCE_NUMBERS] == pytest.approx(list(numbers), abs=1e-9), k
        if k[1] == k[2]:
            assert got[k]["result_name"] == "None"


def test_pair_block_size_does_not_matter(spark, monkeypatch):
    rows = [("9_1", i, 1, float(i), i % 2, i % 5, "Pass" if i % 3 else "Carry", None, i % 105 + 0.5, i % 68 + 0.5, 50.0, 30.0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    results = []
    for size in (3, 16, 256):
        monkeypatch.setattr(ep, "PAIR_BLOCK", size)
        results.append(sorted(map(str, ep.long_features(df, policy="all_pass").collect())))
    assert results[0] == results[1] == results[2]
    assert len(results[0]) == sum(i + 1 for i in range(40) if i % 3)


def test_sequences_and_padding(events):
    vocab = encode.fit_vocabulary(events, ["player_id", "team_id", "type_name", "result_name"])
    seqs = {(r["game_episode"], r["t_pos"]): r for r in ep.train_sequences(events, vocab).collect()}
    assert set(seqs) == {("1_1", 1), ("2_1", 3), ("2_1", 4), ("3_1", 1)}
    s = seqs["2_1", 4]
    assert (s["length"], s["game_id"], len(s["num"]), len(s["num"][0]), len(s["cat"][3])) == (4, 2, 4, 21, 4)
    assert s["target_dx"] == pytest.approx(50 / 105) and s["cat"][3][3] == s["cat"][0][3]  # masked result reads as "None"
    assert ep.check_samples(ep.long_features(events)).first()["n_not_finite"] == 0
    padded = ep.pad_sequences(ep.train_sequences(events, vocab), "num", 6, 21, fill=0.0).filter("t_pos = 4").first()
    assert (len(padded["num"]), padded["num_length"], padded["num"][5]) == (6, 4, [0.0] * 21)
    with pytest.raises(Exception, match="longer than 2"):
        ep.pad_sequences(ep.train_sequences(events, vocab), "num", 2, 21, fill=0.0).collect()
    test = {r["game_episode"]: r["length"] for r in ep.inference_sequences(events, vocab, max_tail_k=3).collect()}
    assert test == {"1_1": 1, "1_2": 1, "2_1": 3, "3_1": 2}


def test_simple_sequences_interleave_points(events):
    got = {r["game_episode"]: r for r in ep.simple_sequences(events, order=["action_id"]).collect()}
    assert set(got) == {"2_1", "3_1"}
    assert got["3_1"]["points"] == [pytest.approx([1 / 105, 2 / 68]), pytest.approx([3 / 105, 4 / 68]), pytest.approx([3 / 105, 4 / 68])]
    assert got["2_1"]["length"] == 9 and got["2_1"]["target_x"] is None
    assert ep.simple_sequences(events, order=["action_id"], min_rows=1).count() == 4


def test_unknown_policy_is_an_error(events):
    with pytest.raises(ValueError):
        ep.targets(events, "first_pass")


FOLD = "game_episode string, fold int, anchor_x double, anchor_y double, delta_x double, delta_y double"


def test_delta_ensemble(spark):
    deltas = [-1.0, 0.1, 0.2, 0.4, 1.0]
    folds = spark.createDataFrame([("a", i, 0.5, 0.5, d, -d) for i, d in enumerate(deltas)], FOLD)
    r = ensemble.delta_ensemble(folds, trim=1).first()
    inner = math.tanh(sum(math.atanh(d) for d in deltas[1:4]) / 3)
    assert (r["end_x"], r["end_y"]) == (pytest.approx((0.5 + inner) * 105), pytest.approx((0.5 - inner) * 68))
    plain = ensemble.delta_ensemble(folds, space="raw").first()
    assert plain["end_x"] == pytest.approx((0.5 + sum(deltas) / 5) * 105)
    with pytest.raises(ValueError):
        ensemble.delta_ensemble(folds, trim=3)
    with pytest.raises(ValueError):
        ensemble.delta_ensemble(folds, space="median")
    with pytest.raises(validate.ValidationError):
        ensemble.delta_ensemble(folds.withColumn("anchor_x", F.col("fold") * 0.1))
    with pytest.raises(validate.ValidationError):
        ensemble.delta_ensemble(folds.unionByName(spark.createDataFrame([("b", 0, 0.5, 0.5, 0.0, 0.0)], FOLD)))


def test_episode_model_scores_every_episode(spark, events):
    import pandas as pd

    from tabflow.plans import episode_model as em

    samples = em.sample_summary(ep.long_features(events, policy="all_pass"))
    models = em.train_fold_models(samples, 2)
    scored = em.predict_deltas(models, em.sample_summary(ep.long_features(events, policy="last_row")))
    assert scored.count() == 2 * 4
    assert {-1.0 <= r["delta_x"] <= 1.0 for r in scored.collect()} == {True}
    vocab = encode.fit_vocabulary(events, ["player_id", "team_id", "type_name", "result_name"])
    own = em.predict_with(ep.inference_sequences(events, vocab), lambda b: pd.DataFrame({"delta_x": b["length"] / 10.0, "delta_y": 0.0}))
    assert {r["game_episode"]: r["delta_x"] for r in own.collect()}["2_1"] == 0.5


def test_a_users_model_scores_every_episode(spark):
    import numpy as np
    import pandas as pd

    from tabflow.functions import fixed_values as fv
    from tabflow.operators import encode
    from tabflow.plans import episode_model
    from tests.test_prefixes import SCHEMA, events

    rows = spark.createDataFrame(events(200), SCHEMA)
    vocabulary = encode.fit_vocabulary(rows, fv.SEQUENCE_CATEGORIES)
    n = len(fv.SEQUENCE_NUMBERS)
    models = [episode_model.MeanScorer(tuple([s] * n), tuple([-s / 9] * n)) for s in (0.01, 5.0)]
    got = episode_model.score_episodes(rows, vocabulary, models, episode_model.mean_scores).collect()
    sequences = {r["game_episode"]: r for r in ep.inference_sequences(rows, vocabulary).collect()}
    assert sorted((r["game_episode"], r["fold"]) for r in got) == sorted((k, f) for k in sequences for f in (0, 1))
    for r in got:
        x = np.nan_to_num(np.array([[np.nan if v is None else v for v in step] for step in sequences[r["game_episode"]]["num"]], dtype=float))
        want = np.clip([x.mean(axis=0).sum() * w for w in ((0.01, -0.01 / 9), (5.0, -5.0 / 9))[r["fold"]]], -1, 1)
        assert np.allclose([r["delta_x"], r["delta_y"]], want)
    one = episode_model.predict_with(ep.inference_sequences(rows, vocabulary), episode_model.mean_scores, model=models[0]).collect()
    assert {(r["game_episode"], round(r["delta_x"], 9)) for r in one} == {(r["game_episode"], round(r["delta_x"], 9)) for r in got if r["fold"] == 0}
    plain = episode_model.predict_with(ep.inference_sequences(rows, vocabulary), lambda b: pd.DataFrame({"delta_x": b["length"] * 0.0 + 3, "delta_y": b["length"] * 0.0})).collect()
    assert {r["delta_x"] for r in plain} == {1.0}
    truth = ep.train_sequences(rows, vocabulary, policy="last_pass")
    assert episode_model.mean_error(episode_model.predict_with(truth, episode_model.mean_scores, model=models[0]).withColumn("fold", F.lit(3)), truth).first()["mean_error_m"] > 0


def test_pieces_hold_every_element(spark):
    df = spark.createDataFrame([("a", [[float(i), 0.0] for i in range(7)]), ("b", [[1.0, 2.0]] * 3), ("c", [])], "k string, points array<array<double>>")
    pieces = {(r["k"], r["piece"]): r["points"] for r in ep.sequence_pieces(df, "points", 3).collect()}
    assert {k: len(v) for k, v in pieces.items()} == {("a", 0): 3, ("a", 1): 3, ("a", 2): 1, ("b", 0): 3, ("c", 0): 0}
    assert pieces["a", 2] == [[6.0, 0.0]]


def test_padded_sequences_of_a_long_episode(spark, tmp_path):
    """99 points: a fixed length of 64 was an error before."""
    from datetime import datetime, timedelta

    from __spark_entry__ import queries

    at = datetime(2024, 1, 2, 3)
    rows = [(i, at + timedelta(seconds=i), 1 if i < 50 else 2, "click", 0.0, "") for i in range(53)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["game_episode"]: r for r in queries()["padded_sequences"](spark, str(tmp_path)).collect()}
    start, end = (lambda i: (i * 37 % 1051) / 10 / 105), (lambda i: (i * 71 % 1051) / 10 / 105 if i % 13 else 0.0)
    assert {k: (r["points_length"], r["n"], r["tail"]) for k, r in got.items()} == {"1_0": (99, 64, 0.0), "2_0": (5, 64, 0.0)}
    assert got["1_0"]["sum_x"] == pytest.approx(sum(start(i) for i in range(50)) + sum(end(i) for i in range(49)))


def test_scoring_hands_over_bounded_batches(spark):
    from tabflow.plans import episode_model

    steps = [15_000, 30_000, 15_000, 5_000, 1]
    rows = [(f"{i}_0", 0.5, 0.5, [[float(i)]] * n) for i, n in enumerate(steps)]
    sequences = spark.createDataFrame(rows, "game_episode string, anchor_x double, anchor_y double, num array<array<double>>").coalesce(1)
    got = {r["game_episode"]: (r["delta_x"], r["delta_y"]) for r in episode_model.predict_with(
        sequences, lambda b: b.assign(delta_x=len(b) / 10, delta_y=b["num"].map(lambda v: v[0][0] / 10))).collect()}
    assert got == {f"{i}_0": (x, i / 10) for i, x in enumerate([0.1, 0.1, 0.2, 0.2, 0.1])}
