"""Event sequences: ordered steps per episode, prefix samples, sequence features.

Data flow: ``order_steps`` numbers the rows of each episode, ``targets`` picks the sample
rows (every pass, the last pass, or the last row), ``sample_steps`` pairs each sample with
the steps up to it, ``sequence_features`` computes the 21 numbers and 4 categories per step,
``to_sequences`` packs them into one array per sample.

An episode may hold a large share of all rows. Numbering therefore runs over range blocks
unless ``max_tail_k`` bounds the episode; one-sample-per-episode pairing is a lookup of one
row per episode; and pairing every pass with its prefix is an equi-join on (episode, sample
block, step block), which spreads a long episode over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.functions import fixed_values as fv
from tabflow.functions import geometry as geo
from tabflow.functions import temporal as tm
from tabflow.operators.encode import apply_vocabulary
from tabflow.operators.lookup import lookup_join
from tabflow.operators.ranking import running_totals, top_rows
from tabflow.scratch import materialize

KEY = "game_episode"
PAIR_BLOCK = 256


def step_order(df: DataFrame) -> list[str]:
    """Order columns of an episode: the action number if present, then the clock."""
    return [c for c in ("action_id", "time_seconds", "row_order") if c in df.columns]


def order_steps(df: DataFrame, *, key: str = KEY, order: Sequence[str] | None = None, max_tail_k: int = 0, partitions: int | None = None) -> DataFrame:
    """Add ``pos`` (1-based) and ``dt_raw`` (seconds since the previous row, null on the first).

    With ``max_tail_k`` only the last k rows of each episode stay, cut before anything else.
    The order columns must tell all rows of an episode apart.
    """
    order = list(order or step_order(df))
    if max_tail_k > 0:
        df = top_rows(df, max_tail_k, [F.desc(c) for c in order], within=key)
        # at most max_tail_k rows per episode
        w = Window.partitionBy(key).orderBy(*order)
        numbered = df.select("*", F.row_number().over(w).cast("long").alias("pos"), F.lag("time_seconds").over(w).alias("__previous"))
    else:
        numbered = running_totals(df, group=[key], order=order, sums={"pos": F.lit(1)}, lags={"__previous": F.col("time_seconds")}, partitions=partitions)
        numbered = numbered.withColumn("pos", F.col("pos") + 1)
    return numbered.withColumn("dt_raw", F.col("time_seconds") - F.col("__previous")).drop("__previous")


def episode_lengths(steps: DataFrame, *, key: str = KEY) -> DataFrame:
    return steps.groupBy(key).agg(F.max("pos").alias("n_steps"))


def drop_short_episodes(df: DataFrame, *, key: str = KEY, min_rows: int = 2) -> DataFrame:
    """Rows of episodes with at least ``min_rows`` rows."""
    counts = materialize(df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).withColumn("__w", F.col("__n")), "episode_rows")
    return lookup_join(df, counts, [key], weight="__w").filter(F.col("__n") >= min_rows).drop("__n")


def targets(steps: DataFrame, policy: str = "all_pass", *, key: str = KEY) -> DataFrame:
    """Sample rows: (key, t_pos, t_team, t_start_x/y, t_end_x/y).

    "all_pass" takes every pass with an end point. "last_pass" takes the last pass of each
    episode, and none if that pass has no end point. "last_row" takes the last row.
    """
    row = F.struct("pos", "team_id", "start_x", "start_y", "end_x", "end_y")
    passes = steps.filter(F.col("type_name") == "Pass")
    if policy == "all_pass":
        picked = passes.select(key, row.alias("t"))
    elif policy == "last_pass":
        picked = passes.groupBy(key).agg(F.max_by(row, "pos").alias("t"))
    elif policy == "last_row":
        picked = steps.groupBy(key).agg(F.max_by(row, "pos").alias("t"))
    else:
        raise ValueError(f"unknown policy {policy!r}: use 'all_pass', 'last_pass' or 'last_row'")
    flat = picked.select(
        key, F.col("t.pos").alias("t_pos"), F.col("t.team_id").alias("t_team"),
        *[F.col(f"t.{c}").alias(f"t_{c}") for c in ("start_x", "start_y", "end_x", "end_y")],
    )
    return flat if policy == "last_row" else flat.filter("t_end_x is not null and t_end_y is not null")


def sample_steps(steps: DataFrame, samples: DataFrame, *, key: str = KEY, one_per_episode: bool) -> DataFrame:
    """Each sample with all steps of its episode up to its position (long form)."""
    if one_per_episode:
        # the rows of an episode that come before its sample are the table's weight
        table = materialize(samples.withColumn("__w", F.col("t_pos")), "samples")
        return lookup_join(steps, table, [key], weight="__w").filter(F.col("pos") <= F.col("t_pos"))
    block = lambda c: F.floor((F.col(c) - 1) / PAIR_BLOCK)
    last = samples.groupBy(key).agg(F.max(block("t_pos")).alias("__last"), F.count(F.lit(1)).alias("__w"))
    # each step goes to the sample blocks at or after its own, each sample to the step blocks up to its own
    s = lookup_join(steps, materialize(last, "sample_blocks"), [key], weight="__w").filter(F.col("__last") >= block("pos"))
    s = s.withColumn("__step_block", block("pos")).withColumn("__sample_block", F.explode(F.sequence(F.col("__step_block"), F.col("__last")))).drop("__last")
    t = samples.withColumn("__sample_block", block("t_pos")).withColumn("__step_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__sample_block"))))
    pairs = s.join(t, [key, "__sample_block", "__step_block"]).filter(F.col("pos") <= F.col("t_pos"))
    return pairs.drop("__sample_block", "__step_block")


def rotated(pairs: DataFrame, field: tuple[float, float] = fv.FIELD) -> DataFrame:
    """Start and end points from the view of the sample's team, opponents turned by 180°."""
    other = F.coalesce(F.col("team_id") != F.col("t_team"), F.lit(True))
    size = {"start_x": field[0], "end_x": field[0], "start_y": field[1], "end_y": field[1]}
    return pairs.withColumns({c: geo.seen_from(F.col(c), other, s) for c, s in size.items()})


def sequence_features(pairs: DataFrame, *, field: tuple[float, float] = fv.FIELD, mask_target_end: bool = True, dt_clip: float = fv.DT_CLIP, dt_ref: float = fv.DT_REF) -> DataFrame:
    """The 21 numbers per step, with the result of the target row masked.

    ``mask_target_end`` hides the end point of the target row, as training needs; inference
    keeps whatever the last row has (normally nothing).
    """
    view = rotated(pairs, field)
    at_target = F.col("pos") == F.col("t_pos")
    sx, sy, ex, ey = (F.col(c) / s for c, s in (("start_x", field[0]), ("start_y", field[1]), ("end_x", field[0]), ("end_y", field[1])))
    mask = geo.has_end(F.col("end_x"), F.col("end_y"), F.col("type_name"))
    if mask_target_end:
        mask = mask & ~at_target
    view = view.withColumns({"__mask": mask, "anchor_x": F.col("t_start_x") / field[0], "anchor_y": F.col("t_start_y") / field[1]})
    moves = geo.move_geometry(F.col("__mask"), sx, sy, ex, ey, F.col("anchor_x"), F.col("anchor_y"), field)
    span = F.col("t_pos") - 1
    out = view.withColumns({
        **moves,
        # the first kept row of an episode has no previous row
        "dt": tm.step_time(F.col("dt_raw"), dt_clip, dt_ref),
        "t_abs_log": tm.clock_time(F.col("time_seconds")),
        "is_second_half": (F.coalesce(F.col("period_id") == 2, F.lit(False)).cast("double") if "period_id" in pairs.columns else F.lit(0.0)),
        "idx_norm": F.coalesce(F.try_divide(F.col("pos") - 1, span), F.lit(0.0)),
        "steps_to_target": F.coalesce(F.try_divide(F.col("t_pos") - F.col("pos"), span), F.lit(0.0)),
        "result_name": F.when(at_target, F.lit("None")).otherwise(F.col("result_name")),
    })
    return out.drop("__mask")


def sample_targets(samples: DataFrame, field: tuple[float, float] = fv.FIELD, *, key: str = KEY) -> DataFrame:
    """Anchor and delta target per sample, with the game number of its key."""
    ax, ay = F.col("t_start_x") / field[0], F.col("t_start_y") / field[1]
    return samples.select(
        key, "t_pos", tm.key_prefix_number(F.col(key)).alias("game_id"), ax.alias("anchor_x"), ay.alias("anchor_y"),
        geo.delta_target(F.col("t_end_x"), field[0], ax).alias("target_dx"), geo.delta_target(F.col("t_end_y"), field[1], ay).alias("target_dy"),
    )


def long_features(df: DataFrame, *, policy: str = "all_pass", max_tail_k: int = 0, vocabulary: DataFrame | None = None, key: str = KEY, order: Sequence[str] | None = None, field: tuple[float, float] = fv.FIELD, dt_clip: float = fv.DT_CLIP, dt_ref: float = fv.DT_REF) -> DataFrame:
    """One row per (sample, step): key, t_pos, pos, 21 numbers, 4 categories and, with a
    vocabulary, their indexes. "last_row" gives the inference sequences."""
    order = list(order or step_order(df))
    used = [key, *order, "time_seconds", "period_id", "team_id", "player_id", "type_name", "result_name", "start_x", "start_y", "end_x", "end_y"]
    steps = order_steps(df.select(*dict.fromkeys(c for c in used if c in df.columns)), key=key, order=order, max_tail_k=max_tail_k)
    steps = materialize(steps, "steps")  # feeds both the samples and their steps
    pairs = sample_steps(steps, targets(steps, policy, key=key), key=key, one_per_episode=policy != "all_pass")
    out = sequence_features(pairs, field=field, mask_target_end=policy != "last_row", dt_clip=dt_clip, dt_ref=dt_ref)
    out = out.select(key, "t_pos", "pos", *fv.SEQUENCE_NUMBERS, *fv.SEQUENCE_CATEGORIES, *_targets_of(out, field))
    return apply_vocabulary(out, vocabulary, fv.SEQUENCE_CATEGORIES) if vocabulary is not None else out


def _targets_of(out: DataFrame, field: tuple[float, float]) -> list[Column]:
    return [
        geo.delta_target(F.col("t_end_x"), field[0], F.col("anchor_x")).alias("target_dx"),
        geo.delta_target(F.col("t_end_y"), field[1], F.col("anchor_y")).alias("target_dy"),
    ]


def to_sequences(long: DataFrame, *, key: str = KEY) -> DataFrame:
    """One row per sample: ``num`` array of 21-number arrays, ``cat`` array of 4-index arrays,
    target, game number and length.

    This packed form is for feeding an outside model: a sample must fit one row. Checks and
    lengths work on the long table.
    """
    step = F.struct(
        "pos", F.array(*[F.col(c).cast("double") for c in fv.SEQUENCE_NUMBERS]).alias("num"),
        F.array(*[F.col(f"{c}_idx") for c in fv.SEQUENCE_CATEGORIES]).alias("cat"),
    )
    packed = long.groupBy(key, "t_pos").agg(
        F.array_sort(F.collect_list(step)).alias("s"), *[F.first(c).alias(c) for c in ("anchor_x", "anchor_y", "target_dx", "target_dy")]
    )
    return packed.select(
        key, "t_pos", tm.key_prefix_number(F.col(key)).alias("game_id"), F.size("s").alias("length"),
        F.col("s.num").alias("num"), F.col("s.cat").alias("cat"), "anchor_x", "anchor_y", "target_dx", "target_dy",
    )


def train_sequences(df: DataFrame, vocabulary: DataFrame, *, policy: str = "all_pass", max_tail_k: int = 0, **options) -> DataFrame:
    """Training samples as arrays with delta targets."""
    return to_sequences(long_features(df, policy=policy, max_tail_k=max_tail_k, vocabulary=vocabulary, **options))


def inference_sequences(df: DataFrame, vocabulary: DataFrame, *, max_tail_k: int = 0, **options) -> DataFrame:
    """One sequence per episode seen from its last row; no target."""
    return to_sequences(long_features(df, policy="last_row", max_tail_k=max_tail_k, vocabulary=vocabulary, **options)).drop("target_dx", "target_dy")


def simple_points(df: DataFrame, *, key: str = KEY, order: Sequence[str] = ("time_seconds",), field: tuple[float, float] = fv.FIELD, min_rows: int = 2) -> DataFrame:
    """Interleaved points start, end, start, … in long form; the last end is the target, not a point.

    ``point`` counts from 0. Training uses ``min_rows=2``; inference keeps every episode.
    """
    narrow = df.select(key, *dict.fromkeys([*order, "time_seconds"]), "start_x", "start_y", "end_x", "end_y")
    steps = materialize(order_steps(narrow, key=key, order=order), "steps")
    last = steps.groupBy(key).agg(F.max("pos").alias("n_steps"), F.max_by(F.struct("end_x", "end_y"), "pos").alias("__end"), F.count(F.lit(1)).alias("__w"))
    joined = lookup_join(steps, materialize(last, "episode_ends"), [key], weight="__w").filter(F.col("n_steps") >= min_rows)
    point = lambda i, x, y: F.struct(((F.col("pos") - 1) * 2 + i).alias("point"), (F.col(x) / field[0]).alias("x"), (F.col(y) / field[1]).alias("y"))
    start, end = point(0, "start_x", "start_y"), point(1, "end_x", "end_y")
    points = joined.select(key, "n_steps", (F.col("__end.end_x") / field[0]).alias("target_x"), (F.col("__end.end_y") / field[1]).alias("target_y"),
                           F.explode(F.when(F.col("pos") < F.col("n_steps"), F.array(start, end)).otherwise(F.array(start))).alias("p"))
    return points.select(key, "p.point", "p.x", "p.y", "target_x", "target_y")


def simple_sequences(df: DataFrame, **options) -> DataFrame:
    """``simple_points`` packed into one array of [x, y] per episode."""
    key = options.get("key", KEY)
    packed = simple_points(df, **options).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("point", F.array("x", "y").alias("xy")))).alias("s"), F.first("target_x").alias("target_x"), F.first("target_y").alias("target_y")
    )
    return packed.select(key, F.col("s.xy").alias("points"), F.size("s").alias("length"), "target_x", "target_y")


def pad_sequences(df: DataFrame, column: str, length: int, width: int, *, fill: float | int = 0) -> DataFrame:
    """Sequences padded with rows of ``fill`` to ``length``; ``<column>_length`` keeps the true length.

    Sequences longer than ``length`` are an error, not cut.
    """
    n = F.size(column)
    filler = F.array(*[F.lit(fill)] * width)
    padded = F.concat(F.col(column), F.array_repeat(filler, (F.lit(length) - n).cast("int")))
    checked = F.when(n <= length, padded).otherwise(F.raise_error(F.lit(f"sequence longer than {length}")).cast(padded_type(df, column)))
    return df.withColumn(f"{column}_length", n).withColumn(column, checked)


def sequence_pieces(df: DataFrame, column: str, length: int) -> DataFrame:
    """Each sequence as one row per piece of up to ``length`` elements, numbered from 0 by ``piece``; an empty one is one piece."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(column) - 1, F.lit(0)), F.lit(length))
    others = [F.col(f"`{c}`") for c in df.columns if c != column]
    pieces = df.select(*others, F.col(f"`{column}`").alias("__whole"), F.posexplode(starts).alias("piece", "__start"))
    return pieces.withColumn(column, F.slice("__whole", F.col("__start") + 1, F.lit(length))).drop("__whole", "__start")


def padded_type(df: DataFrame, column: str):
    return df.schema[column].dataType


def sample_lengths(long: DataFrame, *, key: str = KEY) -> DataFrame:
    """(key, t_pos, length, n_numbers, game_id) of every sample, counted on the long table."""
    counted = long.groupBy(key, "t_pos").agg(F.count(F.lit(1)).alias("length"))
    return counted.select(key, "t_pos", "length", (F.col("length") * len(fv.SEQUENCE_NUMBERS)).alias("n_numbers"), tm.key_prefix_number(F.col(key)).alias("game_id"))


def check_samples(long: DataFrame, *, key: str = KEY) -> DataFrame:
    """One row: number of samples and of samples with a null, NaN or infinite number or target.

    Works on the long table, so no episode has to fit a row.
    """
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c)) == float("inf"))
    wrong = reduce(or_, [bad(c) for c in (*fv.SEQUENCE_NUMBERS, "target_dx", "target_dy")])
    per_sample = long.groupBy(key, "t_pos").agg(F.max(wrong).alias("wrong"))
    return per_sample.agg(F.count(F.lit(1)).alias("n_samples"), F.count_if("wrong").alias("n_not_finite"))
