"""Summaries of every pass's history in linear size, by prefix sums on two sides.

``episodes.long_features`` with "all_pass" pairs each pass with all steps up to it, which is
quadratic in the length of an episode. What a model on summaries needs of a history are its
last row and the means of its numbers. Seen from the other team a coordinate v turns into
1 - v and a displacement into its opposite: both are linear, so a mean over a history follows
from two running totals per number, over the steps of the pass's own team and over all steps.
One row leaves for each pass, and an episode with most of the rows is cut into range blocks
like any other (``ranking.running_totals``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabflow.functions import fixed_values as fv
from tabflow.functions import geometry as geo
from tabflow.functions import temporal as tm
from tabflow.operators import episodes as ep
from tabflow.operators.ranking import running_totals
from tabflow.scratch import materialize

# How a number of a step reads from the other team: 1 - v, -v, or v.
MIRRORED = ("sx", "sy", "ex", "ey", "moved_ex", "moved_ey")
OPPOSED = ("dx", "dy", "angle_sin", "angle_cos")
SHARED = ("moved", "dist", "dt", "t_abs_log", "is_second_half")
NUMBERS = (*MIRRORED, *OPPOSED, *SHARED)


def step_numbers(steps: DataFrame, field: tuple[float, float] = fv.FIELD, dt_clip: float = fv.DT_CLIP, dt_ref: float = fv.DT_REF) -> dict[str, Column]:
    """The numbers of a step seen from its own team.

    ``ex``, ``ey`` are where the step ends, its start where it moves nothing; ``moved_ex`` and
    ``moved_ey`` are null there, so that they count only real moves.
    """
    sx, sy, ex, ey = (F.col(c) / s for c, s in (("start_x", field[0]), ("start_y", field[1]), ("end_x", field[0]), ("end_y", field[1])))
    moved = geo.has_end(F.col("end_x"), F.col("end_y"), F.col("type_name"))
    zero = F.lit(0.0)
    moves = geo.move_geometry(moved, sx, sy, ex, ey, zero, zero, field)
    second = F.coalesce(F.col("period_id") == 2, F.lit(False)).cast("double") if "period_id" in steps.columns else F.lit(0.0)
    return {
        "sx": sx, "sy": sy, "ex": moves["ex_abs"], "ey": moves["ey_abs"], "moved_ex": F.when(moved, ex), "moved_ey": F.when(moved, ey),
        "dx": moves["dx"], "dy": moves["dy"], "angle_sin": moves["angle_sin"], "angle_cos": moves["angle_cos"], "moved": moved.cast("double"), "dist": moves["dist"],
        "dt": tm.step_time(F.col("dt_raw"), dt_clip, dt_ref), "t_abs_log": tm.clock_time(F.col("time_seconds")), "is_second_half": second,
    }


def prefix_summaries(df: DataFrame, *, key: str = ep.KEY, order: Sequence[str] | None = None, field: tuple[float, float] = fv.FIELD, dt_clip: float = fv.DT_CLIP, dt_ref: float = fv.DT_REF) -> DataFrame:
    """One row for every pass with an end point, equal to the summary of its long form.

    (key, t_pos, length, last_<number>, mean_<number>, anchor_x, anchor_y, target_dx, target_dy);
    the end of the pass itself is hidden. Means leave nulls out, as the long form's do.
    """
    order = list(order or ep.step_order(df))
    used = [key, *order, "time_seconds", "period_id", "team_id", "player_id", "type_name", "result_name", "start_x", "start_y", "end_x", "end_y"]
    steps = ep.order_steps(df.select(*dict.fromkeys(c for c in used if c in df.columns)), key=key, order=order)
    steps = materialize(steps, "steps")
    numbers = step_numbers(steps, field, dt_clip, dt_ref)
    sums = {f"__s_{c}": F.coalesce(F.col(f"__v_{c}"), F.lit(0.0)) for c in NUMBERS}
    counts = {f"__n_{c}": F.col(f"__v_{c}").isNotNull().cast("long") for c in NUMBERS}
    valued = steps.withColumns({f"__v_{c}": v for c, v in numbers.items()})
    both = {**sums, **counts}
    whole = running_totals(valued, group=[key], order=["pos"], sums={f"{n}_all": e for n, e in both.items()})
    own = running_totals(whole, group=[key, "team_id"], order=["pos"], sums={**{f"{n}_own": e for n, e in both.items()}, "__steps_own": F.lit(1)})
    # the pass is the last row of its own history, without an end
    row = own.filter("type_name = 'Pass' and end_x is not null and end_y is not null")
    target = {"t_pos": F.col("pos"), "t_team": F.col("team_id"), **{f"t_{c}": F.col(c) for c in ("start_x", "start_y", "end_x", "end_y")}}
    row = ep.sequence_features(row.withColumns(target), field=field, dt_clip=dt_clip, dt_ref=dt_ref)
    last = {"sx": "sx_abs", "sy": "sy_abs", "ex": "ex_abs", "ey": "ey_abs", "moved_ex": None, "moved_ey": None, "moved": "end_mask"}
    # without a team nobody is of the own team, not even the pass
    known = F.col("team_id").isNotNull()

    def total(c: str) -> tuple[Column, Column]:
        """(sum, number of values) over the history, seen from the pass's team."""
        s_own, n_own = (F.when(known, F.col(f"__{k}_{c}_own")).otherwise(F.lit(0)) for k in ("s", "n"))
        s_other, n_other = F.col(f"__s_{c}_all") - s_own, F.col(f"__n_{c}_all") - n_own
        s = s_own + (n_other - s_other if c in MIRRORED else -s_other if c in OPPOSED else s_other)
        name = last.get(c, c)
        if name is None:
            return s, F.col(f"__n_{c}_all")
        return s + F.coalesce(F.col(name), F.lit(0.0)), F.col(f"__n_{c}_all") + F.col(name).isNotNull().cast("long")

    mean = lambda c: F.try_divide(total(c)[0], total(c)[1])
    n = F.col("pos")
    # steps that move nothing, as the pass itself, have 0; without an anchor they are all there is
    relative = lambda c, a: F.coalesce(F.try_divide(total(c)[0] - F.col(f"__n_{c}_all") * F.col(a), n), F.lit(0.0))
    half = F.when(n > 1, F.lit(0.5)).otherwise(F.lit(0.0))
    means = {
        "sx_abs": mean("sx"), "sy_abs": mean("sy"), "ex_abs": mean("ex"), "ey_abs": mean("ey"),
        "sx_rel": mean("sx") - F.col("anchor_x"), "sy_rel": mean("sy") - F.col("anchor_y"), "ex_rel": relative("moved_ex", "anchor_x"), "ey_rel": relative("moved_ey", "anchor_y"),
        "end_mask": mean("moved"), **{c: mean(c) for c in ("dx", "dy", "dist", "angle_sin", "angle_cos", "dt", "t_abs_log", "is_second_half")},
        "idx_norm": half, "steps_to_target": half, "anchor_x": F.col("anchor_x"), "anchor_y": F.col("anchor_y"),
    }
    return row.select(
        key, "t_pos", F.col("pos").alias("length"), *[F.col(c).alias(f"last_{c}") for c in fv.SEQUENCE_NUMBERS], *[means[c].alias(f"mean_{c}") for c in fv.SEQUENCE_NUMBERS],
        "anchor_x", "anchor_y", geo.delta_target(F.col("t_end_x"), field[0], F.col("anchor_x")).alias("target_dx"), geo.delta_target(F.col("t_end_y"), field[1], F.col("anchor_y")).alias("target_dy"),
    )
