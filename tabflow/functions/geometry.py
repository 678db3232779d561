"""Column expressions on field coordinates of moves (start, end) seen from one team."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabflow.functions import fixed_values as fv


def seen_from(value: Column, is_opponent: Column, size: float) -> Column:
    """Coordinate rotated by 180° for rows of the other team; null stays null."""
    return F.when(is_opponent, F.lit(size) - value).otherwise(value)


def has_end(end_x: Column, end_y: Column, action: Column, no_end: tuple[str, ...] = fv.NO_END_TYPES) -> Column:
    """The move has an end point and is of a type that moves the ball."""
    endless = F.coalesce(action.isin(list(no_end)), F.lit(False))
    return end_x.isNotNull() & end_y.isNotNull() & ~endless


def move_geometry(mask: Column, sx: Column, sy: Column, ex: Column, ey: Column, anchor_x: Column, anchor_y: Column, field: tuple[float, float] = fv.FIELD) -> dict[str, Column]:
    """Absolute, anchor-relative, length and direction features of a normalised move.

    Without an end point the absolute end is the start; relative end, step, length and
    direction are 0. Direction also needs a move longer than a millimetre.
    """
    zero = F.lit(0.0)
    dx, dy = F.when(mask, ex - sx).otherwise(zero), F.when(mask, ey - sy).otherwise(zero)
    mx, my = dx * field[0], dy * field[1]
    length = F.sqrt(mx * mx + my * my)
    diagonal = (field[0] ** 2 + field[1] ** 2) ** 0.5
    directed = mask & (length > fv.MIN_MOVE_M)
    angle = F.atan2(my, mx)
    return {
        "sx_abs": sx,
        "sy_abs": sy,
        "ex_abs": F.when(mask, ex).otherwise(sx),
        "ey_abs": F.when(mask, ey).otherwise(sy),
        "sx_rel": sx - anchor_x,
        "sy_rel": sy - anchor_y,
        "ex_rel": F.when(mask, ex - anchor_x).otherwise(zero),
        "ey_rel": F.when(mask, ey - anchor_y).otherwise(zero),
        "end_mask": mask.cast("double"),
        "dx": dx,
        "dy": dy,
        "dist": length / diagonal,
        "angle_sin": F.when(directed, F.sin(angle)).otherwise(zero),
        "angle_cos": F.when(directed, F.cos(angle)).otherwise(zero),
    }


def delta_target(end: Column, size: float, anchor: Column) -> Column:
    return end / size - anchor


def delta_to_end(anchor: Column, delta: Column, size: float) -> Column:
    """End coordinate of a predicted delta, kept on the field."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), anchor + delta)) * size
