"""Column expressions on dates, clocks, combined keys and binned numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabflow.functions import fixed_values as fv


def split_combined_key(c: Column) -> tuple[Column, Column]:
    """Parts before and after the first underscore; without one: (whole, null)."""
    at = F.instr(c, "_")
    return F.when(at > 0, F.substring_index(c, "_", 1)).otherwise(c), F.when(at > 0, F.substring(c, at + 1, F.length(c)))


def key_prefix_number(c: Column) -> Column:
    """The number before the first underscore (the game of a game-episode key)."""
    return F.substring_index(c, "_", 1).try_cast("bigint")


# Date text that is understood: year first with separators or as eight digits, fourteen digits,
# and month/day/year; a time may follow, down to the hour alone. A zone offset is not applied:
# the clock time as written counts. Other bare numbers are no dates.
_CLOCK = r"(?:[ T]+(\d{1,2})(?::?(\d{2})(?::?(\d{2}(?:\.\d{1,6})?)\d*)?)?\s*(?:Z|UTC|[+-]\d{2}:?\d{2})?)?$"
DATE_TEXT = (
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})" + _CLOCK, "$1|$2|$3|$4|$5|$6"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})" + _CLOCK, "$1|$2|$3|$4|$5|$6"),
    (r"^(\d{4})\.(\d{1,2})\.(\d{1,2})" + _CLOCK, "$1|$2|$3|$4|$5|$6"),
    (r"^(\d{4})(\d{2})(\d{2})" + _CLOCK, "$1|$2|$3|$4|$5|$6"),
    (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1|$2|$3|$4|$5|$6"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})" + _CLOCK, "$3|$1|$2|$4|$5|$6"),
)


def to_time(c: Column, dtype: str) -> Column:
    """A timestamp without time zone; text in none of the forms of ``DATE_TEXT`` becomes null."""
    if dtype != "string":
        return c.cast("timestamp_ntz")
    t = F.btrim(c)
    fields = F.lit(None).cast("string")
    for pattern, order in reversed(DATE_TEXT):
        fields = F.when(F.regexp_like(t, F.lit(pattern)), F.regexp_replace(t, pattern, order)).otherwise(fields)

    def made(parts: Column) -> Column:
        # a field that the text leaves out is empty; trying to cast it would cost an exception for every row
        given = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
        number = lambda i: F.coalesce(given(i).try_cast("int"), F.lit(0))
        second = F.coalesce(given(5).try_cast("decimal(16,6)"), F.lit(0).cast("decimal(16,6)"))
        return F.when(parts.isNotNull(), F.try_make_timestamp_ntz(number(0), number(1), number(2), number(3), number(4), second))

    # an array of one element, so that the fields are worked out once
    parsed = F.get(F.transform(F.array(F.split(fields, r"\|")), made), F.lit(0))
    # a plain date needs none of the fields
    return F.when(F.regexp_like(t, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}\z")), t.try_cast("date").cast("timestamp_ntz")).otherwise(parsed)


def date_parts(t: Column) -> dict[str, Column]:
    """Hour, day of week (Monday 0), month, day and weekend flag; a null date has weekend flag 0."""
    return {
        "hour": F.hour(t),
        "dow": F.weekday(t),
        "month": F.month(t),
        "day": F.dayofmonth(t),
        "is_weekend": F.coalesce((F.weekday(t) >= 5).cast("int"), F.lit(0)),
    }


def unix_seconds(t: Column) -> Column:
    """Seconds since the epoch of a time without zone, read as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), t) / 1e6


def bin_label(c: Column, bins: Sequence[tuple[float | None, str]], missing: str = "UNK") -> Column:
    """Right-closed bins given as (upper bound, label); above the last bound or null is ``missing``."""
    label = F.when(c.isNull() | F.isnan(c.cast("double")), missing)
    for upper, name in bins:
        label = label.when(F.lit(True) if upper is None else c <= upper, name)
    return label.otherwise(missing)


def out_of_range(c: Column, low: float, high: float) -> Column:
    """True outside [low, high]; null is not outside."""
    return F.coalesce((c < low) | (c > high), F.lit(False))


def clip(c: Column, low: float, high: float) -> Column:
    """Value limited to [low, high]; null stays null."""
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def step_time(delta: Column, limit: float = fv.DT_CLIP, ref: float = fv.DT_REF) -> Column:
    """log-scaled gap to the previous row; going back in time counts as 0."""
    return F.log1p(clip(F.coalesce(delta, F.lit(0.0)), 0.0, limit)) / F.log1p(F.lit(ref))


def clock_time(seconds: Column, limit: float = fv.CLOCK_CLIP, ref: float = fv.CLOCK_REF) -> Column:
    return F.log1p(clip(seconds, 0.0, limit)) / F.log1p(F.lit(ref))
