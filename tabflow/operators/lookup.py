"""Many-to-one joins against fitted tables (frequencies, ranks, vocabularies, encodings)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A table is broadcast only when its counted rows and its counted bytes stay within these bounds.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20
# Beyond them, rows of this many of the heaviest keys, and rows without a key, are dealt over SALTS tasks.
HEAVY_KEYS = 1_024
# Keys that a sketch of the rows keeps count of.
TRACKED = 10_000
SALTS = 32


def is_small(table: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``table`` (a scan of a written table) is within the broadcast bounds.

    Texts count by their bytes, other columns by 16 bytes; counting stops past the row bound.
    """
    texts = [F.coalesce(F.octet_length(F.col(f"`{n}`")), F.lit(0)) for n, t in table.dtypes if t in ("string", "binary")]
    width = reduce(lambda a, b: a + b, texts, F.lit(16 * len(table.columns))).cast("long")
    counted = table.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("size")).first()
    return counted["n"] <= rows and counted["size"] <= size


def heavy_hashes(counts: DataFrame, on: Sequence[str], weight: str, n: int = HEAVY_KEYS) -> list[int]:
    """Hashes of the ``n`` heaviest keys of a table with one row per key."""
    top = counts.orderBy(F.desc(weight), *[F.col(f"`{c}`") for c in on]).limit(n)
    return [r[0] for r in top.select(F.xxhash64(*[F.col(f"`{c}`") for c in on])).collect()]


def measured_heavy(rows: DataFrame, on: Sequence[Column], n: int = HEAVY_KEYS, tracked: int = TRACKED) -> list[int]:
    """Hashes of the ``n`` heaviest keys of ``rows`` by a frequent-items sketch, from one scan.

    Each task keeps ``tracked`` hashes and their counts, and the sketches of all tasks are merged:
    nothing is shuffled by key. Every key with more than a few ``tracked``-ths of the rows is found;
    what else the sketch names costs a copy of one table row, never a wrong result.
    """
    known = reduce(and_, [c.isNotNull() for c in on])
    sketch = F.expr(f"approx_top_k(h, {n}, {tracked})")
    found = rows.filter(known).select(F.xxhash64(*on).alias("h")).agg(sketch.alias("top")).first()
    return [item["item"] for item in found["top"] or []]


def salted_left_join(rows: DataFrame, table: DataFrame, pairs: Sequence[tuple[str, str]], hot: Sequence[int]) -> DataFrame:
    """Left join by shuffle that reads ``rows`` once and puts no hot or null key into one task.

    Rows whose key hash is in ``hot``, and rows without a key (which match nothing), get one of
    ``SALTS`` numbers; the table's rows of hot keys are repeated for each. Both sides decide by
    the same hash, so a hash shared by two keys only salts one more.
    """
    left, right = [F.col(f"`{a}`") for a, _ in pairs], [F.col(f"`{b}`") for _, b in pairs]
    is_hot = lambda keys: F.xxhash64(*keys).isin(list(hot)) if hot else F.lit(False)
    spread = is_hot(left) | ~reduce(and_, [c.isNotNull() for c in left])
    salted = rows.withColumn("__salt", F.when(spread, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    numbers = F.when(is_hot(right), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    renamed = {b: f"__key_{i}" for i, (_, b) in enumerate(pairs)}
    other = table.select(*[F.col(f"`{c}`") for c in table.columns], *[F.col(f"`{b}`").alias(n) for b, n in renamed.items()], F.explode(numbers).alias("__table_salt"))
    match: Column = F.col("__salt") == F.col("__table_salt")
    for a, b in pairs:
        match = match & (F.col(f"__left.`{a}`") == F.col(renamed[b]))
    return salted.alias("__left").join(other.alias("__right"), match, "left").drop("__salt", "__table_salt", *renamed.values())


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    *,
    weight: str | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    heavy_keys: int = HEAVY_KEYS,
) -> DataFrame:
    """Left join ``rows`` with a table that is unique on ``on``; the ``weight`` column is dropped.

    ``weight`` holds how many rows carry each key; without it the heavy keys are measured on the
    rows, by a sketch, where the table is not small. A small table is broadcast after counting
    its rows and bytes. A large one is joined by one shuffle that reads ``rows`` once, with the
    rows of the heaviest keys and those without a key dealt over several tasks. ``table``
    should be a scan of a written table.
    """
    on = list(on)
    kept = [c for c in table.columns if c != weight]
    added = [c for c in kept if c not in on]
    order = [F.col(f"`{c}`") for c in [*rows.columns, *added]]
    if is_small(table.select(*kept), broadcast_rows):
        return rows.join(F.broadcast(table.select(*kept)), on, "left").select(*order)
    renamed = table.select(*[F.col(f"`{c}`").alias(f"__on_{i}") for i, c in enumerate(on)], *added)
    hot = heavy_hashes(table, on, weight, heavy_keys) if weight else measured_heavy(rows, [F.col(f"`{c}`") for c in on], heavy_keys)
    joined = salted_left_join(rows, renamed, [(c, f"__on_{i}") for i, c in enumerate(on)], hot)
    return joined.select(*order)
