"""Small helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of the size and near-duplicate contracts are runs without white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Texts are handed to numpy in groups of about this many characters.
PIECE_CHARS = 500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the built-in fast path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def id_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id's text modulo ``buckets``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(buckets)).cast("int")


def stretches(texts: pd.Series, limit: int = PIECE_CHARS) -> Iterator[tuple[list[str], np.ndarray]]:
    """The texts of a batch in order as (parts, number of the text each part is from).

    About ``limit`` characters at a time; a longer text is cut into parts of ``limit``
    characters, so memory is bounded whatever a text's length. Null is the empty text.
    """
    parts, of, size = [], [], 0
    for k, t in enumerate(texts):
        t = t if isinstance(t, str) else ""
        for at in range(0, max(1, len(t)), limit):
            parts.append(t[at:at + limit])
            of.append(k)
            size += len(parts[-1])
            if size >= limit:
                yield parts, np.array(of)
                parts, of, size = [], [], 0
    if parts:
        yield parts, np.array(of)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns an operator is about to add: a clashing input column is replaced."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def bounded_broadcast(keys: DataFrame, most: int) -> DataFrame:
    """``keys``, a scan of a written table, marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


_SLOT: list[tuple[object, object]] = []


def worker_slot(name: object, make: Callable[[], object]) -> object:
    """The one object that a Python worker keeps between its tasks; another name takes its place and its memory."""
    if not _SLOT or _SLOT[0][0] != name:
        _SLOT.clear()
        _SLOT.append((name, make()))
    return _SLOT[0][1]


def unpacked(names: Sequence[str], replaced: Sequence[str] = ()) -> list[Column]:
    """The columns of a packed row, without those that an operator's own outputs replace."""
    taken = {n.lower() for n in replaced}
    return [F.col(f"_row.`{c}`").alias(c) for c in names if c.lower() not in taken]


def packed(df: DataFrame, *names: str) -> DataFrame:
    """The whole row as ``_row`` beside copies of the named columns as ``_<name>``: no clash is possible."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[F.col(f"`{n}`").alias(f"_{n}") for n in names])
