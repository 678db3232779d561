"""Shared scratch space for tables that must be written once and read back.

Some operators need a decision that later steps rely on (which range block a row fell
into, a fitted lookup table). Such a table is written as Parquet to the shared folder the
cluster names in ``spark.checkpoint.dir`` and read back: the lineage is cut, a lost
executor does not lose it, and Catalyst knows its true size when it plans joins.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder for written tables: the session's ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests, a laptop) gets a temporary folder; a
    cluster session gets an error, because no machine-local folder is shared there.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tabflow-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tabflow-{sc.applicationId}"


_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession, later: list[str] | None = None):
    """Delete what ``materialize`` writes inside the block when it ends; take results out first.

    With ``later`` the paths are put into that list instead, for the caller to ``free``.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        paths = _SCOPES.pop()
        if later is None:
            free(spark, paths)
        else:
            later += paths


def materialize(df: DataFrame, name: str, *, outlive: bool = False) -> DataFrame:
    """Write ``df`` to the scratch folder and return a scan of what was written.

    ``outlive`` takes the table out of the innermost ``scope``: it belongs to the one around it.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    owners = _SCOPES[:-1] if outlive else _SCOPES
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._scratch_path = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and nothing reads any more."""
    for written in tables:
        _delete(written.sparkSession, written._scratch_path)


def free(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete every table this application wrote to the scratch folder."""
    _delete(spark, scratch_root(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
