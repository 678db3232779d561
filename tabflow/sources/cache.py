"""Validated dataset cache: a built table is reused while its parameters and inputs match."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

FORMAT_VERSION = 1
# Parts of an incremental dataset, and files that a rebuilt part is dealt over.
PARTS = 64
PART_FILES = 4
PART = "__part"
_MANIFEST = "part int, fingerprint string, path string, n_rows long, schema string"


def signature(params: Any) -> str:
    """Twelve hex digits of the canonical JSON of the parameters."""
    return hashlib.sha1(json.dumps(params, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:12]


def file_fingerprint(spark: SparkSession, path: str) -> str:
    """Number, total size and latest change of the files below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length", "modificationTime")
    r = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"), F.max(F.unix_micros("modificationTime")).alias("at")).first()
    return f"{r['n']}-{r['size']}-{r['at']}"


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """Rows and order-free checksums of a table's contents, in one pass; the sum is exact for any number of rows."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in columns or df.columns])
    again = F.xxhash64(h, F.lit(1))  # rows that repeat in pairs cancel out of the first sum only
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("x"), F.coalesce(_hash_sum(again), F.lit(0)).alias("s")).first()
    return f"{r['n']}-{r['x']:x}-{int(r['s']):x}"


def _hash_sum(h: Column) -> Column:
    """Sum of 44 bits of each hash; a long would overflow at about a million rows."""
    return F.sum(F.shiftrightunsigned(h, 20).cast("decimal(20,0)"))


def cached_dataset(
    spark: SparkSession,
    root: str,
    params: Mapping[str, Any],
    build: Callable[[], DataFrame],
    *,
    check: Callable[[DataFrame], str | None] | None = None,
) -> DataFrame:
    """The dataset for ``params`` below ``root``; built on a miss, a mismatch, or a failed check.

    Data goes to a new folder first; the metadata row that names it is written last, so a
    failed build leaves no valid entry. ``check`` returns a reason to rebuild, or nothing.
    """
    wanted = {"format_version": FORMAT_VERSION, **params}
    entry = f"{root.rstrip('/')}/dataset_{signature(wanted)}"
    stored = _read_meta(spark, entry)
    if stored and stored["params"] == json.dumps(wanted, sort_keys=True, ensure_ascii=False) and stored["n_rows"] > 0:
        data = _read_data(spark, stored["path"])
        if data is not None and (check is None or check(data) is None):
            return data
    path = f"{entry}/data-{uuid.uuid4().hex}"
    build().write.parquet(path)
    data = spark.read.parquet(path)
    n, reason = data.count(), check(data) if check else None
    if n == 0 or reason:
        raise ValueError(f"built dataset is not valid: {reason or 'empty'}")
    meta = spark.createDataFrame([(json.dumps(wanted, sort_keys=True, ensure_ascii=False), n, path)], "params string, n_rows long, path string")
    meta.coalesce(1).write.mode("overwrite").json(f"{entry}/meta")
    return data


def cached_datasets(spark: SparkSession, root: str, variants: Mapping[Any, Mapping[str, Any]], build: Callable[[Mapping[str, Any]], DataFrame], **options) -> dict[Any, DataFrame]:
    """Every distinct parameter set built or loaded once, shared by all names that ask for it."""
    loaded: dict[str, DataFrame] = {}
    for params in variants.values():
        if signature(params) not in loaded:
            loaded[signature(params)] = cached_dataset(spark, root, params, lambda p=params: build(p), **options)
    return {name: loaded[signature(params)] for name, params in variants.items()}


@dataclass(frozen=True)
class Parts:
    """An incremental dataset: its rows, and which parts this call built, kept or dropped."""

    data: DataFrame
    rebuilt: list[int]
    kept: list[int]
    dropped: list[int]


def part_of(key: Sequence[str], parts: int):
    """The part that a row's key belongs to; a null key has one, too."""
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key]), F.lit(parts)).cast("int")


def part_fingerprints(df: DataFrame, key: Sequence[str], parts: int) -> dict[int, str]:
    """Rows and order-free checksums of every part that has rows, from one pass and ``parts`` rows."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    hashed = df.select(part_of(key, parts).alias("part"), h.alias("h"), F.xxhash64(h, F.lit(1)).alias("again"))
    sums = hashed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), _hash_sum(F.col("again")).alias("s"))
    return {r["part"]: f"{r['n']}-{r['x']:x}-{int(r['s']):x}" for r in sums.collect()}


def incremental_dataset(
    spark: SparkSession,
    root: str,
    params: Mapping[str, Any],
    source: DataFrame,
    key: Sequence[str],
    build: Callable[[DataFrame], DataFrame],
    *,
    parts: int = PARTS,
) -> Parts:
    """``build(source)`` below ``root``, of which only parts whose source rows changed are built again.

    Rows belong to one of ``parts`` parts by the hash of ``key``. ``build`` works on whole keys
    and keeps their columns, so the rows of a part depend on that part of the source only. The
    manifest holds a fingerprint and a folder for each part. Changed parts are built by one job
    into a new folder; a manifest of a new version then names it beside the folders of the parts
    that stay, so a failed build changes nothing. Parts without source rows leave the manifest.
    Other parameters, another key or number of parts start a dataset of their own. Folders that no
    manifest names any more stay for readers; ``drop_stale`` deletes them.
    """
    wanted = {"format_version": FORMAT_VERSION, "key": list(key), "parts": parts, **params}
    entry = f"{root.rstrip('/')}/parts_{signature(wanted)}"
    version, stored, stored_schema = _read_manifest(spark, entry)
    now = part_fingerprints(source, key, parts)
    changed = sorted(p for p, f in now.items() if p not in stored or stored[p]["fingerprint"] != f)
    dropped = sorted(set(stored) - set(now))
    kept = {p: stored[p] for p in now if p not in changed}
    made: dict[int, int] = {}
    run = f"{entry}/run-{uuid.uuid4().hex}"
    if changed or not version:
        built = build(source.filter(part_of(key, parts).isin(changed)) if len(changed) < len(now) else source)
        schema = built.schema
        built.withColumn(PART, part_of(key, parts)).repartition(F.col(PART), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(PART_FILES))).write.partitionBy(PART).parquet(run)
        made = {r[PART]: r["n"] for r in spark.read.schema(f"{PART} int").option("basePath", run).parquet(run).groupBy(PART).agg(F.count(F.lit(1)).alias("n")).collect()} if changed else {}
        strange = set(made) - set(changed)
        if strange:
            raise ValueError(f"the build changed the key: rows of parts {sorted(strange)[:5]} came from others")
    else:
        schema = StructType.fromJson(json.loads(stored_schema))
    if changed or dropped or not version:
        rows = [(p, now[p], f"{run}/{PART}={p}", made.get(p, 0), None) for p in changed]
        rows += [(p, m["fingerprint"], m["path"], m["n_rows"], None) for p, m in kept.items()]
        # the first row is no part: a manifest without parts is one, too
        rows.insert(0, (-1, "", "", 0, schema.json()))
        manifest = spark.createDataFrame(rows, _MANIFEST)
        manifest.coalesce(1).write.json(f"{entry}/manifests/version={version + 1}")
        stored = {r[0]: {"path": r[2], "n_rows": r[3]} for r in rows[1:]}
    paths = [m["path"] for _, m in sorted(stored.items()) if m["n_rows"]]
    data = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return Parts(data, changed, sorted(kept), dropped)


def drop_stale(spark: SparkSession, root: str) -> int:
    """Delete manifests but the last of each dataset below ``root``, and runs that it does not name."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = 0
    for status in fs.listStatus(fs_path(root)) if fs.exists(fs_path(root)) else []:
        entry = status.getPath().toString()
        if not entry.rsplit("/", 1)[-1].startswith("parts_"):
            continue
        version, stored, _ = _read_manifest(spark, entry)
        used = {m["path"].rsplit("/", 2)[-2] for m in stored.values()} | {f"version={version}"}
        for folder in (entry, f"{entry}/manifests"):
            for child in fs.listStatus(fs_path(folder)):
                name = child.getPath().getName()
                if name.startswith(("run-", "version=")) and name not in used:
                    gone += bool(fs.delete(child.getPath(), True))
    return gone


def _read_manifest(spark: SparkSession, entry: str) -> tuple[int, dict[int, dict], str | None]:
    """(version, part -> row, schema) of the last complete manifest; version 0 if there is none."""
    try:
        rows = spark.read.schema(f"{_MANIFEST}, version int").json(f"{entry}/manifests").collect()  # one row a part and version
    except AnalysisException:
        return 0, {}, None
    last = max((r["version"] for r in rows), default=0)
    parts = {r["part"]: r.asDict() for r in rows if r["version"] == last}
    return last, parts, (parts.pop(-1, None) or {}).get("schema")


def columns_check(names: Sequence[str]) -> Callable[[DataFrame], str | None]:
    """A check that the stored table has the named columns."""
    def check(df: DataFrame) -> str | None:
        missing = [n for n in names if n not in df.columns]
        return f"missing columns: {missing}" if missing else None

    return check


def array_dims_check(sizes: Mapping[str, int]) -> Callable[[DataFrame], str | None]:
    """A check that every inner array of the named columns has the given length."""
    def check(df: DataFrame) -> str | None:
        bad = df.agg(*[F.count_if(F.exists(c, _has_other_size(n))).alias(c) for c, n in sizes.items()]).first().asDict()
        wrong = {c: n for c, n in bad.items() if n}
        return f"wrong inner length: {wrong}" if wrong else None

    return check


def _has_other_size(n: int):
    return lambda step: F.size(step) != n


def _read_meta(spark: SparkSession, entry: str):
    try:
        return spark.read.schema("params string, n_rows long, path string").json(f"{entry}/meta").first()
    except AnalysisException:
        return None


def _read_data(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
