"""Readers and writers of tables, result documents and text reports."""

from __future__ import annotations

import codecs
import re
import uuid
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import CharType, DoubleType, FloatType, StringType, StructField, StructType, VarcharType

from tabflow.functions import fixed_values as fv
from tabflow.operators import validate
from tabflow.scratch import materialize

# Folders that entity files are dealt over; more than 32 are listed by a job, not by the driver.
ENTITY_FOLDERS = 64
# Bytes of an entity file that one task reads, bytes it reads or gives out at once, and lines.
SPLIT_BYTES = 64 << 20
_CHUNK = 1 << 20
_LINES = 10_000


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header (a UTF-8 byte-order mark is ignored).

    Jobs pass a schema; without one the types are inferred with an extra pass, for exploring.
    """
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_typed_csv(spark: SparkSession, path: str, types: Mapping[str, str], *, columns: Sequence[str] | None = None, not_null: Sequence[str] | None = None) -> DataFrame:
    """CSV with declared (narrow) types: a cell that does not fit is an error, and so is a null
    in an integer column (or in the columns of ``not_null``). Columns are found by header name."""
    wanted = list(columns or types)
    header = spark.read.option("header", True).csv(path).columns  # reads the first line only
    missing = [c for c in wanted if c not in header]
    if missing:
        raise validate.ValidationError(f"{path}: missing columns {missing}; available: {header}")
    schema = ", ".join(f"`{c}` {types[c] if c in wanted else 'string'}" for c in header)
    df = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).schema(schema).csv(path)
    integers = [c for c in wanted if types[c] in ("tinyint", "smallint", "int", "bigint")] if not_null is None else not_null
    checked = lambda c: F.coalesce(F.col(f"`{c}`"), F.raise_error(F.lit(f"null in {c}")).cast(types[c])).alias(c)
    return df.select(*[checked(c) if c in integers else F.col(f"`{c}`") for c in wanted])


def read_labelled_tables(spark: SparkSession, train: str, test: str, template: str, *, types: Mapping[str, str] = fv.TABULAR_TYPES, key: str = "id", target: str = "Heart Disease") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training, test and template tables with the checks that belong to loading them."""
    features = [c for c in types if c != target]
    frames = (
        read_typed_csv(spark, train, types),
        read_typed_csv(spark, test, types, columns=features),
        read_typed_csv(spark, template, {key: types[key], target: "double"}),
    )
    for df, name in zip(frames, ("train", "test", "template")):
        validate.require_unique_key(df, key, name)
    validate.require_same_keys([frames[1], frames[2]], key)
    return frames


def read_entity_files(spark: SparkSession, meta: DataFrame, files: str | Sequence[str], schema: StructType | str, *, base: str | None = None, path_column: str = "path", key: str = "game_episode") -> DataFrame:
    """Rows of many per-entity files, each with the metadata row of its file.

    ``files`` is a folder or pattern that covers the files; read are those the metadata lists.
    Relative listed paths count from the folder ``base``. A listed file that is not among ``files``
    is an error. Tasks look the listed files up and read them, long ones in parts of ``SPLIT_BYTES``; no list of
    files is gathered on the driver. Lines are told apart and parsed as Spark's CSV reader does.
    File systems and codecs that pyarrow does not know, and folders that hold columns (``a=b``), take
    Spark's own scan, whose list of all files the driver holds.
    """
    listed = F.col(path_column)
    if base is not None:
        listed = F.when(listed.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:/)"), listed).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), listed))
    listed = meta.select(F.col(key).alias("__key"), _plain(listed).alias("__listed"))
    covers = _Covers.of(spark, files)
    if covers is None:
        return _scan_entity_files(spark, listed, files, schema, key)
    n, key_field = int(spark.conf.get("spark.sql.shuffle.partitions")), listed.schema["__key"]
    found = listed.repartition(n, "__listed").mapInArrow(_look_up(covers), StructType([key_field, *StructType.fromDDL("__listed string, covered int, size long, plain boolean")]))
    told = found.filter("size is null or not plain").select("__listed", "size").limit(6).collect()
    _require_no_missing([r["__listed"] for r in told if r["size"] is None])
    if told:
        return _scan_entity_files(spark, listed, files, schema, key)
    begins = F.when(F.col("__listed").rlike(_PACKED), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(SPLIT_BYTES).cast("long")))
    parts = found.select("__key", "__listed", "covered", F.explode(begins).alias("begin")).repartition(n, "__listed", "begin")
    lines = parts.mapInArrow(_read_lines(covers), StructType([key_field, *StructType.fromDDL("line binary")]))
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = StructType([StructField(f.name, StringType() if isinstance(f.dataType, (CharType, VarcharType)) else f.dataType) for f in fields])
    parsed = lines.select("__key", F.from_csv(F.col("line").cast("string"), fields.json()).alias("__row"))
    return parsed.select(F.col("__key").alias(key), *[F.col(f"__row.`{c}`").alias(c) for c in fields.names if c != key])


def _plain(path: Column) -> Column:
    """A path without its scheme."""
    return F.regexp_replace(F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/"), r"/(\./)+", "/")


def _require_no_missing(missing: list[str | None]) -> None:
    if missing:
        names = ", ".join(map(str, missing[:5])) + (", …" if len(missing) > 5 else "")
        raise validate.ValidationError(f"listed files that are not among the files read: {names}")


def _scan_entity_files(spark: SparkSession, listed: DataFrame, files: str | Sequence[str], schema: StructType | str, key: str) -> DataFrame:
    """``read_entity_files`` by one scan of all ``files``, joined on the file path."""
    # the rows' path is an encoded address, in which a plus stands for itself; the files' is as it is
    own_path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = spark.read.option("header", True).schema(schema).csv(files).withColumn("__path", _plain(own_path))
    there = spark.read.format("binaryFile").load(files).select(_plain(F.col("path")).alias("__listed"))
    _require_no_missing([r[0] for r in listed.join(there, "__listed", "left_anti").select("__listed").limit(6).collect()])
    own = [c for c in rows.columns if c not in ("__path", key)]
    return rows.join(listed, F.col("__path") == F.col("__listed"), "inner").select(F.col("__key").alias(key), *own)


class _Covers:
    """The folders and patterns that entity files are looked for in, and how tasks open them.

    A file is covered as Spark's readers would list it: by its own path or by its folder's, hidden names left out.
    """

    def __init__(self, roots: list[tuple[str, str]], exact: dict[str, int], patterns: list[tuple[int, list[str]]]):
        self.roots, self.exact, self.patterns = roots, exact, patterns

    @classmethod
    def of(cls, spark: SparkSession, files: str | Sequence[str]) -> _Covers | None:
        """None if pyarrow does not know one of the file systems."""
        hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        roots: dict[tuple[str, str], int] = {}
        exact, patterns = {}, []
        for given in [files] if isinstance(files, str) else files:
            path = hadoop.Path(given)
            uri = path.getFileSystem(conf).makeQualified(path).toUri()
            host = uri.getAuthority() or ""
            root = f"{uri.getScheme()}://{host}/", f"/{host}" if host else ""
            if root not in roots:
                try:
                    fs.FileSystem.from_uri(root[0])
                except Exception:  # of many kinds: an unknown scheme, a missing library
                    return None
                roots[root] = len(roots)
            whole = re.sub(r"/(\./)+", "/", f"{root[1]}{uri.getPath()}")
            if not set("{}[]*?\\") & set(whole):
                exact[whole] = roots[root]
                continue
            for one in hadoop.GlobExpander.expand(whole):
                patterns.append((roots[root], [hadoop.GlobPattern(c).compiled().pattern() for c in one.split("/")]))
        return cls(list(roots), exact, patterns)

    def open(self) -> list[tuple[fs.FileSystem, str, int]]:
        """For each root its file system, and what stands in it for the first so many characters of a path."""
        return [(*fs.FileSystem.from_uri(uri), len(host)) for uri, host in self.roots]

    def finder(self):
        """A function of a path: (number of the root, whether tasks can read it by themselves), or None."""
        compiled = [(root, [re.compile(c, re.DOTALL) for c in one]) for root, one in self.patterns]

        def matched(path: str) -> int | None:
            if path in self.exact:
                return self.exact[path]
            parts = path.split("/")
            return next((root for root, one in compiled if len(one) == len(parts) and all(c.fullmatch(x) for c, x in zip(one, parts))), None)

        folder_root = lru_cache(100_000)(matched)

        def find(path: str | None) -> tuple[int, bool] | None:
            folder, _, name = (path or "").rpartition("/")
            if not name or _HIDDEN.search(name):
                return None
            root = folder_root(folder)
            root = matched(path) if root is None else root
            if root is not None:
                return root, not name.endswith(_FOREIGN)
            while "=" in folder.rpartition("/")[2]:
                folder = folder.rpartition("/")[0]
                if (root := folder_root(folder)) is not None:
                    return root, False
            return None

        return find


# Names that Spark's readers leave out, of files that are read from the start, and of codecs that only Hadoop knows.
_HIDDEN = re.compile(r"^_(?!(common_)?metadata)[^=]*$|^\.|^(?!_(common_)?metadata).*\._COPYING_$", re.DOTALL)
_PACKED = r"\.(gz|bz2|zst)$"
_FOREIGN = (".lz4", ".snappy", ".deflate")
_BLANK = bytes(range(33))


def _look_up(covers: _Covers):
    """(key, path) to (key, path, root, size, plain): size is null for a path that is no covered file."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, find = covers.open(), covers.finder()
        for batch in batches:
            paths = batch.column(1).to_pylist()
            found = [find(p) for p in paths]
            size: list[int | None] = [None] * len(paths)
            for k, (place, inside, cut) in enumerate(opened):
                own = [i for i, f in enumerate(found) if f is not None and f[0] == k]
                for i, info in zip(own, place.get_file_info([_inside(inside, paths[i][cut:]) for i in own])):
                    size[i] = info.size if info.type == fs.FileType.File else None
            rest = [pa.array([f and f[0] for f in found], pa.int32()), pa.array(size, pa.int64()), pa.array([f is not None and f[1] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *rest], names=[*batch.schema.names, "covered", "size", "plain"])

    return look_up


def _inside(root: str, path: str) -> str:
    return f"{root.rstrip('/')}{path}"


def _read_lines(covers: _Covers):
    """(key, path, root, begin) to (key, line): the lines of that part of a file, without the header and empty ones."""
    split = SPLIT_BYTES

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = covers.open()
        for batch in batches:
            names, at, lines, n = [batch.schema.names[0], "line"], [], [], 0
            for i, (path, root, begin) in enumerate(zip(*[batch.column(c).to_pylist() for c in (1, 2, 3)])):
                place, inside, cut = opened[root]
                packed = re.search(_PACKED, path)
                with place.open_input_stream(_inside(inside, path[cut:])) if packed else place.open_input_file(_inside(inside, path[cut:])) as source:
                    own = (x for x in _file_lines(source, begin, None if packed else begin + split) if x.strip(_BLANK))
                    if begin == 0:
                        next(own, None)
                    for line in own:
                        at.append(i)
                        lines.append(line)
                        n += len(line)
                        if n >= _CHUNK or len(at) >= _LINES:
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(lines, pa.binary())], names=names)
                            at, lines, n = [], [], 0
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(lines, pa.binary())], names=names)

    return read


def _file_lines(source, begin: int, end: int | None) -> Iterator[bytes]:
    """The lines of an open file that start in [begin, end), without what ends them: a line feed, a carriage return or both."""
    at, held = max(begin - 1, 0), b""
    if at:
        source.seek(at)
    while True:
        chunk = source.read(max(_CHUNK, len(held)))
        lines = (held + chunk).splitlines(keepends=True)
        # a line that may go on, or whose carriage return may be followed by a line feed
        held = lines.pop() if chunk and not lines[-1].endswith(b"\n") else b""
        for line in lines:
            if end is not None and at >= end:
                return
            if at >= begin:
                yield (line.removeprefix(codecs.BOM_UTF8) if at == 0 else line).rstrip(b"\r\n")
            at += len(line)
        if not chunk:
            return


def write_entity_files(df: DataFrame, base: str, *, key: str = "game_episode", path_column: str = "path", folders: int = ENTITY_FOLDERS) -> DataFrame:
    """One CSV file with a header per entity below ``base``; returns the written table of (key, relative path).

    Tasks write the files as they meet the entities, a batch at a time, so neither a folder per entity nor a
    rename of every file by the driver is needed. A repeated task writes files of new names; the table lists
    those of the task that counted. ``base`` is a folder all executors share.
    """
    columns = [c for c in df.columns if c != key]
    header = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c for c in columns)
    lines = df.select(F.col(f"`{key}`").alias("entity"), F.to_csv(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("line"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, root = fs.FileSystem.from_uri(base)
        made, out, now = set(), None, None
        try:
            for batch in batches:
                listed = []
                for entity, part in batch.groupby("entity", sort=False, dropna=False)["line"]:
                    entity = None if pd.isna(entity) else entity
                    if out is None or entity != now:
                        if out is not None:
                            out.close()
                        name = uuid.uuid4()
                        folder = str(name.int % folders)
                        if folder not in made:
                            place.create_dir(f"{root}/{folder}", recursive=True)
                            made.add(folder)
                        out, now = place.open_output_stream(f"{root}/{folder}/{name.hex}.csv"), entity
                        out.write(f"{header}\n".encode())
                        listed.append((entity, f"./{folder}/{name.hex}.csv"))
                    out.write("".join(f"{line}\n" for line in part).encode())
                yield pd.DataFrame(listed, columns=["entity", "path"])
        finally:
            if out is not None:
                out.close()

    dealt = lines.repartition("entity").sortWithinPartitions("entity")
    listed = dealt.mapInPandas(write, f"entity {df.schema[key].dataType.simpleString()}, path string")
    return materialize(listed.select(F.col("entity").alias(key), F.col("path").alias(path_column)), "entity-files")


def null_for_nan(df: DataFrame) -> DataFrame:
    """NaN as null in all floating-point columns."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (FloatType, DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in floats}) if floats else df


def write_table(df: DataFrame, path: str, *, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Parquet, or CSV with a header."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_document(spark: SparkSession, fields: Mapping[str, Column], path: str) -> None:
    """A one-row nested JSON document built from column expressions (structs, maps, arrays)."""
    document(spark, fields).write.mode("overwrite").json(path)


def document(spark: SparkSession, fields: Mapping[str, Column]) -> DataFrame:
    return spark.range(1).select(*[c.alias(n) for n, c in fields.items()])


def read_document(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def number_map(values: Mapping[str, float | int]) -> Column:
    """A driver-side dictionary of numbers as a map column."""
    pairs = [F.lit(v) for k, x in values.items() for v in (str(k), float(x))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")


def importance_report(auc: float, importances: DataFrame, *, top: int = 20) -> DataFrame:
    """Report lines (``line_no``, ``value``): the AUC, a title, and the top importances."""
    spark = importances.sparkSession
    head = spark.createDataFrame([(0, f"Adversarial Validation AUC: {auc:.4f}"), (1, ""), (2, f"Top {top} permuted features (by mean AUC drop):")], "line_no int, value string")
    best = importances.orderBy(F.desc("importance_mean"), "feature").limit(top)
    packed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("importance_mean")).alias("o"), "feature", "importance_mean", "importance_std"))).alias("a"))
    lines = packed.select(F.posexplode("a").alias("i", "r")).select(
        (F.col("i") + 3).alias("line_no"),
        F.concat_ws("  ", F.rpad("r.feature", 30, " "), F.format_number("r.importance_mean", 6), F.format_number("r.importance_std", 6)).alias("value"),
    )
    return head.unionByName(lines)


def write_report(lines: DataFrame, path: str) -> None:
    """The lines in order as one text file; a report has a fixed small number of lines."""
    lines.coalesce(1).sortWithinPartitions("line_no").select("value").write.mode("overwrite").text(path)
