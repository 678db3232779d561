"""Column selection and roles, decided from names, types and (where said) one aggregate."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegralType, NumericType, StringType

from tabflow.functions import fixed_values as fv
from tabflow.functions import text as tx
from tabflow.functions.temporal import split_combined_key
from tabflow.operators.lookup import is_small, measured_heavy, salted_left_join
from tabflow.operators.profile import null_ratios


@dataclass(frozen=True)
class Roles:
    target: str | None = None
    combined_key: str | None = None
    entity_key: str | None = None
    datetime: str | None = None


def first_named(columns: Sequence[str], candidates: Iterable[str]) -> str | None:
    """First candidate present in ``columns``, ignoring case; the name as the table spells it."""
    by_lower = {c.lower(): c for c in reversed(columns)}
    return next((by_lower[c] for c in candidates if c in by_lower), None)


def detect_roles(columns: Sequence[str]) -> Roles:
    return Roles(*(first_named(columns, names) for names in (fv.TARGET_NAMES, fv.COMBINED_KEY_NAMES, fv.ENTITY_KEY_NAMES, fv.DATETIME_NAMES)))


def first_integer_column(df: DataFrame) -> str:
    """First integer column, or the first column."""
    return next((f.name for f in df.schema if isinstance(f.dataType, IntegralType)), df.columns[0])


def first_time_like(columns: Sequence[str]) -> str | None:
    return next((c for c in columns if "time" in c.lower() or "date" in c.lower()), None)


def survey_key(columns: Sequence[str]) -> str | None:
    return next((c for c in fv.SURVEY_KEYS if c in columns), None)


def looks_like_target(name: str, words: Iterable[str] = fv.TARGET_WORDS) -> bool:
    """Name contains a target word; one-letter words must be the whole name."""
    low = name.lower()
    return any(low == w if len(w) == 1 else w in low for w in words)


def target_like_columns(train: Sequence[str], test: Sequence[str], words: Iterable[str] = fv.TARGET_WORDS) -> list[str]:
    """Train-only columns named like a target, and the hard-coded target names."""
    return [c for c in train if (c not in test and looks_like_target(c, words)) or c in fv.HARD_TARGETS]


def aligned_union(left: DataFrame, right: DataFrame, *, label: str = "is_test") -> DataFrame:
    """Both tables stacked by name with a 0/1 side label and sorted columns; missing columns are null."""
    both = left.withColumn(label, F.lit(0)).unionByName(right.withColumn(label, F.lit(1)), allowMissingColumns=True)
    return both.select(*[F.col(f"`{c}`") for c in sorted(both.columns)])


def sparse_columns(train: DataFrame, protect: Iterable[str], share: float = fv.SPARSE_SHARE) -> list[str]:
    """Columns whose null ratio in the training table is above ``share``, except protected ones."""
    kept = set(protect)
    return [c for c, ratio in null_ratios(train).items() if ratio > share and c not in kept]


def drop_sparse(train: DataFrame, test: DataFrame, protect: Iterable[str], *, share: float = fv.SPARSE_SHARE, also: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    gone = [*sparse_columns(train, protect, share), *also]
    return train.drop(*gone), test.drop(*gone)


def feature_list(train: Sequence[str], test: Sequence[str], base: Sequence[str], prefixes: Sequence[str] = ()) -> list[str]:
    """Base names in order, then every column of either table with one of the prefixes, sorted."""
    extra = sorted({c for c in [*train, *test] if prefixes and c.startswith(tuple(prefixes))} - set(base))
    return [*base, *extra]


def select_features(df: DataFrame, features: Sequence[str], *, keep: Sequence[str] = (), prefixes: Sequence[str] = ()) -> DataFrame:
    """The features plus ``keep``; absent ones are 0 if named like a flag, else null."""
    zero = ("is_", "has_", "sig_", *prefixes)
    pick = lambda c: F.col(f"`{c}`") if c in df.columns else (F.lit(0) if c.startswith(zero) else F.lit(None).cast("double")).alias(c)
    return df.select(*[pick(c) for c in [*keep, *features]])


def categorical_columns(df: DataFrame, columns: Sequence[str], forced: Iterable[str] = ()) -> list[str]:
    """Text and boolean columns in order, then forced ones."""
    by_type = [c for c in columns if isinstance(df.schema[c].dataType, (StringType, BooleanType))]
    return [*by_type, *[c for c in forced if c in columns and c not in by_type]]


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and (columns is None or f.name in columns)]


def fill_categories(df: DataFrame, columns: Sequence[str], missing: str = fv.MISSING_CATEGORY) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing)) for c in columns})


def prepare_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null as empty text, white space collapsed."""
    return df.withColumns({c: tx.squeeze(tx.text(c)) for c in columns})


def split_key_columns(df: DataFrame, column: str) -> tuple[DataFrame, str, str]:
    """Split a combined key into entity and time columns; the entity becomes a number only if
    every row converts. Returns the table and the two new names."""
    num = "num" if "num" not in df.columns else "__num"
    time = "date_time" if "date_time" not in df.columns else "__date_time"
    head, tail = split_combined_key(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("nan")))
    as_int = head.try_cast("bigint")
    all_convert = df.agg(F.coalesce(F.bool_and(as_int.isNotNull()), F.lit(False))).first()[0]
    return df.withColumns({num: as_int if all_convert else head, time: tail}), num, time


def clean_placeholders(df: DataFrame) -> DataFrame:
    """All text columns stripped, placeholders as null."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType)]
    return df.withColumns({c: tx.placeholder_to_null(F.col(f"`{c}`")) for c in texts}) if texts else df


def numeric_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: share of all rows of each text column that hold a number."""
    return df.agg(*[F.avg(tx.number_in_text(F.col(f"`{c}`")).isNotNull().cast("double")).alias(c) for c in columns])


def coerce_numeric_like(df: DataFrame, columns: Sequence[str] | None = None, *, share: float = fv.NUMERIC_SHARE, forced: Iterable[str] = fv.FORCED_NUMBERS) -> DataFrame:
    """Text columns where at least ``share`` of the rows hold a number become doubles; forced ones always do."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType) and (columns is None or f.name in columns)]
    if not texts:
        return df
    shares = numeric_shares(df, texts).first().asDict()
    chosen = [c for c in texts if (shares[c] or 0.0) >= share or c in set(forced)]
    return df.withColumns({c: tx.number_in_text(F.col(f"`{c}`")) for c in chosen}) if chosen else df


def dimension_key(dim: DataFrame, fact_key: str) -> str:
    """Key of a dimension: the fact's key name, a usual key name, the first integer column, the first column."""
    return first_named(dim.columns, [fact_key.lower() if fact_key.isascii() else fact_key, *fv.DIMENSION_KEY_NAMES]) or first_integer_column(dim)


def join_dimension(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str | None = None) -> DataFrame:
    """Left join keeping both key columns (one, if they share a name).

    A dimension within the broadcast bounds is left to the planner; for a larger one the fact's
    heaviest keys, measured by a sketch of its rows, and its rows without a key are dealt over
    several tasks.
    """
    dim_key = dim_key or dimension_key(dim, fact_key)
    types = [df.schema[k].dataType for df, k in ((fact, fact_key), (dim, dim_key))]
    whole = all(isinstance(t, IntegralType) for t in types)
    if not (whole or types[0] == types[1]) or is_small(dim):
        if dim_key == fact_key:
            return fact.join(dim, fact_key, "left")
        return fact.join(dim, fact[f"`{fact_key}`"] == dim[f"`{dim_key}`"], "left")
    key = lambda c: F.col(f"`{c}`").cast("bigint") if whole else F.col(f"`{c}`")
    keyed, other = fact.withColumn("__fact_key", key(fact_key)), dim.withColumn("__dim_key", key(dim_key))
    joined = salted_left_join(keyed, other.drop(dim_key) if dim_key == fact_key else other, [("__fact_key", "__dim_key")], measured_heavy(keyed, [F.col("__fact_key")]))
    return joined.drop("__fact_key", "__dim_key")
