"""Exact ranking and threshold metrics, each grouped by any columns (fold, model, feature)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabflow.operators.ranking import present, running_totals


def score_counts(df: DataFrame, score: str, label: str, group: Sequence[str] = ()) -> DataFrame:
    """Positives ``n1`` and negatives ``n0`` per distinct score; null and NaN scores are left out."""
    return present(df, score).groupBy(*group, score).agg(
        F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0")
    )


def auc_of_counts(n1: str = "n1", n0: str = "n0", below: str = "below0") -> Column:
    """Aggregate expression: AUC with ties counted half, null if a class is missing."""
    pairs = F.sum(F.col(n1) * (F.col(below) + F.col(n0) / 2.0))
    return F.try_divide(pairs, F.sum(n1).cast("double") * F.sum(n0))


def roc_auc(df: DataFrame, *, score: str, label: str, group: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Exact area under the ROC curve per group: one row with ``auc``, ``n_pos`` and ``n_neg``."""
    return auc_from_counts(score_counts(df, score, label, group), score, group, partitions=partitions)


def auc_from_counts(counts: DataFrame, score: str, group: Sequence[str] = (), *, partitions: int | None = None, bounded: bool = False) -> DataFrame:
    """AUC per group from positives ``n1`` and negatives ``n0`` per distinct score."""
    ranked = running_totals(counts, group=group, order=[score], sums={"below0": F.col("n0")}, partitions=partitions, bounded=bounded)
    return ranked.groupBy(*group).agg(
        auc_of_counts().alias("auc"), F.sum("n1").alias("n_pos"), F.sum("n0").alias("n_neg")
    )


def separability(df: DataFrame, *, features: Sequence[str], label: str, partitions: int | None = None) -> DataFrame:
    """Univariate AUC of every feature, folded to max(a, 1 - a); 0.5 where a class has no value."""
    long = unpivot_numbers(df, features, [label])
    aucs = roc_auc(long, score="value", label=label, group=["feature"], partitions=partitions)
    folded = F.coalesce(F.greatest("auc", 1.0 - F.col("auc")), F.lit(0.5))
    # a feature without any value has no row in the counts
    empty = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return empty.join(aucs, "feature", "left").select("feature", folded.alias("auc"))


def unpivot_numbers(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Long form (keep…, feature, value) of numeric columns as doubles."""
    narrow = df.select(*keep, *[F.col(f"`{c}`").cast("double").alias(c) for c in features])
    return narrow.unpivot(list(keep), [f"`{c}`" for c in features], "feature", "value")


def threshold_metrics(df: DataFrame, *, prob: str, label: str, threshold: float = 0.5, group: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1 at a threshold (>= is positive)."""
    positive, truth = F.col(prob) >= threshold, F.col(label) == 1
    counts = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(positive & truth).alias("tp"),
        F.count_if(~positive & ~truth).alias("tn"),
        F.count_if(positive & ~truth).alias("fp"),
        F.count_if(~positive & truth).alias("fn"),
    )
    return counts.select(*group, F.lit(float(threshold)).alias("threshold"), "n", "tp", "tn", "fp", "fn", *rates())


def rates() -> list[Column]:
    """Accuracy, precision, recall and F1 from tp, tn, fp, fn; a zero denominator gives 0."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return [
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def threshold_grid(n: int = 181, low: float = 0.05, high: float = 0.95) -> list[float]:
    step = (high - low) / (n - 1)
    return [low + i * step for i in range(n - 1)] + [high]


def threshold_sweep(df: DataFrame, *, prob: str, label: str, n_grid: int = 181, group: Sequence[str] = ()) -> DataFrame:
    """Metrics at every grid threshold from one pass over the rows.

    Each row only adds to the count of thresholds it reaches; the totals at a threshold are
    the suffix sums over at most ``n_grid + 1`` counts per group.
    """
    grid = threshold_grid(n_grid)
    step = (grid[-1] - grid[0]) / (n_grid - 1)
    steps, p = F.lit(grid), F.col(prob)
    guess = F.greatest(F.lit(0), F.least(F.lit(n_grid - 1), F.floor((p - grid[0]) / step))).cast("int")
    # the division may be off by one step of rounding; the grid itself decides
    reached = guess + (F.get(steps, guess) <= p).cast("int") + F.coalesce((F.get(steps, guess + 1) <= p).cast("int"), F.lit(0))
    counts = df.groupBy(*group, reached.alias("reached")).agg(
        F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0")
    )
    cells = df.sparkSession.range(n_grid + 1).select(F.col("id").cast("int").alias("reached"), F.get(steps, (F.col("id") - 1).cast("int")).alias("threshold"))
    groups = counts.select(*group).distinct() if group else None
    # every threshold appears, also where no row stops at it
    frame = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_grid))).alias("reached")) if group else cells.select("reached")
    filled = frame.join(counts, [*group, "reached"], "left").join(F.broadcast(cells), "reached")
    # at most n_grid + 1 rows per group
    up = Window.partitionBy(*(group or [F.lit(0)])).orderBy(F.desc("reached")).rowsBetween(Window.unboundedPreceding, 0)
    all_rows = Window.partitionBy(*(group or [F.lit(0)]))
    n1, n0 = F.coalesce("n1", F.lit(0)), F.coalesce("n0", F.lit(0))
    totals = filled.select(
        *group, "threshold", F.sum(n1).over(up).alias("tp"), F.sum(n0).over(up).alias("fp"),
        F.sum(n1).over(all_rows).alias("n_pos"), F.sum(n0).over(all_rows).alias("n_neg"),
    ).filter("threshold is not null")
    counted = totals.select(*group, "threshold", "tp", "fp", (F.col("n_neg") - F.col("fp")).alias("tn"), (F.col("n_pos") - F.col("tp")).alias("fn"))
    return counted.select("*", *rates())


def best_threshold_by_f1(df: DataFrame, *, prob: str, label: str, n_grid: int = 181, group: Sequence[str] = ()) -> DataFrame:
    """The lowest grid threshold with the highest F1 (``best_threshold``, ``best_f1``)."""
    sweep = threshold_sweep(df, prob=prob, label=label, n_grid=n_grid, group=group)
    best = F.max(F.struct("f1", (-F.col("threshold")).alias("low")))
    return sweep.groupBy(*group).agg(best.alias("b")).select(*group, (-F.col("b.low")).alias("best_threshold"), F.col("b.f1").alias("best_f1"))


def euclidean_error(df: DataFrame, *, pred: tuple[str, str], truth: tuple[str, str], field: tuple[float, float] = (105.0, 68.0), eps: float = 1e-9, group: Sequence[str] = ()) -> DataFrame:
    """Mean distance in metres between normalised points (``eps=0`` for the plain distance)."""
    dx = (F.col(pred[0]) - F.col(truth[0])) * field[0]
    dy = (F.col(pred[1]) - F.col(truth[1])) * field[1]
    return df.groupBy(*group).agg(F.avg(F.sqrt(dx * dx + dy * dy + F.lit(float(eps)))).alias("mean_error_m"))


def error_columns(prob: str, label: str, threshold: float | Column) -> dict[str, Column]:
    """Predicted label, FP/FN/OK, probability of the predicted class, distance to the threshold."""
    p, y = F.col(prob), F.col(label)
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    says_yes = p >= cut
    kind = F.when((y == 0) & says_yes, "FP").when((y == 1) & ~says_yes, "FN").otherwise("OK")
    return {
        "y_pred": says_yes.cast("int"),
        "error_type": kind,
        "confidence": F.when(says_yes, p).otherwise(1.0 - p),
        "margin_to_threshold": F.abs(p - cut),
    }


def error_counts(errors: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Number of wrong rows per error type."""
    return errors.filter("error_type != 'OK'").groupBy(*group, "error_type").agg(F.count(F.lit(1)).alias("n"))
