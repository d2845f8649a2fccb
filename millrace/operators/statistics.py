"""Entropy, evaluation metrics, null coverage and column statistics: aggregates of one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DataError
from ..rows import is_missing, named


def _entropy(counts: DataFrame, n: str = "count") -> DataFrame:
    """-sum p log2 p from counts, with the total from the same aggregate: log2 N - sum(n log2 n)/N."""
    total = F.sum(n)
    h = F.log2(total) - F.sum(F.col(n) * F.log2(F.col(n).cast("double"))) / total
    return counts.agg(F.greatest(h, F.lit(0.0)).alias("entropy"))


def entropy(df: DataFrame, columns: str | list[str]) -> DataFrame:
    """Shannon entropy in bits of one column, or of several together; null is a value."""
    return _entropy(df.groupBy(*([columns] if isinstance(columns, str) else columns)).count())


def joint_entropy(df: DataFrame, x: str, y: str) -> DataFrame:
    return entropy(df, [x, y])


def _entropies(df: DataFrame, y: str, x: str) -> DataFrame:
    """h_xy, h_x and h_y from grouping sets: one scan, one shuffle of the distinct pairs."""
    sets = df.groupingSets([[F.col(x), F.col(y)], [F.col(x)], [F.col(y)]], F.col(x), F.col(y)).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))

    def h(g: int) -> Column:
        n = F.when(F.col("g") == g, F.col("n"))
        return F.log2(F.sum(n)) - F.sum(n * F.log2(n.cast("double"))) / F.sum(n)

    return sets.agg(h(0).alias("h_xy"), h(1).alias("h_x"), h(2).alias("h_y"))


def conditional_entropy(df: DataFrame, y: str, x: str) -> DataFrame:
    """H(y | x)."""
    return _entropies(df, y, x).select((F.col("h_xy") - F.col("h_x")).alias("entropy"))


def information_gain(df: DataFrame, y: str, x: str) -> DataFrame:
    return _entropies(df, y, x).select((F.col("h_y") - F.col("h_xy") + F.col("h_x")).alias("gain"))


def _ratio(a: Column, b: Column) -> Column:
    """IEEE division: 0/0 is NaN, x/0 infinite, instead of an error or a null that averages would skip."""
    a, b = a.cast("double"), b.cast("double")
    inf = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(b == 0, inf).otherwise(a / F.when(b != 0, b))


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """nmae, rmse, mae, mape, smape over rows whose actual value is present.

    nmae is mae over the range of actual values; mape divides by the signed midpoint of both values, smape by
    the mean of their absolute values; both are percentages. A row of 0/0 makes its mean NaN.
    """
    rows = df.where(~is_missing(df, actual))
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    gap = F.abs(a - p)
    mae = F.avg(gap)
    return rows.groupBy(*(by or [])).agg(
        _ratio(mae, F.max(a) - F.min(a)).alias("nmae"), F.sqrt(F.avg((a - p) * (a - p))).alias("rmse"), mae.alias("mae"),
        (100 * F.avg(F.abs(_ratio(gap, (a + p) / 2)))).alias("mape"), (100 * F.avg(_ratio(gap, (F.abs(a) + F.abs(p)) / 2))).alias("smape"))


CLASSIFICATION = ("accuracy", "precision", "recall", "specificity", "negative_predictive_value", "miss_rate", "fall_out", "false_discovery_rate", "false_omission_rate", "threat_score", "f1_score", "matthews_correlation_coefficient", "informedness", "markedness")


def classification_metrics(df: DataFrame, actual: str, predicted: str, negative, positive, by: list[str] | None = None) -> DataFrame:
    """tn, fp, fn, tp and the fourteen metrics of a binary confusion; a zero denominator gives NaN or infinity."""
    a, p = F.col(actual) == F.lit(positive), F.col(predicted) == F.lit(positive)
    na, np_ = F.col(actual) == F.lit(negative), F.col(predicted) == F.lit(negative)
    counts = df.groupBy(*(by or [])).agg(F.count_if(na & np_).alias("tn"), F.count_if(na & p).alias("fp"), F.count_if(a & np_).alias("fn"), F.count_if(a & p).alias("tp"))
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    recall, specificity, precision, npv = _ratio(tp, tp + fn), _ratio(tn, tn + fp), _ratio(tp, tp + fp), _ratio(tn, tn + fn)
    mcc = _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    values = (_ratio(tp + tn, tp + tn + fp + fn), precision, recall, specificity, npv, _ratio(fn, fn + tp), _ratio(fp, fp + tn), _ratio(fp, fp + tp), _ratio(fn, fn + tn), _ratio(tp, tp + fn + fp), _ratio(2 * tp, 2 * tp + fp + fn), mcc, recall + specificity - 1, precision + npv - 1)
    return counts.select(*(by or []), "tn", "fp", "fn", "tp", *[v.alias(n) for n, v in zip(CLASSIFICATION, values)])


def aggregate_folds(df: DataFrame, by: list[str], metrics: Sequence[str]) -> DataFrame:
    """mean, median, min, max and std of each metric, as <metric>_<statistic>."""
    kinds = (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max), ("std", F.stddev_samp))
    return df.groupBy(*by).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n, f in kinds])


def date_mean(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """The earliest date plus the mean distance from it, half-even rounded; groups in one aggregate."""
    d = F.col(column).cast("date")
    days = F.datediff(d, F.lit("1970-01-01").cast("date")).cast("double")
    agg = df.where(d.isNotNull()).groupBy(*(by or [])).agg(F.min(d).alias("_d"), F.min(days).alias("_m"), F.avg(days).alias("_a"))
    return agg.select(*(by or []), F.date_add("_d", F.bround(F.col("_a") - F.col("_m")).cast("int")).alias("date_mean"))


def column_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: <c>_mean, <c>_sd (of the population), <c>_uniques; missing values skipped."""
    out = []
    for c in columns:
        x = F.when(~is_missing(df, c), named(c))
        out += [F.avg(x).alias(f"{c}_mean"), F.stddev_pop(x).alias(f"{c}_sd"), F.count_distinct(x).alias(f"{c}_uniques")]
    return df.agg(*out)


def _masks(df: DataFrame, columns: list[str]) -> list[tuple[int, int]]:
    """(bit mask of missing columns, rows), one for each pattern that occurs; tables may have any number of columns."""
    flags = F.concat(*[F.when(is_missing(df, c), "1").otherwise("0") for c in reversed(columns)])
    return [(int(r["m"], 2), r["count"]) for r in df.groupBy(flags.alias("m")).count().collect()]


def fully_covering_columns(df: DataFrame, column: str) -> list[str]:
    """Columns that are present wherever ``column`` is missing."""
    return [df.columns[i] for i in _covering(_masks(df, df.columns), df.columns.index(column), len(df.columns))]


def _covering(masks: list[tuple[int, int]], bit: int, width: int) -> list[int]:
    gaps = 0
    for m, _ in masks:
        gaps |= m if m >> bit & 1 else 0
    return [i for i in range(width) if i != bit and not gaps >> i & 1]


def coverage_subsets(df: DataFrame, column: str) -> DataFrame:
    """For every non-empty subset of the covering columns: how many rows have all of it, and its score.

    columns, n_columns, row_coverage, row_ratio, column_ratio = n_columns / (columns - 1), score = row_ratio^2 *
    column_ratio. One scan counts the patterns of missing values. The subsets, 2^n of them, are made by Spark; more
    than 2^40 are an error, for which ``best_coverage`` is the way.
    """
    masks, names = _masks(df, df.columns), df.columns
    covering = _covering(masks, names.index(column), len(names))
    if len(covering) > 40:
        raise DataError(f"{len(covering)} covering columns have too many subsets to list")
    total = sum(n for _, n in masks)
    # Patterns that agree in the covering columns are one.
    seen: dict[int, int] = {}
    for m, n in masks:
        gaps = sum(1 << j for j, i in enumerate(covering) if m >> i & 1)
        seen[gaps] = seen.get(gaps, 0) + n
    spark = df.sparkSession
    subsets = spark.range(1, 1 << len(covering)) if covering else spark.range(0)
    patterns = F.broadcast(spark.createDataFrame(list(seen.items()) or [(0, 0)], "gaps bigint, n bigint"))
    covered = F.sum(F.when(F.col("id").bitwiseAND(F.col("gaps")) == 0, F.col("n")).otherwise(0)).alias("row_coverage")
    counted = subsets.join(patterns, F.lit(True)).groupBy("id").agg(covered)
    held = [F.when(F.col("id").bitwiseAND(1 << j) != 0, F.lit(names[i])) for j, i in enumerate(covering)] or [F.lit(None).cast("string")]
    chosen = F.array_compact(F.array(*held))
    ratio, width = F.col("row_coverage") / F.lit(float(total)), F.col("n_columns") / F.lit(float(len(names) - 1))
    out = counted.select(F.array_join(chosen, ",").alias("columns"), F.size(chosen).alias("n_columns"), "row_coverage")
    return out.select("*", ratio.alias("row_ratio"), width.alias("column_ratio"), (ratio * ratio * width).alias("score"))


#: Branches that ``best_coverage`` looks at before it settles for the best subset found.
MOST_BRANCHES = 100_000


def best_coverage(df: DataFrame, column: str) -> list[str]:
    """The subset of the covering columns with the best score, of equal ones the smallest, then the first by name.

    Columns that are missing in the same rows come together, since each adds to the width and takes no more rows.
    Such groups are taken in or left out one after the other; a branch ends where even all that is left, with the rows
    it still has, could not reach the best score so far. The search is exact unless it takes MOST_BRANCHES.
    """
    masks, names = _masks(df, df.columns), df.columns
    total, width = sum(n for _, n in masks), len(names) - 1
    alike: dict[tuple[int, ...], list[int]] = {}
    for i in _covering(masks, names.index(column), len(names)):
        alike.setdefault(tuple(k for k, (m, _) in enumerate(masks) if m >> i & 1), []).append(i)
    groups = sorted(alike.items(), key=lambda g: (sum(masks[k][1] for k in g[0]), g[1]))
    left = [sum(len(g) for _, g in groups[at:]) for at in range(len(groups) + 1)]
    best: tuple | None = None
    waiting, looked = [(0, [], frozenset())], 0
    while waiting and looked < MOST_BRANCHES:
        at, taken, lost = waiting.pop()
        looked += 1
        ratio = (total - sum(masks[k][1] for k in lost)) / total if total else 0.0
        if best is not None and ratio**2 * ((len(taken) + left[at]) / width) < -best[0]:
            continue
        if at == len(groups):
            if taken:
                own = sorted(taken)
                found = (-(ratio**2 * (len(own) / width)), len(own), ",".join(names[i] for i in own), own)
                best = found if best is None else min(best, found)
            continue
        rows, columns = groups[at]
        waiting.append((at + 1, taken, lost))
        waiting.append((at + 1, [*taken, *columns], lost.union(rows)))
    return [names[i] for i in best[3]] if best else []


def performance_summary(events: DataFrame, name: str, start: str, end: str) -> DataFrame:
    """count, total_seconds and mean_seconds of each name of a table of timed events."""
    seconds = F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / 1e6
    return events.groupBy(name).agg(F.count(F.lit(1)).alias("count"), F.sum(seconds).alias("total_seconds"), F.avg(seconds).alias("mean_seconds"))
