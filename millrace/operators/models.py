"""Clustering, ensembles, influence of columns on a model, coefficients and importances."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Model, Pipeline
from pyspark.ml.clustering import KMeans as _KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import AmbiguousArgumentError, ClusteringError, MissingArgumentError, NotFittedError
from ..functions.control import with_timeout
from ..rows import named, require_columns
from ..storage import saved
from .quantiles import FEW, JOBS, quantiles


def assembled(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    require_columns(df, columns)
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)


@dataclass
class KMeans:
    """Labels cluster_1..k and distance columns distance_1..k; inertia and mean distance of the fit.

    Distances are built-in array expressions on the centres, so prediction needs no Python worker.
    """

    num_clusters: int
    columns: Sequence[str]
    seed: int = 42
    timeout: float | None = None
    centers: list[list[float]] | None = None

    def fit(self, df: DataFrame) -> KMeans:
        if self.num_clusters < 1:
            raise ClusteringError("at least one cluster")
        data = assembled(df, self.columns)
        fit = lambda: _KMeans(k=self.num_clusters, seed=self.seed).fit(data)
        model = with_timeout(df.sparkSession, fit, self.timeout)
        self.centers = [list(map(float, c)) for c in model.clusterCenters()]
        self.inertia = model.summary.trainingCost
        self.distortion = self.transform(df).agg(F.avg(F.least(*self._names(), F.lit(float("inf"))))).first()[0]
        return self

    def _names(self) -> list[Column]:
        return [F.col(f"distance_{i + 1}") for i in range(len(self.centers or []))]

    def transform(self, df: DataFrame) -> DataFrame:
        if self.centers is None:
            raise NotFittedError("not fitted")
        new = {}
        for i, center in enumerate(self.centers):
            squares = F.lit(0.0)
            for c, v in zip(self.columns, center):
                squares = squares + (F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v))
            new[f"distance_{i + 1}"] = F.sqrt(squares)
        return df.withColumns(new)

    def predict(self, df: DataFrame, name: str = "cluster") -> DataFrame:
        out = self.transform(df)
        nearest = F.least(*[F.struct(d.alias("d"), F.lit(i + 1).alias("i")) for i, d in enumerate(self._names())], F.struct(F.lit(float("inf")).alias("d"), F.lit(0).alias("i")))
        return out.withColumn(name, F.concat(F.lit("cluster_"), nearest["i"].cast("string")))


@dataclass
class Elbow:
    """k-means for each k; the knee is the k farthest from the chord between the ends, the larger of the knees
    by inertia and by distortion."""

    columns: Sequence[str]
    min_k: int = 2
    max_k: int = 10
    seed: int = 42
    records: list[tuple[int, float, float]] = field(default_factory=list)

    def fit(self, df: DataFrame) -> Elbow:
        data = df.select(*self.columns).cache()
        with ThreadPoolExecutor(4) as pool:  # concurrent jobs on the same cached rows
            fits = list(pool.map(lambda k: KMeans(k, self.columns, self.seed).fit(data), range(self.min_k, self.max_k + 1)))
        self.records = [(m.num_clusters, m.inertia, m.distortion) for m in fits]
        data.unpersist()
        return self

    def optimal(self, by: str = "both") -> int:
        if not self.records:
            raise NotFittedError("not fitted")
        at = {"inertia": [1], "distortion": [2], "both": [1, 2]}[by]
        return max(knee([(r[0], r[i]) for r in self.records]) for i in at)

    def data(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(self.records, "k int, inertia double, distortion double")


def knee(points: list[tuple[float, float]]) -> int:
    """The x of the point farthest from the line through the first and the last."""
    (x1, y1), (x2, y2) = points[0], points[-1]
    length = ((y2 - y1) ** 2 + (x2 - x1) ** 2) ** 0.5 or 1.0
    return max(points, key=lambda p: abs((y2 - y1) * p[0] - (x2 - x1) * p[1] + x2 * y1 - y2 * x1) / length)[0]


def ensemble_mean(predictions: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    weights = list(weights or [1.0] * len(predictions))
    total = predictions[0] * weights[0]
    for p, w in zip(predictions[1:], weights[1:]):
        total = total + p * w
    return total / sum(weights)


def ensemble_vote(predictions: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    """The value with the most weight; of equal ones the first seen. Null predictions have no vote."""
    weights = list(weights or [1.0] * len(predictions))

    def support(p: Column) -> Column:
        total = F.lit(0.0)
        for q, w in zip(predictions, weights):
            total = total + F.when(q == p, F.lit(float(w))).otherwise(0.0)
        return total

    ranked = [F.struct(F.when(p.isNotNull(), support(p)).otherwise(-1.0).alias("w"), F.lit(-i).alias("i"), p.alias("p")) for i, p in enumerate(predictions)]
    return (F.greatest(*ranked) if len(ranked) > 1 else ranked[0])["p"]


@dataclass
class Ensemble:
    """Fitted ML models whose predictions are combined by weighted mean or vote."""

    models: Sequence[Model]
    weights: Sequence[float] | None = None
    problem: str = "regression"

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        out, names = df, []
        for i, m in enumerate(self.models):
            before = set(out.columns)
            out = m.transform(out)
            extra = [c for c in out.columns if c not in before and c != "prediction"]
            out = out.withColumnRenamed("prediction", f"_p{i}").drop(*[c for c in extra if c.endswith(("Prediction", "probability"))])
            names.append(f"_p{i}")
        combine = ensemble_mean if self.problem == "regression" else ensemble_vote
        return out.withColumn(name, combine([F.col(n) for n in names], self.weights)).drop(*names)


def principal_component_model(estimator, columns: Sequence[str], k: int) -> Pipeline:
    """Centred principal components, then the estimator on them."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False), PCA(k=k, inputCol="_centred", outputCol="features"), estimator])


def coefficients(model, columns: Sequence[str]) -> dict[str, float] | None:
    if not hasattr(model, "coefficients"):
        return None
    return {**dict(zip(columns, map(float, model.coefficients))), "intercept": float(model.intercept)}


def feature_importances(model, columns: Sequence[str]) -> dict[str, float] | None:
    """By absolute value, falling."""
    values = getattr(model, "featureImportances", None)
    if values is None:
        return None
    return dict(sorted(zip(columns, map(float, values.toArray())), key=lambda x: -abs(x[1])))


def _deltas(sd: float, mean: float, n: int) -> list[float]:
    reach = sd or abs(mean) * 0.1 or 1.0
    return [reach * (2 * i / (n - 1) - 1) for i in range(n)] if n > 1 else [reach]


#: A point's variable, and the value that it moves or is set to.
Point = tuple[str, float]


#: Statistics by name: of a column, and of one whose values stand for several rows each.
_PLAIN = {"avg": F.avg, "sd": F.stddev_pop, "min": F.min, "max": F.max, "count": F.count}
_WEIGHTED = {
    "avg": lambda y, n: F.sum(y * n) / F.sum(F.when(y.isNotNull(), n)), "sd": lambda y, n: F.sum(y * n) / F.sum(F.when(y.isNotNull(), n)), "min": lambda y, n: F.min(y), "max": lambda y, n: F.max(y),
    "count": lambda y, n: F.coalesce(F.sum(F.when(y.isNotNull(), n)), F.lit(0)),
}


def _clean(x: Column) -> Column:
    return F.when(~F.isnan(x.cast("double")), x.cast("double"))


def _at_points(df: DataFrame, columns: Sequence[str], values: Sequence[float], y: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """_i and what ``y`` makes of each row and the i-th value; a row meets its points within a task."""
    moved = df.select(*[named(x) for x in columns], F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v")) for i, v in enumerate(values)])).alias("_at"))
    return moved.select(F.col("_at.i").alias("_i"), *[named(x) for x in columns if x == "_n"], *[_clean(e).alias(n) for n, e in y(F.col("_at.v")).items()])


def _weighted(cells: DataFrame, columns: Sequence[str], values: Sequence[float], y: Callable[[Column], dict[str, Column]], statistics: dict[str, tuple[str, str]], shares: dict[str, list[float]]) -> tuple[list[dict], dict[str, list[list]]]:
    """For each value the statistics and quantiles of rows that stand _n times each."""
    made, n = _at_points(cells, [*columns, "_n"], values, y), F.col("_n")
    plain = [_WEIGHTED[kind](F.col(of), n).alias(name) for name, (kind, of) in statistics.items()]
    rows = {r["_i"]: r.asDict() for r in made.groupBy("_i").agg(*plain, *[F.percentile(of, list(p), n).alias(f"_at_{of}") for of, p in shares.items()]).collect()}
    spread = {name: of for name, (kind, of) in statistics.items() if kind == "sd"}
    if spread:
        # Around the mean, which takes a pass of its own but loses no digits.
        off = {name: F.col(of) - F.element_at(F.array(*[F.lit(rows[i][name]).cast("double") for i in range(len(values))]), F.col("_i") + 1) for name, of in spread.items()}
        for r in made.groupBy("_i").agg(*[F.sqrt(_WEIGHTED["avg"](x * x, n)).alias(name) for name, x in off.items()]).collect():
            rows[r["_i"]] |= {name: r[name] for name in spread}
    return [rows[i] for i in range(len(values))], {of: [rows[i][f"_at_{of}"] or [None] * len(p) for i in range(len(values))] for of, p in shares.items()}


def _summaries(df: DataFrame, columns: Callable[[str], Sequence[str]], points: dict[str, list[float]], y: Callable[[str, Column], dict[str, Column]], statistics: dict[str, tuple[str, str]], shares: dict[str, list[float]]) -> tuple[dict[Point, dict], dict[str, dict[Point, list]]]:
    """For each variable and point: ``statistics`` of the expressions that ``y`` makes of them, and exact quantiles.

    ``columns`` names what the expressions of a variable are made of. Rows that are equal in them are counted, and met
    with the points once; where up to FEW are different, nothing more than the count reads the table. Of more, partial
    aggregates of all rows, one for each point, are shuffled, and quantiles are taken of an expression for each point.
    Only results come to the driver. NaN counts as null.
    """
    found: dict[Point, dict] = {}
    at: dict[str, dict[Point, list]] = {n: {} for n in shares}
    for c, values in points.items():
        if not values:
            continue
        made = lambda v, c=c: y(c, v)
        cells = saved(df.groupBy(*map(named, columns(c))).agg(F.count(F.lit(1)).alias("_n")))
        different = cells.count()
        if different <= FEW:
            step = max(1, FEW // max(1, different))
            parts = [values[start : start + step] for start in range(0, len(values), step)]
            with ThreadPoolExecutor(JOBS) as pool:
                done = list(pool.map(lambda some: _weighted(cells, columns(c), some, made, statistics, shares), parts))
            for some, (rows, ranks) in zip(parts, done):
                found |= {(c, v): r for v, r in zip(some, rows)}
                for n in shares:
                    at[n] |= {(c, v): r for v, r in zip(some, ranks[n])}
            continue
        rows = _at_points(df, columns(c), values, made).groupBy("_i").agg(*[_PLAIN[kind](of).alias(n) for n, (kind, of) in statistics.items()]).collect()  # one for each point
        found |= {(c, values[r["_i"]]): r.asDict() for r in rows}
        for n, p in shares.items():
            read = quantiles(df, {str(i): _clean(made(F.lit(v))[n]) for i, v in enumerate(values)}, p)
            at[n] |= {(c, v): read[str(i)] for i, v in enumerate(values)}
    return found, at


def function_influence(df: DataFrame, function: Callable[[dict[str, Column]], Column], x_columns: Sequence[str], num_deltas: int = 200) -> DataFrame:
    """What a Column function of x columns makes of moving each of them by up to one sample deviation.

    For each (variable, delta): mean, median, q1, q3, min, max and count of y, original_mean, and mean and median of
    dy and of dy/delta. The function takes its columns' values alone: equal rows are computed once. Only aggregates are shuffled or come to the driver. NaN counts as null; a constant column moves
    by a tenth of its mean; an empty table gives no rows.
    """
    if num_deltas < 1:
        raise AmbiguousArgumentError("at least one delta")
    here = {x: named(x) for x in x_columns}
    before = function(here)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.avg(before).alias("y"), *[f(named(c)).alias(f"{n}_{c}") for c in x_columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    points = {c: [d for d in _deltas(row[f"s_{c}"] or 0.0, row[f"m_{c}"] or 0.0, num_deltas) if d] if row["n"] else [] for c in x_columns}

    def moved(c: str, d: Column) -> dict[str, Column]:
        after = function({**here, c: here[c] + d})
        return {"y": after, "dy": after - before}

    statistics = {"mean": ("avg", "y"), "min": ("min", "y"), "max": ("max", "y"), "count": ("count", "y"), "mean_dy": ("avg", "dy")}
    found, at = _summaries(df, lambda c: x_columns, points, moved, statistics, {"y": [0.25, 0.5, 0.75], "dy": [0.5]})
    rows = []
    for (c, d), s in found.items():
        (q1, median, q3), (median_dy,) = at["y"][c, d], at["dy"][c, d]
        ratios = [None if v is None else v / d for v in (s["mean_dy"], median_dy)]
        rows.append((c, d, s["mean"], median, q1, q3, s["min"], s["max"], s["count"], row["y"], s["mean_dy"], median_dy, *ratios))
    schema = "variable string, delta double, mean double, median double, q1 double, q3 double, min double, max double, count bigint, original_mean double, mean_dy double, median_dy double, mean_ratio double, median_ratio double"
    return df.sparkSession.createDataFrame(rows, schema)


def influence_simulation(df: DataFrame, function: Callable[[dict[str, Column]], Column], columns: Sequence[str], num_points: int = 200, few: int = 10) -> DataFrame:
    """Columns of more than ``few`` values are set to points within two population deviations of their mean,
    others to each of their values: y mean, sd, q1, median, q3 for each (variable, value). The function takes its
    columns' values alone: equal rows are computed once. NaN counts as null."""
    if not columns:
        raise MissingArgumentError("no columns")
    row = df.agg(*[f(named(c)).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    here, points = {x: named(x) for x in columns}, {}
    for c in columns:
        # One value more than ``few`` is all it takes to tell.
        values = df.select(named(c)).where(named(c).isNotNull()).distinct().limit(few + 1).collect()
        if len(values) > few:
            m, s = row[f"m_{c}"], row[f"s_{c}"]
            points[c] = [m + s * (4 * i / max(num_points - 1, 1) - 2) for i in range(num_points)]
        else:
            points[c] = sorted(float(r[0]) for r in values)
    others = lambda c: [x for x in columns if x != c]
    found, at = _summaries(df, others, points, lambda c, v: {"y": function({**here, c: v})}, {"mean": ("avg", "y"), "sd": ("sd", "y")}, {"y": [0.25, 0.5, 0.75]})
    rows = [(c, v, s["mean"], s["sd"], *at["y"][c, v]) for (c, v), s in found.items()]
    return df.sparkSession.createDataFrame(rows, "variable string, value double, mean double, sd double, q1 double, median double, q3 double")
