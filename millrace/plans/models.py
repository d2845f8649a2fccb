"""Queries of clustering, ensembles, influence and model search."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import imputation, models, sampling, search
from .registry import Tables, query
from .statistics import rounded


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round((l_quantity + 2 * l_tax * 100 + l_discount * 100) / 4, 6) AS mean FROM lineitem")
def ensemble_mean(t: Tables) -> DataFrame:
    p = [F.col("l_quantity"), F.col("l_tax") * 100, F.col("l_discount") * 100]
    return t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(models.ensemble_mean(p, [1, 2, 1]), 6).alias("mean"))


@query("""WITH v AS (SELECT p_partkey, 'k' || (p_size % 3) AS a, 'k' || (p_partkey % 3) AS b, 'k' || (length(p_name) % 3) AS c FROM part),
w AS (SELECT p_partkey, unnest([{'i': 0, 'v': a, 'w': 1.0}, {'i': 1, 'v': b, 'w': 0.75}, {'i': 2, 'v': c, 'w': 0.5}]) AS x FROM v),
s AS (SELECT p_partkey, x.v AS vote, sum(x.w) AS weight, min(x.i) AS first FROM w GROUP BY ALL)
SELECT p_partkey, vote FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY weight DESC, first) AS r FROM s) WHERE r = 1""")
def ensemble_vote(t: Tables) -> DataFrame:
    votes = [F.concat(F.lit("k"), (x % 3).cast("string")) for x in (F.col("p_size"), F.col("p_partkey"), F.length("p_name"))]
    return t.part.select("p_partkey", models.ensemble_vote(votes, [1.0, 0.75, 0.5]).alias("vote"))


@query("""WITH s AS (SELECT stddev_samp(p_size) AS a, stddev_samp(p_retailprice) AS b FROM part),
d AS (SELECT unnest([-1.0, -1.0/3, 1.0/3, 1.0])::DOUBLE AS f),
m AS (SELECT 'p_size' AS variable, f * a AS delta, p_size AS x, p_retailprice AS z, 2 * (p_size + f * a) + p_retailprice AS y FROM part, s, d
UNION ALL SELECT 'p_retailprice', f * b, p_size, p_retailprice, 2 * p_size + p_retailprice + f * b FROM part, s, d)
SELECT variable, round(delta, 6) AS delta, round(avg(y), 4) AS mean, round(median(y), 4) AS median, round(quantile_cont(y, 0.25), 4) AS q1, round(quantile_cont(y, 0.75), 4) AS q3, round(min(y), 4) AS min, round(max(y), 4) AS max, count(*) AS count,
round(avg(2 * x + z), 4) AS original_mean, round(avg(y - 2 * x - z), 4) AS mean_dy, round(median(y - 2 * x - z), 4) AS median_dy, round(avg(y - 2 * x - z) / delta, 4) AS mean_ratio, round(median(y - 2 * x - z) / delta, 4) AS median_ratio FROM m GROUP BY variable, delta""")
def influence_linear(t: Tables) -> DataFrame:
    out = models.function_influence(t.part, lambda x: 2 * x["p_size"] + x["p_retailprice"], ["p_size", "p_retailprice"], 4)
    return rounded(out.withColumn("delta", F.round("delta", 6)).select("variable", "delta", *[F.round(c, 4).alias(c) for c in out.columns[2:]]))


@query("""WITH p AS (SELECT p_retailprice, p_size % 4 AS k FROM part)
SELECT 'k' AS variable, v::DOUBLE AS value, round(avg(y), 4) AS mean, round(stddev_pop(y), 4) AS sd, round(quantile_cont(y, 0.25), 4) AS q1, round(median(y), 4) AS median, round(quantile_cont(y, 0.75), 4) AS q3
FROM (SELECT v, p_retailprice * v AS y FROM p, (SELECT DISTINCT k AS v FROM p)) GROUP BY v
UNION ALL SELECT 'p_retailprice', round(v, 4), round(avg(y), 4), round(stddev_pop(y), 4), round(quantile_cont(y, 0.25), 4), round(median(y), 4), round(quantile_cont(y, 0.75), 4)
FROM (SELECT i, v, v * k AS y FROM p, (SELECT i, m + s * (4 * i / 199.0::DOUBLE - 2) AS v FROM (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM p), (SELECT unnest(range(200)) AS i))) GROUP BY i, v""")
def influence_simulation(t: Tables) -> DataFrame:
    df = t.part.select("p_retailprice", (F.col("p_size") % 4).alias("k"))
    return rounded(models.influence_simulation(df, lambda x: x["p_retailprice"] * x["k"], ["p_retailprice", "k"]), 4)


@query()
def kmeans_predict(t: Tables) -> DataFrame:
    return models.KMeans(4, ["p_size", "p_retailprice"]).fit(t.part).predict(t.part).select("p_partkey", "cluster")


@query()
def elbow_table(t: Tables) -> DataFrame:
    return models.Elbow(["p_size", "p_retailprice"], 2, 5).fit(t.part).data(t.part)


@query("""WITH c AS (SELECT [10.0, 1000.0] AS a, [40.0, 1500.0] AS b), d AS (SELECT p_partkey, sqrt((p_size - a[1]) ** 2 + (p_retailprice - a[2]) ** 2)::DOUBLE AS x, sqrt((p_size - b[1]) ** 2 + (p_retailprice - b[2]) ** 2)::DOUBLE AS y FROM part, c)
SELECT p_partkey, round(x, 6) AS distance_1, round(y, 6) AS distance_2, CASE WHEN x <= y THEN 'cluster_1' ELSE 'cluster_2' END AS cluster FROM d""")
def nearest_center(t: Tables) -> DataFrame:
    model = models.KMeans(2, ["p_size", "p_retailprice"], centers=[[10.0, 1000.0], [40.0, 1500.0]])
    return rounded(model.predict(t.part.select("p_partkey", "p_size", "p_retailprice")).select("p_partkey", "distance_1", "distance_2", "cluster"))


@query("""WITH c AS (SELECT [10.0, 1000.0] AS a, [40.0, 1500.0] AS b)
SELECT round(avg(least(sqrt((p_size - a[1]) ** 2 + (p_retailprice - a[2]) ** 2), sqrt((p_size - b[1]) ** 2 + (p_retailprice - b[2]) ** 2)))::DOUBLE, 6) AS distortion FROM part, c""")
def distortion(t: Tables) -> DataFrame:
    model = models.KMeans(2, ["p_size", "p_retailprice"], centers=[[10.0, 1000.0], [40.0, 1500.0]])
    return model.transform(t.part).agg(F.round(F.avg(F.least("distance_1", "distance_2")), 6).alias("distortion"))


@query("SELECT round(regr_slope(p_retailprice, p_size), 4) AS p_size, round(regr_intercept(p_retailprice, p_size), 4) AS intercept FROM part")
def linear_coefficients(t: Tables) -> DataFrame:
    model = LinearRegression(labelCol="p_retailprice", solver="normal").fit(models.assembled(t.part, ["p_size"]))
    found = models.coefficients(model, ["p_size"])
    return t.spark.createDataFrame([(round(found["p_size"], 4), round(found["intercept"], 4))], "p_size double, intercept double")


@query("""WITH h AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_retailprice END AS price FROM part),
l AS (SELECT regr_slope(price, p_size) AS a, regr_intercept(price, p_size) AS b FROM h) SELECT p_partkey, round(coalesce(price, a * p_size + b), 3) AS price FROM h, l""")
def column_imputer(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", "p_size", F.expr("case when p_partkey % 6 = 0 then null else p_retailprice end").alias("price"))
    done = imputation.ColumnImputer("price", ["p_size"], [LinearRegression(solver="normal")]).fit(df).transform(df)
    return rounded(done.select("p_partkey", "price"), 3)


@query()
def data_imputer(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", F.expr("case when p_partkey % 9 = 0 then null else cast(p_size as double) end").alias("size"), F.expr("case when p_partkey % 6 = 1 then null else p_retailprice end").alias("price"))
    return imputation.DataImputer(ignore=()).fit(df).transform(df)


@query()
def cv_linear_regression(t: Tables) -> DataFrame:
    repository = search.EstimatorRepository()
    repository.append(LinearRegression, {"regParam": [0.0, 0.1], "solver": "normal"})
    run = search.CrossValidationSearch(t.part.select("p_partkey", "p_size", "p_retailprice"), ["p_size"], "p_retailprice", repository, sampling.Validation(3, key="p_partkey")).run()
    rows = [(r["estimator"], r["data"], r["training_size"], r["test_size"], r["rmse"], r["smape"]) for r in run.results]
    return t.spark.createDataFrame(rows, "estimator string, data string, training_size bigint, test_size bigint, rmse double, smape double")
