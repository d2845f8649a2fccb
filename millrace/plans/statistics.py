"""Queries of entropy, metrics, coverage, imputation and features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import features, imputation, search
from ..operators import statistics as s
from .registry import Tables, query
from .wrangling import HOLED


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _h(columns: str, table: str = "lineitem") -> str:
    return f"(SELECT -sum(n / t * log2(n / t)) AS h FROM (SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER ()::DOUBLE AS t FROM {table} GROUP BY {columns}))"


@query(f"SELECT round(h, 6) AS entropy FROM {_h('l_returnflag')}")
def entropy_returnflag(t: Tables) -> DataFrame:
    return rounded(s.entropy(t.lineitem, "l_returnflag"))


@query(f"SELECT round(h, 6) AS entropy FROM {_h('l_returnflag, l_linestatus')}")
def joint_entropy(t: Tables) -> DataFrame:
    return rounded(s.joint_entropy(t.lineitem, "l_returnflag", "l_linestatus"))


@query(f"SELECT round((SELECT h FROM {_h('l_returnflag, l_shipmonth', '(SELECT *, month(l_shipdate) AS l_shipmonth FROM lineitem)')}) - (SELECT h FROM {_h('month(l_shipdate)')}), 6) AS entropy")
def conditional_entropy(t: Tables) -> DataFrame:
    return rounded(s.conditional_entropy(t.lineitem.select("l_returnflag", F.month("l_shipdate").alias("m")), "l_returnflag", "m"))


@query(f"SELECT round((SELECT h FROM {_h('l_returnflag')}) + (SELECT h FROM {_h('l_discount')}) - (SELECT h FROM {_h('l_returnflag, l_discount')}), 6) AS gain")
def information_gain(t: Tables) -> DataFrame:
    return rounded(s.information_gain(t.lineitem, "l_returnflag", "l_discount"))


@query("SELECT p_brand AS value, count(*) AS count FROM part GROUP BY p_brand ORDER BY count DESC, value LIMIT 5")
def counter_top_brands(t: Tables) -> DataFrame:
    return arrays.counter(t.part, "p_brand", 5)


@query("""SELECT l_returnflag, round(avg(abs(a - p)) / (max(a) - min(a)), 6) AS nmae, round(sqrt(avg((a - p) * (a - p))), 6) AS rmse, round(avg(abs(a - p)), 6) AS mae,
round(100 * avg(abs(a - p) / abs((a + p) / 2)), 6) AS mape, round(100 * avg(abs(a - p) / ((abs(a) + abs(p)) / 2)), 6) AS smape
FROM (SELECT l_returnflag, l_extendedprice AS a, l_quantity * 1000 AS p FROM lineitem) GROUP BY l_returnflag""")
def regression_metrics(t: Tables) -> DataFrame:
    df = t.lineitem.select("l_returnflag", F.col("l_extendedprice").alias("a"), (F.col("l_quantity") * 1000).alias("p"))
    return rounded(s.regression_metrics(df, "a", "p", ["l_returnflag"]))


@query("""WITH c AS (SELECT count(*) FILTER (WHERE a = 0 AND p = 0)::DOUBLE AS tn, count(*) FILTER (WHERE a = 0 AND p = 1)::DOUBLE AS fp, count(*) FILTER (WHERE a = 1 AND p = 0)::DOUBLE AS fn, count(*) FILTER (WHERE a = 1 AND p = 1)::DOUBLE AS tp
FROM (SELECT CAST(o_totalprice > 100000 AS INTEGER) AS a, CAST(c_acctbal > 2000 AS INTEGER) AS p FROM orders JOIN customer ON o_custkey = c_custkey))
SELECT tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity,
round(tn / (tn + fn), 6) AS negative_predictive_value, round(fn / (fn + tp), 6) AS miss_rate, round(fp / (fp + tn), 6) AS fall_out, round(fp / (fp + tp), 6) AS false_discovery_rate, round(fn / (fn + tn), 6) AS false_omission_rate,
round(tp / (tp + fn + fp), 6) AS threat_score, round(2 * tp / (2 * tp + fp + fn), 6) AS f1_score, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS matthews_correlation_coefficient,
round(tp / (tp + fn) + tn / (tn + fp) - 1, 6) AS informedness, round(tp / (tp + fp) + tn / (tn + fn) - 1, 6) AS markedness FROM c""")
def classification_metrics(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    df = joined.select((F.col("o_totalprice") > 100000).cast("int").alias("a"), (F.col("c_acctbal") > 2000).cast("int").alias("p"))
    return rounded(s.classification_metrics(df, "a", "p", 0, 1))


COVER = f"SELECT event_id, {HOLED} AS value, CASE WHEN event_id % 14 = 1 THEN NULL ELSE user_id END AS user_id, CASE WHEN event_id % 21 = 0 THEN NULL ELSE event_type END AS event_type FROM events"


@query(f"""WITH e AS ({COVER}), n AS (SELECT count(*)::DOUBLE AS n FROM e)
SELECT columns, n_columns, k AS row_coverage, round(k / n, 6) AS row_ratio, round(n_columns / 3.0::DOUBLE, 6) AS column_ratio, round((k / n) * (k / n) * (n_columns / 3.0::DOUBLE), 6) AS score FROM n, (
SELECT 'event_id' AS columns, 1 AS n_columns, count(*) AS k FROM e UNION ALL SELECT 'user_id', 1, count(user_id) FROM e UNION ALL SELECT 'event_id,user_id', 2, count(user_id) FROM e)""")
def null_coverage_subsets(t: Tables) -> DataFrame:
    t.events.createOrReplaceTempView("_coverage_events")
    df = t.spark.sql(COVER.replace("FROM events", "FROM _coverage_events"))
    return rounded(s.coverage_subsets(df, "value"))


@query("SELECT o_orderstatus, CAST(min(d) + CAST(round_even(avg(d - DATE '1970-01-01') - min(d - DATE '1970-01-01'), 0) AS INTEGER) AS DATE) AS date_mean FROM (SELECT o_orderstatus, CAST(o_orderdate AS DATE) AS d FROM orders) GROUP BY o_orderstatus")
def date_mean(t: Tables) -> DataFrame:
    return s.date_mean(t.orders, "o_orderdate", ["o_orderstatus"])


@query("SELECT round(avg(p_size), 6) AS p_size_mean, round(stddev_pop(p_size), 6) AS p_size_sd, count(DISTINCT p_size) AS p_size_uniques, round(avg(p_retailprice), 6) AS p_retailprice_mean, round(stddev_pop(p_retailprice), 6) AS p_retailprice_sd, count(DISTINCT p_retailprice) AS p_retailprice_uniques FROM part")
def column_statistics(t: Tables) -> DataFrame:
    return rounded(s.column_statistics(t.part, ["p_size", "p_retailprice"]))


@query("SELECT event_type, round(avg(value), 6) AS value_mean, round(median(value), 6) AS value_median, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max, round(stddev_samp(value), 6) AS value_std FROM events GROUP BY event_type")
def fold_aggregates(t: Tables) -> DataFrame:
    return rounded(s.aggregate_folds(t.events, ["event_type"], ["value"]))


@query("SELECT event_type, count(*) AS count, round(sum(value) * 1.0, 3) AS total_seconds FROM (SELECT event_type, datediff('microsecond', ts, ts + to_seconds(CAST(user_id AS INTEGER))) / 1e6 AS value FROM events) GROUP BY event_type")
def performance_summary(t: Tables) -> DataFrame:
    df = t.events.select("event_type", F.col("ts").alias("a"), F.expr("ts + make_dt_interval(0, 0, 0, user_id)").alias("b"))
    return s.performance_summary(df, "event_type", "a", "b").select("event_type", "count", F.round("total_seconds", 3).alias("total_seconds"))


SCORES = "SELECT event_type AS estimator, 'd' || (user_id % 5) AS data, avg(value) AS score FROM events WHERE NOT (event_type = 'click' AND user_id % 5 = 2) GROUP BY ALL"


def _scores(t: Tables) -> DataFrame:
    rows = t.events.where("not (event_type = 'click' and user_id % 5 = 2)")
    return rows.groupBy(F.col("event_type").alias("estimator"), F.concat(F.lit("d"), (F.col("user_id") % 5).cast("string")).alias("data")).agg(F.avg("value").alias("score"))


@query(f"SELECT estimator, count(score) AS count, round(avg(score), 6) AS mean, round(min(score), 6) AS min, round(max(score), 6) AS max, round(stddev_samp(score), 6) AS std FROM ({SCORES}) GROUP BY estimator")
def scoreboard_summary(t: Tables) -> DataFrame:
    return rounded(search.measured(_scores(t)))


@query(f"""WITH s AS ({SCORES}) SELECT e.estimator, round(avg(coalesce(score, 0)), 6) AS best_possible, count(score) AS count_measured
FROM (SELECT DISTINCT estimator FROM s) e CROSS JOIN (SELECT DISTINCT data FROM s) d LEFT JOIN s ON s.estimator = e.estimator AND s.data = d.data GROUP BY e.estimator""")
def scoreboard_upper_bound(t: Tables) -> DataFrame:
    return rounded(search.upper_bounds(_scores(t), 0.0))


@query(f"SELECT data, round(avg(score), 6) AS mean FROM ({SCORES}) GROUP BY data")
def scoreboard_mean_per_data(t: Tables) -> DataFrame:
    return rounded(search.mean_per(_scores(t), "data"))


@query("""WITH s AS (SELECT event_type AS estimator, 'd' || (user_id % 5) AS data, CASE WHEN user_id % 5 < 3 THEN avg(value) END AS score FROM events GROUP BY event_type, user_id % 5),
b AS (SELECT estimator, avg(coalesce(score, 0)) AS best FROM s GROUP BY estimator), d AS (SELECT data, avg(score) AS m FROM s GROUP BY data)
SELECT s.estimator, s.data, CAST(row_number() OVER (PARTITION BY s.estimator ORDER BY m DESC NULLS FIRST, md5(concat_ws('-', 42, s.estimator, s.data))) - 1 AS INTEGER) AS turn, round(best, 6) AS best_possible
FROM s JOIN b USING (estimator) JOIN d USING (data) WHERE score IS NULL""")
def task_order(t: Tables) -> DataFrame:
    k = F.col("user_id") % 5
    full = t.events.groupBy(F.col("event_type").alias("estimator"), k.alias("k")).agg(F.avg("value").alias("v"))
    scores = full.select("estimator", F.concat(F.lit("d"), F.col("k").cast("string")).alias("data"), F.when(F.col("k") < 3, F.col("v")).alias("score"))
    return rounded(search.task_order(scores, 0.0).select("estimator", "data", "turn", "best_possible"))


PRICE = "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_extendedprice END"
LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _regression_sql(by: str) -> str:
    group = f"PARTITION BY {by}" if by else ""
    return f"""WITH h AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_quantity, {PRICE} AS price FROM lineitem),
r AS (SELECT *, regr_slope(price, l_quantity) OVER ({group}) AS a, regr_intercept(price, l_quantity) OVER ({group}) AS b, min(price) OVER ({group}) AS lo, max(price) OVER ({group}) AS hi FROM h)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(coalesce(price, least(greatest(b + a * l_quantity, lo), hi)), 3) AS price FROM r"""


def _holed_lines(t: Tables) -> DataFrame:
    return t.lineitem.select(*LINE_KEY, "l_returnflag", "l_quantity", F.expr(PRICE).alias("price"))


@query(_regression_sql(""))
def regression_imputation(t: Tables) -> DataFrame:
    return rounded(imputation.impute_with_regression(_holed_lines(t), "l_quantity", ["price"]).select(*LINE_KEY, "price"), 3)


@query(_regression_sql("l_returnflag"))
def regression_imputation_grouped(t: Tables) -> DataFrame:
    return rounded(imputation.impute_with_regression(_holed_lines(t), "l_quantity", ["price"], ["l_returnflag"]).select(*LINE_KEY, "price"), 3)


def _fill_sql(statistic: str) -> str:
    return f"SELECT event_id, round(coalesce({HOLED}, (SELECT {statistic}({HOLED}) FROM events)), 6) AS value, CAST({HOLED} IS NULL AS INTEGER) AS value_is_null FROM events"


@query(_fill_sql("median"))
def fill_median_flag(t: Tables) -> DataFrame:
    return rounded(imputation.fill_na_and_flag(t.events.select("event_id", F.expr(HOLED).alias("value"))))


@query(_fill_sql("avg"))
def fill_mean_flag(t: Tables) -> DataFrame:
    return rounded(imputation.fill_na_and_flag(t.events.select("event_id", F.expr(HOLED).alias("value")), "mean"))


@query(f"SELECT event_id, event_type, round(coalesce({HOLED}, avg({HOLED}) OVER (PARTITION BY event_type)), 6) AS value FROM events")
def fill_each_split(t: Tables) -> DataFrame:
    return rounded(imputation.fill_each_split(t.events.select("event_id", "event_type", F.expr(HOLED).alias("value")), ["value"], "event_type"))


NORMAL = ["p_size", "p_retailprice"]


@query("SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS p_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS p_retailprice, 0.0::DOUBLE AS one FROM part")
def normalize(t: Tables) -> DataFrame:
    df = t.part.select("p_partkey", *NORMAL, F.lit(1.0).alias("one"))
    return rounded(features.Normalizer(ignore=("p_partkey",)).fit_transform(df))


@query("SELECT 'p_size' AS column, round(avg(p_size), 6) AS mean, round(stddev_samp(p_size), 6) AS sd FROM part UNION ALL SELECT 'p_retailprice', round(avg(p_retailprice), 6), round(stddev_samp(p_retailprice), 6) FROM part")
def normalize_parameters(t: Tables) -> DataFrame:
    return rounded(features.Normalizer().fit(t.part, NORMAL).parameters(t.part))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part")
def untransform(t: Tables) -> DataFrame:
    n = features.Normalizer().fit(t.part, NORMAL)
    return rounded(n.untransform(n.transform(t.part.select("p_partkey", *NORMAL))))


@query("""WITH c AS (SELECT lower(p_type) AS v, count(*) AS n FROM part GROUP BY 1), top AS (SELECT v FROM c ORDER BY n DESC, v LIMIT 3)
SELECT p_partkey, 'p_type_' || v AS name, CAST(lower(p_type) = v AS INTEGER) AS hit FROM part, top
UNION ALL SELECT p_partkey, 'p_type_other', CAST(lower(p_type) NOT IN (SELECT v FROM top) AS INTEGER) FROM part""")
def one_hot_top_n(t: Tables) -> DataFrame:
    done = features.OneHotEncoder(top=3).fit_transform(t.part.select("p_partkey", "p_type"))
    cells = [F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("hit")) for c in done.columns if c != "p_partkey"]
    return done.select("p_partkey", F.explode(F.array(*cells)).alias("x")).select("p_partkey", "x.*")


@query("SELECT p_partkey, p_mfgr, CAST(coalesce(p_mfgr = 'a', false) AS INTEGER) AS letter_a, CAST(coalesce(p_mfgr = 'b', false) AS INTEGER) AS letter_b, CAST(p_mfgr = 'c' OR p_mfgr IS NULL AS INTEGER) AS letter_other FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 < 5 THEN 'a' WHEN p_partkey % 10 < 8 THEN 'b' WHEN p_partkey % 10 = 8 THEN 'c' END AS p_mfgr FROM part)")
def one_hot_with_nulls(t: Tables) -> DataFrame:
    letter = F.expr("case when p_partkey % 10 < 5 then 'a' when p_partkey % 10 < 8 then 'b' when p_partkey % 10 = 8 then 'c' end")
    df = t.part.select("p_partkey", letter.alias("p_mfgr"), F.upper(letter).alias("letter"))
    return features.OneHotEncoder(top=2, exclude=("p_mfgr",)).fit_transform(df)


@query("""SELECT p_partkey, p_size, p_retailprice, round(p_retailprice * p_retailprice, 4) AS p_retailprice2, round(p_retailprice * p_size, 4) AS "p_retailprice.p_size", p_size::DOUBLE * p_size AS p_size2 FROM part""")
def polynomial_degree_2(t: Tables) -> DataFrame:
    out = features.Polynomial().transform(t.part.select("p_partkey", *NORMAL), NORMAL)
    return out.select("p_partkey", *NORMAL, F.round("p_retailprice2", 4).alias("p_retailprice2"), F.round("`p_retailprice.p_size`", 4).alias("p_retailprice.p_size"), "p_size2")


@query("SELECT event_id, value = 0 AS value_is_zero, value > 0 AS value_is_positive, round_even(value, 0) AS value_rounded, value = round_even(value, 0) AS value_is_int FROM events")
def error_features(t: Tables) -> DataFrame:
    return features.error_features(t.events.select("event_id", "value"), ["value"]).drop("value")
