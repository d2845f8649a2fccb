"""Queries of projections, cleaning, joins, reshaping, sampling and splitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import joins, sampling
from ..operators import wrangling as w
from ..rows import seeded_order, with_row_id
from ..sources import synthetic
from .registry import Tables, query


@query("""SELECT c_mktsegment, o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS r
FROM orders JOIN customer ON o_custkey = c_custkey) WHERE r = 1""")
def select_max_order_per_segment(t: Tables) -> DataFrame:
    priced = t.orders.select("o_orderkey", "o_custkey", "o_totalprice").join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return w.select_max(priced, "o_totalprice", ["c_mktsegment"], ["o_orderkey"]).select("c_mktsegment", "o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT p_brand, p_partkey, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS r FROM part) WHERE r = 1")
def select_min_part_per_brand(t: Tables) -> DataFrame:
    return w.select_min(t.part.select("p_brand", "p_partkey", "p_retailprice"), "p_retailprice", ["p_brand"], ["p_partkey"])


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 1")
def select_max_overall(t: Tables) -> DataFrame:
    return w.select_max(t.events.select("event_id", "value"), "value", tie=["event_id"])


@query("SELECT n_nationkey, n_regionkey FROM nation")
def select_columns_exclude(t: Tables) -> DataFrame:
    return w.select_columns(t.nation, exclude=["n_name"])


@query("SELECT n_regionkey, n_nationkey, n_name FROM nation")
def bring_to_front(t: Tables) -> DataFrame:
    return w.bring_to_front(t.nation, "n_regionkey")


@query("SELECT n_name, n_regionkey, n_nationkey FROM nation")
def send_to_back(t: Tables) -> DataFrame:
    return w.send_to_back(t.nation, ["n_nationkey"])


@query("SELECT n_nationkey AS nation_key, n_name AS my_html_name, n_regionkey AS region_and_key FROM nation")
def standardize_columns(t: Tables) -> DataFrame:
    return w.standardize_columns(t.nation.toDF("NationKey", "MyHTMLName", "region & Key"))


@query("""SELECT r_regionkey AS "0", r_name AS "1" FROM region""")
def reset_column_index(t: Tables) -> DataFrame:
    return w.reset_column_index(t.region)


HOLED = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END"


@query(f"SELECT event_id, coalesce({HOLED}, 0.0) AS value, {HOLED} IS NULL AS value_na FROM events")
def fill_na_flag(t: Tables) -> DataFrame:
    return w.fill_na(t.events.select("event_id", F.expr(HOLED).alias("value")), 0.0)


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'URGENT' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def set_value_where(t: Tables) -> DataFrame:
    return w.set_value_where(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "URGENT", F.col("o_orderpriority") == "1-URGENT")


@query("SELECT p_partkey, try_cast(CASE WHEN regexp_matches(regexp_replace(p_brand, '[^0-9.]', '', 'g'), '^[0-9]+$') THEN regexp_replace(p_brand, '[^0-9.]', '', 'g') END AS BIGINT) AS digits, CAST(NULL AS BIGINT) AS name FROM part")
def as_int(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", w.as_int(F.regexp_replace("p_brand", "[^0-9.]", "")).alias("digits"), w.as_int(F.col("p_name")).alias("name"))


@query("SELECT p_partkey, try_cast(p_size || '.5' AS DOUBLE) AS size, try_cast(p_name AS DOUBLE) AS name FROM part")
def as_numeric(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", w.as_numeric(F.concat(F.col("p_size").cast("string"), F.lit(".5"))).alias("size"), w.as_numeric(F.col("p_name")).alias("name"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS size FROM part")
def as_string(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", w.as_string(F.col("p_size")).alias("size"))


ROWWISE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity END AS a, CASE WHEN l_partkey % 3 <> 0 THEN l_tax * 100 END AS b, l_discount * 100 AS c"


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(least(a, b, c), 6) AS low, round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b, c) END, 6) AS strict_low FROM (SELECT {ROWWISE} FROM lineitem)")
def row_min(t: Tables) -> DataFrame:
    df = t.lineitem.selectExpr(*ROWWISE.split(", "))
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(w.row_min(df, ["a", "b", "c"]), 6).alias("low"), F.round(w.row_min(df, ["a", "b", "c"], False), 6).alias("strict_low"))


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(greatest(a, b, c), 6) AS high FROM (SELECT {ROWWISE} FROM lineitem)")
def row_max(t: Tables) -> DataFrame:
    df = t.lineitem.selectExpr(*ROWWISE.split(", "))
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(w.row_max(df, ["a", "b", "c"]), 6).alias("high"))


@query("SELECT min(value) AS min_value, max(value) AS max_value, min(user_id) AS min_user_id, max(user_id) AS max_user_id FROM events")
def column_extremes(t: Tables) -> DataFrame:
    return w.column_extremes(t.events, ["value", "user_id"])


def _bad_part(t: Tables) -> DataFrame:
    return t.part.selectExpr("p_partkey", "p_brand", "p_type", "p_brand AS brand_copy", "'x' AS constant", "CASE WHEN p_partkey % 10 = 0 THEN 1 END AS mostly_null")


@query("SELECT p_partkey, p_brand, p_type, p_brand AS brand_copy, CASE WHEN p_partkey % 10 = 0 THEN 1 END AS mostly_null FROM part")
def drop_single_value_columns(t: Tables) -> DataFrame:
    return w.drop_single_value_columns(_bad_part(t))


@query("SELECT p_partkey, p_brand, p_type, p_brand AS brand_copy, 'x' AS constant FROM part")
def drop_high_na(t: Tables) -> DataFrame:
    return w.drop_columns_with_too_many_nas(_bad_part(t), 0.8)


@query("SELECT p_partkey, p_brand, p_type, CASE WHEN p_partkey % 10 = 0 THEN 1 END AS mostly_null FROM part")
def drop_no_information(t: Tables) -> DataFrame:
    return w.drop_columns_with_no_additional_information(_bad_part(t))


@query("SELECT p_partkey, p_brand, p_type FROM part")
def drop_bad_columns(t: Tables) -> DataFrame:
    return w.drop_bad_columns(_bad_part(t), 0.8)


@query("""SELECT CASE WHEN ab = a AND ab = b THEN 'second' WHEN ab = b THEN 'first' WHEN ab = a THEN 'second' ELSE 'none' END AS useless
FROM (SELECT count(DISTINCT n_name) AS a, count(DISTINCT n_regionkey) AS b, count(DISTINCT (n_name, n_regionkey)) AS ab FROM nation)""")
def get_useless_column(t: Tables) -> DataFrame:
    x = w.get_useless_column(t.nation, "n_name", "n_regionkey")
    return t.spark.createDataFrame([({"n_name": "first", "n_regionkey": "second"}.get(x, "none"),)], "useless string")


@query(f"SELECT count(*) FILTER (WHERE {HOLED} IS NULL) AS with_missing, count(*) FILTER (WHERE {HOLED} IS NOT NULL) AS without_missing FROM events")
def count_rows_missing(t: Tables) -> DataFrame:
    return w.count_missing_rows(t.events.select("event_id", F.expr(HOLED).alias("value")))


@query("SELECT event_id, value FROM events SEMI JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') USING (user_id)")
def data_slice(t: Tables) -> DataFrame:
    buyers = t.events.where("event_type = 'purchase'").select("user_id").distinct()
    return w.DataSlice(t.events, ["event_id", "value"], buyers, "user_id").data


JOIN_SQL = """WITH l AS (SELECT c_custkey, c_nationkey + CASE WHEN c_mktsegment = 'BUILDING' THEN 100 ELSE 0 END AS k FROM customer), r AS (SELECT s_suppkey, s_nationkey + CASE WHEN s_acctbal < 0 THEN 200 ELSE 0 END AS k FROM supplier),
j AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY s_suppkey) AS a, row_number() OVER (PARTITION BY s_suppkey ORDER BY c_custkey) AS b FROM l JOIN r USING (k)),
both_ AS (SELECT k, c_custkey, s_suppkey FROM j WHERE a = 1 AND b = 1) """


def _suppliers(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.expr("s_nationkey + case when s_acctbal < 0 then 200 else 0 end").alias("k"))


def _wisely(t: Tables) -> dict[str, DataFrame]:
    # Some keys are changed to such as the other side does not have, so that both tables go in whole.
    left = t.customer.select("c_custkey", F.expr("c_nationkey + case when c_mktsegment = 'BUILDING' then 100 else 0 end").alias("k"))
    right = _suppliers(t)
    return joins.join_wisely(left, right, ["k"], "c_custkey", "s_suppkey")


@query(JOIN_SQL + "SELECT * FROM both_")
def join_wisely_both(t: Tables) -> DataFrame:
    return _wisely(t)["both"]


@query(JOIN_SQL + "SELECT c_custkey, k FROM l ANTI JOIN both_ USING (c_custkey)")
def join_wisely_left_only(t: Tables) -> DataFrame:
    return _wisely(t)["left_only"]


@query(JOIN_SQL + "SELECT s_suppkey, k FROM r ANTI JOIN both_ USING (s_suppkey)")
def join_wisely_right_only(t: Tables) -> DataFrame:
    return _wisely(t)["right_only"]


@query("""WITH j AS (SELECT c_nationkey AS k, c_custkey, s_suppkey FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey + CASE WHEN s_acctbal < 0 THEN 200 ELSE 0 END)
SELECT k, c_custkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY s_suppkey NULLS LAST) AS a, s_suppkey IS NULL OR row_number() OVER (PARTITION BY s_suppkey ORDER BY c_custkey) = 1 AS b FROM j) WHERE a = 1 AND b""")
def join_and_keep_order(t: Tables) -> DataFrame:
    left = t.customer.select("c_custkey", F.col("c_nationkey").alias("k"))
    return joins.join_and_keep_order(left, _suppliers(t), ["k"], "c_custkey", "s_suppkey", "left", "first")


@query("SELECT coalesce(o_custkey, c_custkey) AS o_custkey, coalesce(o_custkey, c_custkey) AS c_custkey, o_orderkey, c_name FROM (SELECT o_custkey + CASE WHEN o_orderstatus = 'O' THEN 1000000000 ELSE 0 END AS o_custkey, o_orderkey FROM orders) FULL JOIN (SELECT c_custkey, c_name FROM customer) ON o_custkey = c_custkey")
def fast_merge(t: Tables) -> DataFrame:
    left = t.orders.select(F.expr("o_custkey + case when o_orderstatus = 'O' then 1000000000 else 0 end").alias("o_custkey"), "o_orderkey")
    right = t.customer.select("c_custkey", "c_name")
    return joins.fast_merge(left, right, "o_custkey", "c_custkey", "full")


@query("SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, o_orderkey FROM orders) USING (c_custkey)")
def join_preserve_types(t: Tables) -> DataFrame:
    right = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.join_and_preserve_types(t.customer.select("c_custkey", "c_name"), right, ["c_custkey"])


@query("SELECT * FROM (SELECT DISTINCT r_name AS region FROM region) CROSS JOIN (SELECT DISTINCT p_type AS type FROM part)")
def cross_combinations(t: Tables) -> DataFrame:
    return synthetic.combinations(region=t.region.select("r_name"), type=t.part.select("p_type"))


@query("""SELECT 'closed' AS kind, unnest([1.0, 1.5, 2.0, 2.5, 3.0])::DOUBLE AS x UNION ALL SELECT 'open', unnest([1.5, 2.0, 2.5])::DOUBLE
UNION ALL SELECT 'falling', unnest([3.0, 2.0, 1.0])::DOUBLE UNION ALL SELECT 'count', unnest([0.0, 2.5, 5.0, 7.5, 10.0])::DOUBLE""")
def series_points(t: Tables) -> DataFrame:
    made = {"closed": arrays.series(1, 3, step=0.5), "open": arrays.series(1, 3, step=0.5, include_start=False, include_end=False), "falling": arrays.series(3, 1, step=1), "count": arrays.series(0, 10, count=5)}
    return t.spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("xs")) for k, v in made.items()])).alias("s")).select("s.kind", F.explode("s.xs").alias("x"))


@query("SELECT a, b, round(c, 9) AS c FROM (SELECT unnest([0.0, 5.0, 10.0])::DOUBLE AS a) CROSS JOIN (SELECT unnest([1.0, 3.0, 5.0])::DOUBLE AS b) CROSS JOIN (SELECT unnest([9.0, 10.0, 11.0])::DOUBLE AS c)")
def argument_grid(t: Tables) -> DataFrame:
    return synthetic.create_arguments(t.spark, 3, {"a": (0, 10), "b": (1, 5, 2), "c": 10}).withColumn("c", F.round("c", 9))


@query("SELECT a, b FROM (SELECT unnest([1, 2, 3])::INTEGER AS a) CROSS JOIN (SELECT unnest([10, 20])::INTEGER AS b)")
def create_grid(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(g["a"], g["b"]) for g in arrays.create_grid({"a": [1, 2, 3], "b": [10, 20]})], "a int, b int")


@query()
def create_data(t: Tables) -> DataFrame:
    return synthetic.create_data(t.spark, 1000, 5, 2.0)


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("SELECT o_orderstatus, " + ", ".join(f"max(n) FILTER (WHERE o_orderpriority = '{p}') AS n_{p.lower().replace('-', '_').replace(' ', '_')}" for p in PRIORITIES) + " FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_orderstatus")
def long_to_wide(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return w.long_to_wide(counts, ["o_orderstatus"], "o_orderpriority", ["n"], list(PRIORITIES))


@query("SELECT p_partkey, unnest(regexp_split_to_array(replace(p_name, ' ', ', '), '\\s*,\\s*')) AS word FROM part")
def split_rows(t: Tables) -> DataFrame:
    return w.split_rows(t.part.select("p_partkey", F.expr("replace(p_name, ' ', ', ')").alias("names")), "names", name="word")


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY ts, event_id) - 1 AS BIGINT) AS row_id FROM events")
def row_ids(t: Tables) -> DataFrame:
    return with_row_id(t.events.select("event_id", "ts"), [F.col("ts"), F.col("event_id")]).select("event_id", "row_id")


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY md5(concat('42-', event_id)), event_id) - 1 AS BIGINT) AS position FROM events")
def shuffle(t: Tables) -> DataFrame:
    return sampling.shuffle(t.events.select("event_id"), "event_id", name="position")


CHOSEN = "(SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5(concat('42-', user_id)), user_id LIMIT (SELECT round_even(count(DISTINCT user_id) * 0.3, 0)::BIGINT FROM events))"


@query(f"SELECT event_id, user_id, user_id IN {CHOSEN} AS training FROM events")
def split_by_id(t: Tables) -> DataFrame:
    train, test = sampling.split_by_id(t.events.select("event_id", "user_id"), "user_id", fraction=0.3)
    return train.withColumn("training", F.lit(True)).unionByName(test.withColumn("training", F.lit(False)))


@query("SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5(concat('42-', user_id)), user_id LIMIT 10)")
def sample_by_id(t: Tables) -> DataFrame:
    return sampling.sample_by_id(t.events.select("event_id", "user_id"), "user_id", n=10).select("event_id")


@query()
def sample_by_id_with_replacement(t: Tables) -> DataFrame:
    return sampling.sample_by_id(t.events.select("event_id", "user_id"), "user_id", n=20, replace=True)


@query("""WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place, count(*) OVER () AS total FROM events)
SELECT event_id, CAST((SELECT count(*) FROM range(1, 7) AS b(i) WHERE place >= round_even(i * (total / 7.0::DOUBLE), 0)) AS INTEGER) AS piece FROM n""")
def split_pieces(t: Tables) -> DataFrame:
    return sampling.split_pieces(t.events.select("event_id"), ["event_id"], num_splits=7)


@query("""SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat('42-', o_orderkey)), o_orderkey) AS r FROM orders) ORDER BY r, o_orderstatus NULLS FIRST LIMIT 200""")
def balance_sample(t: Tables) -> DataFrame:
    return sampling.balance_sample(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], "o_orderkey", n=200)


@query("""WITH c AS (SELECT o_orderstatus, count(*) AS n, max(count(*)) OVER () AS m FROM orders GROUP BY o_orderstatus),
e AS (SELECT o.o_orderkey, o.o_orderstatus, unnest(generate_series(1, ceil(m / n::DOUBLE)::BIGINT)) AS copy, m FROM orders o JOIN c USING (o_orderstatus))
SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY copy, o_orderkey) AS r FROM e) WHERE r <= m""")
def up_sample(t: Tables) -> DataFrame:
    return sampling.UpSampler().fit_upsample(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")


@query("""SELECT event_id, r <= round_even(n * 0.25, 0) AS training FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(concat('42-', event_id)), event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)""")
def sample_per_group(t: Tables) -> DataFrame:
    train, test = sampling.sample_per_group(t.events.select("event_id", "event_type"), ["event_type"], "event_id", ratio=0.25)
    return train.select("event_id", F.lit(True).alias("training")).unionByName(test.select("event_id", F.lit(False).alias("training")))


def _folds_sql(ids: str, table: str, order: str, bounds: list[str], first: int) -> str:
    """Ids by cumulative counts; ``bounds`` are SQL expressions of the total."""
    steps = " + ".join(f"(s > {b})::INTEGER" for b in bounds)
    return f"""WITH c AS (SELECT {ids}, count(*) AS n FROM {table} GROUP BY ALL), r AS (SELECT {ids}, n, sum(n) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS s, sum(n) OVER () AS total FROM c)
SELECT {ids}, CAST({first} + {steps} AS INTEGER) AS fold, n FROM r"""


def _even(k: int) -> list[str]:
    return [f"round_even(total * {i / k!r}::DOUBLE, 0)" for i in range(1, k)]


@query(_folds_sql("event_id", "events", "md5(concat('42-', event_id)), event_id", _even(5), 1))
def cv_folds(t: Tables) -> DataFrame:
    return sampling.Validation(5, key="event_id").split(t.events.select("event_id")).groupBy("event_id", "fold").agg(F.count("*").alias("n"))


@query(_folds_sql("o_custkey", "orders", "md5(concat('42-', o_custkey)), o_custkey", _even(4), 1))
def cv_grouped_folds(t: Tables) -> DataFrame:
    return sampling.Validation(4, id_columns=("o_custkey",)).split(t.orders.select("o_custkey", "o_orderkey")).groupBy("o_custkey", "fold").agg(F.count("*").alias("n"))


@query(_folds_sql("day", "(SELECT CAST(ts AS DATE) AS day FROM events)", "day", _even(4), 0))
def time_series_folds(t: Tables) -> DataFrame:
    days = t.events.select(F.col("ts").cast("date").alias("day"))
    return sampling.Validation(3, sort_columns=("day",)).split(days).groupBy("day", "fold").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN fold = 1 THEN 'test' ELSE 'training' END AS split FROM (" + _folds_sql("o_custkey", "orders", "md5(concat('42-', o_custkey)), o_custkey", ["round_even(total * 0.8::DOUBLE, 0)"], 0) + ") JOIN orders USING (o_custkey)")
def train_test_split(t: Tables) -> DataFrame:
    return sampling.training_test(t.orders.select("o_custkey", "o_orderkey"), 0.2, id_columns=("o_custkey",)).select("o_orderkey", "split")


@query("SELECT o_custkey, is_holdout, CAST(count(*) AS BIGINT) AS n FROM (" + _folds_sql("o_custkey", "orders", "md5(concat('42-', o_custkey)), o_custkey", ["round_even(total * 0.75::DOUBLE, 0)"], 0).replace("AS fold", "= 1 AS is_holdout") + ") JOIN orders USING (o_custkey) GROUP BY ALL")
def holdout_split(t: Tables) -> DataFrame:
    return sampling.Validation(2, 0.25, id_columns=("o_custkey",)).split(t.orders.select("o_custkey")).groupBy("o_custkey", "is_holdout").agg(F.count("*").alias("n"))


@query("SELECT event_id FROM events ORDER BY md5(concat('42-', event_id)) LIMIT 100")
def seeded_top(t: Tables) -> DataFrame:
    return t.events.select("event_id").orderBy(seeded_order("event_id")).limit(100)
