"""Goldens, properties and errors that no SQL comparison covers."""

import datetime as dt
import math

import pytest
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from millrace import errors
from millrace.functions import arrays, colour, control, dates, hashing, numbers, text
from millrace.operators import features, imputation, joins, models, sampling, search, statistics
from millrace.operators import wrangling as w
from millrace.rows import with_rank, with_row_id
from millrace.sources import excel, tables
from millrace.streaming import stateless


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_text_goldens(spark):
    for given, want in (("CamelCase", "camel_case"), ("MyHTTPServer", "my_http_server"), ("Order Date (UTC)", "order_date_utc_"), ("l_shipdate", "l_shipdate")):
        assert one(spark, text.camel_to_snake(F.lit(given))) == want == text.snake_name(given)
    assert text.snake_name(("v", "x")) == "v_x"
    for given, want in (("", 0), ("Hello", 0), ("A b. C d! e", 2), ("Hi. Yes!", 2)):
        assert one(spark, text.count_sentences(F.lit(given))) == want
    for width in range(1, 9):
        for s in ("ab", "abc", "abcdef"):
            assert one(spark, text.align(F.lit(s), width, "c")) == s.center(width)
    assert one(spark, text.align(F.lit("abcdef"), 3)) == "abcdef"
    assert one(spark, text.wrap(F.lit("aa bb cc"), 9, "left", 0, "<", ">")) == "<aa bb  >\n<cc     >"
    assert one(spark, text.split_and_strip(F.lit(" a $ b$c "), "$")) == ["a", "b", "c"]


def test_date_goldens(spark):
    day = lambda s: F.lit(s).cast("date")
    assert one(spark, dates.add_months(day("2020-06-15"), 6)) == dt.date(2020, 12, 15)
    assert one(spark, dates.add_months(day("2020-01-15"), -1)) == dt.date(2019, 12, 15)
    assert one(spark, dates.add_months(day("2021-01-31"), 1), dates.add_months(day("2021-01-31"), 1, "up")) == (dt.date(2021, 2, 28), dt.date(2021, 3, 1))
    assert one(spark, dates.week_number(day("2021-01-03")), dates.date_part(day("2021-01-03"), "weekday")) == (53, 6)
    assert one(spark, dates.parse_date(F.lit("70-03-04")), dates.parse_date(F.lit("March 4, 2021"))) == (dt.date(1970, 3, 4), dt.date(2021, 3, 4))
    assert one(spark, dates.month_number(F.lit("MARCH")), dates.month_number(F.lit("xxx"))) == (3, None)
    with pytest.raises(errors.MissingArgumentError):
        dates.date_part(F.col("d"), "century")


def test_collection_goldens(spark):
    df = spark.createDataFrame([([[[1, 2], [3]], [[4]]],)], "a array<array<array<int>>>")
    assert df.select(arrays.flatten(df, "a")).first()[0] == [1, 2, 3, 4]
    assert one(spark, arrays.get_duplicates(F.array(*map(F.lit, (1, 2, 3, 4, 2, 1)))))== [1, 2]
    letters = spark.createDataFrame([(c,) for c in "abcdeabcdabcaba"], "c string")
    assert [tuple(r) for r in arrays.counter(letters, "c", 3).collect()] == [("a", 5), ("b", 4), ("c", 3)]
    assert len(arrays.create_grid({"a": [1, 2, 3], "b": [10, 20]})) == 6 and arrays.create_grid({"a": 1}) == [{"a": 1}]
    assert one(spark, arrays.powerset(F.array().cast("array<int>"))) == [[]]
    with pytest.raises(errors.AmbiguousArgumentError):
        arrays.series(0, 1, step=1, count=2)
    assert one(spark, hashing.hash_string(F.lit("abc"))) == "YtnlOWKLGVuN9Uxrj7YkL7C6jaaqeT96SCvfcj3T7bU="


def test_hash_of_files_and_rows(spark, tmp_path):
    import base64
    import hashlib

    (tmp_path / "f").write_bytes(b"abc")
    assert hashing.hash_files(spark, str(tmp_path)).first()["hash"] == base64.b64encode(hashlib.sha256(b"abc").digest()).decode()
    df = spark.range(50)
    assert hashing.hash_rows(df).first() == hashing.hash_rows(df.orderBy(F.desc("id"))).first() != hashing.hash_rows(spark.range(49)).first()


def test_numbers_and_colour(spark):
    assert one(spark, numbers.to_parts(F.lit(-1), (24, 60), ("d", "h", "m"))) == (-1, 23, 59)
    assert one(spark, colour.to_hex(colour.darken(colour.from_hex(F.lit("#ff8000")), 0.5))) == "#804000"
    assert len(one(spark, colour.gradient(colour.rgb(0, 0, 0), colour.rgb(1, 1, 1), 5))) == 5


def test_row_ids_are_gapless(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id")).repartition(7)
    got = with_row_id(df, [F.col("k")], "n").orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(1000))


def test_wrangling_errors_and_ties(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 2), ("b", None, 3), ("b", float("nan"), 4)], "g string, v double, k int")
    assert [tuple(r) for r in w.select_max(df, "v", ["g"], ["k"]).collect()] == [("a", 1.0, 1)]
    assert w.missing_counts(df) == {"g": 0, "v": 2, "k": 0} and w.columns_with_missing(df) == ["v"]
    with pytest.raises(errors.MissingColumnsError):
        w.select_columns(df, ["nope"])
    with pytest.raises(errors.DataError):
        w.long_to_wide(df.withColumn("one", F.lit(1)), ["one"], "g", ["k"])
    with pytest.raises(errors.DuplicationError):
        w.standardize_columns(df.toDF("A", "a ", "k"))
    null_only = spark.createDataFrame([(None, 1), (None, 2)], "x double, y int")
    assert w.drop_single_value_columns(null_only).columns == ["y"]
    four = spark.createDataFrame([(4, 1, "a", "a"), (4, 2, "b", "a"), (4, 1, "a", "a"), (4, 1, "a", "a"), (5, 3, "d", "a2")], "a int, b int, c string, d string")
    assert w.drop_columns_with_no_additional_information(four).columns == ["a", "b", "c"]
    rows = spark.createDataFrame([("1,2", "x"), (None, "y")], "n string, l string")
    assert sorted(map(str, (r["n"] for r in w.split_rows(rows, "n").collect()))) == ["1", "2", "None"]
    assert (w.SliceTemplate(["a", "b"]) & w.SliceTemplate(["b", "c"])).columns == ["b"]


def test_join_wisely_conserves_rows(spark):
    left = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "k int, a int")
    right = spark.createDataFrame([(1, 20), (1, 21), (3, 22)], "k int, b int")
    got = joins.join_wisely(left, right, ["k"], "a", "b")
    assert [tuple(r) for r in got["both"].collect()] == [(1, 10, 20)]
    assert sorted(r["a"] for r in got["left_only"].collect()) == [11, 12]
    assert sorted(r["b"] for r in got["right_only"].collect()) == [21, 22]


def test_statistics_properties(spark):
    df = spark.createDataFrame([(i % 3, i % 2, None if i % 5 == 0 else i) for i in range(60)], "x int, y int, z int")
    h = lambda d: d.first()[0]
    assert h(statistics.joint_entropy(df, "x", "y")) <= h(statistics.entropy(df, "x")) + h(statistics.entropy(df, "y")) + 1e-9
    assert h(statistics.information_gain(df, "y", "x")) == pytest.approx(0, abs=1e-9)
    binary = spark.createDataFrame([(0, 0), (0, 0)], "a int, p int")
    m = statistics.classification_metrics(binary, "a", "p", 0, 1).first()
    assert m["accuracy"] == 1 and math.isnan(m["recall"])
    zero = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (None, 1.0)], "a double, p double")
    assert math.isnan(statistics.regression_metrics(zero, "a", "p").first()["mape"])
    assert statistics.best_coverage(df, "z") == ["x", "y"]


def test_splits_are_complete_and_respect_ids(spark):
    counts = spark.createDataFrame([(1, 3), (2, 4), (3, 3)], "day int, n int")
    got = sampling.split_counts(counts, "n", [F.col("day")], ratios=[0.5, 0.5]).orderBy("day").collect()
    assert [r["bucket"] for r in got] == [0, 1, 1]
    ten = sampling.Validation(3, key="id").split(spark.range(10)).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in ten] == [3, 4, 3]
    df = spark.range(200).withColumn("g", F.col("id") % 17)
    split = sampling.Validation(4, 0.2, id_columns=("g",)).split(df)
    assert split.count() == 200 and split.groupBy("g").agg(F.count_distinct(F.struct("is_holdout", "fold")).alias("n")).where("n > 1").count() == 0
    days = df.withColumn("day", (F.col("id") / 10).cast("int"))
    spec = sampling.Validation(3, sort_columns=("day",))
    for train, test in spec.folds(spec.split(days)):
        assert train.agg(F.max("day")).first()[0] < test.agg(F.min("day")).first()[0]
    with pytest.raises(errors.AmbiguousArgumentError):
        sampling.Validation(2, id_columns=("a",), sort_columns=("b",))
    with pytest.raises(errors.DataError):
        sampling.split_counts(counts, "n", [F.col("day")], ratios=[0.5, 0.4])
    with pytest.raises(errors.AmbiguousArgumentError):
        sampling.balance_sample(df, ["g"], "id", n=201)
    labels = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(7)], "k int, c string")
    up = sampling.UpSampler().fit_upsample(labels, "c", "k").groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in up} == {"a": 5, "b": 5}


def test_features(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    n = features.Normalizer().fit(df)
    assert [tuple(r) for r in n.untransform(n.transform(df)).collect()] == [(1.0, 5.0), (3.0, 5.0)]
    assert {r["b"] for r in n.transform(df).collect()} == {0.0}
    with pytest.raises(errors.AlreadyFittedError):
        n.fit(df)
    with pytest.raises(errors.NotFittedError):
        features.Normalizer().transform(df)
    letters = spark.createDataFrame([("a",)] * 9 + [("B",)] * 5 + [("z",), (None,)], "c string")
    assert features.OneHotEncoder(top=2).fit_transform(letters).columns == ["c_a", "c_b", "c_other"]
    assert features.Polynomial().transform(df, ["a", "b"]).columns == ["a", "b", "a2", "a.b", "b2"]


def test_imputation(spark):
    df = spark.range(40).select("id", F.col("id").cast("double").alias("x"), F.expr("case when id % 4 = 0 then null else 3d * id + 1 end").alias("y"), F.expr("case when id % 5 = 0 then null when id < 20 then 'lo' else 'hi' end").alias("c"))
    done = imputation.DataImputer(categorical=False).fit(df.drop("c")).transform(df.drop("c"))
    assert done.where("abs(y - (3 * id + 1)) > 0.01").count() == 0
    from pyspark.ml.classification import DecisionTreeClassifier

    column = imputation.ColumnImputer("c", ["x"], [DecisionTreeClassifier()]).fit(df).transform(df)
    assert column.where("c is null or (id not in (15, 20) and (c = 'lo') <> (id < 20))").count() == 0
    best = imputation.ColumnImputer("y", ["x"], [DecisionTreeRegressor(maxDepth=1), LinearRegression()]).fit(df)
    assert hasattr(best.model, "coefficients")
    with pytest.raises(errors.NoColumnsError):
        imputation.ColumnImputer("c", ["c"]).fit(df)
    with pytest.raises(errors.NotFittedError):
        imputation.NaFillerFlagger().transform(df)


def test_models_and_search(spark):
    df = spark.range(120).select("id", (F.col("id") % 10).cast("double").alias("x"), (2.0 * (F.col("id") % 10) + 1).alias("y"), (F.col("id") % 3 * 100.0).alias("z"))
    fit = models.KMeans(3, ["z"]).fit(df)
    assert fit.inertia == pytest.approx(0) and fit.predict(df).select("cluster").distinct().count() == 3
    assert models.Elbow(["z"], 2, 5).fit(df).optimal() == 3
    assert models.knee([(1, 10.0), (2, 3.0), (3, 2.5), (4, 2.0)]) == 2
    repository = search.EstimatorRepository()
    repository.append(LinearRegression, {"regParam": [0.0, 5.0]})
    repository.append(LinearRegression, {"regParam": [0.0]})
    assert list(repository.estimators) == ["LinearRegression_1", "LinearRegression_2"]
    run = search.CrossValidationSearch(df, ["x"], "y", repository, sampling.Validation(2, 0.2, key="id"), metric="rmse")
    assert len(run.run(budget=2).results) == 2 and {r["estimator"] for r in run.results} == set(repository.estimators)
    run.run()
    assert run.best_estimator() == "LinearRegression_1" and run.holdout_result()["rmse"] < 0.01
    assert models.coefficients(run.complete_model(), ["x"])["x"] == pytest.approx(2, abs=0.01)
    both = models.Ensemble([run.complete_model(), run.complete_model()]).predict(models.assembled(df, ["x"]))
    assert both.where("abs(prediction - y) > 0.1").count() == 0
    assert search.Evaluation("rmse", 1.0) > search.Evaluation("rmse", 2.0) and search.Evaluation("f1_score", 1.0) > search.Evaluation("f1_score", 0.0)
    with pytest.raises(errors.ComparisonError):
        search.Evaluation("rmse", 1.0) > search.Evaluation("mae", 1.0)  # noqa: B015
    board = search.Scoreboard()
    board.add_task("e", "d")
    with pytest.raises(errors.DuplicationError):
        board.add_task("e", "d")
    with pytest.raises(errors.AmbiguousArgumentError):
        search.Scoreboard(False, 0)
    pca = models.principal_component_model(LinearRegression(labelCol="y"), ["x", "z"], 2).fit(df)
    assert "prediction" in pca.transform(df).columns


def test_excel_matrix():
    rows = [["report", None], [None, None], ["Order Date", "Total"], ["2020", 1]]
    assert excel.sheet_table(rows, find_by=["total", "orderDate"]) == (["order_date", "total"], [["2020", 1]])
    with pytest.raises(errors.MissingColumnsError):
        excel.find_header(rows, ["nope"])


def test_shared_tables(spark):
    shared = tables.SharedTables(spark)
    shared.add("some_numbers", spark.range(3))
    assert shared.get("some_numbers").count() == 3
    with pytest.raises(errors.MutationError):
        shared.add("some_numbers", spark.range(3))


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("MyName", 1.0), (None, 3.0)], "s string, v double").write.parquet(source)
    fitted = features.Normalizer().fit(spark.read.parquet(source))
    stream = spark.readStream.schema("s string, v double").parquet(source)
    out = stateless.transform_stream(stream, lambda d: d.withColumn("s", text.camel_to_snake(F.col("s"))), fitted.transform)
    stateless.write_parquet(out, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(60)
    assert {r["s"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"my_name", None}
    with pytest.raises(errors.DataError):
        with_row_id(stream, [F.col("v")])


def test_timing(spark):
    m = control.Measurements()
    with m.measure("a"):
        pass
    assert m.summary(spark).first()["count"] == 1
    assert control.function_arguments(lambda a, b: None) == ["a", "b"]
    assert control.with_timeout(spark, lambda: spark.range(3).count(), 30) == 3


def test_containers_and_automl(spark):
    from millrace.operators import automl, containers

    df = spark.range(60).select("id", (F.col("id") % 10).cast("double").alias("x"), (2.0 * (F.col("id") % 10) + 1).alias("y"))
    pair = containers.TrainingTestContainer(sampling.training_test(df, 0.25, key="id"), ["x"], "y")
    assert pair.training_data.count() == 45 and pair.test_data.count() == 15
    with pytest.raises(errors.NotFittedError):
        pair.predictions()
    assert pair.fit(LinearRegression()).evaluate_regression().first()["rmse"] < 0.01
    folds = containers.ValidationContainer(df, sampling.Validation(3, 0.1, key="id"), ["x"], "y")
    assert folds.num_folds == 3 and folds.holdout.count() == 6
    assert folds.evaluate_regression({"a": LinearRegression(), "b": DecisionTreeRegressor()}).count() == 6
    assert "rmse_mean" in folds.evaluate_regression({"a": LinearRegression()}, aggregate=True).columns
    with pytest.raises(errors.MissingRowsError):
        folds.get_fold(4)
    auto = automl.AutoML(metric="rmse").add_models(LinearRegression, {"regParam": [0.0, 9.0]}).add_validation("d", df, ["x"], "y", sampling.Validation(2, key="id"))
    assert auto.run().best() == {"d": "LinearRegression_1"}


def test_user_functions_and_tasks(spark):
    from millrace.operators import jobs

    df = spark.createDataFrame([(1, 2.0), (2, None)], "k int, v double")
    assert [r[0] for r in df.select(jobs.map_values(lambda x: -1.0 if x is None else x * 2, F.col("v"), "double")).collect()] == [4.0, -1.0]
    assert [r["n"] for r in jobs.apply_rows(df, lambda r: r["k"] * 10, "n", "int").collect()] == [10, 20]
    groups = jobs.evaluate_groups(spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, 3.0)], "g int, a double, p double"), ["g"], "a", "p", lambda a, p: {"bias": (p - a).mean()}, ["bias"])
    assert tuple(groups.first()) == (1, 0.5)
    done = jobs.run_tasks({"good": lambda: spark.range(5).count(), "bad": lambda: 1 / 0})
    assert done["good"].result == 5 and "ZeroDivisionError" in done["bad"].error
    assert jobs.outcomes_table(spark, done).where("error is not null").count() == 1


def test_runtime_estimator(spark):
    import time

    from millrace.operators.runtime import RuntimeEstimator

    def work(n):
        if n > 90:
            raise ValueError
        time.sleep(n / 5000)

    e = RuntimeEstimator(spark, work, timeout=None)
    e.explore(8, {"n": (10, 100)})
    assert e.measure(n=10.0) is not None and len(e.records) == 8
    got = e.fit().predict(spark.createDataFrame([(50.0,)], "n double")).first()
    assert got["estimated_seconds"] == pytest.approx(0.01, abs=0.01) and "error_expected" in got.asDict()


def test_today(spark):
    assert one(spark, dates.make_date(F.lit(2020), F.lit(2), F.lit(3)), dates.today()) == (dt.date(2020, 2, 3), one(spark, F.current_date()))


def test_workbooks(spark):
    sheets = {"First Sheet": [["x"], ["Order Id", "Total"], [1, None]], "Other": [["A"], ["b"]]}
    got = excel.workbook_tables(spark, sheets, find_header_by_columns={"first_sheet": ["total"]}, column_names={"Other": ["z"]}, index_columns={"First Sheet": ["Total"]})
    assert got["first_sheet"].columns == ["total", "order_id"] and got["first_sheet"].first()["order_id"] == "1"
    assert [r["z"] for r in got["other"].collect()] == ["b"]
    with pytest.raises(errors.MissingColumnsError):
        excel.workbook_tables(spark, sheets, find_header_by_columns=["total"])
    assert list(excel.workbook_tables(spark, sheets, find_header_by_columns=["total"], ignore_sheets_with_no_header=True)) == ["first_sheet"]
    with pytest.raises(KeyError):
        excel.workbook_tables(spark, sheets, headers={"nope": 1})


def test_more_numbers_and_periods(spark):
    clock = ("h", "m")
    half = numbers.to_parts(F.lit(90), (60,), clock)
    assert one(spark, numbers.add(half, half, (60,), clock)) == (3, 0)
    assert one(spark, numbers.subtract(half, numbers.to_parts(F.lit(91), (60,), clock), (60,), clock)) == (-1, 59)
    assert one(spark, numbers.multiply(half, 3, (60,), clock)) == (4, 30)
    for s, want in (("202103", 202103), ("2021-03", 202103), ("2021 Mar", 202103), ("2021/13", None), ("x", None)):
        assert one(spark, dates.parse_year_month(F.lit(s))) == want
    assert one(spark, dates.parse_year_quarter(F.lit("2021Q3")), dates.parse_year_quarter(F.lit("20213"))) == (20213, 20213)
    assert one(spark, dates.add_year_months(F.lit(202012), 1), dates.add_year_months(F.lit(202001), -1)) == (202101, 201912)


def test_more_colours(spark):
    import colorsys

    for rgb_ in ((0.2, 0.5, 0.9), (1.0, 0.0, 0.0), (0.3, 0.3, 0.3)):
        c = colour.rgb(*rgb_)
        h, s, v = one(spark, colour.to_hsv(c))
        assert (h, s, v) == pytest.approx(colorsys.rgb_to_hsv(*rgb_))
        assert tuple(one(spark, colour.from_hsv(colour.to_hsv(c)))) == pytest.approx(rgb_)
        hls = colorsys.rgb_to_hls(*rgb_)
        assert tuple(one(spark, colour.to_hsl(c))) == pytest.approx((hls[0], hls[2], hls[1]))
    assert one(spark, colour.nearest(colour.rgb(0.9, 0.1, 0), {"blue": "#0000ff", "red": "#ff0000"})) == "red"
    assert one(spark, colour.to_hex(colour.shift_hue(colour.rgb(1, 0, 0), 1 / 3))) == "#00ff00"


def test_ranges_equal_global_windows(spark):
    from pyspark.sql import Window

    from millrace.rows import first_rows, with_running_total

    df = spark.range(500).select("id", (F.col("id") * 7 % 11).alias("v"), F.xxhash64("id").alias("k")).repartition(6)
    want = df.withColumn("s", F.sum("v").over(Window.orderBy("k"))).select("id", "s")
    got = with_running_total(df, [F.col("k")], "v", "s").select("id", "s")
    assert sorted(got.collect()) == sorted(want.collect())
    assert first_rows(df, [F.col("k")], 20).count() == 20


def test_columns_with_dots_in_their_names(spark):
    df = spark.createDataFrame([(1, "a", None, "x"), (2, "b", 2.0, "x"), (3, "b", 3.0, "x")], "id int, `meta.url` string, `a.b` double, `one.value` string")
    assert w.select_columns(df, ["meta.url"]).columns == ["meta.url"]
    assert w.move_columns(df, "front", "a.b").columns[0] == "a.b"
    assert w.drop_bad_columns(df, 0.9).columns == ["id", "meta.url", "a.b"]
    assert [r["a.b"] for r in w.fill_na(df, 0.0).orderBy("id").collect()] == [0.0, 2.0, 3.0]
    assert w.select_max(df, "a.b", ["meta.url"]).first()["id"] == 3
    assert w.column_extremes(df, ["a.b"]).first()["max_a.b"] == 3.0


def test_null_coverage_of_a_wide_table(spark):
    rows = [tuple(None if (i * 7 + j) % 13 == 0 else 1 for j in range(100)) for i in range(30)]
    df = spark.createDataFrame(rows, ", ".join(f"c{j} int" for j in range(100)))
    covering = statistics.fully_covering_columns(df, "c0")
    missing = [i for i, r in enumerate(rows) if r[0] is None]
    assert covering == [f"c{j}" for j in range(1, 100) if all(rows[i][j] is not None for i in missing)]
    best = statistics.best_coverage(df, "c0")
    assert best and set(best) <= set(covering)
    with pytest.raises(errors.DataError):
        statistics.coverage_subsets(df, "c0")


def test_best_coverage_is_the_best_subset(spark):
    import random

    rng = random.Random(4)
    for _ in range(4):
        rows = [tuple(None if rng.random() < p else 1 for p in (0.2, 0.1, 0.3, 0.05, 0.4, 0.15)) for _ in range(12)]
        df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int, f int")
        listed = statistics.coverage_subsets(df, "a").orderBy(F.desc("score"), "n_columns", "columns").first()
        assert statistics.best_coverage(df, "a") == (listed["columns"].split(",") if listed else [])


def test_a_time_limit_stops_work(spark):
    import time

    steps = []

    def loop():
        while True:
            steps.append(1)
            time.sleep(0.01)

    start = time.perf_counter()
    with pytest.raises(errors.JobTimeoutError):
        control.with_timeout(spark, loop, 0.5)
    assert time.perf_counter() - start < 3
    time.sleep(0.2)
    done = len(steps)
    time.sleep(0.2)
    assert len(steps) == done  # the loop has ended
    with pytest.raises(errors.JobTimeoutError):
        control.with_timeout(spark, lambda: spark.range(10**11).selectExpr("sum(id % 7)").collect(), 0.5)
    with pytest.raises(ZeroDivisionError):
        control.with_timeout(spark, lambda: 1 / 0, 5)


def test_ranks_within_one_large_class_are_dealt_in_ranges(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") < 19_000, "big").when(F.col("id") < 19_900, "small").alias("label"))
    train, test = sampling.sample_per_group(df, ["label"], "id", n=500)
    counts = {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}
    assert counts == {"big": 500, "small": 500, None: 100} and train.count() + test.count() == 20_000
    ranked = with_rank(df, ["label"], [F.col("id")], "n")
    assert ranked.groupBy("label").agg(F.max("n").alias("m"), F.countDistinct("n").alias("d")).where("m <> d").count() == 0
    assert "Window" not in ranked._jdf.queryExecution().executedPlan().toString()


def test_too_many_values_to_widen_by(spark, monkeypatch):
    monkeypatch.setattr(w, "MOST_WIDENED", 3)
    with pytest.raises(errors.DataError):
        w.long_to_wide(spark.range(4).select("id", F.col("id").alias("w"), F.lit(1).alias("v")), ["id"], "w", ["v"])


def test_exact_quantiles_by_narrowing(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    from millrace.operators import quantiles as q

    n, draw = 6001, np.random.default_rng(1)
    table = pd.DataFrame({"g": draw.integers(0, 3, n).astype(str), "a": draw.normal(size=n), "hot": np.where(draw.random(n) < 0.4, 5.0, draw.integers(0, 10_000, n)), "same": np.full(n, 7.0), "step": np.where(draw.random(n) < 0.5, 1.0, 2.0 + draw.random(n))})
    table.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(table).withColumn("none", F.lit(None).cast("double"))
    shares, names = [0, 0.25, 0.5, 0.75, 1], ["a", "hot", "same", "step"]
    for few in (10**6, 400):
        monkeypatch.setattr(q, "FEW", few)
        monkeypatch.setattr(q, "NARROW", few)
        got = q.quantiles(df, {c: F.col(c) for c in [*names, "none"]}, shares)
        for c in names:
            assert got[c] == pytest.approx(list(np.nanquantile(table[c], shares)), abs=1e-9)
        assert got["none"] == [None] * 5
    assert q.quantiles(df.limit(0), {"a": F.col("a")}, [0.5]) == {"a": [None]}
    want = table.groupby("g")[names].median()
    for r in q.grouped_medians(df, "g", names).collect():
        assert list(r)[1:] == pytest.approx(list(want.loc[r["_part"]]), abs=1e-9)


def test_a_part_without_values_keeps_its_gaps(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None), (None, 4.0), (None, None)], "part string, x double")
    for with_ in ("median", "mean"):
        filled = imputation.fill_each_split(df, ["x"], "part", with_)
        assert sorted((r["part"] or "", r["x"] or 0.0) for r in filled.collect()) == [("", 4.0), ("", 4.0), ("a", 1.0), ("a", 1.0), ("b", 0.0)]


def test_influence_of_an_empty_table(spark):
    df = spark.createDataFrame([], "x double")
    assert models.function_influence(df, lambda c: c["x"], ["x"], 3).count() == 0


def test_parse_date_stays_small(spark):
    """All formats on one text, whatever it takes to compute it, as one small function: 18 texts took minutes."""
    from millrace.plans.catalogue import QUERIES

    plan = dates.parse_date(F.concat(F.lit("20"), F.col("s")))
    df = spark.createDataFrame([("21-03-04",), ("21/3/ 4",), ("00-13",), ("x",), (None,)], "s string")
    shown = df.select(plan)._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("concat(20") <= 2  # in the array, and perhaps in the name
    assert [r[0] for r in df.select(plan).collect()] == [dt.date(2021, 3, 4), dt.date(2021, 3, 4), None, None, None]
    odd = {"0000-01-01": None, "01/02/30": dt.date(2030, 1, 2), "29/2/29": None, "00-02-29": dt.date(2000, 2, 29), "FEBRUARY 29 2021": None, "may 5,2021": dt.date(2021, 5, 5), " June2020": dt.date(2020, 6, 1), "9999-12-31": dt.date(9999, 12, 31)}
    got = spark.createDataFrame([(s,) for s in odd], "s string").select("s", dates.parse_date(F.col("s"))).collect()
    assert {r[0]: r[1] for r in got} == odd
    query = QUERIES["parse_date"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert query.count("RLIKE") + query.count("rlike") <= 18


def _by_windows(left, right, on, left_id, right_id, how, keep):
    """What join_and_keep_order does with repeated ids, over all pairs."""
    from pyspark.sql import Window

    joined, ok = left.join(right, on, how), F.lit(True)
    for mine in (left_id, right_id):
        over = Window.partitionBy(mine)
        order = [F.col(x).asc_nulls_last() if keep == "first" else F.col(x).desc_nulls_last() for x in (left_id, right_id)]
        unique = F.count(F.lit(1)).over(over) == 1 if keep == "none" else F.row_number().over(over.orderBy(*order)) == 1
        joined = joined.withColumn(f"_ok_{mine}", unique | F.col(mine).isNull())
        ok = ok & F.col(f"_ok_{mine}")
    return joined.where(ok).drop(f"_ok_{left_id}", f"_ok_{right_id}")


@pytest.mark.parametrize("how", ["inner", "left", "right", "full_outer"])
def test_joins_without_all_pairs_equal_those_with(spark, how):
    # Keys on one side or both, once and often, null; ids that are null, and ids that are repeated under other keys.
    left = spark.createDataFrame([(i % 7 if i % 5 else None, None if i in (3, 10, 11, 24, 31) else i - 6 if i in (29, 33) else i, f"l{i}") for i in range(40)] + [(20, 90, "x"), (21, 91, "y"), (9, 92, "z")], "k int, a int, p string")
    right = spark.createDataFrame([(i % 9 if i % 4 else None, None if i in (3, 17, 21, 30) else i - 11 if i in (34, 38) else i, f"r{i}") for i in range(40)] + [(20, 95, "x"), (22, 96, "y"), (9, None, "z")], "k long, b int, q string")
    for keep in ("first", "last", "none"):
        got = joins.join_and_keep_order(left, right, ["k"], "a", "b", how, keep)
        want = _by_windows(left, right, ["k"], "a", "b", how, keep)
        assert got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_joins_of_a_large_key_make_no_pairs(spark):
    """Forty thousand rows a side and one key are 1.6 billion pairs."""
    left, right = spark.range(40_000).select(F.lit(1).alias("k"), F.col("id").alias("a")), spark.range(40_000).select(F.lit(1).alias("k"), (-F.col("id")).alias("b"))
    got = joins.join_wisely(left, right, ["k"], "a", "b")
    assert [tuple(r) for r in got["both"].collect()] == [(1, 0, -39_999)]
    assert (got["left_only"].count(), got["right_only"].count()) == (39_999, 39_999)
    whole = joins.join_wisely(left, right, ["k"], "a", "b", remove_duplicates=False)
    assert (whole["left_only"].count(), whole["right_only"].count()) == (0, 0)
    for keep, want in (("first", [(1, 0, -39_999)]), ("last", [(1, 39_999, 0)]), ("none", [])):
        assert [tuple(r) for r in joins.join_and_keep_order(left, right, ["k"], "a", "b", "left", keep).collect()] == want


def test_rows_are_not_dealt_by_a_few_groups(spark):
    """Statistics of groups come to the rows; dealt by group, half of a table would meet in one task."""
    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, F.lit("N")).alias("g"), (F.col("id") % 50).cast("double").alias("x"), F.expr("if(id % 5 = 0, null, id * 2.0)").alias("y"))
    with_lines = imputation.impute_with_regression(df, "x", ["y"], ["g"])
    for filled in (with_lines, imputation.fill_each_split(df, ["y"], "g"), imputation.fill_each_split(df, ["y"], "g", "median"), with_rank(df, ["g"], [F.col("id")], "n")):
        plan = filled._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert (filled.count(), filled.where("y is null").count()) == (20_000, 4_000 if filled.columns[-1] == "n" else 0)
    many = spark.range(2_000).select("id", (F.col("id") % 1_000).alias("g"), F.col("id").cast("double").alias("x"), F.expr("if(id >= 1000, null, 1.0)").alias("y"))
    assert imputation.fill_each_split(many, ["y"], "g").where("y = 1").count() == 2_000


@pytest.mark.parametrize("few", [1_000_000, 7])
def test_influence_counts_equal_rows_once(spark, monkeypatch, few):
    """Quantiles of some 1,400 expressions over all rows took longer than the table deserves; both ways agree."""
    from millrace.operators import models as m

    monkeypatch.setattr(m, "FEW", few)
    df = spark.range(3_000).select(F.when(F.col("id") % 11 > 0, (F.col("id") % 13).cast("double")).alias("a"), (F.col("id") % 3).alias("b"))
    rows = df.collect()
    for r in models.influence_simulation(df, lambda x: x["a"] * x["b"] + 1e6, ["a", "b"], num_points=9).collect():
        ys = sorted(y for y in ((r["value"] * x["b"] if r["variable"] == "a" else None if x["a"] is None else x["a"] * r["value"]) for x in rows) if y is not None)
        mean, at = math.fsum(ys) / len(ys), lambda p: ys[math.floor(p * (len(ys) - 1))] * (1 - p * (len(ys) - 1) % 1) + ys[math.ceil(p * (len(ys) - 1))] * (p * (len(ys) - 1) % 1)  # noqa: B023
        sd = (math.fsum((y - mean) ** 2 for y in ys) / len(ys)) ** 0.5
        assert (r["mean"] - 1e6, r["sd"], r["q1"] - 1e6, r["median"] - 1e6, r["q3"] - 1e6) == pytest.approx((mean, sd, at(0.25), at(0.5), at(0.75)), abs=1e-6)
    linear = models.function_influence(df, lambda x: x["a"] + 2 * x["b"], ["a", "b"], 4).collect()
    assert len(linear) == 8 and all(r["count"] == sum(x["a"] is not None for x in rows) and r["mean_ratio"] == pytest.approx(1 if r["variable"] == "a" else 2) for r in linear)
    seen = []
    if few > 7:
        monkeypatch.setattr(m, "quantiles", lambda *a: seen.append(a))
        assert models.influence_simulation(df, lambda x: x["a"] * x["b"], ["a", "b"], num_points=9).count() == 12 and not seen
        assert [tuple(r)[2:] for r in models.influence_simulation(df, lambda x: F.lit(None).cast("double"), ["b"]).collect()] == [(None,) * 5] * 3
