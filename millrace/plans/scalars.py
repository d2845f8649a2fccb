"""Queries of text, date, array, hash, number and colour functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, colour, dates, hashing, numbers, text
from .registry import Tables, query

_SNAKE = r"regexp_replace(lower(regexp_replace(regexp_replace({x}, '(.)([A-Z][a-z]+)', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')), '\s*_+', '_', 'g')"
_CLEAN = r"regexp_replace(replace(replace(replace(regexp_replace({x}, '&+', '&', 'g'), ' & ', ' and '), '_&_', '_and_'), '&', ' and '), '[^\p{{L}}\p{{N}}_]+', '_', 'g')"


@query("SELECT p_partkey, " + _SNAKE.format(x=_CLEAN.format(x="p_type || 'CamelCase & MyHTTPServer ' || p_name")) + " AS snake FROM part")
def text_camel_to_snake(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.camel_to_snake(F.concat("p_type", F.lit("CamelCase & MyHTTPServer "), "p_name")).alias("snake"))


@query(r"SELECT doc_id, md5(" + _CLEAN.format(x="text") + r") AS cleaned, md5(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters FROM documents")
def text_clean(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.remove_non_alphanumeric(F.col("text")).cast("binary")).alias("cleaned"), F.md5(text.remove_non_alphabetic(F.col("text")).cast("binary")).alias("letters"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S*\p{L}\S*')) AS INTEGER) AS words FROM documents")
def text_words(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.count_words(F.col("text")).alias("words"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(s, '[.!?;] ')) AS INTEGER) + CAST(regexp_matches(s, '[.!?;]\z') AS INTEGER) AS sentences FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents)")
def text_sentences(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.count_sentences(F.col("text")).alias("sentences"))


@query("""SELECT c_custkey, rpad(c_mktsegment, greatest(12, length(c_mktsegment))::INTEGER, ' ') AS l, lpad(c_mktsegment, greatest(12, length(c_mktsegment))::INTEGER, ' ') AS r,
repeat(' ', ((12 - length(c_mktsegment)) // 2)::BIGINT) || c_mktsegment || repeat(' ', (12 - length(c_mktsegment) - (12 - length(c_mktsegment)) // 2)::BIGINT) AS c, c_name AS whole FROM customer""")
def text_align(t: Tables) -> DataFrame:
    s = F.col("c_mktsegment")
    return t.customer.select("c_custkey", text.align(s, 12, "left").alias("l"), text.align(s, 12, "right").alias("r"), text.align(s, 12, "centre").alias("c"), text.align(F.col("c_name"), 3).alias("whole"))


@query(r"SELECT p_partkey, regexp_matches(p_name, '\p{L}') AS name, regexp_matches(p_size::VARCHAR, '\p{L}') AS size FROM part")
def text_is_word(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.is_word(F.col("p_name")).alias("name"), text.is_word(F.col("p_size").cast("string")).alias("size"))


@query(r"SELECT p_partkey, array_to_string(regexp_split_to_array(replace(p_name, ' ', ' | '), '\s*\|\s*'), '/') AS parts FROM part")
def text_split_and_strip(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(text.split_and_strip(F.expr("replace(p_name, ' ', ' | ')"), "|"), "/").alias("parts"))


@query()
def text_wrap(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.wrap(F.col("text"), 60, "right", 2, "| ", " |").cast("binary")).alias("wrapped"))


D = "CAST(o_orderdate AS DATE)"


@query(f"""SELECT o_orderkey, day({D})::INTEGER AS day, month({D})::INTEGER AS month, monthname({D}) AS monthname, quarter({D})::INTEGER AS quarter, strftime({D}, '%Y-%m') AS yearmonth, year({D}) || '-Q' || quarter({D}) AS yearquarter, (isodow({D}) - 1)::INTEGER AS weekday, dayname({D}) AS weekdayname FROM orders""")
def date_parts(t: Tables) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", *[dates.date_part(d, p).alias(p) for p in ("day", "month", "monthname", "quarter", "yearmonth", "yearquarter", "weekday", "weekdayname")])


@query(f"SELECT o_orderkey, CAST({D} + INTERVAL 1 MONTH AS DATE) AS month, CAST({D} - INTERVAL 1 MONTH AS DATE) AS back, CAST({D} + INTERVAL 6 MONTH AS DATE) AS quarters, CAST({D} + INTERVAL 1 YEAR AS DATE) AS year, CAST({D} + INTERVAL 14 DAY AS DATE) AS weeks FROM orders")
def add_months_down(t: Tables) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", dates.add_months(d, 1).alias("month"), dates.add_months(d, -1).alias("back"), dates.add_quarters(d, 2).alias("quarters"), dates.add_years(d, 1).alias("year"), dates.add_time(d, 2, "weeks").alias("weeks"))


@query(f"SELECT o_orderkey, CASE WHEN day(m) < day({D}) THEN CAST(m + INTERVAL 1 DAY AS DATE) ELSE m END AS month FROM (SELECT *, CAST({D} + INTERVAL 1 MONTH AS DATE) AS m FROM orders)")
def add_months_up(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", dates.add_months(F.col("o_orderdate").cast("date"), 1, "up").alias("month"))


_US = "datediff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts)"


@query(f"""SELECT event_id, {_US} / 1e6 AS s, {_US} / 6e7 AS min, {_US} / 3.6e9 AS h, {_US} / 8.64e10 AS day,
CASE WHEN {_US} < 1000 THEN 'us' WHEN {_US} < 1000000 THEN 'ms' WHEN {_US} < 60000000 THEN 's' WHEN {_US} < 3600000000 THEN 'min' WHEN {_US} < 86400000000 THEN 'h' ELSE 'day' END AS unit FROM events""")
def elapsed_units(t: Tables) -> DataFrame:
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    parts = [dates.elapsed(start, F.col("ts"), u).alias(u) for u in ("s", "min", "h", "day")]
    return t.events.select("event_id", *parts, dates.best_unit(F.timestamp_diff("MICROSECOND", start, F.col("ts"))).alias("unit"))


@query(f"SELECT o_orderkey, round(m, 6) AS months, round(m / 12, 6) AS years FROM (SELECT o_orderkey, (year({D}) - 1995) * 12 + (month({D}) - 3) + (day({D}) - 17) / 31.0::DOUBLE AS m FROM orders)")
def elapsed_months(t: Tables) -> DataFrame:
    start, end = F.lit("1995-03-17").cast("date"), F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", F.round(dates.elapsed(start, end, "month"), 6).alias("months"), F.round(dates.elapsed(start, end, "year"), 6).alias("years"))


@query(f"SELECT o_orderkey, (year({D}) * 100 + month({D}))::INTEGER AS ym, (year({D}) * 12 + month({D}))::INTEGER AS months, CAST(least({D} - (day({D}) - 1)::INTEGER + 30, last_day({D})) AS DATE) AS day31 FROM orders")
def year_month(t: Tables) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    ym = dates.year_month(d)
    return t.orders.select("o_orderkey", ym.alias("ym"), dates.month_index(d).alias("months"), dates.year_month_to_date(ym, 31).alias("day31"))


@query(f"SELECT o_orderkey, year({D}) || 'Q' || quarter({D}) AS yq, (year({D}) * 10 + quarter({D}))::INTEGER AS yqi, CAST(date_trunc('quarter', {D}) AS DATE) AS first, CAST(last_day(date_trunc('quarter', {D}) + INTERVAL 2 MONTH) AS DATE) AS last FROM orders")
def year_quarter(t: Tables) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", dates.year_quarter(d).alias("yq"), dates.year_quarter_int(d).alias("yqi"), dates.first_day_of_quarter(d).alias("first"), dates.last_day_of_quarter(d).alias("last"))


@query(f"SELECT o_orderkey, weekofyear({D})::INTEGER AS week FROM orders")
def iso_week(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", dates.week_number(F.col("o_orderdate")).alias("week"))


@query(f"SELECT o_orderkey, CAST(date_trunc('month', {D}) AS DATE) AS first, last_day({D}) AS last, day(last_day({D}))::INTEGER AS days, dayofyear(make_date(year({D}), 12, 31))::INTEGER AS year_days, monthname({D}) AS name, month({D})::INTEGER AS number FROM orders")
def month_bounds(t: Tables) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    name = dates.month_name(F.month(d))
    return t.orders.select("o_orderkey", dates.first_day_of_month(d).alias("first"), dates.last_day_of_month(d).alias("last"), dates.number_of_days(F.year(d), F.month(d)).alias("days"), dates.number_of_days(F.year(d)).alias("year_days"), name.alias("name"), dates.month_number(name).alias("number"))


#: The forms of FORMATS that Spark writes in its own letters, and what is left of the date: day, month or year.
_FORMS = {
    "yyyy-MM-dd": "day", "yyyy/M/d": "day", "yyyy.MM.dd": "day", "yyyy-MM": "month", "yyyy/M": "month", "yyyy.MM": "month", "yyyy": "year", "yy-MM-dd": "day", "yy/M/d": "day",
    "yy.MM.dd": "day", "MMM dd, yyyy": "day", "MMMM d, yyyy": "day", "MMMM d yyyy": "day", "MM/dd/yyyy": "day", "M/d/yy": "day", "MMM yyyy": "month", "' 'MMMMyyyy": "month", "MMM d,yyyy": "day",
}
_ODD = {"03/04/2020": "2020-03-04", "13-02-2020": None, "2021-02-30": None, "05/06/07": "2005-06-07", "jan 5, 1999": "1999-01-05", "2021-3-4": "2021-03-04", "no date": None, "20210304": None, "2021-13": None, "68-1-1": "2068-01-01", "69-1-1": "1969-01-01"}


@query(f"SELECT o_orderkey, i::INTEGER AS i, CAST(CASE w WHEN 'day' THEN {D} ELSE date_trunc(w, {D}) END AS DATE) AS d FROM orders, (SELECT unnest({list(range(len(_FORMS)))}) AS i, unnest({list(_FORMS.values())}) AS w)")
def parse_date(t: Tables) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    texts = F.array(*[F.date_format(d, f) for f in _FORMS])
    return t.orders.select("o_orderkey", F.posexplode(texts).alias("i", "s")).select("o_orderkey", "i", dates.parse_date(F.col("s")).alias("d"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', CAST({f"'{d}'" if d else 'NULL'} AS DATE))" for s, d in _ODD.items()) + ") AS v(s, d)")
def parse_odd_date(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(s,) for s in _ODD], "s string").select("s", dates.parse_date(F.col("s")).alias("d"))


@query(f"SELECT o_orderkey, {D} AS cut FROM orders")
def string_to_date(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", dates.string_to_date(F.date_format(F.col("o_orderdate").cast("date"), "yyyy.MM.dd")).alias("cut"))


_LISTS = "(SELECT o_custkey, list(o_orderkey % 7 ORDER BY o_orderkey) AS a, list(o_orderkey % 5 ORDER BY o_orderkey) AS b FROM orders GROUP BY o_custkey)"


def _lists(t: Tables) -> DataFrame:
    rows = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey"))).alias("os"))
    return rows.select("o_custkey", F.transform("os", lambda o: o["o_orderkey"] % 7).alias("a"), F.transform("os", lambda o: o["o_orderkey"] % 5).alias("b"))


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _list_sql(e: str) -> str:
    return f"array_to_string(list_transform({e}, lambda x: x::VARCHAR), ',')"


@query(f"""SELECT o_custkey, len(list_distinct(a)) < len(a) AS has, {_list_sql("list_filter(list_filter(a, lambda x, i: list_position(a, x) = i), lambda x: len(list_filter(a, lambda y: y = x)) > 1)")} AS dups,
{_list_sql("list_filter(a, lambda x, i: list_position(a, x) = i)")} AS once FROM {_LISTS}""")
def array_duplicates(t: Tables) -> DataFrame:
    a = F.col("a")
    return _lists(t).select("o_custkey", arrays.has_duplicates(a).alias("has"), _joined(arrays.get_duplicates(a)).alias("dups"), _joined(arrays.remove_duplicates(a)).alias("once"))


_U = "list_filter({x}, lambda x, i: list_position({x}, x) = i)"


@query(f"""SELECT o_custkey, {_list_sql("list_filter(a, lambda x: list_contains(b, x))")} AS common, {_list_sql(_U.format(x="list_concat(a, b)"))} AS either,
{_list_sql("list_filter(" + _U.format(x="a") + ", lambda x: NOT list_contains(b, x))")} AS only_a,
{_list_sql("list_concat(list_filter(" + _U.format(x="a") + ", lambda x: NOT list_contains(b, x)), list_filter(" + _U.format(x="b") + ", lambda x: NOT list_contains(a, x)))")} AS one_of, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS subset FROM {_LISTS}""")
def set_ops(t: Tables) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _lists(t).select("o_custkey", _joined(arrays.intersection(a, b)).alias("common"), _joined(arrays.union(a, b)).alias("either"), _joined(arrays.difference(a, b)).alias("only_a"), _joined(arrays.symmetric_difference(a, b)).alias("one_of"), arrays.is_subset(a, b).alias("subset"))


@query(f"SELECT o_custkey, {_list_sql('list_concat(a, a)')} AS flat, len(a) * 2 AS n FROM {_LISTS}")
def array_flatten(t: Tables) -> DataFrame:
    nested = _lists(t).select("o_custkey", F.array(F.array("a"), F.array("a")).alias("deep"))
    flat = arrays.flatten(nested, "deep")
    return nested.select("o_custkey", _joined(flat).alias("flat"), F.size(flat).cast("long").alias("n"))


@query(f"SELECT o_custkey, i::INTEGER AS i, list_sum(a[1:i])::DOUBLE AS s FROM (SELECT o_custkey, a, unnest(generate_series(1, len(a))) AS i FROM {_LISTS})")
def array_cumsum(t: Tables) -> DataFrame:
    return _lists(t).select("o_custkey", F.posexplode(arrays.cumsum(F.col("a"))).alias("i", "s")).withColumn("i", F.col("i") + 1)


@query(f"SELECT o_custkey, x, y FROM (SELECT o_custkey, unnest(a) AS x, b FROM {_LISTS}), unnest(b) AS u(y)")
def array_product(t: Tables) -> DataFrame:
    pairs = arrays.product(F.col("a"), F.col("b"))
    return _lists(t).select("o_custkey", F.explode(pairs).alias("p")).select("o_custkey", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query("SELECT unnest(['', '1', '2', '3', '1,2', '1,3', '2,3', '1,2,3']) AS s, unnest([0, 1, 2, 3, 4, 5, 6, 7])::INTEGER AS i")
def array_powerset(t: Tables) -> DataFrame:
    one = t.spark.range(1).select(F.array(*map(F.lit, (1, 2, 3))).alias("a"))
    return one.select(F.posexplode(arrays.powerset(F.col("a"))).alias("i", "p")).select(_joined("p").alias("s"), "i")


@query("SELECT k, count(*) AS n FROM (SELECT CASE WHEN p_size % 2 = 0 THEN 'a=1,b=2' ELSE 'a=2,b=1' END AS k FROM part) GROUP BY k")
def canonical_map(t: Tables) -> DataFrame:
    m = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("a"), 1 + F.col("p_size") % 2, F.lit("b"), 2 - F.col("p_size") % 2)).otherwise(F.create_map(F.lit("b"), 2 - F.col("p_size") % 2, F.lit("a"), 1 + F.col("p_size") % 2))
    key = F.array_join(F.transform(arrays.canonical_map(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return t.part.select(key.alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, to_base64(unhex(sha256(chr(39) || c_name || chr(39)))) AS hash FROM customer")
def hash_object_base64(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", hashing.hash_string(F.col("c_name")).alias("hash"))


@query()
def hash_object_base32(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", hashing.hash_string(F.col("c_name"), 32).alias("hash"))


@query("SELECT event_id, lpad((d)::VARCHAR, 2, '0') || ':' || lpad(h::VARCHAR, 2, '0') || ':' || lpad(m::VARCHAR, 2, '0') AS clock, d * 1440 + h * 60 + m AS total FROM (SELECT event_id, event_id // 1440 AS d, event_id // 60 % 24 AS h, event_id % 60 AS m FROM events)")
def mixed_radix(t: Tables) -> DataFrame:
    names = ("d", "h", "m")
    parts = t.events.select("event_id", numbers.to_parts(F.col("event_id"), (24, 60), names).alias("p"))
    return parts.select("event_id", numbers.display(F.col("p"), names, (2, 2, 2)).alias("clock"), numbers.from_parts([F.col("p")[n] for n in names], (24, 60)).alias("total"))


PALETTE = {"red": "#ff0000", "lime": "#00ff00", "navy": "#000080", "grey": "#808080", "gold": "#ffd700"}  # fixed values
_PALETTE_SQL = " UNION ALL ".join(f"SELECT '{n}' AS name, {int(h[1:3], 16)} / 255.0::DOUBLE AS r, {int(h[3:5], 16)} / 255.0::DOUBLE AS g, {int(h[5:], 16)} / 255.0::DOUBLE AS b" for n, h in PALETTE.items())


def _palette(t: Tables, name: str, c: str) -> DataFrame:
    return t.spark.createDataFrame(list(PALETTE.items()), "name string, hex string").select(F.col("name").alias(name), colour.from_hex(F.col("hex")).alias(c))


@query(f"WITH p AS ({_PALETTE_SQL}) SELECT x.name AS a, y.name AS b, round(sqrt((x.r - y.r) ** 2 + (x.g - y.g) ** 2 + (x.b - y.b) ** 2), 6) AS distance FROM p x, p y")
def colour_distance(t: Tables) -> DataFrame:
    pairs = _palette(t, "a", "x").crossJoin(_palette(t, "b", "y"))
    return pairs.select("a", "b", F.round(colour.distance(F.col("x"), F.col("y")), 6).alias("distance"))


@query(f"WITH p AS ({_PALETTE_SQL}) SELECT x.name AS a, y.name AS b, '#' || " + " || ".join(f"printf('%02x', round_even((x.{c} * 3 + y.{c}) / 4 * 255, 0)::INTEGER)" for c in "rgb") + " AS mixed FROM p x, p y")
def colour_mix(t: Tables) -> DataFrame:
    pairs = _palette(t, "a", "x").crossJoin(_palette(t, "b", "y"))
    return pairs.select("a", "b", colour.to_hex(colour.mix(F.col("x"), F.col("y"), 3, 1)).alias("mixed"))


@query(f"WITH p AS ({_PALETTE_SQL}) SELECT name AS a, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM p")
def colour_hsl_round_trip(t: Tables) -> DataFrame:
    back = _palette(t, "a", "x").select("a", colour.from_hsl(colour.to_hsl(F.col("x"))).alias("c"))
    return back.select("a", *[F.round(F.col("c")[n], 6).alias(n) for n in "rgb"])
