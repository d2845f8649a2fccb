"""Line deduplication by site-relative frequency: a line on too large a share of a host's pages is boilerplate.

Lines are counted under a 128-bit digest, once a page, with partial sums before the shuffle. Boilerplate lines
of a host number at most its mean lines a page divided by the ratio, so a host's set of them is small however
large the host is; that set joins the pages, and each page's lines are filtered in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, packed_row, saved, sized_broadcast

RATIO, LEAST_PAGES = 0.02, 5
#: Pages below which nothing is boilerplate: two pages may quote or copy each other.
FEWEST_PAGES = 3
#: Boilerplate lines up to which the sets are broadcast.
BROADCAST_LINES = 500_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def boilerplate(docs: DataFrame, host: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, digest, pages, host_pages) of the lines on more than ``ratio`` of a host's pages and on at least
    ``least_pages`` of them; on a small host, more than half its pages will do, and FEWEST_PAGES. Lines are compared
    without the spaces around them; blank ones never count."""
    fewest = min(FEWEST_PAGES, least_pages)
    pages = docs.select(column(host).alias("host"), F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _digest)).alias("digests"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    counts = pages.select("host", F.explode("digests").alias("digest")).groupBy("host", "digest").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= fewest)
    totals = totals.withColumnRenamed("host", "_host")
    enough = F.least(F.lit(least_pages), F.greatest(F.lit(fewest), F.floor(F.col("host_pages") / 2) + 1))
    return counts.join(totals, counts["host"].eqNullSafe(totals["_host"])).where((F.col("pages") > ratio * F.col("host_pages")) & (F.col("pages") >= enough)).drop("_host")


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """row (the input row, all columns), text (without its boilerplate lines), n_lines, n_dropped.

    Null text counts as one empty line; null hosts are one host; repeated rows are pages of their own. Input
    columns may have any names: they stay inside ``row``.
    """
    found = saved(boilerplate(docs, host, ratio, least_pages).select("host", "digest"))
    sets = found.groupBy("host").agg(F.collect_list("digest").alias("digests"))
    sets = sized_broadcast(sets, found.count(), BROADCAST_LINES)
    packed = docs.select(packed_row(docs), _lines(F.col("text")).alias("lines"))
    joined = packed.join(sets, packed["row"][host].eqNullSafe(sets["host"]), "left")
    kept = F.when(F.col("digests").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("digests", _digest(x))))
    done = joined.select("row", "lines", kept.alias("kept"))
    return done.select("row", F.array_join("kept", "\n").alias("text"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of the text that is left) for each row, repeated ones too; null text
    is one empty line, which stays. A line exactly on the ratio stays."""
    done = drop_boilerplate(docs.select("doc_id", "source", "text"))
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: The same in DuckDB.
SQL = f"""
WITH pages AS (SELECT row_number() OVER () AS r, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
totals AS (SELECT source, count(*) AS host_pages FROM pages GROUP BY source),
seen AS (SELECT source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x)), lambda x: x <> ''))) AS line FROM pages),
bad AS (SELECT s.source, s.line FROM (SELECT source, line, count(*) AS n FROM seen GROUP BY source, line) s
  JOIN totals t ON s.source IS NOT DISTINCT FROM t.source WHERE n >= least({LEAST_PAGES}, greatest({FEWEST_PAGES}, host_pages // 2 + 1)) AND n > {RATIO}::DOUBLE * host_pages),
cut AS (SELECT r, generate_subscripts(lines, 1) AS i, unnest(lines) AS line, source FROM pages),
kept AS (SELECT c.r, string_agg(c.line, chr(10) ORDER BY c.i) AS text, count(*) AS n FROM cut c
  ANTI JOIN bad b ON c.source IS NOT DISTINCT FROM b.source AND trim(c.line) = b.line GROUP BY c.r)
SELECT p.doc_id, len(p.lines)::BIGINT AS n_lines, (len(p.lines) - coalesce(k.n, 0))::BIGINT AS n_dropped, sha256(coalesce(k.text, '')) AS kept_sha256
FROM pages p LEFT JOIN kept k USING (r)
"""
