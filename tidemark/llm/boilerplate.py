"""Site-relative line deduplication, with DataFrame functions only.

A line is boilerplate of a host if more than ``max_ratio`` of the host's pages, and at least
``min_pages`` of them, contain it. Boilerplate lines are dropped from all pages of that host; other
hosts keep them. Lines are compared by a 64-bit hash of their exact text; lines without a word
are never boilerplate. Each page counts once for each of its lines.

A host has at most (mean lines per page) / max_ratio boilerplate lines. Where all hosts' lines together
are at most ``broadcast_lines`` (counted first), they go to all tasks and pages are cleaned without
being moved; beyond that, pages meet their own lines in joins on (host, line) and on the page, so a
host with a third of all pages spreads over tasks in both.

A null host is a host of its own. A null text has no lines and stays null; an empty text stays
empty. Very long texts are cleaned whole, and each of their lines counts once. Repeated rows are pages
each. Other columns are kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import table, written

MAX_RATIO, MIN_PAGES, BROADCAST_LINES = 0.1, 5, 100_000
WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, line (hash), pages, host_pages of every boilerplate line."""
    site = F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("\0")).alias("host")
    pages = docs.select(site, "text")
    hashes = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(x)))
    seen = pages.select("host", F.explode(hashes).alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    return seen.join(totals, "host").where(F.col("pages") > max_ratio * F.col("host_pages"))


def counted(
    spark: SparkSession,
    docs: DataFrame,
    host: str = "source",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """row (a struct of all columns of ``docs``, with boilerplate lines taken out of ``text``), n_lines and n_dropped."""
    lines = written(boilerplate(docs, host, max_ratio, min_pages), spark)
    few = lines.count() <= broadcast_lines
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("text").alias("whole"),
        F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("\0")).alias("host"),
    )
    if few:
        by_host = lines.groupBy("host").agg(F.collect_set("line").alias("drop"))
        marked = rows.join(F.broadcast(by_host), "host", "left")
    else:
        rows = rows.withColumn("rid", F.xxhash64("host", "whole"))
        held = rows.select("host", "rid", F.explode(F.array_distinct(F.transform(_lines(F.col("whole")), lambda x: F.xxhash64(x)))).alias("line"))
        hits = held.join(lines.select("host", "line"), ["host", "line"], "left_semi").distinct().groupBy("rid").agg(F.collect_set("line").alias("drop"))
        marked = rows.join(hits, "rid", "left")
    none = F.array().cast("array<bigint>")
    split = marked.select("row", "whole", F.coalesce("drop", none).alias("drop"), _lines(F.col("whole")).alias("lines"))
    kept = split.withColumn("kept", F.when(F.size("drop") > 0, F.filter("lines", lambda x: ~F.array_contains(F.col("drop"), F.xxhash64(x)))).otherwise(F.col("lines")))
    text = F.when(F.size("kept") < F.size("lines"), F.array_join("kept", "\n")).otherwise(F.col("whole"))
    return kept.select(
        F.struct(*(text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns)).alias("row"),
        F.when(F.col("whole").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("whole").isNull(), 0).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
    )


def cleaned(spark: SparkSession, docs: DataFrame, host: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """The rows and columns of ``docs`` without boilerplate lines in ``text``."""
    return counted(spark, docs, host, max_ratio, min_pages).select("row.*")


def op3_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counted(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("row.doc_id", "n_lines", "n_dropped", "row.text")


ORACLE = r"""
WITH l AS (
  SELECT doc_id, coalesce(source, chr(0)) AS host, text, string_split(text, chr(10)) AS ls FROM documents),
seen AS (
  SELECT host, line, count(*) AS pages
  FROM (SELECT host, unnest(list_distinct(ls)) AS line FROM l) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY host, line),
totals AS (SELECT host, count(*) AS host_pages FROM l GROUP BY host),
b AS (
  SELECT host, list(line) AS drops FROM seen JOIN totals USING (host)
  WHERE pages >= 5 AND pages > 0.1 * host_pages GROUP BY host),
k AS (
  SELECT doc_id, text, ls, CASE WHEN drops IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(drops, x)) END AS kept
  FROM l LEFT JOIN b USING (host))
SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped,
       CASE WHEN len(kept) < len(ls) THEN coalesce(array_to_string(kept, chr(10)), '') ELSE text END AS text
FROM k
"""
