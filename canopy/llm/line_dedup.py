"""Line dedup by site-relative frequency.

A line is boilerplate on a host if two pages or more contain it and their share of the host's pages exceeds a ratio; hosts
of every size are judged alike. Lines are counted by their MD5 digest (16 bytes, partial counts before the shuffle), so long
lines are not moved. A host of average a lines a page has at most a / ratio boilerplate lines, which bounds the array that
each host's pages are filtered with; the table of these arrays is broadcast only if its measured size is small. Beyond that
only hosts of many pages, a thousand of them at most, are joined by broadcast, and the others by a shuffle, so that no host's
pages gather in one task.

Defined cases: a null text stays null and has no lines; blank lines are kept and not counted; a line repeated in one page
counts once for that page; repeated rows count as pages of their own; a null host is a host like any other; a page may be
left with an empty text. Other columns pass through unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import HOT_ROWS, staged

RATIO = 0.1
BROADCAST_ROWS = 200_000
HOT_HOSTS = 1_000
SALTS = 16


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(pages: DataFrame, *, host: Column, text: Column, ratio: float = RATIO) -> DataFrame:
    """Rows (host, digest, n_with, n_pages) of the lines that exceed the ratio on their host."""
    source = pages.select(host.alias("host"), text.cast("string").alias("text"))
    # A host's total goes to each salt of its lines, which are dealt by digest: a host's lines need not meet.
    totals = source.groupBy("host").agg(F.count("*").alias("n_pages")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    distinct = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: x != ""), _digest))
    lines = source.where(F.col("text").isNotNull()).select("host", F.explode(distinct).alias("digest"))
    counts = lines.groupBy("host", "digest").agg(F.count("*").alias("n_with")).where(F.col("n_with") > 1)
    counts = counts.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int"))
    found = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")) & (F.col("c.salt") == F.col("t.salt")))
    return found.where(F.col("n_with") / F.col("n_pages") > ratio).select("c.host", "digest", "n_with", "n_pages")


def drop_boilerplate(pages: DataFrame, *, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, counts: bool = False) -> DataFrame:
    """pages with the boilerplate lines taken out of text_col; with counts, also n_lines and n_dropped."""
    found = staged(boilerplate(pages, host=F.col(f"`{host_col}`"), text=F.col(f"`{text_col}`"), ratio=ratio), "boilerplate")
    by_host = found.groupBy("host", "n_pages").agg(F.collect_set("digest").alias("common"))
    whole = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"))
    same = F.col(f"row.`{host_col}`").eqNullSafe(F.col("host"))
    if found.count() <= BROADCAST_ROWS:
        parts = [whole.join(F.broadcast(by_host), same, "left")]
    else:
        many = F.col("n_pages") > max(HOT_ROWS, pages.count() // HOT_HOSTS)  # HOT_HOSTS hosts at most
        hot = F.broadcast(by_host.where(many))
        rest = whole.join(hot.select("host"), same, "left_anti")
        parts = [whole.join(hot, same), rest.join(by_host.where(~many), same, "left")]
    lines = _lines(F.col(f"row.`{text_col}`").cast("string"))
    kept = F.filter(lines, lambda x: (x == "") | ~F.array_contains(F.col("common"), _digest(x)))
    parts = [p.select("row", lines.alias("lines"), F.when(F.col("common").isNull(), lines).otherwise(kept).alias("kept")) for p in parts]
    columns = [F.array_join("kept", "\n").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in pages.columns]
    if counts:
        n_lines, n_kept = F.coalesce(F.size("lines"), F.lit(0)), F.coalesce(F.size("kept"), F.lit(0))
        columns += [n_lines.cast("long").alias("n_lines"), (n_lines - n_kept).cast("long").alias("n_dropped")]
    return reduce(DataFrame.union, [p.select(*columns) for p in parts])


def line_dedup_report(documents: DataFrame) -> DataFrame:
    """The digest of op9: line counts and a hash of what is left of each document (null for a null text)."""
    cleaned = drop_boilerplate(documents.select("doc_id", "source", "text"), counts=True)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT source, count(*) AS n_pages FROM pages GROUP BY source),
lines AS (SELECT source, unnest(list_distinct(list_filter(lines, lambda x: x <> ''))) AS line FROM pages WHERE text IS NOT NULL),
counts AS (SELECT source, line, count(*) AS n_with FROM lines GROUP BY source, line),
common AS (
  SELECT c.source, list(c.line) AS common FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n_with > 1 AND c.n_with * 1.0 / t.n_pages > {RATIO} GROUP BY c.source
),
kept AS (
  SELECT doc_id, text, lines,
    CASE WHEN common IS NULL THEN lines ELSE list_filter(lines, lambda x: x = '' OR NOT list_contains(common, x)) END AS kept
  FROM pages p LEFT JOIN common b ON p.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, (coalesce(len(lines), 0) - coalesce(len(kept), 0))::BIGINT AS n_dropped,
  CASE WHEN text IS NULL THEN NULL ELSE sha256(array_to_string(kept, chr(10))) END AS kept_sha256
FROM kept
"""
