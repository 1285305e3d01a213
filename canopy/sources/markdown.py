"""A search index over Markdown pages: sections, headings, breadcrumbs, all in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import text as X

SECTION, LAST_SECTION = 300, 500


def split_front_matter(content: Column) -> tuple[Column, Column]:
    """(front matter, body)."""
    matter = F.regexp_extract(content, r"(?s)^---\s*\n(.*?)\n---", 1)
    return matter, F.regexp_replace(content, r"(?s)^---\s*\n.*?\n---", "")


def front_value(matter: Column, key: str) -> Column:
    return F.trim(F.regexp_extract(matter, rf"(?m)^{key}:\s*(.*)$", 1))


def breadcrumbs(key: Column) -> Column:
    """The folders of a page's key, as titles; null for a page at the top."""
    parts = F.filter(F.split(key, "/"), lambda s: s != "")
    return F.when(F.size(parts) > 1, F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda s: F.initcap(F.regexp_replace(s, "-", " "))))


def sections(pages: DataFrame) -> DataFrame:
    """pages (path, content) -> (path, place, heading, heading_id, content).

    A heading of the second level begins a section; one that looks like code begins none and drops what follows it.
    """
    lines = pages.withColumn("_body", split_front_matter(F.col("content"))[1]).select("path", F.posexplode(F.split("_body", "\n")).alias("line", "text"))
    heading = F.regexp_extract("text", r"^##\s+(.+)", 1)
    lines = lines.withColumn("_h", F.when(F.col("text").rlike(r"^##\s+.+"), X.strip_markdown(F.trim(heading))))
    by_page = Window.partitionBy("path").orderBy("line")
    lines = lines.withColumn("place", F.sum(F.col("_h").isNotNull().cast("int")).over(by_page))
    held = lines.groupBy("path", "place").agg(
        F.max("_h").alias("heading"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_h").isNull(), F.struct("line", "text")))), lambda x: x["text"]), "\n").alias("raw"),
    )
    code = F.coalesce(F.col("heading").rlike(r"^[a-z].*[A-Z]|_|`"), F.lit(False))
    last = F.max("place").over(Window.partitionBy("path"))
    held = held.withColumn("_last", F.col("place") == last)
    plain = held.where(~code & (F.trim(F.regexp_replace("raw", r"\s+", " ")) != ""))
    cut = F.when(F.col("_last"), F.substring(X.strip_markdown(F.col("raw")), 1, LAST_SECTION)).otherwise(F.substring(X.strip_markdown(F.col("raw")), 1, SECTION))
    return plain.select("path", "place", "heading", X.slug(F.col("heading")).alias("heading_id"), cut.alias("content"))


def search_index(pages: DataFrame) -> DataFrame:
    """One row a page: key, url, title, description, breadcrumbs and sections in order."""
    matter = split_front_matter(F.col("content"))[0]
    key = F.regexp_replace(F.regexp_replace("path", r"\.mdx?$", ""), r"(?:^|/)index$", "")
    facts = pages.select("path", key.alias("key"), front_value(matter, "title").alias("title"), front_value(matter, "description").alias("description"))
    parts = sections(pages).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("place", "heading", "heading_id", "content"))).alias("sections"))
    url = F.when(F.col("key") == "", F.lit("/docs")).otherwise(F.concat(F.lit("/docs/"), F.col("key")))
    return facts.join(parts, "path", "left").select("path", "key", url.alias("url"), "title", "description", breadcrumbs(F.col("key")).alias("breadcrumbs"), "sections")
