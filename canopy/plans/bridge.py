"""The vector tree: a deterministic four-level tree over the `embeddings` table, in Spark and (for comparison) in SQL.

root -> one directory a label -> five files -> one unit a vector. A unit's identity and leaf vectors are the halves of its
embedding; a container's are the centroids of its children's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import text, vectors

ROOT = "dir:root"
RESIDUALS = "array<struct<audit:string,hash:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _half(first: int) -> Column:
    return F.slice("embedding", first, 32).cast("array<double>")


def unit_rows(embeddings: DataFrame) -> DataFrame:
    """The leaves, with every column of the node schema that the vectors can stand for."""
    v = F.col("vec_id")
    directory = F.concat(F.lit("root/L"), F.col("label").cast("string"))
    path = F.concat(directory, F.lit("/F"), (v % 5).cast("string"))
    kind = F.when(v % 7 == 0, "type").otherwise("function")
    name = F.concat(F.lit("v"), v.cast("string"))
    none = F.array().cast("array<string>")
    return embeddings.select(
        F.concat(F.when(kind == "type", "type:").otherwise("func:"), path, F.lit(":"), name).alias("key"),
        kind.alias("kind"),
        name.alias("name"),
        path.alias("path"),
        v.cast("long").alias("ord"),
        F.concat(F.lit("file:"), path).alias("parent_key"),
        F.lit(3).alias("depth"),
        _half(1).alias("identity"),
        _half(33).alias("leaf"),
        F.when(v % 4 == 0, F.array(F.concat(F.lit("P"), (v % 13).cast("string")))).otherwise(none).alias("patterns"),
        F.lit(None).cast("string").alias("companion"),
        (F.col("label") == 9).alias("util"),
        (v % 11 == 0).alias("helper"),
        (v % 3 != 0).alias("exported"),
        (v % 2 == 0).alias("pure"),
        F.when(v % 29 == 0, "outward").alias("bound"),
        F.when(v % 17 == 0, F.array(F.struct(F.lit("merge-candidates").alias("audit"), F.lit(None).cast("string").alias("hash")))).otherwise(F.array().cast(RESIDUALS)).alias("residuals"),
        F.when(v % 5 != 1, F.concat(F.lit("unit "), name)).alias("description"),
        F.array(F.concat(F.lit("v"), (v + 50).cast("string"))).alias("calls"),
        F.when(v % 6 == 0, F.concat(F.lit("v"), (v + 7).cast("string"))).otherwise("void").alias("returns_type"),
        F.array(F.lit("x"), F.lit("y")).alias("param_names"),
        F.array(F.lit("number"), F.concat(F.lit("v"), (v - 7).cast("string"))).alias("param_types"),
        (v % 3).cast("int").alias("documented_params"),
        (v % 4 == 1).alias("has_return_doc"),
    )


def _containers(children: DataFrame, kind: str, prefix: str, depth: int, base: int, util: Column, key: Column) -> DataFrame:
    """Parents of children, whose vectors are centroids."""
    means = children.groupBy("parent_key").agg(
        vectors.centroid(F.col("identity")).alias("identity"), vectors.centroid(F.col("leaf")).alias("leaf"), F.min("ord").alias("_first"), F.bool_and("util").alias("_util")
    )
    path = text.strip_key_prefix(F.col("parent_key"))
    none = F.array().cast("array<string>")
    nothing = F.lit(None).cast("string")
    return means.select(
        F.col("parent_key").alias("key"),
        F.lit(kind).alias("kind"),
        text.base_name(path).alias("name"),
        path.alias("path"),
        key.cast("long").alias("ord"),
        (F.concat(F.lit("dir:"), text.parent_path(path)) if depth else nothing).alias("parent_key"),
        F.lit(depth).alias("depth"),
        "identity",
        "leaf",
        none.alias("patterns"),
        nothing.alias("companion"),
        util.alias("util"),
        F.lit(False).alias("helper"),
        F.lit(True).alias("exported"),
        F.lit(False).alias("pure"),
        nothing.alias("bound"),
        F.array().cast(RESIDUALS).alias("residuals"),
        F.when(F.lit(kind == "directory"), F.concat(F.lit("about "), path)).alias("description"),
        none.alias("calls"),
        nothing.alias("returns_type"),
        none.alias("param_names"),
        none.alias("param_types"),
        F.lit(0).alias("documented_params"),
        F.lit(False).alias("has_return_doc"),
    )


_KEPT: dict[tuple[str, str], DataFrame] = {}


def vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes, kept in memory and on disk for the session; ord: units by vec_id, then files, the root, the directories."""
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _KEPT:
        _KEPT[known] = build_tree(spark, sf_dir)
    return _KEPT[known].persist()


def build_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = unit_rows(table(spark, sf_dir, "embeddings"))
    number = F.regexp_extract(F.col("parent_key"), r"L(\d+)", 1).cast("long")
    file_number = F.regexp_extract(F.col("parent_key"), r"F(\d+)$", 1).cast("long")
    files = _containers(units, "file", "file:", 2, 0, F.col("_util"), 1_000_000_000 + number * 5 + file_number)
    directories = _containers(files, "directory", "dir:", 1, 0, F.col("_util"), 2_000_000_001 + number)
    root = _containers(directories, "directory", "dir:", 0, 0, F.lit(False), F.lit(2_000_000_000))
    return units.unionByName(files).unionByName(directories).unionByName(root)


#: The same nodes in SQL: nodes(key, kind, name, path, ord, parent_key, depth, identity, leaf, ...).
NODES_SQL = """
units AS (
  SELECT (CASE WHEN vec_id % 7 = 0 THEN 'type:' ELSE 'func:' END) || 'root/L' || label || '/F' || (vec_id % 5) || ':v' || vec_id AS key,
    CASE WHEN vec_id % 7 = 0 THEN 'type' ELSE 'function' END AS kind, 'v' || vec_id AS name,
    'root/L' || label || '/F' || (vec_id % 5) AS path, vec_id AS ord, 'file:root/L' || label || '/F' || (vec_id % 5) AS parent_key, 3 AS depth,
    embedding[1:32]::DOUBLE[] AS identity, embedding[33:64]::DOUBLE[] AS leaf, label = 9 AS util, vec_id % 11 = 0 AS helper,
    CASE WHEN vec_id % 29 = 0 THEN 'outward' END AS bound, vec_id % 17 = 0 AS unmerged, CASE WHEN vec_id % 4 = 0 THEN 'P' || (vec_id % 13) END AS pattern,
    'v' || (vec_id + 50) AS callee, CASE WHEN vec_id % 6 = 0 THEN 'v' || (vec_id + 7) ELSE 'void' END AS returns_type, 'v' || (vec_id - 7) AS param_type
  FROM embeddings
),
file_cells AS (
  SELECT parent_key AS key, i, avg(identity[i]) AS a, avg(leaf[i]) AS b FROM (SELECT *, unnest(generate_series(1, 32)) AS i FROM units) GROUP BY parent_key, i
),
file_vectors AS (SELECT key, list(a ORDER BY i) AS identity, list(b ORDER BY i) AS leaf FROM file_cells GROUP BY key),
files AS (
  SELECT v.key, substr(v.key, 6) AS path, identity, leaf, u.util, 'dir:' || regexp_extract(v.key, 'root/L[0-9]+') AS parent_key,
    1000000000 + regexp_extract(v.key, 'L([0-9]+)', 1)::BIGINT * 5 + regexp_extract(v.key, 'F([0-9]+)$', 1)::BIGINT AS ord
  FROM file_vectors v JOIN (SELECT parent_key, bool_and(util) AS util FROM units GROUP BY parent_key) u ON u.parent_key = v.key
),
dir_cells AS (
  SELECT parent_key AS key, i, avg(identity[i]) AS a, avg(leaf[i]) AS b FROM (SELECT *, unnest(generate_series(1, 32)) AS i FROM files) GROUP BY parent_key, i
),
dir_vectors AS (SELECT key, list(a ORDER BY i) AS identity, list(b ORDER BY i) AS leaf FROM dir_cells GROUP BY key),
dirs AS (
  SELECT v.key, substr(v.key, 5) AS path, identity, leaf, u.util, 'dir:root' AS parent_key, 2000000001 + regexp_extract(v.key, 'L([0-9]+)', 1)::BIGINT AS ord
  FROM dir_vectors v JOIN (SELECT parent_key, bool_and(util) AS util FROM files GROUP BY parent_key) u ON u.parent_key = v.key
),
root_cells AS (SELECT i, avg(identity[i]) AS a, avg(leaf[i]) AS b FROM (SELECT *, unnest(generate_series(1, 32)) AS i FROM dirs) GROUP BY i),
root AS (SELECT list(a ORDER BY i) AS identity, list(b ORDER BY i) AS leaf FROM root_cells),
nodes AS (
  SELECT key, kind, name, path, ord, parent_key, depth, identity, leaf, util, helper, bound, unmerged, pattern, callee, returns_type, param_type FROM units
  UNION ALL SELECT key, 'file', regexp_extract(key, 'F[0-9]+$'), path, ord, parent_key, 2, identity, leaf, util, false, NULL, false, NULL, NULL, NULL, NULL FROM files
  UNION ALL SELECT key, 'directory', regexp_extract(key, 'L[0-9]+$'), path, ord, parent_key, 1, identity, leaf, util, false, NULL, false, NULL, NULL, NULL, NULL FROM dirs
  UNION ALL SELECT 'dir:root', 'directory', 'root', 'root', 2000000000, NULL, 0, identity, leaf, false, false, NULL, false, NULL, NULL, NULL, NULL FROM root
)
"""
