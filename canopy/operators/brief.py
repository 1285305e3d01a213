"""A brief: what to read before adding something, as ranked facets around a placement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import text as X
from canopy.functions import vectors as V

from .place import Calibration, Embedder, place
from .tree import ancestors, is_leaf

CAPS = {"siblings": 5, "utilities": 3, "symbols": 5, "related": 3, "ancestors": 3, "pattern_members": 3, "companion_members": 2}


def _near(rows: DataFrame, q: list[float], vector, k: int) -> DataFrame:
    query = F.array(*[F.lit(float(x)) for x in q])
    return rows.withColumn("similarity", V.cosine(query, vector)).orderBy(F.desc("similarity"), "ord").limit(k)


def _facet(rows: DataFrame, *more: str) -> DataFrame:
    signature = F.when(F.col("kind") == "function", X.callable_signature(F.col("param_names"), F.col("param_types"), F.col("returns_type"))).otherwise("")
    start = F.coalesce("start_line", F.lit(1)) if "start_line" in rows.columns else F.lit(1)
    end = F.coalesce("end_line", F.lit(1)) if "end_line" in rows.columns else F.lit(1)
    pure = F.when(F.col("kind") == "function", F.col("pure")).otherwise(False)
    return rows.select(
        "key", "name", "kind", F.coalesce("parent_key", F.lit("")).alias("file"), start.alias("start_line"), end.alias("end_line"), F.trim(F.coalesce("description", F.lit(""))).alias("description"),
        signature.alias("signature"), "helper", pure.alias("pure"), "exported", "patterns", "companion", "ord", *more,
    )


def symbols(nodes: DataFrame, q: list[float], placement_key: str, k: int = CAPS["symbols"]) -> DataFrame:
    """Non-util leaves nearest to the query, outside the placement."""
    rows = nodes.where(is_leaf(F.col("kind")) & ~F.col("util") & ~V.is_empty(F.col("identity")) & ~F.col("parent_key").eqNullSafe(F.lit(placement_key)))
    return _facet(_near(rows, q, F.col("identity"), k), "similarity")


def utilities(nodes: DataFrame, q: list[float], k: int = CAPS["utilities"]) -> DataFrame:
    rows = nodes.where(is_leaf(F.col("kind")) & F.col("util") & ~V.is_empty(F.col("identity")))
    return _facet(_near(rows, q, F.col("identity"), k), "similarity")


def siblings(nodes: DataFrame, q: list[float], placement_key: str, k: int = CAPS["siblings"]) -> DataFrame:
    rows = nodes.where((F.col("parent_key") == placement_key) & (F.col("kind") != "pattern"))
    return _near(rows, q, V.routing(F.col("leaf"), F.col("identity")), k).select("key", "name", "kind", F.trim(F.coalesce("description", F.lit(""))).alias("description"), "similarity", "ord")


def members(nodes: DataFrame, anchors: DataFrame, by: str, k: int) -> DataFrame:
    """Nodes that share a pattern tag (or a companion) with an anchor: in the anchors' order, each once, not the anchors."""
    groups = anchors.withColumn("anchor_ord", F.row_number().over(Window.orderBy(F.desc("similarity"), "ord"))).select(F.col("name").alias("anchor"), "anchor_ord", by)
    if by == "patterns":
        groups = groups.select("anchor", "anchor_ord", F.posexplode("patterns").alias("tag_ord", "tag"))
        held = nodes.select(*nodes.columns, F.explode("patterns").alias("tag"))
    else:
        groups = groups.where("companion is not null").select("anchor", "anchor_ord", F.lit(0).alias("tag_ord"), F.col("companion").alias("tag"))
        held = nodes.withColumn("tag", F.col("companion"))
    met = held.join(F.broadcast(groups), "tag").join(F.broadcast(anchors.select("key")), "key", "left_anti")
    first = met.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("anchor_ord", "tag_ord"))).where("_n = 1")
    top = first.orderBy("anchor_ord", "tag_ord", "ord").limit(k)
    return _facet(top, "anchor", "tag", "anchor_ord", "tag_ord")


def brief(nodes: DataFrame, text: str, embed: Embedder, caps: dict[str, int] | None = None, calibration: Calibration | None = None) -> dict:
    """The placement (a dict) and seven facets (DataFrames)."""
    cap = CAPS | (caps or {})
    placed = place(nodes, text, embed, calibration)
    if placed["suggestion"]["action"] == "add-to-directory":
        target = placed["suggestion"]["target"]
    else:
        first = placed["top_paths"][0]["parent_key"]
        row = nodes.where(F.col("key") == first).select("parent_key").first()
        target = row["parent_key"] if row and row["parent_key"] else first
    q = placed["query_vector"]
    near = symbols(nodes, q, target, cap["symbols"])
    up = ancestors(nodes.where(~is_leaf(F.col("kind")))).where(F.col("key") == target).select(F.col("ancestor").alias("_a"), "distance")
    lineage = nodes.join(up, F.col("key") == F.col("_a")).orderBy("distance").limit(cap["ancestors"]).select("name", "key", "distance", F.trim(F.coalesce("description", F.lit(""))).alias("description"))
    seen = near.select("file", "name", "kind")
    spark = nodes.sparkSession
    schema = "name string, kind string, description string, file string, ord long, similarity double"
    rel = spark.createDataFrame([tuple(r[c] for c in ("name", "kind", "description", "file", "ord", "similarity")) for r in placed["related"]], schema)
    rel = rel.join(seen, ["file", "name", "kind"], "left_anti").orderBy(F.desc("similarity"), "ord").limit(cap["related"])
    return {
        "query": text,
        "placement": placed["suggestion"] | {"path": target, "confidence": placed["confidence"]},
        "ancestors": lineage,
        "siblings": siblings(nodes, q, target, cap["siblings"]),
        "utilities": utilities(nodes, q, cap["utilities"]),
        "symbols": near,
        "related": rel,
        "pattern_members": members(nodes, near, "patterns", cap["pattern_members"]),
        "companion_members": members(nodes, near, "companion", cap["companion_members"]),
    }
