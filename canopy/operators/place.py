"""Placement: where in the tree a text belongs, with confidence calibrated on the tree's own descriptions.

Routing probabilities of all directories are worked out at once (a group a directory and query); paths then grow level by
level from the start. What is collected on the driver is a handful of rows for one query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.functions import stats
from canopy.functions import vectors as V
from canopy.plans.settle import settled

from . import cluster
from .tree import capability_root, is_leaf, root_key

Embedder = Callable[[list[str]], list[list[float]]]
NEW = "«create-new»"
TOP_PATHS, SHOWN_PATHS, RELATED = 5, 3, 10
SENSITIVITY = 2.0

# The kinds of bridging modules, what they do, and the layer that each is routed to.
BRIDGE_TYPES = [
    ("orchestrator", "Sequences and coordinates multiple pipeline stages, calling into different subsystems in a defined order to produce a combined result", "command"),
    ("processor", "Takes input data from one subsystem and transforms it into output consumed by a different subsystem", "domain"),
    ("presenter", "Converts domain data structures into formatted output for human display in a terminal or interface", "command"),
    ("resolver", "Merges competing configuration sources and input options into a single resolved settings object", "command"),
    ("gateway", "Crosses a system boundary like network, database, or filesystem on behalf of a domain module", "domain"),
    ("adapter", "Converts between two different data formats used by different subsystems", "domain"),
    ("entry-point", "The root dispatcher that boots the application, sets up routing, and delegates to subcommands", "root"),
]


def query_rows(spark: SparkSession, vectors: list[list[float]]) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "qid int, q array<double>")


def routing_children(nodes: DataFrame) -> DataFrame:
    """Rows (parent_key, child, child_name, ord, vector): directories to choose from; util ones only under a util parent."""
    parents = nodes.where("kind = 'directory'").select(F.col("key").alias("_pk"), F.col("util").alias("_pu"))
    child = nodes.where("kind = 'directory'").join(parents, F.col("parent_key") == F.col("_pk")).where("_pu or not util")
    return child.select("parent_key", F.col("key").alias("child"), F.col("name").alias("child_name"), "ord", V.routing(F.col("leaf"), F.col("identity")).alias("vector"))


def choices(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (qid, parent_key, child, child_name, probability); child is null for making a new directory."""
    met = routing_children(nodes).crossJoin(F.broadcast(queries))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("ord", "ascending")])
        vectors = np.array(table["vector"].to_pylist(), float)
        p = cluster.softmax_with_new(cluster.blended_scores(np.array(table["q"][0].as_py(), float), vectors))
        n = len(p)
        return pa.table(
            {
                "qid": pa.array([table["qid"][0].as_py()] * n, pa.int32()),
                "parent_key": pa.array([table["parent_key"][0].as_py()] * n),
                "child": pa.array([*table["child"].to_pylist(), None], pa.string()),
                "child_name": pa.array([*table["child_name"].to_pylist(), NEW], pa.string()),
                "child_ord": pa.array([*range(1, n), 0], pa.int32()),
                "probability": pa.array(p),
            }
        )

    return met.groupBy("qid", "parent_key").applyInArrow(run, "qid int, parent_key string, child string, child_name string, child_ord int, probability double")


def chain_search(nodes: DataFrame, queries: DataFrame, start: DataFrame, top: int = TOP_PATHS) -> DataFrame:
    """Rows (qid, rank, parent_key, parent_name, confidence, depth, trail) of the best paths below the start (one row, key)."""
    names = nodes.select(F.col("key").alias("_k"), F.col("name").alias("parent_name"))
    options = settled(choices(nodes, queries))
    trail = "array<struct<node:string,choice:string,probability:double>>"
    front = queries.select("qid").crossJoin(start.select(F.col("key").alias("parent_key"))).join(names, F.col("parent_key") == F.col("_k")).drop("_k")
    front = front.select("qid", "parent_key", "parent_name", F.lit(0.0).alias("log_prob"), F.lit(0).alias("depth"), F.array().cast(trail).alias("trail"), F.array().cast("array<int>").alias("order"))
    done = None
    for _ in range((nodes.agg(F.max("depth")).first()[0] or 0) + 1):
        met = front.join(options, ["qid", "parent_key"], "left")
        step = F.struct(F.col("parent_name").alias("node"), F.col("child_name").alias("choice"), F.round(F.col("probability") * 100, 1).alias("probability"))
        onward = met.where("child_name is not null and probability > 0").select(
            "qid", "parent_key", "parent_name", "child", "child_name", (F.col("log_prob") + F.log("probability")).alias("log_prob"), "depth",
            F.concat("trail", F.array(step)).alias("trail"), F.concat("order", F.array("child_ord")).alias("order"),
        )
        ended = met.where("child_name is null").select(*front.columns).unionByName(onward.where("child is null").select(*front.columns))
        done = ended if done is None else done.unionByName(ended)
        front = onward.where("child is not null").select("qid", F.col("child").alias("parent_key"), F.col("child_name").alias("parent_name"), "log_prob", (F.col("depth") + 1).alias("depth"), "trail", "order")
        front = settled(front)  # else each level would work out all levels above it again
    done = settled(done)
    mean = F.col("log_prob") / F.greatest("depth", F.lit(1))
    scored = done.withColumn("_m", mean)
    best = scored.groupBy("qid").agg(F.max("_m").alias("_best"))
    scored = scored.join(best, "qid").withColumn("_e", F.exp(F.col("_m") - F.col("_best")))
    total = scored.groupBy("qid").agg(F.sum("_e").alias("_z"))
    ranked = scored.join(total, "qid").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("_m"), "order")))
    return ranked.where(F.col("rank") <= top).select("qid", "rank", "parent_key", "parent_name", (F.col("_e") / F.col("_z")).alias("confidence"), "depth", "trail")


def best_leaf(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (qid, name, similarity): the leaf whose identity is nearest, the first of equals; nothing below 0."""
    leaves = nodes.where(is_leaf(F.col("kind"))).where(~V.is_empty(F.col("identity"))).select("name", "ord", "identity")
    met = leaves.crossJoin(F.broadcast(queries)).select("qid", "name", "ord", V.cosine(F.col("q"), F.col("identity")).alias("similarity"))
    top = met.where("similarity > 0").groupBy("qid").agg(F.max(F.struct("similarity", (-F.col("ord")).alias("_neg"), "name")).alias("_t"))
    return queries.select("qid").join(top, "qid", "left").select("qid", F.coalesce("_t.name", F.lit("")).alias("name"), F.coalesce("_t.similarity", F.lit(0.0)).alias("similarity"))


def axes(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows (qid, classification, domain_fit, capability_fit) over the top directories."""
    top = nodes.where("kind = 'directory'").join(root_key(nodes).select(F.col("key").alias("_r")), F.col("parent_key") == F.col("_r"))
    met = top.crossJoin(F.broadcast(queries)).select("qid", "util", V.cosine(F.col("q"), F.col("identity")).alias("s"))
    best = met.groupBy("qid").agg(F.coalesce(F.max(F.when(~F.col("util"), F.col("s"))), F.lit(0.0)).alias("domain_fit"), F.coalesce(F.max(F.when(F.col("util"), F.col("s"))), F.lit(0.0)).alias("capability_fit"))
    return best.withColumn("classification", F.when(F.col("capability_fit") > F.col("domain_fit"), "capability").otherwise("domain"))


def probes(nodes: DataFrame) -> DataFrame:
    """Rows (parent_key, description): the first described file of each top directory and of its first sub-directory."""
    top = nodes.where("kind = 'directory'").join(root_key(nodes).select(F.col("key").alias("_r")), F.col("parent_key") == F.col("_r")).select("key", "ord")
    sub = nodes.where("kind = 'directory'").join(top.select(F.col("key").alias("parent_key"), F.col("ord").alias("_po")), "parent_key")
    first = sub.groupBy("_po").agg(F.min_by("key", "ord").alias("key")).select("key", F.col("_po").alias("ord"), F.lit(1).alias("_level"))
    places = top.withColumn("_level", F.lit(0)).unionByName(first)
    files = nodes.where("kind = 'file' and coalesce(description, '') <> ''").select(F.col("parent_key").alias("key"), F.col("ord").alias("_fo"), "description")
    found = files.join(places, "key").groupBy("key", "ord", "_level").agg(F.min_by("description", "_fo").alias("description"))
    return found.orderBy("ord", "_level").select(F.col("key").alias("parent_key"), "description")


@dataclass(frozen=True)
class Calibration:
    alien: float = 0.0
    hard_alien: float = 0.0
    gate: float = 0.0
    bridge: float = 0.0
    probe_count: int = 0


def thresholds(similarities: list[float], confidences: list[float]) -> Calibration:
    """Fences of the probes' own similarities and confidences."""

    def lower(x: list[float], k: float) -> float:
        if len(x) < 2:
            return -stats.INF
        v = np.array(x)
        median = np.median(v)
        spread = max(np.median(np.abs(v - median)), (np.percentile(v, 75) - np.percentile(v, 25)) / 2)
        return float(median - k * stats.MAD_SCALE * spread) if spread > 0 else -stats.INF

    gate = lower(confidences, SENSITIVITY) if len(confidences) >= 2 else 0.0
    middle = float(np.median(np.abs(np.array(confidences) - np.median(confidences)))) if len(confidences) >= 2 else 0.0
    return Calibration(lower(similarities, SENSITIVITY), lower(similarities, SENSITIVITY + 1), gate, max(0.0, gate - middle), len(similarities))


def calibrate(nodes: DataFrame, embed: Embedder) -> Calibration:
    texts = [r["description"] for r in probes(nodes).collect()]  # two a top directory at most
    if len(texts) < 2:
        return Calibration()
    queries = query_rows(nodes.sparkSession, embed(texts))
    similar = {r["qid"]: r["similarity"] for r in best_leaf(nodes, queries).collect()}
    sure = {r["qid"]: r["confidence"] for r in chain_search(nodes, queries, root_key(nodes), 1).collect()}
    return thresholds([similar[i] for i in sorted(similar)], [sure[i] for i in sorted(sure)])


def bridge_type(embed: Embedder, q: list[float]) -> dict:
    """The kind of bridging module a query names; confident if it stands out by more than one deviation."""
    sims = [cluster._cosine(np.array(q), np.array(v)) for v in embed([t[1] for t in BRIDGE_TYPES])]
    order = sorted(range(len(sims)), key=lambda i: (-sims[i], i))
    top, second = sims[order[0]], sims[order[1]]
    spread = float(np.std(sims, ddof=1))
    confident = spread > 0 and top - float(np.mean(sims)) > spread and top - second > spread
    alternatives = [{"type": BRIDGE_TYPES[i][0], "similarity": round(sims[i], 4)} for i in order[:SHOWN_PATHS]]
    return {"type": BRIDGE_TYPES[order[0]][0], "layer": BRIDGE_TYPES[order[0]][2], "confidence": top, "gap": top - second, "confident": confident, "alternatives": alternatives}


def _nearest(rows: DataFrame, q: list[float], vector) -> tuple[str, str] | None:
    query = F.array(*[F.lit(float(x)) for x in q])
    found = rows.select("key", "name", "ord", V.cosine(query, vector).alias("s")).where("s > -1").orderBy(F.desc("s"), "ord").limit(1).collect()
    return (found[0]["key"], found[0]["name"]) if found else None


def route_by_layer(nodes: DataFrame, layer: str, q: list[float]) -> tuple[str, str] | None:
    root = nodes.join(root_key(nodes), "key", "left_semi").select("key", "name").first()
    dirs = nodes.where("kind = 'directory'")
    vector = V.routing(F.col("leaf"), F.col("identity"))
    if layer == "root":
        return (root["key"], root["name"]) if root else None
    if layer == "command":
        home = dirs.where("name = 'commands'").orderBy("ord").limit(1).select(F.col("key").alias("parent_key"))
        return _nearest(dirs.join(home, "parent_key", "left_semi"), q, F.col("identity"))
    if layer == "domain" and root:
        best = _nearest(dirs.where((F.col("parent_key") == root["key"]) & ~F.col("util")), q, vector)
        return (_nearest(dirs.where(F.col("parent_key") == best[0]), q, vector) or best) if best else None
    return None


def related(nodes: DataFrame, q: list[float], placement_key: str, k: int = RELATED) -> DataFrame:
    """The k leaves nearest to a query, those of the placement itself left out."""
    query = F.array(*[F.lit(float(x)) for x in q])
    rows = nodes.where(is_leaf(F.col("kind"))).where(~V.is_empty(F.col("identity")) & ~F.col("parent_key").eqNullSafe(F.lit(placement_key)))
    scored = rows.select("name", "kind", F.coalesce("description", F.lit("")).alias("description"), F.col("parent_key").alias("file"), "ord", V.cosine(query, F.col("identity")).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "ord").limit(k)


def place(nodes: DataFrame, text: str, embed: Embedder, calibration: Calibration | None = None) -> dict:
    """Axis, detection, suggestion, best paths, bridge and related units for one text."""
    if not root_key(nodes).take(1):
        raise ValueError("the tree has no root directory")
    cal = calibration or calibrate(nodes, embed)
    q = [float(x) for x in embed([text])[0]]
    queries = query_rows(nodes.sparkSession, [q])
    axis, leaf = axes(nodes, queries).first(), best_leaf(nodes, queries).first()
    start = root_key(nodes)
    if axis and axis["classification"] == "capability" and (home := capability_root(nodes)).take(1):
        start = home
    paths = [r.asDict(True) for r in chain_search(nodes, queries, start).orderBy("rank").collect()]
    top = paths[0]
    gap = top["confidence"] - paths[1]["confidence"] if len(paths) > 1 else 1.0
    makes_new = any(t["choice"] == NEW for t in top["trail"])
    alien = leaf["similarity"] < cal.hard_alien or (leaf["similarity"] < cal.alien and top["confidence"] < cal.gate)
    described = {r["key"]: (r["description"] or "").split("\n")[0] for r in nodes.where(F.col("key").isin([p["parent_key"] for p in paths])).select("key", "description").collect()}
    near = lambda rows: [{"name": p["parent_name"], "description": described.get(p["parent_key"], ""), "confidence": round(100 * p["confidence"], 1)} for p in rows[:SHOWN_PATHS]]
    bridge = None
    if alien or makes_new:
        known = [p for p in paths if not any(t["choice"] == NEW for t in p["trail"])]
        suggestion = {
            "action": "ask-user", "method": "probe-alien-detection" if alien else "level-alien-detection", "reason": "nothing in the tree is like this text",
            "best_leaf": {"name": leaf["name"], "similarity": round(leaf["similarity"], 4)}, "neighborhoods": near(known),
        }
    elif top["confidence"] < cal.bridge:
        bridge = bridge_type(embed, q)
        route = route_by_layer(nodes, bridge["layer"], q) if bridge["confident"] else None
        if route:
            suggestion = {"action": "add-to-directory", "target": route[0], "name": route[1], "method": "bridge-type-routing", "bridge_type": bridge["type"], "bridge_layer": bridge["layer"]}
        else:
            reason = "no place for this layer" if bridge["confident"] else f"uncertain bridge type {bridge['type']}"
            suggestion = {"action": "ask-user", "method": "bridge-escalation", "reason": reason, "bridge_type": bridge["type"], "candidates": near(paths)}
    elif top["confidence"] < cal.gate:
        suggestion = {"action": "ask-user", "method": "safety-gate", "reason": f"low confidence ({100 * top['confidence']:.1f}%)", "neighborhoods": near(paths)}
    else:
        suggestion = {"action": "add-to-directory", "target": top["parent_key"], "name": top["parent_name"], "method": "chain-search"}
    target = suggestion.get("target", top["parent_key"])
    return {
        "query": text,
        "query_vector": q,
        "axis": axis.asDict() if axis else None,
        "detection": {"alien_fence": cal.alien, "probe_count": cal.probe_count, "best_leaf": leaf.asDict(), "chain_gap": round(100 * gap, 1), "global_alien": alien, "level_alien": top["parent_name"] if makes_new else None},
        "suggestion": suggestion,
        "confidence": round(100 * top["confidence"], 1),
        "top_paths": paths[:SHOWN_PATHS],
        "bridge": bridge,
        "related": [r.asDict() for r in related(nodes, q, target).collect()],
    }
