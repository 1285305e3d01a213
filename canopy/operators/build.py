"""From parsed units to a scored snapshot: facets, vectors, the node table, score cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.functions import text
from canopy.functions import vectors as V
from canopy.plans.settle import settled
from canopy.sources.embed import Embedder, embedded
from canopy.sources.store import SnapshotStore
from canopy.sources.typescript import FILE, UNIT

from . import rollup, scores, tree

FACETS = ("name", "description", "parent", "path", "signature", "causes", "calls")


def _relative(path: Column, root: str) -> Column:
    return F.regexp_replace(F.substr(path, F.lit(len(root.rstrip("/")) + 1)), "^/", "")


def unit_facets(units: DataFrame, files: DataFrame, root: str, keywords: list[str]) -> DataFrame:
    """units with the seven facet texts, their hash and the cache key."""
    told = files.select("path", F.coalesce("description", F.lit("")).alias("f_parent"))
    held = units.join(told, "path", "left")
    function = F.col("kind") == "function"
    facets = {
        "f_name": F.col("name"),
        "f_description": F.coalesce("description", F.lit("")),
        "f_parent": F.coalesce("f_parent", F.lit("")),
        "f_path": text.path_signal(_relative(F.col("path"), root), keywords),
        "f_signature": F.when(function, text.function_signature(F.col("param_names"), F.col("param_types"), F.col("returns_type"))).otherwise(text.type_signature(F.col("fields"))),
        "f_causes": F.when(function, text.causes_text(F.col("causes"))).otherwise(""),
        "f_calls": F.when(function, text.calls_text(F.col("calls"))).otherwise(""),
    }
    held = held.withColumns(facets)
    short = F.when(function, "func").otherwise("type")
    return held.withColumns({"facet_hash": text.facet_hash(*[F.col(f"f_{f}") for f in FACETS]), "cache_key": text.leaf_cache_key(short, F.col("path"), F.col("name"))})


def container_facets(rows: DataFrame, kind: str, root: str, keywords: list[str]) -> DataFrame:
    role = F.col("borrows.role") if "borrows" in rows.columns else F.lit(None).cast("string")
    name, description = text.with_role(F.col("name"), F.col("description"), role)
    facets = {"f_name": name, "f_description": F.coalesce(description, F.lit("")), "f_path": text.path_signal(_relative(F.col("path"), root), keywords)}
    held = rows.withColumns(facets)
    return held.withColumns({"facet_hash": text.facet_hash(F.col("f_name"), F.col("f_description"), F.col("f_path")), "cache_key": text.container_cache_key(F.lit(kind), F.col("path"))})


def _embedded(rows: DataFrame, facets: tuple[str, ...], embed: Embedder) -> DataFrame:
    """Vectors for the facets of rows that were not cached; empty texts, and all texts of cached rows, are not sent."""
    sent = rows.withColumns({f"s_{f}": F.when(F.col("cached"), F.lit("")).otherwise(F.col(f"f_{f}")) for f in facets})
    return embedded(sent, {f"s_{f}": f"{f}_vec" for f in facets}, embed).drop(*[f"s_{f}" for f in facets])


def embed_units(units: DataFrame, embed: Embedder, previous: DataFrame | None = None) -> DataFrame:
    rows = _embedded(rollup.resolve_cache(units, previous), FACETS, embed)
    rows = rows.withColumn("description_vec", V.with_parent(F.col("description_vec"), F.col("parent_vec")))
    return rollup.blend_units(rows).drop(*[f"{f}_vec" for f in FACETS], *[f"f_{f}" for f in FACETS])


def embed_containers(rows: DataFrame, embed: Embedder, previous: DataFrame | None = None) -> DataFrame:
    own = ("name", "description", "path")
    out = _embedded(rollup.resolve_cache(rows, previous, F.lit(True)), own, embed)
    fresh = V.identity(F.col("name_vec"), F.col("path_vec"), F.col("description_vec"))
    return out.withColumn("identity", F.coalesce("identity", fresh)).drop("leaf", *[f"{f}_vec" for f in own], *[f"f_{f}" for f in own])


def nodes_of(units: DataFrame, files: DataFrame, directories: DataFrame) -> DataFrame:
    """The node table: functions before types in each file, then the file; then directories; flags and patterns settled."""
    none, nothing = F.array().cast("array<string>"), F.lit(None).cast("string")
    unit_depth = F.size(F.split("path", "/"))
    leaf = units.select(
        F.concat_ws(":", F.when(F.col("kind") == "function", "func").otherwise("type"), "path", "name").alias("key"), "kind", "name", "path",
        (F.col("start_line") + F.when(F.col("kind") == "type", 1_000_000).otherwise(0)).cast("long").alias("ord"),
        F.concat(F.lit("file:"), F.col("path")).alias("parent_key"), unit_depth.alias("depth"), "identity", "leaf", F.coalesce("patterns", none).alias("patterns"), nothing.alias("companion"), "util", "helper",
        "exported", "pure", "bound", "residuals", "description", "calls", "returns_type", "param_names", "param_types", "documented_params", "has_return_doc", "causes", "start_line", "end_line", "facet_hash",
    )

    def container(rows: DataFrame, prefix: str, kind: str, base: int) -> DataFrame:
        has = lambda c, other: F.col(c) if c in rows.columns else other
        return rows.select(
            F.concat(F.lit(prefix), F.col("path")).alias("key"), F.lit(kind).alias("kind"), "name", "path", (F.lit(base) + F.conv(F.substring(F.md5("path"), 1, 7), 16, 10).cast("long")).alias("ord"),
            nothing.alias("parent_key"), (unit_depth - 1).alias("depth"), "identity", "leaf", none.alias("patterns"), has("companion", nothing).alias("companion"), has("util", F.lit(False)).alias("util"),
            has("helper", F.lit(False)).alias("helper"), F.lit(True).alias("exported"), F.lit(False).alias("pure"), has("bound", nothing).alias("bound"), "residuals", "description", none.alias("calls"),
            nothing.alias("returns_type"), none.alias("param_names"), none.alias("param_types"), F.lit(0).alias("documented_params"), F.lit(False).alias("has_return_doc"), nothing.alias("causes"),
            F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), "facet_hash",
        )

    every = leaf.unionByName(container(files, "file:", "file", 2_000_000)).unionByName(container(directories, "dir:", "directory", 1_000_000_000))
    every = every.withColumn("hash", text.unit_hash(F.col("facet_hash"), F.col("name"), F.col("path")))
    wired = settled(tree.wire_parents(every, directories))
    flagged = settled(tree.propagate_util(tree.detect_helpers(wired)))
    return settled(tree.lift_patterns(tree.group_patterns(flagged)))


def generate(
    store: SnapshotStore, files: DataFrame, directories: DataFrame, root: str, embed: Embedder, *, model_id: str, keywords: list[str] | None = None, commit: str = "0000000", pin: str | None = None, now_ms: int | None = None
) -> str:
    """Parse results to a written snapshot, reusing the vectors of unchanged units of the active one."""
    words = keywords or []
    units = files.select(F.explode("units").alias("u")).select("u.*")
    cached = store.cache(model_id) or {}
    before = None
    if {"functions", "types"} <= set(cached):
        pick = ("cache_key", "facet_hash", "identity", "leaf")
        before = cached["functions"].select(*pick).unionByName(cached["types"].select(*pick))
    unit_rows = settled(embed_units(unit_facets(units, files, root, words), embed, before))
    old = lambda t: cached[t].select("cache_key", "facet_hash", "identity", "leaf") if t in cached else None
    file_rows = settled(embed_containers(container_facets(files.drop("units", "corrupt"), "file", root, words), embed, old("files")))
    dir_rows = settled(embed_containers(container_facets(directories, "dir", root, words), embed, old("directories")))
    held = unit_rows.select(F.col("path").alias("file"), F.get(F.coalesce("patterns", F.array().cast("array<string>")), 0).alias("pattern"), "bound", "leaf")
    listed = file_rows.withColumns({"file": F.col("path"), "directory": text.parent_path(F.col("path")), "ord": F.xxhash64("path")})
    file_rows = settled(rollup.blend_files(listed, held))
    dir_rows = rollup.blend_directories(dir_rows.withColumn("parent", text.parent_path(F.col("path"))), file_rows.select("directory", "leaf"))
    dir_rows = settled(dir_rows)
    nodes = nodes_of(unit_rows, file_rows, dir_rows)
    tables = {
        "files": file_rows.drop("file", "directory", "ord", "cached"),
        "directories": dir_rows.drop("parent", "cached"),
        "functions": unit_rows.where("kind = 'function'").drop("cached"),
        "types": unit_rows.where("kind = 'type'").drop("cached"),
        "scores": scores.score_cards(nodes),
        "metadata": nodes.sparkSession.createDataFrame([("model_id", model_id), ("commit_hash", commit)], "key string, value string"),
    }
    return store.write(tables, commit=commit, model_id=model_id, pin=pin, now_ms=now_ms)


def rebuild(store: SnapshotStore, snapshot: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Files with their units, and directories, as they were parsed, from a stored snapshot (the active one by default)."""
    shape = T.StructType.fromDDL(f"units array<{UNIT}>")["units"].dataType
    names = shape.elementType.names
    units = store.read("functions", snapshot).unionByName(store.read("types", snapshot), allowMissingColumns=True)
    line = F.struct("start_line", "name", F.struct(*names).cast(shape.elementType).alias("u"))
    held = units.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["u"]).alias("units"))
    files = store.read("files", snapshot).join(held, "path", "left").withColumn("units", F.coalesce("units", F.array().cast(shape)))
    columns = [f.name for f in T.StructType.fromDDL(FILE).fields if f.name != "corrupt"]
    return files.select(*columns), store.read("directories", snapshot).select("path", "name", "children", "description", "util", "borrows", "residuals")
