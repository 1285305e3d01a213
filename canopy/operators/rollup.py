"""Vector roll-ups from units to files to directories, and reuse of earlier embeddings by content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import vectors as V
from canopy.plans.settle import settled

#: Rounds after which the plan so far is worked out and kept, as each round's plan holds those before it.
SETTLE_ROUNDS = 4


def resolve_cache(units: DataFrame, previous: DataFrame | None, container: Column | None = None) -> DataFrame:
    """units (cache_key, facet_hash, ...) with identity and leaf of the same key and hash from before, and `cached`.

    Containers take only the identity over; what they hold is rolled up anew.
    """
    if previous is None:
        none = F.lit(None).cast("array<double>")
        return units.withColumns({"identity": none, "leaf": none, "cached": F.lit(False)})
    old = previous.select("cache_key", F.col("facet_hash").alias("_h"), F.col("identity").alias("_i"), F.col("leaf").alias("_l"))
    met = units.join(old, "cache_key", "left")
    hit = F.coalesce(F.col("_h") == F.col("facet_hash"), F.lit(False))
    keep_leaf = hit & ~container if container is not None else hit
    return met.withColumns({"identity": F.when(hit, F.col("_i")), "leaf": F.when(keep_leaf, F.col("_l")), "cached": hit}).drop("_h", "_i", "_l")


def blend_units(units: DataFrame) -> DataFrame:
    """units with name, path, description, signature, causes and calls vectors -> identity and leaf."""
    own = V.identity(F.col("name_vec"), F.col("path_vec"), F.col("description_vec"))
    signature = V.signature_signals(F.col("signature_vec"), F.col("causes_vec"), F.col("calls_vec"))
    blended = units.withColumn("_id", own).withColumn("_sig", signature)
    leaf = V.blend(F.col("_id"), F.col("_sig"), 0.5, 0.5)
    fresh = blended.withColumns({"identity": F.coalesce("identity", "_id") if "identity" in units.columns else F.col("_id"), "_leaf": leaf})
    return fresh.withColumn("leaf", F.coalesce("leaf", "_leaf") if "leaf" in units.columns else F.col("_leaf")).drop("_id", "_sig", "_leaf")


def collapse_patterns(units: DataFrame) -> DataFrame:
    """units (file, pattern, leaf) -> one vector a pattern of a file, and the unpatterned ones as they are."""
    held = units.where(~V.is_empty(F.col("leaf")))
    grouped = held.where("coalesce(pattern, '') <> ''").groupBy("file", "pattern").agg(V.centroid(F.col("leaf")).alias("leaf")).select("file", "leaf")
    return held.where("coalesce(pattern, '') = ''").select("file", "leaf").unionByName(grouped)


def file_content(units: DataFrame) -> DataFrame:
    """(file, content): the centroid of a file's representatives, in which outward units count once more."""
    outward = units.where("bound = 'outward'").where(~V.is_empty(F.col("leaf"))).select("file", "leaf")
    return collapse_patterns(units).unionByName(outward).groupBy("file").agg(V.centroid(F.col("leaf")).alias("content"))


def blend_files(files: DataFrame, units: DataFrame) -> DataFrame:
    """files (file, directory, bound, identity, ord) with leaf.

    An inward file holds what its siblings do. Files go in order, and an inward file sees the inward ones before it, so
    the inward files of a directory are resolved one after the other: as many rounds as the most that a directory has.
    """
    content = file_content(units)
    half = lambda c: V.blend(F.col("identity"), F.coalesce(F.col(c), V.empty()), 0.5, 0.5)
    plain = files.where("coalesce(bound, '') <> 'inward'").join(content, "file", "left").withColumn("leaf", half("content")).drop("content")
    inward = files.where("bound = 'inward'").withColumn("_n", F.row_number().over(Window.partitionBy("directory").orderBy("ord")))
    done = plain
    for n in range(1, (inward.agg(F.max("_n")).first()[0] or 0) + 1):
        around = done.where(~V.is_empty(F.col("leaf"))).groupBy("directory").agg(V.centroid(F.col("leaf")).alias("_around"))
        now = inward.where(F.col("_n") == n).drop("_n").join(around, "directory", "left").join(content, "file", "left")
        now = now.withColumn("_c", F.coalesce("_around", "content")).withColumn("leaf", half("_c")).select(*done.columns)
        done = done.unionByName(now)
        if n % SETTLE_ROUNDS == 0:
            done = settled(done)
    return done


def blend_directories(directories: DataFrame, files: DataFrame) -> DataFrame:
    """directories (path, parent, identity) with leaf: half their identity, half the centroid of what they hold, deepest first."""
    depth = F.size(F.split("path", "/"))
    levels = directories.withColumn("_d", depth)
    held = files.where(~V.is_empty(F.col("leaf"))).select(F.col("directory").alias("parent"), "leaf")
    done = None
    spans = levels.agg(F.min("_d"), F.max("_d")).first()
    for level in range(spans[1] or 0, (spans[0] or 1) - 1, -1):
        content = held.groupBy("parent").agg(V.centroid(F.col("leaf")).alias("_c")).withColumnRenamed("parent", "path")
        now = levels.where(F.col("_d") == level).drop("_d").join(content, "path", "left")
        now = now.withColumn("leaf", V.blend(F.col("identity"), F.coalesce("_c", V.empty()), 0.5, 0.5)).drop("_c")
        if (spans[1] - level) % SETTLE_ROUNDS == SETTLE_ROUNDS - 1:
            now = settled(now)
        held = held.unionByName(now.where(~V.is_empty(F.col("leaf"))).select("parent", "leaf"))
        done = now if done is None else done.unionByName(now)
    return done


def keyword_ranking(names: DataFrame, keywords: DataFrame, top: int = 3) -> DataFrame:
    """keywords (keyword, vector) by the sum of their cosines with all names (vector); the sum needs only the names' total.

    With unit vectors the sum of cosines is one dot product with the sum of the names.
    """
    total = names.where(~V.is_empty(F.col("vector"))).agg(V.centroid(V.unit(F.col("vector"))).alias("_m"), F.count("*").alias("_n"))
    ranked = keywords.crossJoin(F.broadcast(total)).withColumn("score", V.dot(V.unit(F.col("vector")), F.col("_m")) * F.col("_n"))
    return ranked.orderBy(F.desc("score"), "keyword").limit(top).select("keyword", "score")


def prune_outliers(vectors: DataFrame, by: str, m: float = 2.0, min_size: int = 3) -> DataFrame:
    """Drop vectors whose cosine with their group's centroid is m deviations below the mean; small groups stay whole."""
    center = vectors.groupBy(by).agg(V.centroid(F.col("vector")).alias("_c"))
    sims = vectors.join(center, by).withColumn("_s", V.cosine(F.col("vector"), F.col("_c")))
    w = Window.partitionBy(by)
    kept = sims.withColumns({"_n": F.count("*").over(w), "_mu": F.avg("_s").over(w), "_sd": F.coalesce(F.stddev_samp("_s").over(w), F.lit(0.0))})
    return kept.where((F.col("_n") < min_size) | (F.col("_s") >= F.col("_mu") - m * F.col("_sd"))).select(*vectors.columns)
