"""Snapshots from a stream of units: each micro-batch reuses the vectors of unchanged units and embeds the others.

The reference surface has no streams; this is an extension over the same cache join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from canopy.functions import text
from canopy.operators.rollup import resolve_cache
from canopy.sources.embed import Embedder, embedded


def upsert(known: DataFrame | None, batch: DataFrame, embed: Embedder) -> DataFrame:
    """The known vectors (cache_key, facet_hash, identity, leaf) with a batch (cache_key, text, seq) of later versions in place."""
    last = batch.groupBy("cache_key").agg(F.max_by("text", "seq").alias("text"))
    last = last.withColumn("facet_hash", text.facet_hash(F.col("text")))
    met = resolve_cache(last, known)
    fresh = embedded(met.withColumn("_send", F.when(F.col("cached"), F.lit("")).otherwise(F.col("text"))), {"_send": "_v"}, embed)
    rows = fresh.select("cache_key", "facet_hash", F.coalesce("identity", "_v").alias("identity"), F.coalesce("leaf", "_v").alias("leaf"))
    return rows if known is None else known.join(rows.select("cache_key"), "cache_key", "left_anti").unionByName(rows)


def keep_vectors(units: DataFrame, folder: str, embed: Embedder, checkpoint: str) -> StreamingQuery:
    """Write the newest vectors of a stream (cache_key, text, seq); `folder/current` names the folder to read.

    A batch that is repeated after a failure writes the same rows again.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = current(spark, folder)
        target = f"{folder}/v{number}-{uuid.uuid4().hex}"
        upsert(known, batch, embed).write.parquet(target)
        spark.createDataFrame([(target,)], "path string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/current")

    return units.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark, folder: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/current")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.parquet(spark.read.parquet(f"{folder}/current").first()["path"])
