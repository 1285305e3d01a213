"""Work on all pairs within groups, without rows for the pairs.

Groups of more than BLOCK_ROWS rows (the 10,000 largest of them, which is a fixed bound for the broadcast) are dealt into
blocks by a hash of the row, and every two blocks meet in one task; a row is copied once for each block of its group. Other
groups share tasks, and are gone through one after the other there. Within a task products are worked out in tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS = 2_000
TILE = 2_000
MOST_SPLIT = 10_000


class Group:
    """The rows of one group in a task, in their order, as Arrow columns and a matrix of unit vectors."""

    def __init__(self, table: pa.Table, across: bool):
        self.table, self.across = table, across
        self.block = table["_block"].to_numpy()
        vectors = table["vector"].combine_chunks()
        width = len(vectors[0]) if len(vectors) else 0
        self.matrix = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def column(self, name: str) -> list:
        return self.table[name].to_pylist()

    def tiles(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, product, wanted): cosines of some rows with all that follow, and which pairs are met here."""
        n = len(self.matrix)
        for start in range(0, n, TILE):
            rows = np.arange(start, min(start + TILE, n))
            product = np.clip(self.matrix[rows] @ self.matrix[start:].T, -1.0, 1.0)
            wanted = np.arange(start, n)[None, :] > rows[:, None]
            if self.across:  # pairs within a block are met where both sides are that block
                wanted &= self.block[rows][:, None] != self.block[start:][None, :]
            yield rows, product, wanted


def over_groups(rows: DataFrame, group: str, work: Callable[[Group], list[dict]], schema: str) -> DataFrame:
    """work's rows of every group of rows (group, key, ord, vector of length one, ...); a large group is seen in pairs of blocks."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rows.sparkSession
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    sizes = rows.groupBy(group).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_blocks")).where("_blocks > 1")
    split = F.broadcast(sizes.orderBy(F.desc("_blocks"), group).limit(MOST_SPLIT))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.join(split, group, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    shared = F.concat(F.lit("shared task "), F.pmod(F.xxhash64(group), F.lit(tasks)).cast("string"))
    dealt = dealt.withColumns(
        {"_task": F.when(F.col("_blocks") == 1, shared).otherwise(F.col(group).cast("string")), "_left": F.least("_block", "_other"), "_right": F.greatest("_block", "_other")}
    )

    def run(table: pa.Table) -> pa.Table:
        out: list[dict] = []
        across = table["_left"][0].as_py() != table["_right"][0].as_py()
        table = table.sort_by([(group, "ascending"), ("ord", "ascending")])
        runs = table[group].combine_chunks().dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero(np.diff(runs, prepend=-1, append=-2))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1:
                out += work(Group(table.slice(a, b - a), across))
        return pa.Table.from_pylist(out, kinds)

    return dealt.drop("_blocks", "_other").groupBy("_task", "_left", "_right").applyInArrow(run, schema)
