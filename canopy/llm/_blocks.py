"""Groups of any size, compared in blocks.

A group of more than `most` members is dealt into blocks by a hash of the member, and each pair of blocks (and each block
with itself) becomes a group of its own, so that every two members still meet in one task and no task holds more than two
blocks. Members of a group of n are copied about n / most times; a group within the bound is one block and copies none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_blocks(members: DataFrame, blocks: Column, by: Column) -> DataFrame:
    """members with columns block, left and right; rows of one key that share (left, right) are to be compared."""
    own = F.pmod(F.xxhash64(by, F.lit(7)), blocks).cast("int")
    dealt = members.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
    return dealt.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")}).drop("other")
