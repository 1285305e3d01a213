"""Robust statistics over groups: medians, quartiles, spreads and fences, as aggregates joined by group."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.plans.settle import settled

MAD_SCALE = 1.4826
INF = float("inf")


def deviation(x: Column) -> Column:
    """Aggregate: sample deviation, 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def z_fences(x: Column, k: float | Column) -> tuple[Column, Column]:
    """Aggregates: mean minus and plus k deviations; infinite for fewer than two values."""
    few = F.count(x) < 2
    spread = F.lit(k) * F.stddev_samp(x) if not isinstance(k, Column) else k * F.stddev_samp(x)
    return F.when(few, F.lit(-INF)).otherwise(F.avg(x) - spread), F.when(few, F.lit(INF)).otherwise(F.avg(x) + spread)


class Ordered:
    """The values of a column in order, over all rows: exact values by rank, without gathering them in one task.

    Distinct values with their counts are ranged over partitions; the driver learns each partition's total only.
    """

    def __init__(self, rows: DataFrame, value: str):
        counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
        self.parts = settled(counted.repartitionByRange("v").withColumn("p", F.spark_partition_id()))
        self.first, self.n = {}, 0
        for r in self.parts.groupBy("p").agg(F.sum("c").alias("c")).orderBy("p").collect():
            self.first[r["p"]], self.n = self.n, self.n + r["c"]
        self.known: dict[int, float] = {}

    def at(self, *ranks: int) -> list[float]:
        """The values of some ranks, from 0."""
        if missing := sorted(set(ranks) - set(self.known)):
            homes = {r: max(p for p, f in self.first.items() if f <= r) for r in missing}
            upto = F.sum("c").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
            wanted = [(F.col("p") == p) & (F.col("upto") > r - self.first[p]) & (F.col("upto") - F.col("c") <= r - self.first[p]) for r, p in homes.items()]
            found = self.parts.where(F.col("p").isin(list(homes.values()))).withColumn("upto", upto).where(reduce(or_, wanted)).collect()
            for x in found:
                end = self.first[x["p"]] + x["upto"]
                self.known |= {r: x["v"] for r in missing if end - x["c"] <= r < end}
        return [self.known[r] for r in ranks]

    def quantile(self, q: float) -> float | None:
        """By linear interpolation between ranks."""
        if not self.n:
            return None
        place = q * (self.n - 1)
        low, high = self.at(math.floor(place), math.ceil(place))
        return low + (place - math.floor(place)) * (high - low)


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with their number, from 1, in an order of all rows: ranged over partitions, whose sizes are all that the driver learns."""
    held = settled(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    first, n = [], 0
    for r in held.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect():
        first.append((r["_p"], n))
        n += r["n"]
    before = F.broadcast(rows.sparkSession.createDataFrame(first, "_p int, _before long"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return held.join(before, "_p").withColumn("number", place + F.col("_before")).drop("_p", "_before")


def _left_out(ordered: Ordered, own: Column, q: float) -> tuple[Column, list[float]]:
    """The quantile of all values but one's own, and what it can be.

    Without a value, each rank from its own on holds what the next rank held.
    """
    place = q * (ordered.n - 2)
    low, high = math.floor(place), math.ceil(place)
    a, b, c, d = ordered.at(low, low + 1, high, high + 1)
    share = place - low
    below, above = F.when(own <= a, F.lit(b)).otherwise(F.lit(a)), F.when(own <= c, F.lit(d)).otherwise(F.lit(c))
    return below + F.lit(share) * (above - below), sorted({x + share * (y - x) for x in (a, b) for y in (c, d)})


def robust(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, n, median, q1, q3, mad, spread: exact quantiles, then those of the distances from the median.

    Groups are gathered one by one; over all rows values are found by rank.
    """
    x = F.col(value)
    rows = rows.where(x.isNotNull())
    if by:
        first = rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile(x, F.lit(0.5)).alias("median"), F.percentile(x, F.lit(0.25)).alias("q1"), F.percentile(x, F.lit(0.75)).alias("q3"))
        mad = rows.join(first.select(*by, "median"), by).groupBy(*by).agg(F.percentile(F.abs(x - F.col("median")), F.lit(0.5)).alias("mad"))
        both = first.join(mad, by)
    else:
        ordered = Ordered(rows, value)
        middle = ordered.quantile(0.5)
        away = Ordered(rows.select(F.abs(x - F.lit(middle)).alias("away")), "away") if ordered.n else ordered
        found = (ordered.n, middle, ordered.quantile(0.25), ordered.quantile(0.75), away.quantile(0.5))
        both = rows.sparkSession.createDataFrame([found], "n long, median double, q1 double, q3 double, mad double")
    spread = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.greatest("mad", (F.col("q3") - F.col("q1")) / 2))
    return both.withColumn("spread", spread)


def robust_fences(stats: DataFrame, k: float) -> DataFrame:
    """stats of robust() with lower and upper: median plus and minus k scaled spreads; infinite without spread."""
    flat = (F.col("n") < 2) | (F.col("spread") == 0)
    reach = F.lit(k * MAD_SCALE) * F.col("spread")
    return stats.withColumns(
        {"lower": F.when(flat, F.lit(-INF)).otherwise(F.col("median") - reach), "upper": F.when(flat, F.lit(INF)).otherwise(F.col("median") + reach)}
    )


def pooled_floor(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """One row: lower quartile of all distances from the group medians; 0 for fewer than three."""
    medians = rows.groupBy(*by).agg(F.percentile(F.col(value), F.lit(0.5)).alias("_m"))
    away = Ordered(rows.join(medians, by).select(F.abs(F.col(value) - F.col("_m")).alias("away")), "away")
    return rows.sparkSession.createDataFrame([(away.quantile(0.25) if away.n >= 3 else 0.0,)], "floor double")


def leave_one_out(rows: DataFrame, key: str, value: str, k: float) -> DataFrame:
    """For each row, the robust upper fence of all other rows; infinite with fewer than two others or without spread."""
    ordered, own = Ordered(rows, value), F.col(value)
    if ordered.n < 3:
        return rows.select(key, F.lit(INF).alias("upper"))
    median, can_be = _left_out(ordered, own, 0.5)
    mad = F.lit(None).cast("double")
    for m in can_be:  # four medians at most
        away = Ordered(rows.select(F.abs(own - F.lit(m)).alias("away")), "away")
        mad = F.when(F.col("_m") == F.lit(m), _left_out(away, F.abs(own - F.lit(m)), 0.5)[0]).otherwise(mad)
    half = (_left_out(ordered, own, 0.75)[0] - _left_out(ordered, own, 0.25)[0]) / 2
    spread = F.greatest(mad, half)
    return rows.withColumn("_m", median).select(key, F.when(spread == 0, F.lit(INF)).otherwise(F.col("_m") + F.lit(k * MAD_SCALE) * spread).alias("upper"))


def softmax_with_new(scores: DataFrame, score: str, by: list[str]) -> DataFrame:
    """Probability of each child and of making a new one, whose score is the mean plus the deviation of the others."""
    x = F.col(score)
    group = scores.groupBy(*by).agg(F.count("*").alias("_n"), F.avg(x).alias("_mu"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("_sd"), F.max(x).alias("_max"))
    group = group.withColumns({"_t": F.greatest(1 / F.greatest(F.col("_n"), F.lit(1)), F.lit(0.01)), "_new": F.col("_mu") + F.col("_sd")})
    group = group.withColumn("_max", F.greatest("_max", "_new"))
    rows = scores.join(group, by)
    rows = rows.withColumn("_e", F.exp((x - F.col("_max")) / F.col("_t")))
    total = rows.groupBy(*by).agg((F.sum("_e") + F.max(F.exp((F.col("_new") - F.col("_max")) / F.col("_t")))).alias("_z"))
    out = rows.join(total, by).withColumn("probability", F.col("_e") / F.col("_z"))
    out = out.withColumn("new_probability", F.exp((F.col("_new") - F.col("_max")) / F.col("_t")) / F.col("_z"))
    return out.drop("_n", "_mu", "_sd", "_max", "_t", "_new", "_e", "_z")
