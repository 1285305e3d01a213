"""Score cards: fit, uniqueness, best uncle, subtree and overall health of every node."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import vectors as V
from canopy.plans.settle import settled

from .blocks import Group, over_groups
from .tree import eligible_children, is_leaf


SETTLE_LEVELS = 4


def _inward():
    return F.col("bound").eqNullSafe(F.lit("inward"))


def fit(nodes: DataFrame) -> DataFrame:
    """Rows (key, fit): how well a node sits with its parent; null without a parent or for a util container under another."""
    parents = nodes.select(F.col("key").alias("_pk"), F.col("identity").alias("_pi"), F.col("util").alias("_pu"))
    joined = nodes.join(parents, F.col("parent_key") == F.col("_pk"), "left")
    plain = joined.where(~_inward())
    absent = F.col("_pk").isNull() | (F.col("util") & ~is_leaf(F.col("kind")) & ~F.col("_pu"))
    usual = F.when(absent, F.lit(None)).when(V.is_empty(F.col("_pi")) | V.is_empty(F.col("leaf")), F.lit(1.0)).otherwise(V.cosine(F.col("_pi"), F.col("leaf")))
    out = plain.select("key", usual.alias("fit"))
    inward = joined.where(_inward())
    siblings = nodes.where(~F.col("util") & ~_inward() & ~V.is_empty(F.col("identity"))).groupBy(F.col("parent_key").alias("_sp")).agg(V.centroid(F.col("identity")).alias("_c"))
    met = inward.join(siblings, F.col("parent_key") == F.col("_sp"), "left")
    between = F.when(absent, F.lit(None)).when(V.is_empty(F.col("_pi")) | V.is_empty(F.col("leaf")) | F.col("_c").isNull(), F.lit(1.0)).otherwise(V.cosine(F.col("_c"), F.col("identity")))
    return out.unionByName(met.select("key", between.alias("fit")))


def children_fit(nodes: DataFrame) -> DataFrame:
    """Rows (key, children_fit) of containers: their identity against what they hold."""
    either = V.is_empty(F.col("identity")) | V.is_empty(F.col("leaf"))
    return nodes.where(~is_leaf(F.col("kind"))).select("key", F.when(either, F.lit(1.0)).otherwise(V.cosine(F.col("identity"), F.col("leaf"))).alias("children_fit"))


def _deltas(nodes: DataFrame) -> DataFrame:
    """Eligible children with the unit vector from their parent's identity to theirs."""
    children = eligible_children(nodes).where(~V.is_empty(F.col("identity")))
    parents = nodes.where(~V.is_empty(F.col("identity"))).select(F.col("key").alias("_pk"), F.col("identity").alias("_pi"))
    joined = children.join(parents, F.col("parent_key") == F.col("_pk"))
    return joined.select("key", "name", "ord", "kind", "bound", "parent_key", V.unit(V.subtract(F.col("identity"), F.col("_pi"))).alias("delta"))


def uniqueness(nodes: DataFrame) -> DataFrame:
    """Rows (key, uniqueness): mean distance to the siblings; 2 where there is none to compare.

    With unit vectors the mean cosine to the others is (u . sum of all - u . u) / (n - 1): no pairs are formed.
    """
    d = _deltas(nodes)
    sums = d.groupBy("parent_key").agg(F.count("*").alias("_n"), V.centroid(F.col("delta")).alias("_mean")).where("_n > 1")
    u = F.col("delta")
    near = (V.dot(u, F.col("_mean")) * F.col("_n") - V.dot(u, u)) / (F.col("_n") - 1)
    means = d.join(sums, "parent_key").select("key", (1 - near).alias("uniqueness"))
    return nodes.select("key").join(means, "key", "left").select("key", F.coalesce("uniqueness", F.lit(V.NO_SIBLINGS)).alias("uniqueness"))


def _distances(group: Group) -> list[dict]:
    """One row: how many distances a group's rows have here, their sum and sum of squares, and the least with its two rows."""
    n, total, squares, least = 0, 0.0, 0.0, None
    for rows, product, wanted in group.tiles():
        if not wanted.any():
            continue
        distance = 1 - product
        held = distance[wanted]
        n, total, squares = n + held.size, total + float(held.sum()), squares + float(held @ held)
        i, j = np.unravel_index(int(np.argmin(np.where(wanted, np.round(distance, 12), np.inf))), distance.shape)
        found = (round(float(distance[i, j]), 12), int(rows[i]), int(rows[0] + j))
        least = found if least is None else min(least, found)
    if not n:
        return []
    name, order = group.table["name"], group.table["ord"]
    worst = {"distance": least[0], "a_ord": order[least[1]].as_py(), "b_ord": order[least[2]].as_py(), "a_name": name[least[1]].as_py(), "b_name": name[least[2]].as_py()}
    return [{"key": group.table["parent_key"][0].as_py(), "n": n, "total": total, "squares": squares, "worst": worst}]


def children_uniqueness(nodes: DataFrame) -> DataFrame:
    """Rows (key, children_uniqueness, worst_a, worst_b): evenness of the children's distances, and the nearest two.

    Outward children count only where there are no others.
    """
    outward = F.col("bound").eqNullSafe(F.lit("outward"))
    only_outward = eligible_children(nodes).groupBy("parent_key").agg(F.bool_and(outward).alias("_only"))
    held = _deltas(nodes).join(only_outward, "parent_key").where(F.col("_only") | ~outward)
    schema = "key string, n long, total double, squares double, worst struct<distance:double,a_ord:long,b_ord:long,a_name:string,b_name:string>"
    parts = over_groups(held.select("parent_key", "key", "name", "ord", F.col("delta").alias("vector")), "parent_key", _distances, schema)
    sums = parts.groupBy("key").agg(F.sum("n").alias("_n"), F.sum("total").alias("_t"), F.sum("squares").alias("_q"), F.min("worst").alias("_w"))
    mu = F.col("_t") / F.col("_n")
    spread = F.when(F.col("_n") > 1, F.sqrt(F.greatest((F.col("_q") - F.col("_t") * mu) / (F.col("_n") - 1), F.lit(0.0)))).otherwise(0.0)
    even = F.when(mu == 0, F.lit(0.0)).otherwise(1 / (1 + spread / mu))
    return sums.select("key", even.alias("children_uniqueness"), F.col("_w.a_name").alias("worst_a"), F.col("_w.b_name").alias("worst_b"))


def best_uncle(nodes: DataFrame) -> DataFrame:
    """Rows (key, best_uncle, best_uncle_score): the parent's sibling whose identity fits the node's leaf best, the first of equals."""
    parents = nodes.select(F.col("key").alias("_pk"), F.col("parent_key").alias("_gk"), F.col("companion").alias("_pc"))
    child = nodes.where(~V.is_empty(F.col("leaf"))).select("key", "parent_key", "leaf").join(parents, F.col("parent_key") == F.col("_pk")).where("_gk is not null")
    uncles = nodes.where(~V.is_empty(F.col("identity"))).select(
        F.col("key").alias("_uk"), F.col("parent_key").alias("_gk"), F.col("name").alias("_un"), F.col("identity").alias("_ui"), F.col("ord").alias("_uo"), F.col("companion").alias("_uc")
    )
    met = child.join(uncles, "_gk").where((F.col("_uk") != F.col("parent_key")) & (F.col("_uc").isNull() | ~F.col("_uc").eqNullSafe(F.col("_pc"))))
    scored = met.select("key", "_un", "_uo", V.cosine(F.col("_ui"), F.col("leaf")).alias("_s"))
    top = scored.groupBy("key").agg(F.max(F.struct("_s", (-F.col("_uo")).alias("_neg"), "_un")).alias("_t"))
    return top.select("key", F.col("_t._un").alias("best_uncle"), F.col("_t._s").alias("best_uncle_score"))


def closure(nodes: DataFrame) -> DataFrame:
    """Rows (top, key): every non-util container below each container, reached through non-util containers, and itself."""
    inner = nodes.where(~is_leaf(F.col("kind"))).select("key", "parent_key", "util")
    step = inner.where(~F.col("util")).select(F.col("parent_key").alias("_p"), F.col("key").alias("_c"))
    front = inner.select(F.col("key").alias("top"), "key")
    found = front
    for n in range(nodes.agg(F.max("depth")).first()[0] or 0):
        if n % SETTLE_LEVELS == SETTLE_LEVELS - 1:  # a deep tree's plan would hold every level many times over
            front, found = settled(front), settled(found)
        front = front.join(step, F.col("key") == F.col("_p")).select("top", F.col("_c").alias("key"))
        found = found.union(front)
    return found


def score_cards(nodes: DataFrame) -> DataFrame:
    """All metrics of every node; uniqueness is 2 where there is nothing to compare."""
    base = nodes.select("key", "kind", "name", "util").join(fit(nodes), "key", "left").join(uniqueness(nodes), "key", "left")
    own = F.when(F.col("fit").isNull() | (F.col("uniqueness") == V.NO_SIBLINGS), F.lit(None))
    own = own.otherwise(V.harmonic_mean(V.unitize_cosine(F.col("fit")), V.unitize_distance(F.col("uniqueness"))))
    base = base.withColumn("score", own)
    with_children = eligible_children(nodes).select(F.col("parent_key").alias("key")).distinct()
    cv = with_children.join(children_uniqueness(nodes), "key")
    cv = cv.withColumn("children_uniqueness", F.when(F.col("children_uniqueness") != V.NO_SIBLINGS, F.col("children_uniqueness")))
    base = base.join(children_fit(nodes), "key", "left").join(cv, "key", "left")
    known = F.col("children_uniqueness").isNotNull()
    base = base.withColumn("children_score", F.when(known & F.col("children_fit").isNotNull(), V.harmonic_mean(V.unitize_cosine(F.col("children_fit")), F.col("children_uniqueness"))))

    values = base.where(F.col("kind") != "pattern").select("key", F.col("children_fit").alias("_f"), F.col("children_uniqueness").alias("_u"))
    below = closure(nodes).where("top <> key").join(values, "key").groupBy(F.col("top").alias("key")).agg(F.avg("_f").alias("_bf"), F.avg("_u").alias("_bu"))
    base = base.join(below, "key", "left")
    container = ~is_leaf(F.col("kind"))
    base = base.withColumn("subtree_fit", F.when(container, F.coalesce("_bf", "children_fit"))).withColumn("subtree_uniqueness", F.when(container, F.col("_bu"))).drop("_bf", "_bu")
    both = F.col("subtree_fit").isNotNull() & F.col("subtree_uniqueness").isNotNull()
    base = base.withColumn("subtree_score", F.when(both, V.harmonic_mean(V.unitize_cosine(F.col("subtree_fit")), F.col("subtree_uniqueness"))))
    overall = F.when(F.col("score").isNull(), F.col("subtree_score")).when(F.col("subtree_score").isNull(), F.col("score")).otherwise(V.harmonic_mean(F.col("score"), F.col("subtree_score")))
    return base.withColumn("overall_score", overall).join(best_uncle(nodes), "key", "left").drop("util")


def score_deltas(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Change of each score against a former snapshot; 0 where either is missing. The subtree's change is that of its fit."""
    old = previous.select("key", F.col("overall_score").alias("_o"), F.col("score").alias("_s"), F.col("children_score").alias("_c"), F.col("subtree_fit").alias("_f"))
    joined = current.join(old, "key", "left")
    change = lambda a, b: F.coalesce(F.col(a) - F.col(b), F.lit(0.0))
    return joined.select(
        "key",
        change("overall_score", "_o").alias("overall_delta"),
        change("score", "_s").alias("self_delta"),
        change("children_score", "_c").alias("children_delta"),
        change("subtree_fit", "_f").alias("subtree_delta"),
    )


def ranked(cards: DataFrame, limit: int = 20) -> DataFrame:
    """The report's rows: lowest overall score first; 0 for all."""
    ordered = cards.orderBy(F.col("overall_score").asc_nulls_last(), "key")
    return ordered.limit(limit) if limit else ordered


def top_of_group(rows: DataFrame, by: str, order: list, limit: int) -> DataFrame:
    n = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(n)).where(F.col("_n") <= limit).drop("_n")
