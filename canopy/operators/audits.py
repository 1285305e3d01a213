"""The audits: each finds nodes that stand out against the tree's own distributions.

An audit is a function of a Context that returns findings; register more with @audit. The report is their union in order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import stats
from canopy.functions import vectors as V
from canopy.plans.settle import settled, tidied

from . import cluster, pairs
from .pairs import suppressed
from .ranked import ranked_pairs
from .tree import eligible_children, is_leaf

FINDING = ["audit", "key", "name", "hash", "parent_key", "pair_key", "pair_name", "value", "group_value", "delta", "fence", "ord"]
TYPES = {"value": "double", "group_value": "double", "delta": "double", "fence": "double", "ord": "long"}


@dataclass(frozen=True)
class Audit:
    name: str
    title: str
    detect: Callable[[Context], DataFrame]
    describe: Column


REGISTRY: dict[str, Audit] = {}


def audit(name: str, title: str, describe: Callable[[], Column] | None = None):
    def register(detect: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
        REGISTRY[name] = Audit(name, title, detect, describe or (lambda: F.col("name")))
        return detect

    return register


class Context:
    """A tree, a sensitivity, and what several audits share, each worked out once."""

    def __init__(self, nodes: DataFrame, k: float = 2.0, disabled: frozenset[str] = frozenset()):
        self.nodes, self.k, self.disabled = pairs.with_hash(nodes), k, disabled

    @cached_property
    def sibling_stats(self) -> DataFrame:
        return pairs.sibling_stats(self.nodes)

    @cached_property
    def level_fences(self) -> DataFrame:
        return pairs.fences_by_level(self.sibling_stats, self.k)

    @cached_property
    def fences(self) -> dict[str, float]:
        found = {r["level"]: r["fence"] for r in self.level_fences.collect()}  # two scalars
        return {level: found.get(level, stats.INF) for level in ("leaf", "file")}

    @cached_property
    def outliers(self) -> DataFrame:
        return outliers(self)


def finding(audit_name: str, rows: DataFrame, /, *, also: Sequence[str] = (), **columns: Column) -> DataFrame:
    have = {"audit": F.lit(audit_name)} | columns
    return rows.select(*also, *[(have[c] if c in have else F.col(c) if c in rows.columns else F.lit(None)).cast(TYPES.get(c, "string")).alias(c) for c in FINDING])


def _upper(rows: DataFrame, value: str, k: float) -> DataFrame:
    return F.broadcast(rows.agg(stats.z_fences(F.col(value), k)[1].alias("fence")))


@audit("incomplete-docs", "Incomplete docs")
def incomplete_docs(ctx: Context) -> DataFrame:
    """Nodes that lack a description, documented parameters, a documented result, or a word on purity."""
    blank = F.coalesce(F.trim("description"), F.lit("")) == ""
    params = F.size("param_names")
    causes = F.col("causes") if "causes" in ctx.nodes.columns else F.lit(None)
    function = F.col("kind") == "function"
    missing = F.array(
        F.when(function & blank, "description"),
        F.when(function & (params > 0) & (F.col("documented_params") < params), F.concat((params - F.col("documented_params")).cast("string"), F.lit("/"), params.cast("string"), F.lit(" @param"))),
        F.when(function & (F.col("returns_type") != "void") & (F.col("returns_type") != "") & ~F.col("has_return_doc"), "@returns"),
        F.when(function & ~F.col("pure") & causes.isNull(), "purity or causes"),
        F.when(F.col("kind").isin("type", "file") & blank, "description"),
        F.when((F.col("kind") == "directory") & blank, "description (manifest)"),
    )
    rows = ctx.nodes.withColumn("missing", F.array_compact(missing)).where((F.size("missing") > 0) & ~suppressed(F.col("residuals"), F.col("hash"), "incomplete-docs"))
    return finding("incomplete-docs", rows, pair_name=F.array_join("missing", ", "))


@audit("focal-drift", "Focal drift")
def focal_drift(ctx: Context) -> DataFrame:
    """Outward nodes whose similarity to the parent's content another child beats."""
    parents = ctx.nodes.select(F.col("key").alias("_pk"), F.col("leaf").alias("_pl"))
    children = ctx.nodes.where(~V.is_empty(F.col("leaf")) & ~F.col("util") & ~F.col("helper") & ~F.col("bound").eqNullSafe(F.lit("inward")))
    sims = children.join(parents, F.col("parent_key") == F.col("_pk")).select("key", "name", "hash", "parent_key", "bound", "ord", V.cosine(F.col("_pl"), F.col("leaf")).alias("sim"))
    top = sims.groupBy(F.col("parent_key").alias("_tp")).agg(F.max(F.struct("sim", (-F.col("ord")).alias("_neg"), "name")).alias("_t"))
    rows = sims.where("bound = 'outward'").join(top, F.col("parent_key") == F.col("_tp"))
    rows = rows.where((F.col("_t.sim") > F.col("sim")) & (F.col("_t.name") != F.col("name")))
    return finding("focal-drift", rows, value=F.col("_t.sim") - F.col("sim"), pair_name=F.col("_t.name"))


def _label_fits(ctx: Context, util: bool) -> DataFrame:
    counts = ctx.nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("_pk")).agg(F.count("*").alias("children")).where("children >= 2")
    rows = ctx.nodes.where(~is_leaf(F.col("kind")) & (F.col("kind") != "pattern") & (F.col("util") == util) & ~V.is_empty(F.col("identity")) & ~V.is_empty(F.col("leaf")))
    return rows.join(counts, F.col("key") == F.col("_pk")).withColumn("label_fit", V.cosine(F.col("identity"), F.col("leaf")))


def _incoherent(ctx: Context, util: bool, name: str) -> DataFrame:
    rows = _label_fits(ctx, util)
    middle = stats.Ordered(rows, "label_fit").quantile(0.5)
    low = rows.agg(F.least(stats.z_fences(F.col("label_fit"), ctx.k)[0], F.lit(middle).cast("double")).alias("_fence"))
    flagged = rows.crossJoin(F.broadcast(low)).where((F.col("label_fit") < F.col("_fence")) & ~suppressed(F.col("residuals"), F.col("hash"), name))
    return finding(name, flagged, value=F.col("label_fit"), fence=F.col("_fence"))


@audit("incoherent", "Incoherent")
def incoherent(ctx: Context) -> DataFrame:
    return _incoherent(ctx, False, "incoherent")


def sibling_means(ctx: Context) -> DataFrame:
    """Rows (parent_key, part, key, ..., mean_sim): each comparable child's mean similarity to the others of its part.

    With unit vectors the mean over the others is (u . sum of all - 1) / (n - 1): no pairs are formed.
    """
    parents = ctx.nodes.where(~is_leaf(F.col("kind")) & ~F.col("util")).select(F.col("key").alias("_pk"), F.col("kind").alias("_kind"))
    children = ctx.nodes.where(~F.col("util") & ~F.col("helper") & F.col("bound").isNull() & ~V.is_empty(F.col("leaf"))).join(parents, F.col("parent_key") == F.col("_pk"))
    part = F.when((F.col("_kind") == "file") & (F.col("kind") == "type"), "type").otherwise("rest")
    rows = children.select("parent_key", part.alias("part"), "key", "name", "hash", "residuals", "ord", V.unit(F.col("leaf")).alias("u"))
    sums = rows.groupBy("parent_key", "part").agg(F.count("*").alias("_n"), V.centroid(F.col("u")).alias("_mean")).where("_n >= 3")
    own = F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)
    return rows.join(sums, ["parent_key", "part"]).withColumn("mean_sim", (V.dot(F.col("u"), F.col("_mean")) * F.col("_n") - own) / (F.col("_n") - 1)).drop("u", "_mean")


@audit("outliers", "Outliers")
def outliers(ctx: Context) -> DataFrame:
    """Children far below their siblings' median mean similarity, measured by the wider of the group's and the pooled spread."""
    means = sibling_means(ctx)
    local = stats.robust(means, "mean_sim", ["parent_key", "part"])
    floor = F.broadcast(stats.pooled_floor(means, "mean_sim", ["parent_key", "part"]))
    group = means.groupBy("parent_key", "part").agg(F.avg("mean_sim").alias("group_mean"))
    rows = means.join(local.select("parent_key", "part", "median", "spread"), ["parent_key", "part"]).join(group, ["parent_key", "part"]).crossJoin(floor)
    fence = F.col("median") - F.lit(ctx.k * stats.MAD_SCALE) * F.greatest("spread", "floor")
    rows = rows.withColumn("_fence", fence).where((F.col("mean_sim") < F.col("_fence")) & ~suppressed(F.col("residuals"), F.col("hash"), "outliers"))
    return finding("outliers", rows, value=F.col("mean_sim"), group_value=F.col("group_mean"), fence=F.col("_fence"))


@audit("duplicates", "Duplicates")
def duplicates(ctx: Context) -> DataFrame:
    return _told_finding("duplicates", pairs.duplicates(ctx.nodes, ctx.fences["leaf"], ctx.fences["file"], told=True))


def _told_finding(name: str, rows: DataFrame) -> DataFrame:
    told = {"key": "a", "pair_key": "b", "pair_name": "b_name", "value": "similarity"} | {c: f"a_{c}" for c in ("name", "hash", "parent_key", "ord")}
    return finding(name, rows, **{c: F.col(x) for c, x in told.items()})


def _pair_finding(name: str, rows: DataFrame, a: str, b: str) -> DataFrame:
    return finding(
        name,
        rows,
        key=F.col(f"{a}.key"),
        name=F.col(f"{a}.name"),
        hash=F.col(f"{a}.hash"),
        parent_key=F.col(f"{a}.parent_key"),
        pair_key=F.col(f"{b}.key"),
        pair_name=F.col(f"{b}.name"),
        value=F.col("similarity"),
        ord=F.col(f"{a}.ord"),
    )


def containment_gaps(ctx: Context) -> DataFrame:
    """Rows (key, top, gap): how far the child most like its parent is ahead of the next independent one."""
    parents = ctx.nodes.where(~is_leaf(F.col("kind")) & ~F.col("util") & (F.col("kind") != "pattern") & ~V.is_empty(F.col("leaf"))).select(
        F.col("key").alias("_pk"), F.col("leaf").alias("_pl")
    )
    children = ctx.nodes.where(~F.col("util") & ~F.col("helper") & ~V.is_empty(F.col("leaf"))).join(parents, F.col("parent_key") == F.col("_pk"))
    side = F.struct(V.cosine(F.col("_pl"), F.col("leaf")).alias("sim"), (-F.col("ord")).alias("neg"), "key", "name", "kind", "returns_type", "param_types", "bound")
    sims = children.select("parent_key", side.alias("c"))
    tops = sims.groupBy("parent_key").agg(F.max("c").alias("t"))
    others = sims.join(tops, "parent_key").where((F.col("c.key") != F.col("t.key")) & ~pairs.type_and_producer("c", "t"))
    second = others.groupBy("parent_key", "t").agg(F.max("c.sim").alias("second"), (F.count("*") + 1).alias("independent"))
    return second.select(
        "parent_key", F.col("t.key").alias("dominant"), F.col("t.name").alias("dominant_name"), F.col("t.bound").alias("dominant_bound"), F.col("t.sim").alias("top"), "second", "independent", (F.col("t.sim") - F.col("second")).alias("gap")
    )


@audit("containments", "Containments")
def containments(ctx: Context) -> DataFrame:
    gaps = containment_gaps(ctx)
    lower = stats.robust_fences(stats.robust(gaps, "top", []), ctx.k).select(F.when(F.col("lower") == -stats.INF, F.lit(0.0)).otherwise(F.col("lower")).alias("_floor"))
    rows = gaps.crossJoin(_upper(gaps, "gap", ctx.k)).crossJoin(F.broadcast(lower)).where((F.col("gap") > F.col("fence")) & (F.col("top") > F.col("_floor")))
    rows = rows.where(~F.col("dominant_bound").eqNullSafe(F.lit("outward")))
    own = ctx.nodes.select("key", "name", "hash", "residuals", "ord")
    rows = rows.join(own, F.col("parent_key") == F.col("key")).where(~suppressed(F.col("residuals"), F.col("hash"), "containments"))
    return finding("containments", rows, parent_key=F.lit(None), pair_key=F.col("dominant"), pair_name=F.col("dominant_name"), value=F.col("gap"))


@audit("incoherent-utils", "Incoherent utils")
def incoherent_utils(ctx: Context) -> DataFrame:
    return _incoherent(ctx, True, "incoherent-utils")


@audit("util-duplicates", "Util duplicates")
def util_duplicates(ctx: Context) -> DataFrame:
    return _told_finding("util-duplicates", pairs.util_duplicates(ctx.nodes, ctx.fences["leaf"], told=True))


def misplacement(ctx: Context) -> DataFrame:
    """Rows of containers and the directories, beside any of their ancestors, that fit them better than the parent."""
    from .tree import ancestors

    nodes = ctx.nodes
    parents = nodes.where("parent_key is not null").select(F.col("key").alias("_pk"), F.col("identity").alias("_pi"), F.col("companion").alias("_pc"))
    moved = nodes.where(~is_leaf(F.col("kind")) & ~F.col("util") & (F.col("kind") != "pattern")).join(parents, F.col("parent_key") == F.col("_pk"))
    moved = moved.withColumn("parent_fit", V.cosine(F.col("_pi"), F.col("leaf")))
    above = ancestors(nodes)
    over = nodes.select(F.col("key").alias("ancestor"), F.col("parent_key").alias("_gk"))
    places = nodes.where("kind = 'directory'").select(F.col("key").alias("uncle"), F.col("parent_key").alias("_gk"), F.col("identity").alias("_ui"), F.col("companion").alias("_uc"))
    met = moved.join(above, "key").join(over, "ancestor").join(places, "_gk").where("uncle <> ancestor")
    met = met.where(F.col("_pc").isNull() | ~F.col("_uc").eqNullSafe(F.col("_pc"))).withColumn("uncle_fit", V.cosine(F.col("_ui"), F.col("leaf")))
    return met.where("uncle_fit > parent_fit").withColumn("delta", F.col("uncle_fit") - F.col("parent_fit"))


@audit("misplaced", "Misplaced")
def misplaced(ctx: Context) -> DataFrame:
    raw = misplacement(ctx)
    strict, loose = stats.z_fences(F.col("delta"), ctx.k)[1].alias("fence"), stats.z_fences(F.col("delta"), ctx.k / 2)[1].alias("_loose")
    rows = raw.crossJoin(F.broadcast(raw.agg(strict, loose)))
    if "outliers" in ctx.disabled:
        rows = rows.withColumn("_odd", F.lit(False))
    else:
        odd = ctx.outliers.select("key", F.lit(True).alias("_odd")).distinct()
        rows = rows.join(odd, "key", "left")
    limit = F.when(F.coalesce("_odd", F.lit(False)), F.col("_loose")).otherwise(F.col("fence"))
    rows = rows.where((F.col("delta") >= limit) & ~suppressed(F.col("residuals"), F.col("hash"), "misplaced"))
    return finding("misplaced", rows, value=F.col("parent_fit"), pair_key=F.col("uncle"))


PULLS = 3
_PULL = "key string, other string, ord long, similarity double"


def _nearest_pulls(dirs: DataFrame, floors: DataFrame) -> DataFrame:
    """Rows (key, other, ord, similarity): for each candidate, of every block of directories the PULLS nearest above its floor.

    A pull is no sibling, parent, or child, and not the directory that the candidate borrows from. Blocks of directories
    meet in tasks of their own, which multiply matrices; only the nearest few leave them.
    """
    blocks = max(1, -(-dirs.count() // pairs.BLOCK_ROWS))
    numbered = dirs.join(floors, "key", "left").withColumn("_own", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    sides = []
    for side in (0, 1):
        met = numbered.where("min_sibling_sim is not null") if side == 0 else numbered
        met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        i, j = ("_own", "_other") if side == 0 else ("_other", "_own")
        sides.append(met.select("key", "ord", "parent_key", F.col("_target").alias("target"), F.col("_u").alias("vector"), F.col("min_sibling_sim").alias("floor"), F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side")))

    def nearest(table: pa.Table) -> pa.Table:
        own, other = (table.filter(pc.equal(table["side"], side)) for side in (0, 1))
        out: list[dict] = []
        if own.num_rows and other.num_rows:
            u, v = (np.array(t["vector"].to_pylist(), np.float64) for t in (own, other))
            keys, parents = ([np.array([x or "" for x in t[c].to_pylist()]) for t in (own, other)] for c in ("key", "parent_key"))
            ids = np.unique(np.concatenate([*keys, *parents]))
            (k, l), (p, q) = ([np.searchsorted(ids, x) for x in pair] for pair in (keys, parents))
            apart = (p[:, None] != q[None, :]) & (l[None, :] != p[:, None]) & (q[None, :] != k[:, None]) & (k[:, None] != l[None, :])
            product = np.clip(u @ v.T, -1.0, 1.0)
            near = apart & (product > own["floor"].to_numpy()[:, None])
            order, targets = other["ord"].to_numpy(), own["target"].to_pylist()
            for r in np.flatnonzero(near.any(1)).tolist():
                at = np.flatnonzero(near[r])
                if targets[r]:
                    at = at[[not keys[1][c].endswith("/" + targets[r]) for c in at]]
                for c in at[np.lexsort((order[at], -product[r, at]))][:PULLS].tolist():
                    out.append({"key": str(keys[0][r]), "other": str(keys[1][c]), "ord": int(order[c]), "similarity": float(product[r, c])})
        return pa.table({c: pa.array([x[c] for x in out], kind) for c, kind in (("key", pa.string()), ("other", pa.string()), ("ord", pa.int64()), ("similarity", pa.float64()))})

    return sides[0].unionByName(sides[1]).groupBy("i", "j").applyInArrow(nearest, _PULL)


def vocabulary_pulls(ctx: Context) -> tuple[DataFrame, DataFrame]:
    """Candidates (key, min_sibling_sim, _top, max_delta) and their PULLS nearest pulls: other directories nearer than the least similar sibling."""
    dirs = ctx.nodes.where("kind = 'directory'").where(~V.is_empty(F.col("identity")))
    borrowed = F.col("borrows.target") if "borrows" in ctx.nodes.columns else F.lit(None).cast("string")
    dirs = dirs.withColumn("_target", borrowed).withColumn("_u", V.unit(F.col("identity")))
    parents = dirs.select(F.col("key").alias("parent_key"))
    own = dirs.where(~suppressed(F.col("residuals"), F.col("hash"), "vocabulary-bleed")).join(parents, "parent_key", "left_semi").select("key", "parent_key", "_u")
    siblings = dirs.select(F.col("key").alias("_sk"), "parent_key", F.col("_u").alias("_su"))
    least = own.join(siblings, "parent_key").where("_sk <> key").groupBy("key").agg(F.min(V.unit_cosine(F.col("_u"), F.col("_su"))).alias("min_sibling_sim"))
    found = _nearest_pulls(dirs.select("key", "ord", "parent_key", "_target", "_u"), least)
    ranked = found.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("similarity"), "ord"))).where(F.col("_n") <= PULLS)
    pulls = ranked.join(least, "key").select("key", "other", F.col("ord").alias("_oo"), "similarity", "min_sibling_sim")
    most = pulls.groupBy("key").agg(F.max("similarity").alias("_top"))
    return least.join(most, "key", "left").select("key", "min_sibling_sim", "_top", F.coalesce(F.col("_top") - F.col("min_sibling_sim"), F.lit(0.0)).alias("max_delta")), pulls


@audit("vocabulary-bleed", "Vocabulary bleed")
def vocabulary_bleed(ctx: Context) -> DataFrame:
    candidates, pulls = vocabulary_pulls(ctx)
    fences = stats.leave_one_out(candidates, "key", "max_delta", ctx.k)
    rows = candidates.join(fences, "key").where(F.col("_top").isNotNull() & (F.col("max_delta") > F.col("upper")))
    named = pulls.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("similarity"), "_oo"))).where(F.col("_n") <= PULLS)
    listed = named.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "other"))), lambda x: x["other"]), ", ").alias("_listed"))
    rows = rows.join(listed, "key").join(ctx.nodes.select("key", "name", "hash", "ord"), "key")
    return finding("vocabulary-bleed", rows, value=F.col("max_delta"), fence=F.col("upper"), pair_name=F.col("_listed"))


@audit("merge-candidates", "Merge candidates")
def merge_candidates(ctx: Context) -> DataFrame:
    rows = pairs.sibling_pairs(ctx.nodes, ctx.fences).where(~pairs.calls_each_other("a", "b"))
    # A function that calls a unit inside a pattern container is its caller too.
    inside = ctx.nodes.join(ctx.nodes.where("kind = 'pattern'").select(F.col("key").alias("_pk")), F.col("parent_key") == F.col("_pk")).groupBy("_pk").agg(F.collect_set("name").alias("_names"))
    for function, container in (("a", "b"), ("b", "a")):
        called = F.coalesce((F.col(f"{function}.kind") == "function") & F.arrays_overlap(F.col(f"{function}.calls"), F.col("_names")), F.lit(False))
        rows = rows.join(inside, F.col(f"{container}.key") == F.col("_pk"), "left").where(~called).drop("_pk", "_names")
    open_pair = ~suppressed(F.col("a.residuals"), F.col("a.hash"), "merge-candidates") & ~suppressed(F.col("b.residuals"), F.col("b.hash"), "merge-candidates")
    return _pair_finding("merge-candidates", rows.where(open_pair), "a", "b")


def drift(ctx: Context) -> DataFrame:
    """Rows (key, children, drifted, drift_ratio, ...): how many of a container's children fit an uncle better."""
    nodes = ctx.nodes
    holders = nodes.where(~is_leaf(F.col("kind")) & ~F.col("util") & (F.col("kind") != "pattern") & F.col("parent_key").isNotNull() & ~V.is_empty(F.col("identity")))
    holders = holders.select("key", "name", "hash", "residuals", "ord", F.col("parent_key").alias("_gk"), F.col("identity").alias("_pi"))
    child = nodes.where(~is_leaf(F.col("kind")) & ~F.col("util") & ~V.is_empty(F.col("leaf"))).select(F.col("key").alias("_ck"), F.col("parent_key").alias("_pk"), F.col("ord").alias("_co"), F.col("leaf").alias("_cl"))
    uncles = nodes.where("kind = 'directory'").where(~V.is_empty(F.col("identity"))).select(F.col("key").alias("_uk"), F.col("name").alias("_un"), F.col("ord").alias("_uo"), F.col("parent_key").alias("_gk"), F.col("identity").alias("_ui"))
    met = holders.join(uncles, "_gk").where("_uk <> key").join(child, F.col("key") == F.col("_pk"))
    met = met.withColumn("_pf", V.cosine(F.col("_pi"), F.col("_cl"))).withColumn("_uf", V.cosine(F.col("_ui"), F.col("_cl")))
    each = met.groupBy("key", "name", "hash", "residuals", "ord", "_ck", "_co", "_pf").agg(F.max(F.struct("_uf", (-F.col("_uo")).alias("_neg"), "_un")).alias("_best"))
    best = F.greatest("_best._uf", F.lit(0.0))
    rows = each.groupBy("key", "name", "hash", "residuals", "ord").agg(
        F.count("*").alias("children"),
        F.sum((best > F.col("_pf")).cast("int")).alias("drifted"),
        F.avg("_pf").alias("mean_parent_fit"),
        F.max(F.struct(best.alias("fit"), (-F.col("_co")).alias("_neg"), F.when(F.col("_best._uf") > 0, F.col("_best._un")).otherwise("").alias("name"))).alias("worst"),
    )
    return rows.where("children >= 2").withColumn("drift_ratio", F.col("drifted") / F.col("children"))


@audit("weak-identity", "Weak identity")
def weak_identity(ctx: Context) -> DataFrame:
    rows = drift(ctx)
    rows = rows.crossJoin(_upper(rows, "drift_ratio", ctx.k)).where((F.col("drift_ratio") > 0.5) & (F.col("drift_ratio") >= F.col("fence")))
    rows = rows.where(~suppressed(F.col("residuals"), F.col("hash"), "weak-identity"))
    return finding("weak-identity", rows, value=F.col("mean_parent_fit"), group_value=F.col("worst.fit"), pair_key=F.col("worst.name"))


def _bloated(ctx: Context, kind: str, name: str) -> DataFrame:
    parents = ctx.nodes.where((F.col("kind") == kind) & ~F.col("util") & ~suppressed(F.col("residuals"), F.col("hash"), name)).select(
        F.col("key").alias("_pk"), F.col("name").alias("_pn"), F.col("hash").alias("_ph"), F.col("ord").alias("_po")
    )
    children = ctx.nodes.where(~F.col("util") & ~F.col("helper") & ~V.is_empty(F.col("leaf"))).join(parents.select("_pk"), F.col("parent_key") == F.col("_pk"))
    members = children.select(F.col("parent_key").alias("group"), "key", "kind", "ord", F.col("leaf").alias("vector"))
    split = cluster.dendrograms(members).where(cluster.significant_gap(F.col("merges"), ctx.k))
    large = F.filter("clusters", lambda c: F.size(c) >= 3)
    rows = split.withColumn("_large", large).where(F.size("_large") >= 2)
    if kind == "file":
        mixed = F.filter("_large", lambda c: F.exists(c, lambda m: ~m.startswith("type:")))
        rows = rows.where(F.size(mixed) > 1)
    rows = rows.join(parents, F.col("group") == F.col("_pk"))
    return finding(name, rows, key=F.col("_pk"), name=F.col("_pn"), hash=F.col("_ph"), value=F.col("gap"), pair_name=F.size("_large").cast("string"), ord=F.col("_po"))


@audit("bloated-directories", "Bloated directories")
def bloated_directories(ctx: Context) -> DataFrame:
    return _bloated(ctx, "directory", "bloated-directories")


@audit("bloated-files", "Bloated files")
def bloated_files(ctx: Context) -> DataFrame:
    return _bloated(ctx, "file", "bloated-files")


# The order of the report.
ORDER = """bloated-directories bloated-files outliers merge-candidates misplaced duplicates containments focal-drift incoherent
incoherent-utils util-duplicates vocabulary-bleed weak-identity incomplete-docs""".split()
ASCENDING, BY_DELTA, UNSORTED = ("outliers", "incoherent", "incoherent-utils"), ("misplaced",), ("weak-identity", "bloated-directories", "bloated-files", "incomplete-docs")


#: Audits whose findings are pairs, as many as the square of the nodes: what they compare, for ranked_pairs().
PAIRED: dict[str, Callable[[Context], tuple[DataFrame, list[tuple[int, int]]]]] = {
    "merge-candidates": lambda ctx: pairs.sibling_members(ctx.nodes, ctx.fences),
    "duplicates": lambda ctx: pairs.duplicate_members(ctx.nodes, ctx.fences["leaf"], ctx.fences["file"]),
    "util-duplicates": lambda ctx: pairs.util_members(ctx.nodes, ctx.fences["leaf"]),
}
_OF_PAIRS = ["key", "name", "hash", "parent_key", "pair_key", "pair_name", "value", "ord", "rank"]


def report(ctx: Context, names: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """All findings with the audit's place and each finding's rank within it; only columns of them, if given.

    The nodes are worked out once and kept: every audit scans them several times, and each scan of a cached tree would
    put the tree's own plan into the plan of each job, all of which the driver holds. Audits are worked out one after the
    other, so that no plan holds more than one; pairs leave their tasks with their ranks.
    """
    ctx = Context(settled(ctx.nodes), ctx.k, ctx.disabled)
    columns = columns or [*FINDING, "rank", "audit_ord", "title"]
    parts: list[DataFrame] = []
    rows: dict[tuple[str, bool], list[DataFrame]] = {}
    ordered = sorted(REGISTRY.items(), key=lambda x: ORDER.index(x[0]) if x[0] in ORDER else len(ORDER))
    for n, (name, a) in enumerate(ordered):
        if name in ctx.disabled or (names is not None and name not in names):
            continue
        about = {"audit_ord": F.lit(n), "title": F.lit(a.title)}
        if name in PAIRED:
            members, meets = PAIRED[name](ctx)
            ranked = ranked_pairs(members, meets, [c for c in _OF_PAIRS if c in columns], siblings=name == "merge-candidates")
            parts.append(finding(name, ranked, also=["rank"] if "rank" in columns else []).withColumns(about).select(*columns))
        else:
            by = ("value", False) if name in ASCENDING else ("delta", True) if name in BY_DELTA else ("ord", False) if name in UNSORTED else ("value", True)
            found = tidied(a.detect(ctx).withColumns(about))
            rows.setdefault(by, []).append(found)
            if a.detect is outliers:
                ctx.outliers = found  # not worked out again for misplaced
    for (c, turned), found in rows.items():
        parts.append(_ranked(reduce(DataFrame.unionByName, found), F.desc(c) if turned else F.asc(c)).select(*columns))
    return reduce(DataFrame.unionByName, parts) if parts else None


def _ranked(found: DataFrame, by: Column) -> DataFrame:
    """found with each finding's rank within its audit: numbered over all, less the findings of the audits before."""
    before, n = [], 0
    for r in found.groupBy("audit_ord").agg(F.count("*").alias("n")).orderBy("audit_ord").collect():  # a row for each audit
        before.append((r["audit_ord"], n))
        n += r["n"]
    first = F.broadcast(found.sparkSession.createDataFrame(before, "audit_ord int, _first long"))
    placed = stats.numbered(found, [F.col("audit_ord"), by, *[F.col(c) for c in ("ord", "key", "pair_key")]])
    return placed.join(first, "audit_ord").withColumn("rank", F.col("number") - F.col("_first")).drop("number", "_first")


def shown(findings: DataFrame, limit: int = 15) -> DataFrame:
    """The first findings of each audit; 0 for all. The count of the rest is in `more`."""
    counted = findings.withColumn("more", F.greatest(F.count("*").over(Window.partitionBy("audit")) - limit, F.lit(0)))
    return counted.where(F.col("rank") <= limit) if limit else counted
