"""The registered queries over the driver's tables and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import stats, text
from canopy.functions import vectors as V
from canopy.operators import audits, brief, cluster, pairs, place, scores, tree

from .bridge import NODES_SQL, table, vector_tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
K = 1.0  # the sensitivity of the registered audits: the random vectors of the tables have few extremes


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def _context(spark: SparkSession, sf_dir: str) -> audits.Context:
    return audits.Context(vector_tree(spark, sf_dir), K)


def _cos(a: str, b: str) -> str:
    return f"greatest(-1.0, least(1.0, list_cosine_similarity({a}, {b})))"


_PRODUCER = """((a.kind = 'type' AND b.kind = 'function' AND (contains(b.returns_type, a.name) OR b.param_type = a.name))
    OR (b.kind = 'type' AND a.kind = 'function' AND (contains(a.returns_type, b.name) OR a.param_type = b.name)))"""
_CALLS = "((a.kind = 'function' AND coalesce(a.callee = b.name, false)) OR (b.kind = 'function' AND coalesce(b.callee = a.name, false)))"
_SIBLINGS = f"""
WITH {NODES_SQL},
usable AS (SELECT n.*, p.kind AS parent_kind FROM nodes n JOIN nodes p ON p.key = n.parent_key
  WHERE p.kind IN ('file', 'directory') AND NOT p.util AND NOT n.util AND NOT n.helper),
pairs AS (SELECT CASE WHEN a.parent_kind = 'directory' THEN 'file' ELSE 'leaf' END AS level, a.parent_key, a.key AS ka, b.key AS kb, a.unmerged OR b.unmerged AS shut,
    {_CALLS} AS calls, {_cos('a.leaf', 'b.leaf')} AS similarity
  FROM usable a JOIN usable b ON a.parent_key = b.parent_key AND a.ord < b.ord WHERE NOT coalesce({_PRODUCER}, false)),
fences AS (SELECT level, CASE WHEN count(*) < 2 THEN 'infinity'::DOUBLE ELSE avg(similarity) + {K} * stddev_samp(similarity) END AS fence FROM pairs GROUP BY level)
"""


@query(_SIBLINGS + "SELECT level, count(*) AS n_pairs, round(avg(similarity), 6) AS mean_similarity, round(any_value(fence), 6) AS fence FROM pairs JOIN fences USING (level) GROUP BY level")
def sibling_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _context(spark, sf_dir).sibling_stats
    return sums.select("level", "n_pairs", r6("mean").alias("mean_similarity")).join(F.broadcast(pairs.fences_by_level(sums, K).select("level", r6("fence").alias("fence"))), "level")


@query(_SIBLINGS + "SELECT level, ka AS key, kb AS pair_key, parent_key, round(similarity, 6) AS value FROM pairs JOIN fences USING (level) WHERE similarity > fence AND NOT shut AND NOT calls")
def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audits.merge_candidates(_context(spark, sf_dir))
    level = F.when(F.col("key").startswith("file:") | F.col("key").startswith("dir:"), "file").otherwise("leaf")
    return found.select(level.alias("level"), "key", "pair_key", "parent_key", r6("value").alias("value"))


def _duplicate_sql(left: str, right: str, where: str, level: str) -> str:
    within = "a.ord < b.ord AND " if left == right else ""
    return f"""SELECT a.key AS key, b.key AS pair_key, round({_cos('a.leaf', 'b.leaf')}, 6) AS value
      FROM nodes a JOIN nodes b ON {within}a.parent_key <> b.parent_key
      WHERE {left.replace('@', 'a')} AND {right.replace('@', 'b')} AND {where} AND {_cos('a.leaf', 'b.leaf')} > (SELECT fence FROM fences WHERE level = '{level}')"""


_LEAF, _UTIL, _FILE = "@.depth = 3 AND NOT @.util", "@.depth = 3 AND @.util", "@.kind = 'file' AND NOT @.util"
_APART = f"coalesce(a.pattern <> b.pattern, true) AND NOT {_CALLS}"


@query(
    _SIBLINGS
    + _duplicate_sql(_LEAF, _LEAF, _APART, "leaf")
    + " UNION ALL "
    + _duplicate_sql(_LEAF, _UTIL, _APART, "leaf")
    + " UNION ALL "
    + _duplicate_sql(_FILE, _FILE, "true", "file")
)
def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = _context(spark, sf_dir)
    found = pairs.duplicates(context.nodes, context.fences["leaf"], context.fences["file"])
    return found.select(F.col("a").alias("key"), F.col("b").alias("pair_key"), r6("similarity").alias("value"))


@query(_SIBLINGS + _duplicate_sql(_UTIL, _UTIL, _APART, "leaf"))
def util_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = _context(spark, sf_dir)
    found = pairs.util_duplicates(context.nodes, context.fences["leaf"])
    return found.select(F.col("a").alias("key"), F.col("b").alias("pair_key"), r6("similarity").alias("value"))


_FIT = f"""
WITH {NODES_SQL},
fit AS (SELECT n.key, CASE WHEN p.key IS NULL OR (n.util AND NOT p.util AND n.depth < 3) THEN NULL ELSE {_cos('p.identity', 'n.leaf')} END AS fit
  FROM nodes n LEFT JOIN nodes p ON p.key = n.parent_key),
eligible AS (SELECT n.* FROM nodes n JOIN nodes p ON p.key = n.parent_key WHERE p.util OR NOT n.util),
cells AS (SELECT c.key, c.parent_key, c.name, c.ord, c.bound, i, c.identity[i] - p.identity[i] AS d
  FROM (SELECT *, unnest(generate_series(1, 32)) AS i FROM eligible) c JOIN nodes p ON p.key = c.parent_key),
deltas AS (SELECT key, parent_key, any_value(name) AS name, any_value(ord) AS ord, any_value(bound) AS bound, list(d ORDER BY i) AS delta FROM cells GROUP BY key, parent_key),
distances AS (SELECT a.parent_key, a.key AS ka, b.key AS kb, a.name AS na, b.name AS nb, a.ord AS oa, b.ord AS ob, a.bound AS ba, b.bound AS bb, 1 - {_cos('a.delta', 'b.delta')} AS distance
  FROM deltas a JOIN deltas b ON a.parent_key = b.parent_key AND a.ord < b.ord),
uniq AS (SELECT key, avg(distance) AS uniqueness FROM (SELECT ka AS key, distance FROM distances UNION ALL SELECT kb, distance FROM distances) GROUP BY key),
only_out AS (SELECT parent_key, bool_and(coalesce(bound = 'outward', false)) AS only_out FROM eligible GROUP BY parent_key),
held AS (SELECT d.* FROM distances d JOIN only_out o USING (parent_key) WHERE only_out OR (coalesce(ba, '') <> 'outward' AND coalesce(bb, '') <> 'outward')),
cv AS (SELECT parent_key AS key, CASE WHEN avg(distance) = 0 THEN 0 ELSE 1 / (1 + coalesce(stddev_samp(distance), 0) / avg(distance)) END AS children_uniqueness FROM held GROUP BY parent_key),
worst AS (SELECT parent_key AS key, na AS worst_a, nb AS worst_b FROM (SELECT *, row_number() OVER (PARTITION BY parent_key ORDER BY distance, oa, ob) AS n FROM held) WHERE n = 1),
cfit AS (SELECT key, {_cos('identity', 'leaf')} AS children_fit FROM nodes WHERE depth < 3),
uncles AS (SELECT n.key, u.name, u.ord, {_cos('u.identity', 'n.leaf')} AS s FROM nodes n JOIN nodes p ON p.key = n.parent_key JOIN nodes u ON u.parent_key = p.parent_key AND u.key <> p.key),
uncle AS (SELECT key, name AS best_uncle, s AS best_uncle_score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC, ord) AS n FROM uncles) WHERE n = 1)
"""


@query(_FIT + "SELECT key, round(fit, 6) AS fit FROM fit")
def node_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.fit(vector_tree(spark, sf_dir)).select("key", r6("fit").alias("fit"))


@query(_FIT + "SELECT n.key, round(coalesce(uniqueness, 2.0), 6) AS uniqueness FROM nodes n LEFT JOIN uniq USING (key)")
def node_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.uniqueness(vector_tree(spark, sf_dir)).select("key", r6("uniqueness").alias("uniqueness"))


@query(_FIT + "SELECT key, round(children_uniqueness, 6) AS children_uniqueness, worst_a, worst_b FROM cv JOIN worst USING (key)")
def children_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.children_uniqueness(vector_tree(spark, sf_dir)).select("key", r6("children_uniqueness").alias("children_uniqueness"), "worst_a", "worst_b")


@query(_FIT + "SELECT key, best_uncle, round(best_uncle_score, 6) AS best_uncle_score FROM uncle")
def best_uncles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.best_uncle(vector_tree(spark, sf_dir)).select("key", "best_uncle", r6("best_uncle_score").alias("best_uncle_score"))


def _hm(a: str, b: str) -> str:
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {a} <= 0 OR {b} <= 0 THEN 0 ELSE 2 * {a} * {b} / ({a} + {b}) END"


_CARDS = (
    _FIT
    + f""",
base AS (SELECT n.key, n.kind, n.depth, n.util, n.path, fit, coalesce(uniqueness, 2.0) AS uniqueness, children_fit, children_uniqueness
  FROM nodes n LEFT JOIN fit USING (key) LEFT JOIN uniq USING (key) LEFT JOIN cfit USING (key) LEFT JOIN cv USING (key)),
own AS (SELECT *, CASE WHEN uniqueness = 2.0 THEN NULL ELSE {_hm('((fit + 1) / 2)', '(uniqueness / 2)')} END AS score, {_hm('((children_fit + 1) / 2)', 'children_uniqueness')} AS children_score FROM base),
below AS (SELECT t.key, avg(d.children_fit) AS f, avg(d.children_uniqueness) AS u FROM base t JOIN base d ON d.depth < 3 AND t.depth < d.depth AND NOT d.util AND starts_with(d.path, t.path || '/')
  WHERE t.depth < 3 GROUP BY t.key),
sub AS (SELECT own.*, CASE WHEN depth < 3 THEN coalesce(f, children_fit) END AS subtree_fit, CASE WHEN depth < 3 THEN u END AS subtree_uniqueness FROM own LEFT JOIN below USING (key)),
whole AS (SELECT *, {_hm('((subtree_fit + 1) / 2)', 'subtree_uniqueness')} AS subtree_score FROM sub),
cards AS (SELECT *, CASE WHEN score IS NULL THEN subtree_score WHEN subtree_score IS NULL THEN score ELSE {_hm('score', 'subtree_score')} END AS overall_score FROM whole)
"""
)
_CARD = ["fit", "uniqueness", "score", "children_fit", "children_uniqueness", "children_score", "subtree_fit", "subtree_uniqueness", "subtree_score", "overall_score"]


@query(_CARDS + f"SELECT key, kind, {', '.join(f'round({c}, 6) AS {c}' for c in _CARD)} FROM cards")
def score_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.score_cards(vector_tree(spark, sf_dir)).select("key", "kind", *[r6(c).alias(c) for c in _CARD])


@query(_CARDS + "SELECT key, round(overall_score, 6) AS overall_score FROM cards ORDER BY overall_score ASC NULLS LAST, key LIMIT 20")
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.ranked(scores.score_cards(vector_tree(spark, sf_dir))).select("key", r6("overall_score").alias("overall_score"))


@query(
    _SIBLINGS
    + f""",
members AS (SELECT n.parent_key, CASE WHEN p.kind = 'file' AND n.kind = 'type' THEN 'type' ELSE 'rest' END AS part, n.key, n.ord, n.leaf FROM nodes n JOIN nodes p ON p.key = n.parent_key
  WHERE p.kind IN ('file', 'directory') AND NOT p.util AND NOT n.util AND NOT n.helper AND n.bound IS NULL),
groups AS (SELECT parent_key, part FROM members GROUP BY parent_key, part HAVING count(*) >= 3),
means AS (SELECT a.parent_key, a.part, a.key, avg({_cos('a.leaf', 'b.leaf')}) AS m FROM members a JOIN members b ON a.parent_key = b.parent_key AND a.part = b.part AND a.key <> b.key
  JOIN groups g ON g.parent_key = a.parent_key AND g.part = a.part GROUP BY a.parent_key, a.part, a.key),
medians AS (SELECT parent_key, part, quantile_cont(m, 0.5) AS med, (quantile_cont(m, 0.75) - quantile_cont(m, 0.25)) / 2 AS half, avg(m) AS group_mean FROM means GROUP BY parent_key, part),
away AS (SELECT parent_key, part, key, m, med, half, group_mean, abs(m - med) AS away FROM means JOIN medians USING (parent_key, part)),
spreads AS (SELECT parent_key, part, greatest(quantile_cont(away, 0.5), any_value(half)) AS spread FROM away GROUP BY parent_key, part),
pooled AS (SELECT quantile_cont(away, 0.25) AS pooled FROM away)
SELECT key, parent_key, round(m, 6) AS value, round(group_mean, 6) AS group_value FROM away JOIN spreads USING (parent_key, part), pooled WHERE m < med - {K} * 1.4826 * greatest(spread, pooled)"""
)
def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.outliers(_context(spark, sf_dir)).select("key", "parent_key", r6("value").alias("value"), r6("group_value").alias("group_value"))


_GAPS = f"""
WITH {NODES_SQL},
sims AS (SELECT n.*, {_cos('p.leaf', 'n.leaf')} AS s FROM nodes n JOIN nodes p ON p.key = n.parent_key WHERE p.kind IN ('file', 'directory') AND NOT p.util AND NOT n.util AND NOT n.helper),
tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent_key ORDER BY s DESC, ord) AS n FROM sims) WHERE n = 1),
gaps AS (SELECT a.parent_key AS key, any_value(a.key) AS pair_key, any_value(a.bound) AS bound, any_value(a.s) AS top, any_value(a.s) - max(b.s) AS gap FROM tops a JOIN sims b ON a.parent_key = b.parent_key AND a.key <> b.key
  WHERE NOT coalesce({_PRODUCER}, false) GROUP BY a.parent_key),
mid AS (SELECT quantile_cont(top, 0.5) AS med, (quantile_cont(top, 0.75) - quantile_cont(top, 0.25)) / 2 AS half, count(*) AS n FROM gaps),
spread AS (SELECT greatest(quantile_cont(abs(top - med), 0.5), any_value(half)) AS spread FROM gaps, mid),
bounds AS (SELECT (SELECT avg(gap) + {K} * stddev_samp(gap) FROM gaps) AS fence, CASE WHEN n < 2 OR spread = 0 THEN 0 ELSE med - {K} * 1.4826 * spread END AS low FROM mid, spread)
"""


@query(_GAPS + "SELECT key, pair_key, round(gap, 6) AS value, round(fence, 6) AS fence FROM gaps, bounds WHERE gap > fence AND top > low AND coalesce(bound, '') <> 'outward'")
def containments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.containments(_context(spark, sf_dir)).select("key", "pair_key", r6("value").alias("value"), r6("fence").alias("fence"))


@query(
    f"""WITH {NODES_SQL},
sims AS (SELECT n.*, {_cos('p.leaf', 'n.leaf')} AS s FROM nodes n JOIN nodes p ON p.key = n.parent_key WHERE NOT n.util AND NOT n.helper AND coalesce(n.bound, '') <> 'inward'),
tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent_key ORDER BY s DESC, ord) AS n FROM sims) WHERE n = 1)
SELECT a.key, a.parent_key, t.name AS pair_name, round(t.s - a.s, 6) AS value FROM sims a JOIN tops t ON t.parent_key = a.parent_key WHERE a.bound = 'outward' AND t.s > a.s AND t.name <> a.name"""
)
def focal_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.focal_drift(_context(spark, sf_dir)).select("key", "parent_key", "pair_name", r6("value").alias("value"))


def _incoherent_sql(util: str) -> str:
    return f"""WITH {NODES_SQL},
fits AS (SELECT key, {_cos('identity', 'leaf')} AS f FROM nodes WHERE depth < 3 AND util = {util} AND key IN (SELECT parent_key FROM nodes GROUP BY parent_key HAVING count(*) >= 2)),
low AS (SELECT least(CASE WHEN count(*) < 2 THEN '-infinity'::DOUBLE ELSE avg(f) - {K} * stddev_samp(f) END, quantile_cont(f, 0.5)) AS low FROM fits)
SELECT key, round(f, 6) AS value, round(low, 6) AS fence FROM fits, low WHERE f < low"""


@query(_incoherent_sql("false"))
def incoherent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.incoherent(_context(spark, sf_dir)).select("key", r6("value").alias("value"), r6("fence").alias("fence"))


@query(_incoherent_sql("true"))
def incoherent_utils(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.incoherent_utils(_context(spark, sf_dir)).select("key", r6("value").alias("value"), r6("fence").alias("fence"))


@query(
    f"""WITH {NODES_SQL},
moved AS (SELECT n.key, n.path, n.leaf, {_cos('p.identity', 'n.leaf')} AS parent_fit FROM nodes n JOIN nodes p ON p.key = n.parent_key WHERE n.depth IN (1, 2) AND NOT n.util),
raw AS (SELECT m.key, u.key AS pair_key, parent_fit, {_cos('u.identity', 'm.leaf')} - parent_fit AS delta FROM moved m JOIN nodes u ON u.kind = 'directory' AND u.depth = 1
  WHERE m.key LIKE 'file:%' AND NOT starts_with(m.path, u.path || '/') AND {_cos('u.identity', 'm.leaf')} > parent_fit)
SELECT key, pair_key, round(delta, 6) AS delta FROM raw"""
)
def misplacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.misplacement(_context(spark, sf_dir)).select("key", F.col("uncle").alias("pair_key"), r6("delta").alias("delta"))


@query(
    f"""WITH {NODES_SQL},
holders AS (SELECT * FROM nodes WHERE depth = 1 AND NOT util),
met AS (SELECT h.key, c.key AS child, {_cos('h.identity', 'c.leaf')} AS pf, max({_cos('u.identity', 'c.leaf')}) AS uf FROM holders h JOIN nodes u ON u.depth = 1 AND u.key <> h.key JOIN nodes c ON c.parent_key = h.key AND NOT c.util
  GROUP BY h.key, c.key, h.identity, c.leaf)
SELECT key, count(*) AS children, sum(CASE WHEN greatest(uf, 0) > pf THEN 1 ELSE 0 END)::BIGINT AS drifted, round(avg(pf), 6) AS mean_parent_fit, round(max(greatest(uf, 0)), 6) AS worst_fit FROM met GROUP BY key HAVING count(*) >= 2"""
)
def identity_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audits.drift(_context(spark, sf_dir))
    return rows.select("key", "children", F.col("drifted").cast("long").alias("drifted"), r6("mean_parent_fit").alias("mean_parent_fit"), r6("worst.fit").alias("worst_fit"))


@query(
    """SELECT (CASE WHEN vec_id % 7 = 0 THEN 'type:' ELSE 'func:' END) || 'root/L' || label || '/F' || (vec_id % 5) || ':v' || vec_id AS key,
  array_to_string(list_filter([CASE WHEN vec_id % 5 = 1 THEN 'description' END, CASE WHEN vec_id % 7 <> 0 THEN (2 - vec_id % 3) || '/2 @param' END,
    CASE WHEN vec_id % 7 <> 0 AND vec_id % 6 = 0 AND vec_id % 4 <> 1 THEN '@returns' END, CASE WHEN vec_id % 7 <> 0 AND vec_id % 2 = 1 THEN 'purity or causes' END],
    lambda x: x IS NOT NULL AND x <> '0/2 @param'), ', ') AS missing
FROM embeddings WHERE vec_id % 5 = 1 OR (vec_id % 7 <> 0 AND (vec_id % 3 <> 2 OR (vec_id % 6 = 0 AND vec_id % 4 <> 1) OR vec_id % 2 = 1))
UNION ALL SELECT DISTINCT 'file:root/L' || label || '/F' || (vec_id % 5), 'description' FROM embeddings"""
)
def incomplete_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.incomplete_docs(_context(spark, sf_dir)).select("key", F.col("pair_name").alias("missing"))


@query()
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["audit", "audit_ord", "rank", "key", "pair_key", "value"]
    return audits.report(_context(spark, sf_dir), columns=columns).withColumn("value", r6("value"))


@query(
    f"""WITH {NODES_SQL}, d AS (SELECT key, ord, parent_key, identity FROM nodes WHERE depth < 3), own AS (SELECT * FROM d WHERE parent_key IS NOT NULL),
least AS (SELECT a.key, min({_cos('a.identity', 'b.identity')}) AS m FROM own a JOIN d b ON a.parent_key = b.parent_key AND a.key <> b.key GROUP BY a.key),
pulls AS (SELECT a.key, b.key AS other, b.ord, {_cos('a.identity', 'b.identity')} AS s FROM own a JOIN least USING (key)
  JOIN d b ON b.key <> a.key AND coalesce(b.parent_key, '') <> a.parent_key AND b.key <> a.parent_key AND coalesce(b.parent_key, '') <> a.key WHERE {_cos('a.identity', 'b.identity')} > m),
cand AS (SELECT key, any_value(m) AS m, max(s) AS top, coalesce(max(s) - any_value(m), 0) AS delta FROM least LEFT JOIN pulls USING (key) GROUP BY key),
mid AS (SELECT a.key, quantile_cont(b.delta, 0.5) AS med, (quantile_cont(b.delta, 0.75) - quantile_cont(b.delta, 0.25)) / 2 AS half FROM cand a JOIN cand b ON a.key <> b.key GROUP BY a.key),
spread AS (SELECT mid.key, any_value(med) AS med, greatest(quantile_cont(abs(b.delta - med), 0.5), any_value(half)) AS spread FROM mid JOIN cand b ON mid.key <> b.key GROUP BY mid.key),
listed AS (SELECT key, string_agg(other, ', ' ORDER BY s DESC, ord) AS pair_name FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC, ord) AS n FROM pulls) WHERE n <= 3 GROUP BY key)
SELECT key, pair_name, round(delta, 6) AS value FROM cand JOIN spread USING (key) JOIN listed USING (key) WHERE spread > 0 AND delta > med + {K} * 1.4826 * spread"""
)
def vocabulary_bleed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree's files stand for directories, so that directories have others beside their siblings."""
    nodes = vector_tree(spark, sf_dir).where("depth < 3").withColumn("kind", F.lit("directory"))
    return audits.vocabulary_bleed(audits.Context(nodes, K)).select("key", "pair_name", r6("value").alias("value"))


# Clustering, placement and briefs: checked against numpy in the tests.


@query()
def advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.advise_tree(vector_tree(spark, sf_dir))


@query()
def bloated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.bloated_files(audits.Context(vector_tree(spark, sf_dir), 0.5)).select("key", r6("value").alias("value"), "pair_name")


@query()
def dendrogram_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = vector_tree(spark, sf_dir).where("depth = 3")
    found = cluster.dendrograms(leaves.select(F.col("parent_key").alias("group"), "key", "ord", F.col("leaf").alias("vector")))
    return found.select("group", F.size("clusters").alias("n_clusters"), r6("gap").alias("gap"), F.transform("merges", lambda m: F.round(m, 6)).alias("merges"))


@query()
def unit_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = vector_tree(spark, sf_dir).where("depth = 3").select(F.col("parent_key").alias("group"), "key", "ord", F.col("identity").alias("vector"))
    return cluster.positions_3d(leaves).select("key", r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"))


def _label_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query a label: the centroid of its units' identities."""
    units = vector_tree(spark, sf_dir).where("depth = 3").withColumn("label", F.regexp_extract("path", r"L(\d+)", 1).cast("int"))
    return units.groupBy(F.col("label").alias("qid")).agg(V.centroid(F.col("identity")).alias("q"))


@query()
def placement_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = vector_tree(spark, sf_dir)
    found = place.chain_search(nodes, _label_queries(spark, sf_dir), tree.root_key(nodes))
    return found.select("qid", "rank", "parent_key", r6("confidence").alias("confidence"), "depth")


_LABEL_Q = """, q_cells AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS a FROM (SELECT *, unnest(generate_series(1, 32)) AS i FROM embeddings) GROUP BY label, i),
q AS (SELECT label AS qid, list(a ORDER BY i) AS q FROM q_cells GROUP BY label)"""


@query(
    f"WITH {NODES_SQL}{_LABEL_Q}, met AS (SELECT qid, name, ord, {_cos('q.q', 'n.identity')} AS s FROM nodes n, q WHERE depth = 3) "
    "SELECT qid::BIGINT AS qid, name, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, ord) AS n FROM met) WHERE n = 1"
)
def best_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = place.best_leaf(vector_tree(spark, sf_dir), _label_queries(spark, sf_dir))
    return found.select(F.col("qid").cast("long").alias("qid"), "name", r6("similarity").alias("similarity"))


@query(
    f"WITH {NODES_SQL}{_LABEL_Q}, met AS (SELECT qid, util, {_cos('q.q', 'n.identity')} AS s FROM nodes n, q WHERE depth = 1), "
    "best AS (SELECT qid, coalesce(max(CASE WHEN NOT util THEN s END), 0) AS d, coalesce(max(CASE WHEN util THEN s END), 0) AS c FROM met GROUP BY qid) "
    "SELECT qid::BIGINT AS qid, round(d, 6) AS domain_fit, round(c, 6) AS capability_fit, CASE WHEN c > d THEN 'capability' ELSE 'domain' END AS classification FROM best"
)
def placement_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = place.axes(vector_tree(spark, sf_dir), _label_queries(spark, sf_dir))
    return found.select(F.col("qid").cast("long").alias("qid"), r6("domain_fit").alias("domain_fit"), r6("capability_fit").alias("capability_fit"), "classification")


@query(
    f"WITH {NODES_SQL}, root_q AS (SELECT identity AS q FROM root) "
    f"SELECT key, round({_cos('root_q.q', 'n.identity')}, 6) AS similarity FROM nodes n, root_q WHERE depth = 3 AND NOT util ORDER BY {_cos('root_q.q', 'n.identity')} DESC, ord LIMIT 5"
)
def nearest_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = vector_tree(spark, sf_dir)
    q = nodes.where("depth = 0").select("identity").first()[0]
    return brief.symbols(nodes, q, "").select("key", r6("similarity").alias("similarity"))


# Tree operators.


@query(
    f"WITH {NODES_SQL} SELECT pattern AS tag, parent_key, count(*) AS members FROM nodes WHERE pattern IS NOT NULL GROUP BY pattern, parent_key HAVING count(*) >= 2"
)
def in_file_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.in_file_patterns(vector_tree(spark, sf_dir)).select("tag", "parent_key", "members")


@query(
    f"WITH {NODES_SQL}, t AS (SELECT pattern AS tag, path, regexp_extract(path, 'root/L[0-9]+') AS d FROM nodes WHERE pattern IS NOT NULL) "
    "SELECT tag, count(DISTINCT path) AS files, CASE WHEN count(DISTINCT d) = 1 THEN 'dir:' || any_value(d) ELSE 'dir:root' END AS directory_key FROM t GROUP BY tag HAVING count(DISTINCT path) >= 2"
)
def cross_file_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = vector_tree(spark, sf_dir)
    tagged = nodes.where("size(patterns) > 0").select(F.get("patterns", 0).alias("tag"), "path")
    return tree.cross_file_patterns(tagged, nodes).select("tag", F.col("files").cast("long").alias("files"), "directory_key")


@query(
    f"WITH {NODES_SQL} SELECT p.key, count(c.key) AS children FROM nodes p LEFT JOIN nodes c ON c.parent_key = p.key GROUP BY p.key"
)
def child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.count_children(vector_tree(spark, sf_dir).select("key", "kind"))


@query(
    f"""WITH {NODES_SQL}, t AS (SELECT pattern AS tag, parent_key AS file, path, regexp_extract(path, 'root/L[0-9]+') AS d, count(*) AS members FROM nodes WHERE pattern IS NOT NULL GROUP BY ALL),
l AS (SELECT tag, CASE WHEN count(DISTINCT d) = 1 THEN 'dir:' || any_value(d) ELSE 'dir:root' END AS holder FROM t GROUP BY tag HAVING count(DISTINCT path) >= 2)
SELECT 'pattern:' || file || ':' || tag AS key, coalesce('pattern:' || holder || ':' || tag, file) AS parent_key, tag AS name, false AS util FROM t LEFT JOIN l USING (tag) WHERE members >= 2
UNION ALL SELECT 'pattern:' || holder || ':' || tag, holder, tag, false FROM l"""
)
def pattern_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.lift_patterns(tree.group_patterns(vector_tree(spark, sf_dir))).where("kind = 'pattern'").select("key", "parent_key", "name", "util")


@query(
    f"WITH RECURSIVE {NODES_SQL}, up AS (SELECT key, parent_key AS ancestor, 1 AS distance FROM nodes WHERE parent_key IS NOT NULL UNION ALL "
    "SELECT up.key, n.parent_key, distance + 1 FROM up JOIN nodes n ON n.key = up.ancestor WHERE n.parent_key IS NOT NULL) SELECT key, ancestor, distance::BIGINT AS distance FROM up WHERE ancestor <> 'dir:root'"
)
def node_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.ancestors(vector_tree(spark, sf_dir)).select("key", "ancestor", F.col("distance").cast("long").alias("distance"))


@query(
    f"WITH {NODES_SQL}, f AS (SELECT key, kind, path, name, ord % 3 <> 0 AS exported, helper, callee FROM nodes WHERE depth = 3), "
    "called AS (SELECT path, callee AS name, count(*) AS callers FROM f WHERE kind = 'function' GROUP BY path, callee) "
    "SELECT f.key, coalesce(kind = 'function' AND NOT exported AND callers >= 2, false) OR helper AS helper FROM f LEFT JOIN called USING (path, name)"
)
def helper_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.detect_helpers(vector_tree(spark, sf_dir).where("depth = 3")).select("key", "helper")


@query(
    """SELECT r_name AS region, n_name AS nation, count(c_custkey) AS customers, round(coalesce(avg(c_acctbal), 0), 4) AS mean_balance
FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name"""
)
def nation_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    each = customer.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("m"))
    met = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).join(each, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return met.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.coalesce("n", F.lit(0)).cast("long").alias("customers"), F.round(F.coalesce("m", F.lit(0.0)), 4).alias("mean_balance"))


# Statistics over the star schema.

_ROBUST = """WITH s AS (SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3
  FROM lineitem GROUP BY l_returnflag, l_linestatus),
a AS (SELECT l.l_returnflag, l.l_linestatus, quantile_cont(abs(l_extendedprice - median), 0.5) AS mad FROM lineitem l JOIN s ON s.l_returnflag = l.l_returnflag AND s.l_linestatus = l.l_linestatus GROUP BY l.l_returnflag, l.l_linestatus),
b AS (SELECT s.*, mad, CASE WHEN n < 2 THEN 0 ELSE greatest(mad, (q3 - q1) / 2) END AS spread FROM s JOIN a USING (l_returnflag, l_linestatus))
"""


@query(
    _ROBUST + "SELECT l_returnflag, l_linestatus, n, round(median, 4) AS median, round(q1, 4) AS q1, round(q3, 4) AS q3, round(mad, 4) AS mad, round(median - 2 * 1.4826 * spread, 4) AS lower, round(median + 2 * 1.4826 * spread, 4) AS upper FROM b"
)
def robust_price_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.robust_fences(stats.robust(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice"), "l_extendedprice", ["l_returnflag", "l_linestatus"]), 2.0)
    return rows.select("l_returnflag", "l_linestatus", "n", *[F.round(c, 4).alias(c) for c in ("median", "q1", "q3", "mad", "lower", "upper")])


@query(
    """SELECT o_orderpriority, count(*) AS n, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS deviation, round(avg(o_totalprice) - 2 * stddev_samp(o_totalprice), 4) AS lower,
  round(avg(o_totalprice) + 2 * stddev_samp(o_totalprice), 4) AS upper FROM orders GROUP BY o_orderpriority"""
)
def order_price_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("o_totalprice")
    low, high = stats.z_fences(x, 2.0)
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), stats.deviation(x).alias("d"), low.alias("l"), high.alias("h"))
    return rows.select("o_orderpriority", "n", F.round("d", 4).alias("deviation"), F.round("l", 4).alias("lower"), F.round("h", 4).alias("upper"))


@query(
    """WITH b AS (SELECT n_name, s_acctbal FROM supplier JOIN nation ON n_nationkey = s_nationkey), m AS (SELECT n_name, quantile_cont(s_acctbal, 0.5) AS m FROM b GROUP BY n_name)
SELECT round(quantile_cont(abs(s_acctbal - m), 0.25), 4) AS floor, count(*) AS n FROM b JOIN m USING (n_name)"""
)
def pooled_balance_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.broadcast(table(spark, sf_dir, "nation"))
    rows = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", "s_acctbal")
    return stats.pooled_floor(rows, "s_acctbal", ["n_name"]).select(F.round("floor", 4).alias("floor")).crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))


@query(
    """WITH v AS (SELECT n_name, avg(c_acctbal) AS v FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name),
s AS (SELECT a.n_name, quantile_cont(b.v, 0.5) AS med, (quantile_cont(b.v, 0.75) - quantile_cont(b.v, 0.25)) / 2 AS half FROM v a JOIN v b ON a.n_name <> b.n_name GROUP BY a.n_name),
m AS (SELECT s.n_name, quantile_cont(abs(b.v - med), 0.5) AS mad FROM s JOIN v b ON s.n_name <> b.n_name GROUP BY s.n_name)
SELECT n_name, round(med + 2 * 1.4826 * greatest(mad, half), 4) AS upper FROM s JOIN m USING (n_name)"""
)
def leave_one_out_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.broadcast(table(spark, sf_dir, "nation"))
    each = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.avg("c_acctbal").alias("v"))
    return stats.leave_one_out(each, "n_name", "v", 2.0).select("n_name", F.round("upper", 4).alias("upper"))


@query(
    """WITH s AS (SELECT p_brand, p_type, avg(p_retailprice) / 1000 AS s FROM part GROUP BY p_brand, p_type),
g AS (SELECT p_brand, count(*) AS n, avg(s) + stddev_pop(s) AS fresh FROM s GROUP BY p_brand),
e AS (SELECT s.p_brand, p_type, exp(s / greatest(1.0 / n, 0.01)) AS e, exp(fresh / greatest(1.0 / n, 0.01)) AS f FROM s JOIN g USING (p_brand))
SELECT p_brand, p_type, round(e / (sum(e) OVER (PARTITION BY p_brand) + f), 6) AS probability, round(f / (sum(e) OVER (PARTITION BY p_brand) + f), 6) AS new_probability FROM e"""
)
def softmax_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg((F.avg("p_retailprice") / 1000).alias("s"))
    return stats.softmax_with_new(each, "s", ["p_brand"]).select("p_brand", "p_type", r6("probability").alias("probability"), r6("new_probability").alias("new_probability"))


@query(
    """WITH h AS (SELECT user_id, avg(CASE WHEN event_id % 2 = 0 THEN value END) AS a, avg(CASE WHEN event_id % 2 = 1 THEN value END) AS b FROM events GROUP BY user_id)
SELECT user_id, round(coalesce(a - b, 0), 6) AS delta FROM h WHERE a IS NOT NULL"""
)
def snapshot_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two halves of the events stand for two snapshots of one card a user."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")

    def cards(half: int) -> DataFrame:
        mean = events.where(F.col("event_id") % 2 == half).groupBy(F.col("user_id").alias("key")).agg(F.avg("value").alias("v")).where("v is not null")
        return mean.select("key", *[F.col("v").alias(c) for c in ("overall_score", "score", "children_score", "subtree_fit")])

    return scores.score_deltas(cards(0), cards(1)).select(F.col("key").alias("user_id"), r6("overall_delta").alias("delta"))


# Text operators.


@query("SELECT doc_id, sha256(coalesce(lang, '') || chr(0) || coalesce(source, '') || chr(0) || coalesce(text, '')) AS facet_hash, substr(sha256(coalesce(lang, '') || chr(0) || coalesce(source, '') || chr(0) || coalesce(text, '')), 1, 8) AS hash FROM documents")
def facet_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    h = text.facet_hash(F.col("lang"), F.col("source"), F.col("text"))
    return d.select("doc_id", h.alias("facet_hash"), text.unit_hash(h, F.col("source"), F.col("lang")).alias("hash"))


@query(
    """WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents) SELECT h.doc_id, p.h IS NOT NULL AS cached FROM h LEFT JOIN (SELECT * FROM h WHERE doc_id % 5 <> 0) p ON p.doc_id = h.doc_id AND p.h = h.h"""
)
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose id is no multiple of five stand for the former snapshot."""
    from canopy.operators import rollup

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("cache_key"), "doc_id", text.facet_hash(F.col("text")).alias("facet_hash"))
    previous = d.where("doc_id % 5 <> 0").select("cache_key", "facet_hash", F.array(F.lit(1.0)).alias("identity"), F.array(F.lit(1.0)).alias("leaf"))
    return rollup.resolve_cache(d, previous).select("doc_id", "cached")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)")
def suppressed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query(
    """SELECT page_id, CASE WHEN p = '' THEN 'web-pages/' WHEN d = '' THEN 'web/pages/' ELSE 'web/pages/' || d || '/' END AS signal, trim(regexp_replace(lower(p), '[^a-z0-9_]+', '-', 'g'), '-') AS slug
FROM (SELECT page_id, p, regexp_replace(p, '/?[^/]*$', '') AS d FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS p FROM pages))"""
)
def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", text.path_signal(path, ["web", "pages"]).alias("signal"), text.slug(path).alias("slug"))


@query(
    """SELECT conv_id, turn, CASE WHEN coalesce(text, '') <> '' THEN role || ': ' || text ELSE role END AS signature, CASE WHEN length(coalesce(text, '')) > 0 THEN 'calls: ' || role || ', turn' ELSE '' END AS calls FROM conversations"""
)
def turn_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    calls = F.when(F.length(F.coalesce("text", F.lit(""))) > 0, F.array(F.col("role"), F.lit("turn"))).otherwise(F.array().cast("array<string>"))
    return c.select("conv_id", "turn", text.identity_signature(F.col("role"), F.col("text")).alias("signature"), text.calls_text(calls).alias("calls"))


@query(
    """SELECT p_partkey, 'params: name (' || p_type || '), brand (unknown) | returns: ' || p_brand AS signature, '(name: ' || p_type || ', brand: unknown) => ' || p_brand AS callable, 'fields: size (int), name (' || p_type || ')' AS fields FROM part"""
)
def part_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, types = F.array(F.lit("name"), F.lit("brand")), F.array(F.col("p_type"))
    fields = F.array(F.struct(F.lit("size").alias("name"), F.lit("int").alias("type")), F.struct(F.lit("name").alias("name"), F.col("p_type").alias("type")))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.function_signature(names, types, F.col("p_brand")).alias("signature"),
        text.callable_signature(names, types, F.col("p_brand")).alias("callable"),
        text.type_signature(fields).alias("fields"),
    )


@query(
    """SELECT p_partkey, CASE WHEN s >= 0.7 THEN 'strong' WHEN s >= 0.4 THEN 'moderate' ELSE 'weak' END AS verdict, CAST(floor(s * 100 + 0.5) AS BIGINT) || '%' AS percent FROM (SELECT p_partkey, p_size / 50.0 AS s FROM part)"""
)
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size") / 50.0
    return table(spark, sf_dir, "part").select("p_partkey", text.verdict(s).alias("verdict"), text.percent(s).alias("percent"))


@query(
    """SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round((greatest(l_quantity - l_linenumber - 1, 0) * l_discount + l_linenumber * l_tax + l_discount * 3 + l_quantity * l_tax) / 1e6, 9) AS cost FROM lineitem"""
)
def usage_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = {"in": F.col("l_discount"), "out": F.col("l_tax"), "cache_read": F.col("l_tax"), "cache_write": F.lit(3) * F.col("l_discount")}
    cost = text.usage_cost(F.col("l_quantity"), F.col("l_quantity"), F.col("l_linenumber"), F.lit(1), price)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round(cost, 9).alias("cost"))


@query(
    f"""WITH {NODES_SQL} SELECT key, list_transform(identity, lambda x: round(x, 6)) AS identity, list_transform(leaf, lambda x: round(x, 6)) AS leaf FROM nodes WHERE depth < 3"""
)
def container_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_tree(spark, sf_dir).where("depth < 3").select("key", *[V.rounded(F.col(c)).alias(c) for c in ("identity", "leaf")])
