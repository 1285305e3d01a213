"""More registered queries: text, vector, roll-up, tree, source and store operators over the driver's tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import text
from canopy.functions import vectors as V
from canopy.operators import audits, brief, place, rollup, scores, tree
from canopy.sources import typescript
from canopy.sources.store import SnapshotStore

from .bridge import NODES_SQL, table, vector_tree
from .queries import _cos, query, r6

# Text.


@query(
    """SELECT p_partkey, p_name || ' | ' || p_brand AS joined, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS causes,
CASE WHEN p_size % 3 = 0 THEN 'role: ' || p_brand ELSE p_brand END AS name,
CASE WHEN p_size % 3 <> 0 THEN p_type WHEN p_size % 2 = 0 THEN 'Represent a role: ' || p_type ELSE 'Represent a role' END AS description,
'exports: ' || p_brand || ', ' || p_type AS exports, 'children: ' || p_brand AS children FROM part"""
)
def container_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    role, told = F.when(F.col("p_size") % 3 == 0, "role"), F.when((F.col("p_size") % 2 == 0) | (F.col("p_size") % 3 != 0), F.col("p_type"))
    name, description = text.with_role(F.col("p_brand"), told, role)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.joined_signature(F.col("p_name"), F.lit(""), F.col("p_brand"), F.lit(None).cast("string")).alias("joined"),
        text.causes_text(F.when(F.col("p_size") % 2 == 0, F.col("p_type"))).alias("causes"),
        name.alias("name"),
        description.alias("description"),
        text.exports_signature(F.array("p_brand", "p_type")).alias("exports"),
        text.children_signature(F.array(F.concat(F.lit("a/b/"), F.col("p_brand")))).alias("children"),
    )


@query(
    f"""WITH {NODES_SQL} SELECT key, path, replace(path, 'root/', '') AS shown, kind || chr(0) || path || chr(0) || name AS leaf_key, kind || chr(0) || path AS container_key, ord || '-abc' AS snapshot,
substr(sha256(name || chr(0) || path), 1, 8) AS hash FROM nodes"""
)
def unit_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = vector_tree(spark, sf_dir)
    return n.select(
        "key",
        text.key_path(F.col("key")).alias("path"),
        text.short_path(F.col("path"), "root").alias("shown"),
        text.leaf_cache_key(F.col("kind"), F.col("path"), F.col("name")).alias("leaf_key"),
        text.container_cache_key(F.col("kind"), F.col("path")).alias("container_key"),
        text.snapshot_id(F.col("ord"), F.lit("abc")).alias("snapshot"),
        text.unit_hash(F.lit(None).cast("string"), F.col("name"), F.col("path")).alias("hash"),
    )


@query(
    """SELECT p_partkey, printf('%.4f', x) AS fixed, CASE WHEN d > 0 THEN '↑ +' WHEN d < 0 THEN '↓ ' ELSE '→ ' END || printf('%.8f', d) AS delta,
CASE WHEN d > 0 THEN '↑ +' WHEN d < 0 THEN '↓ ' ELSE '→ ' END || printf('%.1f%%', d * 100) AS change, CASE WHEN d < 0 THEN 0.0 ELSE d * 1e6 END AS per_million
FROM (SELECT p_partkey, p_size / 8.0 AS x, (p_size - 20) / 8.0 AS d FROM part)"""
)
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 8.0).alias("x"), ((F.col("p_size") - 20) / 8.0).alias("d"))
    return p.select("p_partkey", text.fixed(F.col("x")).alias("fixed"), text.delta(F.col("d")).alias("delta"), text.delta(F.col("d"), True).alias("change"), text.per_million(F.col("d").cast("string")).alias("per_million"))


@query("SELECT p_partkey, trim(regexp_replace(p_name || ' ' || p_brand || ' see ' || p_type || ' item ' || p_size || ' a, ' || p_size || '. end', '\\s+', ' ', 'g')) AS plain FROM part")
def plain_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ["import x from 'y'\n# ", "p_name", "\n\n> **", "p_brand", "** see [`", "p_type", "`](to/it)\n```js\ncode\n```\n---\n- *item* ", "p_size", "\n\n| - | - |\n| a | ", "p_size", " |\n<Tab k='v'>end</Tab>"]
    page = F.concat(*[F.col(x).cast("string") if x.startswith("p_") else F.lit(x) for x in parts])
    return table(spark, sf_dir, "part").select("p_partkey", text.strip_markdown(page).alias("plain"))


@query(
    """SELECT p_partkey, p_size / 4.0 AS number, 0.0::DOUBLE AS missing, p_brand AS word, '' AS none, contains(lower(p_type), 'brass') OR contains(lower(p_type), 'steel plated') AS matches, true AS any_title FROM part"""
)
def typed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.to_json(F.struct((F.col("p_size") / 4.0).alias("n"), F.col("p_brand").alias("w")))
    terms = text.filter_terms(" BRASS, Steel-plated ,,")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.json_number(d, "n").alias("number"),
        text.json_number(d, "w").alias("missing"),
        text.json_string(d, "w").alias("word"),
        text.json_string(d, "none").alias("none"),
        text.title_matches(F.col("p_type"), terms).alias("matches"),
        text.title_matches(F.col("p_type"), []).alias("any_title"),
    )


# Vectors.

_PARTS_SQL = """v AS (SELECT vec_id, embedding[1:16]::DOUBLE[] AS a, CASE WHEN vec_id % 3 = 0 THEN [] ELSE embedding[17:32]::DOUBLE[] END AS b,
  CASE WHEN vec_id % 5 = 0 THEN [] ELSE embedding[33:48]::DOUBLE[] END AS c FROM embeddings)"""


def _mix(a: str, b: str, x: float, y: float) -> str:
    return f"(CASE WHEN len({a}) = 0 THEN {b} WHEN len({b}) = 0 THEN {a} ELSE list_transform(list_zip({a}, {b}), lambda z: z[1] * {x} + z[2] * {y}) END)"


def _vector_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda first: F.slice("embedding", first, 16).cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", part(1).alias("a"), F.when(F.col("vec_id") % 3 == 0, V.empty()).otherwise(part(17)).alias("b"), F.when(F.col("vec_id") % 5 == 0, V.empty()).otherwise(part(33)).alias("c")
    )


_ROUNDED = lambda x: f"list_transform({x}, lambda z: round(z, 6))"


@query(
    f"""WITH {_PARTS_SQL} SELECT vec_id, {_ROUNDED(_mix('a', 'b', 0.7, 0.3))} AS parented, {_ROUNDED(_mix(_mix('a', 'b', 0.7, 0.3), 'c', 0.5, 0.5))} AS identity,
{_ROUNDED(_mix('b', 'a', 0.75, 0.25))} AS routing, {_ROUNDED("CASE WHEN len(b) > 0 AND len(c) > 0 THEN list_transform(list_zip(a, b, c), lambda z: z[1] * 0.6 + z[2] * 0.25 + z[3] * 0.15) WHEN len(b) > 0 THEN " + _mix('a', 'b', 0.7, 0.3) + " WHEN len(c) > 0 THEN " + _mix('a', 'c', 0.7, 0.3) + " ELSE a END")} AS signature FROM v"""
)
def vector_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vector_parts(spark, sf_dir)
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return v.select(
        "vec_id", V.rounded(V.with_parent(a, b)).alias("parented"), V.rounded(V.identity(a, b, c)).alias("identity"), V.rounded(V.routing(b, a)).alias("routing"), V.rounded(V.signature_signals(a, b, c)).alias("signature")
    )


@query("SELECT c_custkey, coalesce(avg(o_orderkey), 0) = 0 AS nothing, round(coalesce(avg(o_orderkey), 0), 4) AS mean_key FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def mean_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    each = met.groupBy("c_custkey").agg(V.mean(F.col("o_orderkey")).alias("m"))
    return each.select("c_custkey", (F.col("m") == 0).alias("nothing"), F.round("m", 4).alias("mean_key"))


def _centers(of: str, by: str, vector: str, n: int, name: str) -> str:
    """SQL: (key, c) of the centroids of a group's vectors."""
    return f"""{name}_cells AS (SELECT {by} AS key, i, avg({vector}[i]) AS a FROM (SELECT *, unnest(generate_series(1, {n})) AS i FROM {of}) GROUP BY {by}, i),
{name} AS (SELECT key, list(a ORDER BY i) AS c FROM {name}_cells GROUP BY key)"""


@query(
    f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), {_centers('e', 'label', 'v', 64, 'center')},
sims AS (SELECT vec_id, label, {_cos('v', 'c')} AS s FROM e JOIN center ON center.key = label),
bounds AS (SELECT label, avg(s) - 1.0 * coalesce(stddev_samp(s), 0) AS low, count(*) AS n FROM sims GROUP BY label)
SELECT vec_id, label::INTEGER AS label FROM sims JOIN bounds USING (label) WHERE n < 3 OR s >= low"""
)
def pruned_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    return rollup.prune_outliers(e, "label", m=1.0).select("vec_id", F.col("label").cast("int").alias("label"))


@query(
    f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
SELECT 'k' || k.vec_id AS keyword, round(sum({_cos('k.v', 'n.v')}), 6) AS score FROM e k, e n WHERE k.vec_id % 11 = 0 AND n.vec_id % 11 <> 0 GROUP BY k.vec_id ORDER BY sum({_cos('k.v', 'n.v')}) DESC, keyword LIMIT 3"""
)
def keyword_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    words = e.where("vec_id % 11 = 0").select(F.concat(F.lit("k"), F.col("vec_id").cast("string")).alias("keyword"), "vector")
    return rollup.keyword_ranking(e.where("vec_id % 11 <> 0"), words).select("keyword", r6("score").alias("score"))


_CONTENT_SQL = f"""u AS (SELECT parent_key AS file, pattern, bound, leaf FROM nodes WHERE depth = 3),
tagged AS (SELECT file || '|' || pattern AS g, leaf FROM u WHERE pattern IS NOT NULL), {_centers('tagged', 'g', 'leaf', 32, 'tags')},
parts AS (SELECT file, leaf FROM u WHERE pattern IS NULL UNION ALL SELECT split_part(key, '|', 1), c FROM tags UNION ALL SELECT file, leaf FROM u WHERE bound = 'outward'), {_centers('parts', 'file', 'leaf', 32, 'content')}"""


def _units(nodes: DataFrame) -> DataFrame:
    return nodes.where("depth = 3").select(F.col("parent_key").alias("file"), F.get("patterns", 0).alias("pattern"), "bound", "leaf")


@query(f"WITH {NODES_SQL}, {_CONTENT_SQL} SELECT key AS file, {_ROUNDED('c')} AS content FROM content")
def file_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rollup.file_content(_units(vector_tree(spark, sf_dir)))
    return found.select("file", V.rounded(F.col("content")).alias("content"))


@query(
    f"""WITH {NODES_SQL}, {_CONTENT_SQL}, f AS (SELECT key, parent_key, identity, ord, right(key, 2) = 'F3' AS inward FROM nodes WHERE kind = 'file'),
plain AS (SELECT f.key, parent_key, {_mix('identity', 'c', 0.5, 0.5)} AS leaf FROM f JOIN content USING (key) WHERE NOT inward), {_centers('plain', 'parent_key', 'leaf', 32, 'around')},
done AS (SELECT key, parent_key, leaf FROM plain UNION ALL SELECT f.key, parent_key, {_mix('identity', 'coalesce(around.c, content.c)', 0.5, 0.5)} FROM f LEFT JOIN around ON around.key = f.parent_key JOIN content ON content.key = f.key WHERE inward),
{_centers('done', 'parent_key', 'leaf', 32, 'held')},
dirs2 AS (SELECT n.key, n.parent_key, {_mix('n.identity', 'held.c', 0.5, 0.5)} AS leaf FROM nodes n JOIN held ON held.key = n.key WHERE n.kind = 'directory'),
{_centers('dirs2', 'parent_key', 'leaf', 32, 'top')},
tops AS (SELECT n.key, {_mix('n.identity', 'top.c', 0.5, 0.5)} AS leaf FROM nodes n JOIN top ON top.key = n.key WHERE n.depth = 0)
SELECT key, {_ROUNDED('leaf')} AS leaf FROM done UNION ALL SELECT key, {_ROUNDED('leaf')} FROM dirs2 UNION ALL SELECT key, {_ROUNDED('leaf')} FROM tops"""
)
def rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth file of a directory stands for an inward one."""
    nodes = vector_tree(spark, sf_dir)
    files = nodes.where("kind = 'file'").select(F.col("key").alias("file"), F.col("parent_key").alias("directory"), F.when(F.col("key").endswith("F3"), "inward").alias("bound"), "identity", "ord")
    files = rollup.blend_files(files, _units(nodes))
    strip = lambda c: F.regexp_replace(c, "^dir:", "")
    directories = nodes.where("kind = 'directory'").select("path", strip(F.col("parent_key")).alias("parent"), "identity")
    above = rollup.blend_directories(directories, files.withColumn("directory", strip(F.col("directory"))))
    out = files.select(F.col("file").alias("key"), "leaf").unionByName(above.select(F.concat(F.lit("dir:"), F.col("path")).alias("key"), "leaf"))
    return out.select("key", V.rounded(F.col("leaf")).alias("leaf"))


@query(
    f"""WITH {_PARTS_SQL}, own AS (SELECT vec_id, {_mix(_mix('a', 'b', 0.7, 0.3), 'c', 0.5, 0.5)} AS identity, {_mix('c', 'b', 0.7, 0.3)} AS sig FROM v)
SELECT vec_id, {_ROUNDED('identity')} AS identity, {_ROUNDED(_mix('identity', 'sig', 0.5, 0.5))} AS leaf FROM own"""
)
def blended_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vector_parts(spark, sf_dir)
    named = {"name_vec": F.col("a"), "path_vec": F.col("b"), "description_vec": F.col("c"), "signature_vec": F.col("c"), "causes_vec": V.empty(), "calls_vec": F.col("b")}
    found = rollup.blend_units(v.select("vec_id", *[c.alias(n) for n, c in named.items()]))
    return found.select("vec_id", *[V.rounded(F.col(c)).alias(c) for c in ("identity", "leaf")])


# Trees.


@query(f"WITH {NODES_SQL} SELECT key, parent_key FROM nodes")
def wired_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers without parents, wired again from their directories' lists, which also name a file that is not there."""
    nodes = vector_tree(spark, sf_dir).select("key", "kind", "path", "parent_key")
    listed = nodes.where("kind in ('file', 'directory') and parent_key is not null").groupBy(F.regexp_replace("parent_key", "^dir:", "").alias("path"))
    directories = listed.agg(F.concat(F.collect_list("path"), F.array(F.lit("root/missing"))).alias("children"))
    cut = nodes.withColumn("parent_key", F.when(F.col("kind").isin("function", "type"), F.col("parent_key")))
    return tree.wire_parents(cut, directories).select("key", "parent_key")


@query(f"WITH {NODES_SQL} SELECT key, util FROM nodes")
def util_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers lose their flag and get it back from their children; a directory does from its files in the same pass."""
    cut = vector_tree(spark, sf_dir).select("key", "kind", "parent_key", (F.col("util") & F.col("kind").isin("function", "type")).alias("util"))
    return tree.propagate_util(cut).select("key", "util")


@query(f"WITH {NODES_SQL} SELECT (SELECT key FROM nodes WHERE kind = 'directory' AND parent_key IS NULL) AS root, (SELECT key FROM nodes WHERE kind = 'directory' AND util AND parent_key = 'dir:root' ORDER BY ord LIMIT 1) AS capability")
def tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = vector_tree(spark, sf_dir)
    return tree.root_key(nodes).select(F.col("key").alias("root")).crossJoin(F.broadcast(tree.capability_root(nodes).select(F.col("key").alias("capability"))))


@query(f"WITH {NODES_SQL}, g AS (SELECT *, row_number() OVER (PARTITION BY coalesce(pattern, key) ORDER BY ord) AS n, count(*) OVER (PARTITION BY coalesce(pattern, key)) AS group_size FROM nodes) SELECT key, group_size FROM g WHERE n = 1")
def group_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.first_of_group(vector_tree(spark, sf_dir), F.get("patterns", 0)).select("key", "group_size")


_QUERY_SQL = "root_q AS (SELECT identity AS q FROM root)"


@query(
    f"""WITH {NODES_SQL}, {_QUERY_SQL}, s AS (SELECT key, ord, {_cos('q', _mix('leaf', 'identity', 0.75, 0.25))} AS s FROM nodes, root_q WHERE parent_key = 'dir:root'),
u AS (SELECT key, ord, {_cos('q', 'identity')} AS s FROM nodes, root_q WHERE depth = 3 AND util)
(SELECT 'sibling' AS facet, key, round(s, 6) AS similarity FROM s ORDER BY s.s DESC, ord LIMIT 3) UNION ALL (SELECT 'utility', key, round(s, 6) FROM u ORDER BY u.s DESC, ord LIMIT 3)"""
)
def brief_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = vector_tree(spark, sf_dir)
    q = nodes.where("depth = 0").select("identity").first()[0]
    facet = lambda name, rows: rows.select(F.lit(name).alias("facet"), "key", r6("similarity").alias("similarity"))
    return facet("sibling", brief.siblings(nodes, q, "dir:root", 3)).unionByName(facet("utility", brief.utilities(nodes, q, 3)))


@query(
    f"""WITH {NODES_SQL}, {_QUERY_SQL}, near AS (SELECT *, {_cos('q', 'identity')} AS s FROM nodes, root_q WHERE depth = 3 AND NOT util ORDER BY s DESC, ord LIMIT 5),
anchors AS (SELECT key, name, pattern, 'C' || ord % 3 AS companion, row_number() OVER (ORDER BY s DESC, ord) AS n FROM near),
others AS (SELECT *, 'C' || ord % 3 AS companion FROM nodes WHERE depth = 3 AND key NOT IN (SELECT key FROM anchors)),
p AS (SELECT o.key, o.ord, a.name AS anchor, a.n, row_number() OVER (PARTITION BY o.key ORDER BY a.n) AS k FROM others o JOIN anchors a ON a.pattern = o.pattern),
c AS (SELECT o.key, o.ord, a.name AS anchor, a.n, row_number() OVER (PARTITION BY o.key ORDER BY a.n) AS k FROM others o JOIN anchors a ON a.companion = o.companion)
(SELECT 'patterns' AS facet, key, anchor FROM p WHERE k = 1 ORDER BY n, ord LIMIT 6) UNION ALL (SELECT 'companion', key, anchor FROM c WHERE k = 1 ORDER BY n, ord LIMIT 6)"""
)
def brief_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units get one of three companions by their number."""
    nodes = vector_tree(spark, sf_dir).withColumn("companion", F.when(F.col("depth") == 3, F.concat(F.lit("C"), (F.col("ord") % 3).cast("string"))))
    q = nodes.where("depth = 0").select("identity").first()[0]
    anchors = brief.symbols(nodes, q, "")
    out = [brief.members(nodes, anchors, by, 6).select(F.lit(by).alias("facet"), "key", "anchor") for by in ("patterns", "companion")]
    return out[0].unionByName(out[1])


@query(
    f"""WITH {NODES_SQL}, f AS (SELECT parent_key, 'about ' || key AS description, row_number() OVER (PARTITION BY parent_key ORDER BY ord) AS n FROM nodes WHERE kind = 'file' AND ord % 3 <> 0)
SELECT parent_key, description FROM f WHERE n = 1"""
)
def probe_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = vector_tree(spark, sf_dir)
    told = F.when((F.col("kind") == "file") & (F.col("ord") % 3 != 0), F.concat(F.lit("about "), F.col("key")))
    return place.probes(nodes.withColumn("description", told)).select("parent_key", "description")


@query(
    f"""WITH {NODES_SQL}, u AS (SELECT parent_key AS f, ord, {_cos('identity', 'leaf')} AS s FROM nodes WHERE depth = 3), top AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY s DESC, ord) AS n FROM u)
SELECT f AS file, ord, round(s, 6) AS fit FROM top WHERE n <= 2"""
)
def best_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = vector_tree(spark, sf_dir).where("depth = 3").select(F.col("parent_key").alias("file"), "ord", V.cosine(F.col("identity"), F.col("leaf")).alias("fit"))
    return scores.top_of_group(units, "file", [F.desc("fit"), F.asc("ord")], 2).select("file", "ord", r6("fit").alias("fit"))


@query(
    f"""WITH {NODES_SQL}, f AS (SELECT 'a' || ord % 3 AS audit, key, row_number() OVER (PARTITION BY ord % 3 ORDER BY ord) AS rank, count(*) OVER (PARTITION BY ord % 3) AS n FROM nodes WHERE depth = 3)
SELECT audit, key, rank::INTEGER AS rank, greatest(n - 4, 0) AS more FROM f WHERE rank <= 4"""
)
def shown_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    found = vector_tree(spark, sf_dir).where("depth = 3").withColumn("audit", F.concat(F.lit("a"), (F.col("ord") % 3).cast("string")))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("audit").orderBy("ord")))
    return audits.shown(found, 4).select("audit", "key", F.col("rank").cast("int").alias("rank"), "more")


# Sources and snapshots.

_SOURCE = '''/** Module of {n}.
 * @unitUtil
 */
import {{ z }} from "zod";
import {{ Helper }} from "./helper";
const quotes = /["'`{{]/g, half = 4 / 2;
/** Takes {n}.
 * @param a the first
 * @returns a text
 * @unitPure
 * @unitPatterns one, two
 * @unitResidual duplicates [abc]
 */
export function take{k}(a: string, b: number = {k}): string {{
  return `${{join({{ a }})}} }}` + pad(a) + help{k}(b);
}}
// function gone() {{
/** A {n}.
 * @unitCompanion other
 */
export interface Type{k} {{ id: string; helper: Helper[] }}
function help{k}(x: number): number {{ return x; }}
'''


@query(
    """WITH u AS (SELECT n_nationkey AS k, n_name AS n, 'src/r' || n_regionkey || '/n' || n_nationkey || '.ts' AS path FROM nation)
SELECT path, 'take' || k AS name, 'function' AS kind, 'Takes ' || n || '.' AS description, true AS exported, true AS pure, true AS util, 'a: string, b: number' AS params, 'string' AS result, 'join, pad, help' || k AS calls, 'one, two' AS patterns,
  'duplicates abc' AS residuals, NULL AS companion, '' AS fields, 1 AS documented, true AS returned, 14 AS start_line, 16 AS end_line, false AS corrupt FROM u
UNION ALL SELECT path, 'Type' || k, 'type', 'A ' || n || '.', true, false, true, '', NULL, '', '', '', 'other', 'id: string, helper: Helper[]', 0, false, 21, 21, false FROM u
UNION ALL SELECT path, 'help' || k, 'function', NULL, false, false, true, 'x: number', 'number', '', '', '', NULL, '', 0, false, 22, 22, false FROM u"""
)
def unit_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source file a nation, written by rule."""
    sources = _sources(spark, sf_dir)
    u = typescript.parse_files(sources).select("corrupt", F.explode("units").alias("u")).select("u.*", "corrupt")
    pairs = lambda a, b: F.array_join(F.zip_with(a, b, lambda x, y: F.concat(x, F.lit(": "), y)), ", ")
    return u.select(
        "path", "name", "kind", "description", "exported", "pure", "util", pairs("param_names", "param_types").alias("params"), F.col("returns_type").alias("result"), F.array_join("calls", ", ").alias("calls"),
        F.array_join("patterns", ", ").alias("patterns"), F.array_join(F.transform("residuals", lambda r: F.concat_ws(" ", r["audit"], r["hash"])), ", ").alias("residuals"), "companion",
        F.array_join(F.transform("fields", lambda f: F.concat(f["name"], F.lit(": "), f["type"])), ", ").alias("fields"), F.col("documented_params").alias("documented"), F.col("has_return_doc").alias("returned"), "start_line", "end_line", "corrupt",
    )


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("n_nationkey").cast("string"), F.col("n_name")
    pieces = _SOURCE.replace("{n}", "\0n\0").replace("{k}", "\0k\0").replace("{{", "{").replace("}}", "}").split("\0")
    code = F.concat(*[{"n": n, "k": k}.get(p, F.lit(p)) for p in pieces])
    path = F.concat(F.lit("src/r"), F.col("n_regionkey").cast("string"), F.lit("/n"), k, F.lit(".ts"))
    return table(spark, sf_dir, "nation").select(path.alias("path"), code.alias("code"))


@query(
    """WITH u AS (SELECT 'src/r' || n_regionkey || '/n' || n_nationkey || '.ts' AS path, 'Type' || n_nationkey AS name, n_name AS n FROM nation)
SELECT path, 'zod' AS external, './helper' AS internal, 'Module of ' || n || '.' AS description, name, './helper' AS refs FROM u"""
)
def file_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = typescript.parse_files(_sources(spark, sf_dir))
    refs = typescript.field_references(typescript.unit_table(files), files).select("path", "name", F.array_join("refs", ", ").alias("refs"))
    return files.select("path", F.array_join("imports_external", ", ").alias("external"), F.array_join("imports_internal", ", ").alias("internal"), "description").join(refs, "path")


@query(
    """WITH f AS (SELECT n_regionkey AS r, 'src/r' || n_regionkey || '/n' || n_nationkey || '.ts' AS path FROM nation)
SELECT 'src/r' || r AS path, 'r' || r AS name, string_agg(path, ' ' ORDER BY path) AS children, 'Region ' || r AS description, r % 2 = 0 AS util, 'it' AS role, 'outliers' AS residuals FROM f GROUP BY r
UNION ALL SELECT 'src', 'src', string_agg('src/r' || r, ' ' ORDER BY r), NULL, false, NULL, '' FROM (SELECT DISTINCT r FROM f)"""
)
def scanned_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("r_regionkey").cast("string")
    told = F.concat(F.lit("Region "), r, F.lit('\n@unitBorrows src/other "it"\n@unitResidual outliers\n'), F.when(F.col("r_regionkey") % 2 == 0, "@unitUtil").otherwise(""))
    manifests = table(spark, sf_dir, "region").select(F.concat(F.lit("src/r"), r).alias("path"), told.alias("content"))
    found = typescript.directories(typescript.parse_files(_sources(spark, sf_dir)), "src", manifests)
    return found.select(
        "path", "name", F.array_join("children", " ").alias("children"), "description", "util", F.col("borrows.role").alias("role"), F.array_join(F.transform("residuals", lambda x: x["audit"]), " ").alias("residuals")
    )


@query(
    """SELECT * FROM (VALUES (1, '3-c3', 3, 'first'), (2, '4-c4', 4, NULL), (3, '5-c5', 5, NULL)) AS t(place, snapshot_id, ms, pin)"""
)
def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six snapshots of the nations, of which a store that keeps two unpinned ones has three left: one was pinned."""
    from canopy.plans.settle import shared_folder

    store = SnapshotStore(spark, f"{shared_folder(spark)}/canopy-{uuid.uuid4().hex}", keep=2)
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.lit(1.0).alias("overall_score"))
    for ms in range(1, 7):
        store.write({"scores": rows}, model_id="m", commit=f"c{ms}", now_ms=ms)
        if ms in (1, 3):
            store.pin("first")  # the name moves from the first snapshot to the third
    found = [(n, s.snapshot_id, s.timestamp, s.pin_name) for n, s in enumerate(store.history(), 1)]
    return spark.createDataFrame(found, "place int, snapshot_id string, ms int, pin string")
