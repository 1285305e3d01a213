import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators import audits, brief, cluster, pairs, place, ranked, rollup, scores, tree
from canopy.sources.embed import embedded, hashing_embedder

from .helpers import Tree


def _found(spark, t, name, k=2.0):
    return [r.asDict() for r in audits.REGISTRY[name].detect(audits.Context(t.frame(spark), k)).collect()]


def one_hot(n, k):
    return [1.0 if i == k else 0.0 for i in range(n)]


def test_every_audit_is_registered():
    assert len(audits.REGISTRY) == 14


def test_incomplete_docs(spark):
    t = Tree()
    t.dir("src", [1, 0])
    t.file("src/a.ts", [1, 0])
    t.fn("src/a.ts", "go", [1, 0], pure=False, param_names=["x"], param_types=["T"], returns_type="string", description=None)
    t.fn("src/a.ts", "quiet", [1, 0], description=None, residuals=[("incomplete-docs", None)])
    found = _found(spark, t, "incomplete-docs")
    assert [f["name"] for f in found] == ["go"] and found[0]["pair_name"] == "description, 1/1 @param, @returns, purity or causes"


def test_focal_drift(spark):
    t = Tree()
    t.dir("src", [1, 0])
    t.file("src/a.ts", [1, 0])
    t.fn("src/a.ts", "focal", [0, 1], bound="outward")
    t.fn("src/a.ts", "overtaker", [1, 0])
    found = _found(spark, t, "focal-drift")
    assert [(f["name"], f["pair_name"]) for f in found] == [("focal", "overtaker")] and found[0]["value"] == pytest.approx(1)


def _incoherent(util):
    t = Tree()
    t.dir("src", [0.5, 0.5, 0])
    for k in range(5):
        t.file(f"src/f{k}.ts", [0.9, 0.1, 0], util=util)
        for n in "ab":
            t.fn(f"src/f{k}.ts", n, [0.88, 0.12, 0], util=util)
    t.file("src/bad.ts", [0, 0, 1], [1, 0, 0], util=util)
    for n in "ab":
        t.fn("src/bad.ts", n, [0, 0, 1], util=util)
    return t


def test_incoherent(spark):
    assert "file:src/bad.ts" in [f["key"] for f in _found(spark, _incoherent(False), "incoherent")]
    assert "file:src/bad.ts" in [f["key"] for f in _found(spark, _incoherent(True), "incoherent-utils")]


def test_outliers(spark):
    t = Tree()
    t.dir("src", [0.8, 0.2, 0])
    t.file("src/a.ts", [0.8, 0.2, 0])
    for n, v in zip("abcd", ([0.9, 0.1, 0], [0.85, 0.15, 0], [0.88, 0.12, 0], [0.87, 0.13, 0]), strict=True):
        t.fn("src/a.ts", n, v)
    t.fn("src/a.ts", "outlier", [0, 0, 1])
    assert [f["name"] for f in _found(spark, t, "outliers")] == ["outlier"]


def _duplicates(util):
    t = Tree()
    t.dir("src", [1] + [0] * 5)
    t.file("src/base.ts", [0, 0, 1, 1, 1, 1])
    for k in range(2, 6):
        t.fn("src/base.ts", f"b{k}", one_hot(6, k))
    t.file("src/a.ts", [0.95, 0.05, 0, 0, 0, 0])
    t.fn("src/a.ts", "fnA", [0.95, 0.05, 0, 0, 0, 0], util=util)
    t.file("src/b.ts", [0.94, 0.06, 0, 0, 0, 0])
    t.fn("src/b.ts", "fnB", [0.94, 0.06, 0, 0, 0, 0], util=util)
    return t


def test_duplicates(spark):
    assert ("fnA", "fnB") in [(f["name"], f["pair_name"]) for f in _found(spark, _duplicates(False), "duplicates")]
    assert ("fnA", "fnB") in [(f["name"], f["pair_name"]) for f in _found(spark, _duplicates(True), "util-duplicates")]


def test_duplicates_exclude_callers_patterns_and_residuals(spark):
    base = _duplicates(False)
    for change in ({"calls": ["fnB"]}, {"residuals": [("duplicates", None)]}):
        t = _duplicates(False)
        at = next(i for i, r in enumerate(t.rows) if r[2] == "fnA")
        from .helpers import SCHEMA

        t.rows[at] = tuple(change.get(f.name, v) for f, v in zip(SCHEMA.fields, t.rows[at], strict=True))
        assert ("fnA", "fnB") not in [(f["name"], f["pair_name"]) for f in _found(spark, t, "duplicates")]
    assert base.rows


def test_containments(spark):
    t = Tree()
    t.dir("src", [0.5, 0.5, 0])
    for k in range(4):
        t.file(f"src/f{k}.ts", [0.5, 0.5, 0])
        t.fn(f"src/f{k}.ts", "p", [0.6, 0.4, 0])
        t.fn(f"src/f{k}.ts", "q", [0.4, 0.6, 0])
    t.file("src/dom.ts", [1, 0, 0])
    t.fn("src/dom.ts", "dominant", [0.99, 0.01, 0])
    t.fn("src/dom.ts", "weakA", [0, 1, 0])
    t.fn("src/dom.ts", "weakB", [0, 0, 1])
    assert ("file:src/dom.ts", "dominant") in [(f["key"], f["pair_name"]) for f in _found(spark, t, "containments", 1.5)]


def test_misplaced_and_bleed(spark):
    t = Tree()
    t.dir("src", [0.5, 0.5, 0])
    for n, v in (("auth", [1, 0, 0]), ("api", [0, 1, 0]), ("db", [0, 0, 1])):
        t.dir(f"src/{n}", v)
    for k in range(8):
        t.file(f"src/auth/f{k}.ts", [0.45, 0.55, 0])
    t.file("src/auth/misfit.ts", [0, 0.95, 0.05])
    assert "misfit.ts" in [f["name"] for f in _found(spark, t, "misplaced")]
    t = Tree()
    t.dir("src", [0.5, 0.5, 0])
    for n, v in (("auth", [0, 0.95, 0.05]), ("api", [0, 1, 0]), ("db", [0, 0, 1])):
        t.dir(f"src/{n}", v)
    t.dir("other", [0.3, 0.3, 0.4])
    assert _found(spark, t, "vocabulary-bleed")


def test_merge_candidates(spark):
    t = Tree()
    t.dir("src", one_hot(6, 0))
    t.file("src/a.ts", one_hot(6, 0))
    for k in range(2, 6):
        t.fn("src/a.ts", f"b{k}", one_hot(6, k))
    t.fn("src/a.ts", "nearA", [0.95, 0.05, 0, 0, 0, 0])
    t.fn("src/a.ts", "nearB", [0.94, 0.06, 0, 0, 0, 0])
    assert [(f["name"], f["pair_name"]) for f in _found(spark, t, "merge-candidates")] == [("nearA", "nearB")]


def _two_bundles(make):
    rows = []
    for k, (a, b) in enumerate([(0.9, 0.1), (0.85, 0.15), (0.88, 0.12)]):
        rows.append((f"x{k}", [a, b] + [0] * 6))
        rows.append((f"y{k}", [0] * 6 + [a, b]))
    for n, v in rows:
        make(n, v)


def test_bloated(spark):
    t = Tree()
    t.dir("src", [1] * 8)
    _two_bundles(lambda n, v: t.file(f"src/{n}.ts", v))
    assert [f["key"] for f in _found(spark, t, "bloated-directories")] == ["dir:src"]
    t = Tree()
    t.dir("src", [1] * 8)
    t.file("src/a.ts", [1] * 8)
    _two_bundles(lambda n, v: t.fn("src/a.ts", n, v))
    assert [f["key"] for f in _found(spark, t, "bloated-files")] == ["file:src/a.ts"]


def test_weak_identity(spark):
    t = Tree()
    t.dir("src", [1, 1, 1])
    t.dir("src/weak", [1, 0, 0])
    t.dir("src/strong", [0, 1, 0])
    for k in range(3):
        t.file(f"src/weak/f{k}.ts", [0.1, 0.9, 0])
        t.file(f"src/strong/g{k}.ts", [0, 1, 0])
    found = _found(spark, t, "weak-identity", 0.5)
    assert [(f["name"], f["pair_key"]) for f in found] == [("weak", "strong")]


def test_report_ranks_and_limits(spark):
    t = _duplicates(False)
    rows = audits.report(audits.Context(t.frame(spark)), ["duplicates", "incomplete-docs"])
    assert {r["audit"] for r in rows.collect()} <= {"duplicates", "incomplete-docs"}
    assert audits.shown(rows, 1).groupBy("audit").count().where("count > 1").count() == 0
    assert audits.report(audits.Context(t.frame(spark), disabled=frozenset({"duplicates"})), ["duplicates", "focal-drift"]).where("audit = 'duplicates'").count() == 0


def test_pairs_above_equals_brute_force(spark):
    r = np.random.default_rng(0)
    x, y = r.standard_normal((40, 6)), r.standard_normal((25, 6))
    frame = lambda m, p: spark.createDataFrame([(f"{p}{i}", i, v.tolist()) for i, v in enumerate(m)], "key string, ord long, vector array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    for rows in (7, 1000):
        got = {(p["a"], p["b"]) for p in pairs.pairs_above(frame(x, "x"), None, 0.4, rows).collect()}
        s = unit(x) @ unit(x).T
        assert got == {(f"x{i}", f"x{j}") for i in range(40) for j in range(i + 1, 40) if s[i, j] > 0.4}
        got = {(p["a"], p["b"]) for p in pairs.pairs_above(frame(x, "x"), frame(y, "y"), 0.4, rows).collect()}
        s = unit(x) @ unit(y).T
        assert got == {(f"x{i}", f"y{j}") for i in range(40) for j in range(25) if s[i, j] > 0.4}


def test_score_cards(spark):
    t = Tree()
    t.dir("src", [0.8, 0.2, 0.1, 0.1], [0.9, 0.1, 0.1, 0])
    t.file("src/app.ts", [0.7, 0.4, 0.2, 0.1], [0.8, 0.3, 0.1, 0])
    t.file("src/utils.ts", [0.2, 0.7, 0.4, 0.1], [0.1, 0.8, 0.3, 0])
    t.fn("src/app.ts", "main", [0.75, 0.3, 0.2, 0.1])
    t.fn("src/app.ts", "formatName", [0.25, 0.75, 0.3, 0.1])
    cards = {r["key"]: r for r in scores.score_cards(t.frame(spark)).collect()}
    for r in cards.values():
        for c in ("score", "children_score", "subtree_score", "overall_score"):
            assert r[c] is None or 0 <= r[c] <= 1
    assert cards["dir:src"]["fit"] is None and cards["func:src/app.ts:main"]["uniqueness"] != 2
    assert cards["file:src/app.ts"]["subtree_uniqueness"] is None and cards["file:src/app.ts"]["overall_score"] == cards["file:src/app.ts"]["score"]
    assert cards["file:src/utils.ts"]["children_uniqueness"] is None and cards["file:src/utils.ts"]["children_fit"] is not None
    assert cards["func:src/app.ts:main"]["best_uncle"] == "utils.ts"


def test_inward_fit_is_against_siblings(spark):
    t = Tree()
    t.dir("src", [1, 0])
    t.file("src/index.ts", [1, 0], bound="inward")
    t.file("src/a.ts", [0, 1])
    t.file("src/b.ts", [1, 0], util=True)
    fits = {r["key"]: r["fit"] for r in scores.fit(t.frame(spark)).collect()}
    assert fits["file:src/index.ts"] == pytest.approx(0) and fits["file:src/b.ts"] is None


def test_deltas(spark):
    row = lambda k, x: (k, x, x, x, x)
    schema = "key string, overall_score double, score double, children_score double, subtree_fit double"
    now, old = spark.createDataFrame([row("a", 0.5), row("b", 0.4)], schema), spark.createDataFrame([row("a", 0.2), row("b", None)], schema)
    got = {r["key"]: r["subtree_delta"] for r in scores.score_deltas(now, old).collect()}
    assert got["a"] == pytest.approx(0.3) and got["b"] == 0


def test_tree_flags(spark):
    t = Tree()
    t.dir("src", [1, 0])
    t.dir("src/u", [1, 0])
    t.file("src/u/a.ts", [1, 0])
    t.fn("src/u/a.ts", "one", [1, 0], util=True, calls=["low", "low"])
    t.fn("src/u/a.ts", "two", [1, 0], util=True, calls=["low"])
    t.fn("src/u/a.ts", "low", [1, 0], util=True, exported=False)
    n = t.frame(spark)
    assert {r["name"] for r in tree.detect_helpers(n).where("helper").collect()} == {"low"}
    util = {r["key"] for r in tree.propagate_util(n).where("util").collect()}
    assert {"file:src/u/a.ts", "dir:src/u"} <= util and "dir:src" not in util
    assert {(r["key"], r["ancestor"], r["distance"]) for r in tree.ancestors(n).collect()} >= {("func:src/u/a.ts:one", "file:src/u/a.ts", 1), ("func:src/u/a.ts:one", "dir:src/u", 2)}
    assert tree.root_key(n).first()["key"] == "dir:src"


def test_patterns(spark):
    t = Tree()
    t.dir("src", [1, 0])
    for d in ("x", "y"):
        t.dir(f"src/{d}", [1, 0])
        t.file(f"src/{d}/a.ts", [1, 0])
        for k in range(3):
            t.fn(f"src/{d}/a.ts", f"f{k}", [1, k], patterns=["P", "Q"] if k < 2 else ["P"])
    n = t.frame(spark)
    grouped = tree.group_patterns(n)
    made = {r["key"]: r["parent_key"] for r in grouped.where("kind = 'pattern'").collect()}
    outer = "pattern:file:src/x/a.ts:P"
    assert made[outer] == "file:src/x/a.ts" and made[f"pattern:{outer}:Q"] == outer
    assert {r["parent_key"] for r in grouped.where("name = 'f0' and path = 'src/x/a.ts'").collect()} == {f"pattern:{outer}:Q"}
    assert [(r["tag"], r["files"], r["directory_key"]) for r in tree.cross_file_patterns(n.where("size(patterns) > 0").select(F.get("patterns", 0).alias("tag"), "path"), n).collect()] == [("P", 2, "dir:src")]


def test_average_linkage_against_definition():
    r = np.random.default_rng(3)
    for n in (2, 3, 7, 12):
        d = cluster.angles(r.standard_normal((n, 5)))
        groups, want = [[i] for i in range(n)], []
        while len(groups) > 1:
            _, a, b = min((np.mean([[d[x, y] for y in groups[j]] for x in groups[i]]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
            want.append(np.mean([[d[x, y] for y in groups[b]] for x in groups[a]]))
            groups[a] = groups[a] + groups[b]
            del groups[b]
        assert [h for _, _, h in cluster.average_linkage(d)] == pytest.approx(sorted(want))


def test_dendrogram_and_gap(spark):
    assert cluster.dendrogram(np.ones((1, 3))) is None
    clusters, gap, merges = cluster.dendrogram(np.array([[1, 0.0], [1, 0.01], [0, 1], [0.01, 1]]))
    assert clusters == [[0, 1], [2, 3]] and gap > 1 and len(merges) == 3
    arr = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    one = spark.range(1)
    assert one.select(cluster.significant_gap(arr(0, 0.1, 0.2, 2), 2.0).alias("x")).first()["x"]
    assert not one.select(cluster.significant_gap(arr(0, 1), 2.0).alias("x")).first()["x"]
    assert one.select(cluster.cut_thresholds(arr(3, 1, 2)).alias("x")).first()["x"] == [1.5, 2.5]


def test_advice_finds_two_groups(spark):
    rows, r = [], np.random.default_rng(1)
    for k in range(8):
        v = np.array([1, 0.2, 0, 0] if k % 2 else [0, 0, 1, 0.2]) + r.normal(0, 0.05, 4)
        rows.append((f"d{k}", k, v.tolist(), v.tolist()))
    got = cluster.advise_descriptions(spark.createDataFrame(rows, "name string, ord long, identity array<double>, leaf array<double>")).first()
    assert got["child_count"] == 8 and len(got["merges"]) == 7 and len(got["cuts"]) == 6
    last = got["cuts"][-1]
    assert sorted(sorted(g["names"]) for g in last["groups"]) == [["d0", "d2", "d4", "d6"], ["d1", "d3", "d5", "d7"]]


def test_local_projection_keeps_geometry():
    r = np.random.default_rng(0)
    children, q = r.standard_normal((5, 20)), r.standard_normal(20)
    pq, pc = cluster.local_projection(q, children)
    moved = children - children.mean(0)
    assert pc @ pc.T == pytest.approx(moved @ moved.T, abs=1e-8) and pc @ pq == pytest.approx(moved @ (q - children.mean(0)), abs=1e-8)
    assert cluster.local_projection(q, children[:1]) is None and cluster.local_projection(q, np.ones((3, 20))) is None
    assert cluster.softmax_with_new(np.array([0.1, 0.5])).sum() == pytest.approx(1)


def _project():
    t = Tree()
    embed = hashing_embedder(32)
    e = lambda s: embed([s])[0]
    t.dir("src", e("application root billing search"))
    for d, topic in (("billing", "invoice payment tax money"), ("search", "query index ranking token")):
        t.dir(f"src/{d}", e(topic), description=topic)
        for k, w in enumerate(topic.split()):
            t.file(f"src/{d}/{w}.ts", e(f"{w} {topic}"), description=f"{w} handling of {topic}")
            t.fn(f"src/{d}/{w}.ts", f"make{w}", e(f"{w} {topic}"), patterns=["maker"] if k < 2 else [])
    t.dir("src/utils", e("string date helper"), util=True)
    t.file("src/utils/str.ts", e("string helper"), util=True)
    t.fn("src/utils/str.ts", "trimAll", e("string helper trim"), util=True)
    return t, embed


def test_place_and_brief(spark):
    t, embed = _project()
    nodes = t.frame(spark).persist()
    got = place.place(nodes, "invoice tax payment money", embed, place.Calibration(-1, -1, -1, -1, 4))
    assert got["suggestion"]["action"] in ("add-to-directory", "ask-user") and got["axis"]["classification"] == "domain"
    assert got["axis"]["domain_fit"] > got["axis"]["capability_fit"]
    assert got["top_paths"][0]["parent_key"] in ("dir:src/billing", "dir:src") and 0 < got["confidence"] <= 100
    assert got["related"][0]["similarity"] >= got["related"][-1]["similarity"]
    facets = brief.brief(nodes, "invoice tax payment money", embed, {"symbols": 2}, place.Calibration(-1, -1, -1, -1, 4))
    names = [r["name"] for r in facets["symbols"].collect()]
    assert len(names) == 2 and facets["utilities"].first()["name"] == "trimAll"
    members = [r["name"] for r in facets["pattern_members"].collect()]
    assert not set(members) & set(names) and facets["companion_members"].count() == 0
    assert place.bridge_type(embed, embed(["network database filesystem boundary gateway"])[0])["type"] == "gateway"
    assert place.route_by_layer(nodes, "root", [0.0] * 32) == ("dir:src", "src") and place.route_by_layer(nodes, "command", [0.0] * 32) is None
    assert place.route_by_layer(nodes, "domain", embed(["query index ranking"])[0])[0] == "dir:src/search"


def test_calibration(spark):
    t, embed = _project()
    cal = place.calibrate(t.frame(spark).persist(), embed)
    assert cal.probe_count == 3
    assert place.thresholds([0.9, 0.8, 0.85], [0.5, 0.6, 0.55]).gate == pytest.approx(0.55 - 2 * 1.4826 * 0.05)
    t = Tree()
    t.dir("src", [1, 0])
    assert place.calibrate(t.frame(spark), lambda x: [[1.0, 0.0]] * len(x)) == place.Calibration()


def test_rollup(spark):
    units = spark.createDataFrame(
        [("f", "P", None, [1.0, 0.0]), ("f", "P", None, [0.0, 1.0]), ("f", None, "outward", [4.0, 4.0]), ("g", None, None, [2.0, 0.0])], "file string, pattern string, bound string, leaf array<double>"
    )
    content = {r["file"]: r["content"] for r in rollup.file_content(units).collect()}
    assert content["f"] == pytest.approx([8.5 / 3, 8.5 / 3]) and content["g"] == [2, 0]
    files = spark.createDataFrame([("f", "d", None, [0.0, 0.0], 1), ("g", "d", None, [0.0, 0.0], 2), ("i", "d", "inward", [1.0, 1.0], 3)], "file string, directory string, bound string, identity array<double>, ord long")
    leaf = {r["file"]: r["leaf"] for r in rollup.blend_files(files, units).collect()}
    assert leaf["g"] == [1, 0] and leaf["i"] == pytest.approx([0.5 + 0.25 * (8.5 / 6 + 1) , 0.5 + 0.25 * (8.5 / 6)])
    dirs = spark.createDataFrame([("d", "", [1.0, 0.0]), ("d/e", "d", [0.0, 2.0])], "path string, parent string, identity array<double>")
    held = spark.createDataFrame([("d/e", [2.0, 0.0]), ("d", [4.0, 0.0])], "directory string, leaf array<double>")
    out = {r["path"]: r["leaf"] for r in rollup.blend_directories(dirs, held).collect()}
    assert out["d/e"] == [1, 1] and out["d"] == pytest.approx([0.5 + 0.25 * 5, 0.25])


def test_cache_and_blend(spark):
    units = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")], "cache_key string, facet_hash string")
    old = spark.createDataFrame([("a", "h1", [1.0], [2.0]), ("b", "other", [1.0], [2.0])], "cache_key string, facet_hash string, identity array<double>, leaf array<double>")
    got = {r["cache_key"]: (r["cached"], r["identity"], r["leaf"]) for r in rollup.resolve_cache(units, old, F.lit(True)).collect()}
    assert got == {"a": (True, [1.0], None), "b": (False, None, None), "c": (False, None, None)}
    assert rollup.resolve_cache(units, None).where("cached").count() == 0
    ranked = rollup.keyword_ranking(spark.createDataFrame([([1.0, 0.0],), ([0.9, 0.1],)], "vector array<double>"), spark.createDataFrame([("near", [2.0, 0.0]), ("far", [0.0, 1.0])], "keyword string, vector array<double>"))
    assert [r["keyword"] for r in ranked.collect()] == ["near", "far"]


def test_embedding_skips_empty_texts(spark):
    seen = embedded(spark.createDataFrame([(1, "alpha"), (2, ""), (3, None), (4, "alpha")], "id long, t string"), {"t": "v"}, hashing_embedder(16), batch=1).orderBy("id").collect()
    assert [len(r["v"]) for r in seen] == [16, 0, 0, 16] and seen[0]["v"] == seen[3]["v"] and sum(x * x for x in seen[0]["v"]) == pytest.approx(1)


def test_render(spark):
    from canopy.operators import render

    t = _duplicates(False)
    nodes = t.frame(spark)
    ctx = audits.Context(nodes)
    lines = render.finding_lines(audits.report(ctx, ["duplicates", "incomplete-docs", "merge-candidates"]), ctx.nodes, "src").collect()
    assert any(r["heading"].startswith('"fnA" [') and "duplicates across modules" in r["heading"] and r["detail"] == "similarity 100%" for r in lines)
    assert all(r["heading"] for r in lines)
    cards = render.score_lines(scores.score_cards(nodes)).collect()
    assert {r["verdict"] for r in cards} <= {"strong", "moderate", "weak", None} and render.as_json(nodes.select("key")).first()["json"].startswith('{"key"')
    where = cluster.positions_3d(nodes.where("parent_key is not null").select(F.col("parent_key").alias("group"), "key", "ord", F.col("leaf").alias("vector")))
    assert '"x":' in render.tree_json(nodes, where).first()["json"]
    assert {r["key"]: r["children"] for r in tree.count_children(nodes.select("key", "kind")).collect()}["file:src/base.ts"] == 4


def test_lifted_patterns(spark):
    t = Tree()
    t.dir("src", [1, 0])
    for d in ("x", "y"):
        t.dir(f"src/{d}", [1, 0])
        t.file(f"src/{d}/a.ts", [1, 0])
        for k in range(2 if d == "x" else 1):
            t.fn(f"src/{d}/a.ts", f"f{k}", [1, k], patterns=["P"])
    out = {r["key"]: r["parent_key"] for r in tree.lift_patterns(tree.group_patterns(t.frame(spark))).collect()}
    assert out["pattern:dir:src:P"] == "dir:src" and out["pattern:file:src/x/a.ts:P"] == "pattern:dir:src:P" == out["func:src/y/a.ts:f0"]
    assert out["func:src/x/a.ts:f0"] == "pattern:file:src/x/a.ts:P"


def test_texts_of_placements(spark):
    from canopy.operators import render

    t, embed = _project()
    nodes = t.frame(spark).persist()
    cal = place.Calibration(-1, -1, -1, -1, 4)
    assert "confidence" in render.placement_text(place.place(nodes, "invoice tax", embed, cal))
    told = render.brief_text(brief.brief(nodes, "invoice tax", embed, calibration=cal))
    assert told.startswith("Placement:") and "Utilities:\n  trimAll" in told


def test_duplicate_pairs_are_ruled_out_before_they_leave_their_task(spark):
    """Nulls and shared values rule out as the joins on every pair did, and nothing is joined to the pairs any more."""
    rows, r = [], np.random.default_rng(3)
    t = Tree()
    t.dir("src", [1, 0])
    for f, companion in enumerate((None, "c", "c", "d")):
        t.file(f"src/f{f}.ts", [1, 0.1 * f], companion=companion)
        for u in range(4):
            extra = {"patterns": [[], None, ["p", None], [None]][u], "calls": [None, ["f0u1"], [], ["f2u0", None]][u], "util": u == 3, "kind": "type" if u == 1 else "function"}
            t.fn(f"src/f{f}.ts", f"f{f}u{u}", r.uniform(0.2, 1, 2).tolist(), **extra)
    nodes = t.frame(spark)
    found = pairs.duplicates(nodes, 0.5, 0.5, told=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("FlatMapGroupsInArrow")]
    rows = [x.asDict() for x in nodes.collect()]
    parent = {x["key"]: x for x in rows}
    want = set()
    for x in rows:
        for y in rows:
            s = np.dot(x["leaf"], y["leaf"]) / np.linalg.norm(x["leaf"]) / np.linalg.norm(y["leaf"])
            p, q = parent.get(x["parent_key"]), parent.get(y["parent_key"])
            if x["depth"] != y["depth"] or not p or p is q and x["depth"] == 2 or x["parent_key"] == y["parent_key"] or s <= 0.5 or x["depth"] != 2:
                continue
            called = x["kind"] == "function" and y["name"] in (x["calls"] or ()) or y["kind"] == "function" and x["name"] in (y["calls"] or ())
            shared = {v for v in x["patterns"] or () if v} & set(y["patterns"] or ())
            mates = p["companion"] and p["companion"] == q["companion"]
            if called or shared or x["util"] or (x["ord"] > y["ord"] if not y["util"] else False) or (mates and not y["util"]):
                continue
            want.add((x["key"], y["key"], x["name"], y["name"], x["parent_key"], x["ord"]))
    got = [(f["a"], f["b"], f["a_name"], f["b_name"], f["a_parent_key"], f["a_ord"]) for f in found.collect()]
    assert want and sorted(got) == sorted(want)


def test_report_holds_no_cached_tree_and_ranks_ties_by_pair(spark):
    t = Tree()
    t.dir("src", [1, 0])
    for f in range(5):
        t.file(f"src/f{f}.ts", [1, 0.1 * f])
        for u in range(3):
            t.fn(f"src/f{f}.ts", f"f{f}u{u}", [1, 0] if u == 0 else [float(u - 1), f + 1.0])
    nodes = t.frame(spark).persist()
    rows = audits.report(audits.Context(nodes, 0.1), ["duplicates", "outliers"])
    assert "InMemory" not in rows._jdf.queryExecution().toString()
    found = [(r["rank"], -r["value"], r["ord"], r["key"], r["pair_key"]) for r in rows.where("audit = 'duplicates'").collect()]
    nodes.unpersist()
    assert len({x[1:4] for x in found}) < len(found)
    assert [x[0] for x in sorted(found, key=lambda x: x[1:])] == list(range(1, len(found) + 1))


def _copies():
    """Units in files of two directories, many of them copies, with calls, companions, a pattern and types that units make."""
    t = Tree()
    t.dir("src", [1, 0, 0])
    for d in "ab":
        t.dir(f"src/{d}", [1, 0, 0])
        for f in range(3):
            path = f"src/{d}/f{f}.ts"
            t.file(path, [1, 0.1 * f, 0], companion="c" if f == 1 else None)
            if f == 2:
                t.add("pattern", f"{path}/p", "p", [1, 0.2, 0.1], parent=f"file:{path}", depth=4)
                t.add("function", f"{path}/p", f"{d}in", [1, 0.2, 0], parent=f"pattern:{path}/p", depth=5)
            for u in range(7):
                name = f"{d}{f}u{u}"
                extra = {"calls": [f"{d}{f}u0", "bin"], "returns_type": f"{d}{f}t0", "residuals": [("merge-candidates", None)] if u == 5 else []}
                t.fn(path, name, [1, 0, 0] if u < 3 else [1, 0.3 * u, 0.1 * f], util=d == "b" and f < 2, patterns=["P"] if u == 4 else [], **extra)
                t.fn(path, f"{d}{f}t{u}", [1, 0.01 * u, 0.2], kind="type", companion="c" if u == 6 else None)
    return t


@pytest.mark.parametrize("name", ["duplicates", "util-duplicates", "merge-candidates"])
@pytest.mark.parametrize(("block_rows", "range_pairs"), [(4_000, 4_000_000), (7, 10)])
def test_pairs_are_ranked_in_blocks_and_ranges(spark, name, block_rows, range_pairs):
    ctx = audits.Context(_copies().frame(spark), -0.5)
    columns = ["key", "name", "hash", "parent_key", "pair_key", "pair_name", "ord"]
    members, meets = audits.PAIRED[name](ctx)
    rows = ranked.ranked_pairs(members, meets, [*columns, "value", "rank"], siblings=name == "merge-candidates", block_rows=block_rows, range_pairs=range_pairs).collect()
    found = {tuple(r[c] for c in columns): r["value"] for r in rows}
    want = {tuple(r[c] for c in columns): r["value"] for r in audits.REGISTRY[name].detect(ctx).collect()}
    assert want and len(found) == len(rows) and found == pytest.approx(want)
    order = sorted(rows, key=lambda r: (-r["value"], r["ord"], r["key"], r["pair_key"]))
    assert len({r["value"] for r in rows}) < len(rows) and [r["rank"] for r in order] == list(range(1, len(rows) + 1))


def test_report_sorts_no_pairs(spark):
    rows = audits.report(audits.Context(_copies().frame(spark), -0.5), list(audits.PAIRED))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "parent_key" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    assert {r["audit"] for r in rows.select("audit").collect()} == set(audits.PAIRED)


def test_cells_are_packed_with_gaps_of_any_width():
    for cells in ([], [0], [5, 6, 65_540, 65_541, 131_075, 10**9], list(range(0, 10**6, 7))):
        cells = np.array(cells, np.int64)
        assert (ranked.unpacked(ranked.packed(cells), len(cells)) == cells).all()
