import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.functions import stats, text
from canopy.functions import vectors as V


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def _v(*x):
    return F.array(*[F.lit(float(v)) for v in x])


def test_cosine(spark):
    assert _one(spark, V.cosine(_v(1, 0), _v(0, 1))) == 0
    assert _one(spark, V.cosine(_v(1, 2), _v(1, 2))) == pytest.approx(1)
    assert _one(spark, V.cosine(_v(1, 2), _v(-1, -2))) == pytest.approx(-1)
    assert _one(spark, V.cosine(V.empty(), _v(1, 2))) == 0 == _one(spark, V.cosine(_v(0, 0), _v(1, 2)))
    r = np.random.default_rng(0)
    rows = [(r.standard_normal(8).tolist(), r.standard_normal(8).tolist()) for _ in range(50)]
    for x in spark.createDataFrame(rows, "a array<double>, b array<double>").withColumn("c", V.cosine(F.col("a"), F.col("b"))).collect():
        assert x["c"] == pytest.approx(np.dot(x["a"], x["b"]) / np.linalg.norm(x["a"]) / np.linalg.norm(x["b"]))
        assert -1 <= x["c"] <= 1


def test_blends(spark):
    assert _one(spark, V.blend(_v(1, 0), _v(0, 1), 0.5, 0.5)) == [0.5, 0.5]
    assert _one(spark, V.blend(V.empty(), _v(0, 1), 0.5, 0.5)) == [0, 1] and _one(spark, V.blend(_v(2, 1), V.empty(), 0.5, 0.5)) == [2, 1]
    assert _one(spark, V.signature_signals(_v(1, 0), V.empty(), V.empty())) == [1, 0]
    assert _one(spark, V.signature_signals(_v(1, 0), _v(0, 1), V.empty())) == pytest.approx([0.7, 0.3])
    assert _one(spark, V.signature_signals(_v(1, 0), V.empty(), _v(0, 1))) == pytest.approx([0.7, 0.3])
    assert _one(spark, V.signature_signals(_v(1, 0), _v(0, 1), _v(1, 1))) == pytest.approx([0.75, 0.4])
    assert _one(spark, V.identity(_v(1, 0), _v(0, 1), _v(1, 1))) == pytest.approx([0.85, 0.65])
    assert _one(spark, V.routing(_v(1, 0), _v(0, 1))) == pytest.approx([0.75, 0.25]) and _one(spark, V.routing(V.empty(), _v(0, 1))) == [0, 1]
    assert _one(spark, V.harmonic_mean(F.lit(0.5), F.lit(1.0))) == pytest.approx(2 / 3) and _one(spark, V.harmonic_mean(F.lit(0.0), F.lit(1.0))) == 0


def test_centroid_and_evenness(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [2.0, 4.0])], "g string, v array<double>")
    assert {r["g"]: r["c"] for r in df.groupBy("g").agg(V.centroid(F.col("v")).alias("c")).collect()} == {"a": [0.5, 0.5], "b": [2.0, 4.0]}
    d = spark.createDataFrame([(1.0,), (1.0,), (1.0,)], "d double")
    assert d.agg(V.evenness(F.col("d")).alias("x")).first()["x"] == 1
    assert d.agg(V.evenness(F.col("d") * 0).alias("x")).first()["x"] == 0
    assert d.limit(1).agg(V.evenness(F.col("d")).alias("x")).first()["x"] == 1


def _values(spark, x):
    return spark.createDataFrame([("g", float(v)) for v in x], "g string, v double")


def test_fences(spark):
    assert stats.robust(_values(spark, [3, 1, 2]), "v", ["g"]).first()["median"] == 2
    assert stats.robust(_values(spark, [4, 1, 3, 2]), "v", ["g"]).first()["median"] == 2.5
    assert _values(spark, [2, 4, 4, 4, 5, 5, 7, 9]).agg(stats.deviation(F.col("v")).alias("s")).first()["s"] == pytest.approx(2.138, abs=1e-3)
    assert _values(spark, [2]).agg(stats.deviation(F.col("v")).alias("s")).first()["s"] == 0
    low, high = stats.z_fences(F.col("v"), 2.0)
    assert tuple(_values(spark, [7]).agg(low, high).first()) == (-stats.INF, stats.INF)
    assert tuple(_values(spark, [1, 2, 3, 4, 5]).agg(low, high).first()) == pytest.approx((3 - 2 * 2.5**0.5, 3 + 2 * 2.5**0.5))
    row = stats.robust_fences(stats.robust(_values(spark, [1, 2, 3, 4, 100]), "v", ["g"]), 2.0).first()
    assert row["spread"] == 1 and row["upper"] == pytest.approx(3 + 2 * 1.4826) and row["upper"] < 100
    flat = stats.robust_fences(stats.robust(_values(spark, [5, 5, 5]), "v", ["g"]), 2.0).first()
    assert (flat["lower"], flat["upper"]) == (-stats.INF, stats.INF)
    assert stats.robust(_values(spark, [1, 2, 3, 10]), "v", []).select("q1", "q3").first() == (1.75, 4.75)


def test_pooled_floor_and_leave_one_out(spark):
    assert stats.pooled_floor(_values(spark, [1, 2]), "v", ["g"]).first()["floor"] == 0
    assert stats.pooled_floor(_values(spark, [1, 2, 3]), "v", ["g"]).first()["floor"] == 0.5
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 90.0)], "k string, v double")
    fences = {r["k"]: r["upper"] for r in stats.leave_one_out(rows, "k", "v", 2.0).collect()}
    assert fences["d"] == pytest.approx(2 + 2 * 1.4826) and fences["a"] > 90 or fences["a"] > 3


def test_softmax_sums_to_one(spark):
    rows = spark.createDataFrame([("p", "x", 0.2), ("p", "y", 0.9), ("q", "z", 0.4)], "p string, c string, s double")
    out = stats.softmax_with_new(rows, "s", ["p"]).collect()
    for p in ("p", "q"):
        own = [r for r in out if r["p"] == p]
        assert sum(r["probability"] for r in own) + own[0]["new_probability"] == pytest.approx(1)
    assert next(r for r in out if r["p"] == "q")["probability"] == pytest.approx(0.5)


def test_signatures(spark):
    s = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    assert _one(spark, text.function_signature(s("a", "b"), s("T"), F.lit("R"))) == "params: a (T), b (unknown) | returns: R"
    assert _one(spark, text.function_signature(s(), s(), F.lit("void"))) == "returns: void"
    assert _one(spark, text.callable_signature(s("a"), s("T"), F.lit("R"))) == "(a: T) => R"
    assert _one(spark, text.identity_signature(F.lit("n"), F.lit(None).cast("string"))) == "n" and _one(spark, text.identity_signature(F.lit("n"), F.lit("d"))) == "n: d"
    assert _one(spark, text.calls_text(s())) == "" and _one(spark, text.children_signature(s("a/b.ts", "c"))) == "children: b.ts, c"
    assert _one(spark, text.joined_signature(F.lit("a"), F.lit(""), F.lit("b"))) == "a | b"


def test_paths_and_keys(spark):
    signal = lambda p: _one(spark, text.path_signal(F.lit(p), ["k1", "k2"]))
    assert (signal(""), signal("a.ts"), signal("x/y/a.ts")) == ("k1-k2/", "k1/k2/", "k1/k2/x/y/")
    assert _one(spark, text.key_path(F.lit("func:a/b.ts:go"))) == "a/b.ts" and _one(spark, text.key_path(F.lit("dir:a/b"))) == "a/b" and _one(spark, text.strip_key_prefix(F.lit("plain"))) == "plain"
    assert _one(spark, text.short_path(F.lit("root/a"), "root")) == "a"
    assert _one(spark, text.snapshot_id(F.lit(12), F.lit("abc"))) == "12-abc"
    import hashlib

    assert _one(spark, text.facet_hash(F.lit("a"), F.lit(None).cast("string"), F.lit("b"))) == hashlib.sha256(b"a\0\0b").hexdigest()
    assert _one(spark, text.leaf_cache_key(F.lit("func"), F.lit("p"), F.lit("n"))) == "func\0p\0n"


def test_formats(spark):
    assert _one(spark, text.fixed(F.lit(0.5))) == "0.5000" and _one(spark, text.percent(F.lit(0.125))) == "13%"
    assert [_one(spark, text.verdict(F.lit(x))) for x in (0.7, 0.4, 0.39)] == ["strong", "moderate", "weak"]
    assert _one(spark, text.slug(F.lit("Hello, World! "))) == "hello-world"
    assert _one(spark, text.strip_markdown(F.lit("---\nt: 1\n---\n# Head\n**bold** [link](x) `code`"))) == "t: 1 Head bold link code"
    assert _one(spark, text.json_number(F.lit('{"a": 2.5, "b": "x"}'), "a")) == 2.5 and _one(spark, text.json_number(F.lit('{"b": "x"}'), "b")) == 0
    assert _one(spark, text.json_string(F.lit("not json"), "a")) == ""
    assert [_one(spark, text.per_million(F.lit(x))) for x in ("0.000002", "-1", "x")] == [2.0, 0.0, 0.0]
    price = {"in": F.lit(2.0), "out": F.lit(4.0), "cache_read": F.lit(1.0), "cache_write": F.lit(3.0)}
    assert _one(spark, text.usage_cost(F.lit(10), F.lit(5), F.lit(20), F.lit(0), price)) == pytest.approx((20 + 20) / 1e6)
    assert text.filter_terms(" Out-liers, ,merge") == ["out liers", "merge"]
    assert _one(spark, text.title_matches(F.lit("Merge candidates"), ["merge"])) and not _one(spark, text.title_matches(F.lit("x"), ["merge"]))
    assert _one(spark, text.delta(F.lit(0.25), True)) == "↑ +25.0%"
    assert _one(spark, text.with_role(F.lit("d"), F.lit(None).cast("string"), F.lit("cli"))[0]) == "cli: d"
