"""Near and exact duplicates: against brute force, with the defined edge cases and forced hot groups."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from canopy.llm import _components, caps, minhash, suffix_dedup


def _roots(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_paths_stars_and_rings(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    found = {r["id"]: r["component"] for r in _components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {x for link in links for x in link} - {300}
    assert found == _roots(ids, [link for link in links if link[0] != link[1]])
    assert _components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spanning_links_connect_what_is_connected():
    r = random.Random(3)
    for _ in range(40):
        n = r.randint(1, 30)
        near = {(a, b) for a in range(n) for b in range(a) if r.random() < 0.08}
        near |= {(b, a) for a, b in near}
        found = _components.spanning_links(n, lambda x: [y for y in range(n) if (x, y) in near], r.randrange(n))
        assert set(found) <= near and _roots(range(n), found) == _roots(range(n), near)


def _shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.setdefault(i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def _copies(r, words, many, most):
    base = r.choices(words, k=r.randint(8, 160))
    out = []
    for _ in range(many):
        own = list(base)
        for _ in range(r.randint(0, most)):
            own[r.randrange(len(own))] = r.choice(words)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("hot", [3_000, 6])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(minhash, "HOT", hot)
    monkeypatch.setattr(minhash, "CLUSTER_ROWS", hot)
    r = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(r.choices(words, k=40))
    texts = [t for _ in range(14) for t in _copies(r, words, r.randint(1, 12), 4)]
    texts += [passage + " " + " ".join(r.choices(words, k=60)) for _ in range(30)] + [passage + f" tail{k}" for k in range(12)]
    texts += ["", None, " \t\n", "one two", "ONE two", "a b c d", "a b c d e f", "a b c d e f g", "x " * 5000, "x " * 5001]
    r.shuffle(texts)
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[4]], "doc_id long, text string").withColumns({"id": F.lit("c"), "n": F.lit(1), "component": F.lit(2), "whole": F.lit(3), "sketch": F.lit(4)})
    found = minhash.near_duplicates(docs).collect()
    sets = _shingle_sets(rows)
    links = [(a, b) for a in sets for b in sets if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = _roots(sets, links)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in found} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert len(found) == len(rows) + 1
    kept = minhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.collect()} == {i for i in sets if want[i] == i}


def test_near_duplicates_of_null_ids_and_nothing(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (2, "a b c d e f g")], "doc_id long, text string")
    found = {x["doc_id"]: (x["component_id"], x["kept"]) for x in minhash.near_duplicates(docs).collect()}
    assert found == {None: (None, True), 2: (2, True)}
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_pipeline_stage_equals_brute_force_at_80(spark):
    r = random.Random(9)
    words = [f"w{k}" for k in range(500)]
    texts = []
    for _ in range(12):  # two words of a hundred changed: 86 of 106 shingles, 0.81
        base = r.choices(words, k=100)
        own = list(base)
        own[30], own[60] = "new", "newer"
        texts += [" ".join(base), " ".join(own)]
    texts += [t for _ in range(12) for t in _copies(r, words, 8, 4)]
    texts += ["a b c d e f g h", "a b c d e f g h i", "p q r s t u v", "p q r s t u v w"]  # 4 of 5 shingles, and 3 of 4
    rows = list(enumerate(texts))
    sets = _shingle_sets(rows)
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if b < a}
    assert sum(0.8 <= x < 0.85 for x in share.values()) > 12
    want = _roots(sets, [link for link in share if 100 * len(sets[link[0]] & sets[link[1]]) >= 80 * len(sets[link[0]] | sets[link[1]])])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x["doc_id"] for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i in sets if want[i] == i}


@pytest.mark.parametrize("threshold", [80, 85])
def test_estimate_drops_one_in_a_million_at_most(threshold):
    limits, share = minhash.Limits(threshold), threshold / 100
    for m in range(62, 71):
        assert sum(math.comb(m, c) * share**c * (1 - share) ** (m - c) for c in range(limits.least[m])) <= 1e-6


@pytest.mark.parametrize("threshold", [80, 85])
def test_pairs_at_the_threshold_meet_in_single_values_and_in_runs(threshold):
    limits, r = minhash.Limits(threshold), np.random.default_rng(threshold)
    missed_keys = missed_runs = 0
    for _ in range(3000):
        common = 400 * threshold // 100
        values = r.integers(0, 2**63, 400, np.int64)
        own = (400 - common) // 2
        a, b = (np.sort(np.concatenate([values[:common], x]))[: minhash.SKETCH] for x in (values[common : common + own], values[common + own :]))
        missed_keys += not set(a[: limits.keys].tolist()) & set(b[: limits.keys].tolist())
        runs = [sorted({hash(tuple(x[i : i + 3].tolist())) for i in range(x.size - 2)})[: limits.runs] for x in (a, b)]
        missed_runs += not set(runs[0]) & set(runs[1])
    assert missed_keys == 0 and missed_runs <= 1


def test_estimate_is_exact_on_whole_sets():
    a, b = np.array([1, 2, 3, 4], np.uint64), np.array([2, 3, 4, 9], np.uint64)
    assert minhash.estimate(a, b, 4, 4) == (3 / 5, True)
    assert minhash.estimate(a, b, 9, 4) == (3 / 4, False)


@pytest.mark.parametrize("small", [False, True])
def test_caps_equal_brute_force(spark, monkeypatch, small):
    if small:  # lists, tiles and parts of a few rows
        for name in ("LIST_ROWS", "BLOCK_ROWS", "TILE", "HOT_ROWS", "PACK_ROWS"):
            monkeypatch.setattr(caps, name, {"TILE": 16, "HOT_ROWS": 2, "PACK_ROWS": 50}.get(name, 7))
    r = np.random.default_rng(4)
    base = r.standard_normal((60, 16))
    rows = [b + r.standard_normal(16) * s for b in base for s in (0, 0.05, 0.15)] + [base[0] + r.standard_normal(16) * 0.1 for _ in range(25)]
    vectors = [(k, [float(x) for x in v]) for k, v in enumerate(rows)]
    vectors += [(900, vectors[3][1]), (901, [2 * x for x in vectors[3][1]]), (902, None), (903, []), (904, [0.0] * 16), (905, [float("nan")] * 16), (906, [None] * 16), (907, [1.0, 2.0]), (908, [2.0, 4.0]), (909, [float("inf")] * 16)]
    vectors += [(910, [3.0]), (911, [-3.0]), (912, [5.0]), (913, [1e-300, 2e-300]), (914, [1e200, 2e200]), (915, [1.0, None])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "raw": F.lit(2), "weight": F.lit(3), "class": F.lit(4), "label": F.lit(0)})
    found = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in caps.near_duplicates(df).collect()}
    good = {i: np.array(v) / max(map(abs, v)) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    good = {i: v / np.linalg.norm(v) for i, v in good.items()}
    links = [(a, b) for a in good for b in good if a != b and good[a].size == good[b].size and good[a] @ good[b] >= 0.95]
    want = _roots([i for i, _ in vectors], links)
    assert found == {i: (sum(a == i for a, _ in links), want[i], want[i] == i) for i, _ in vectors}
    assert caps.near_duplicates(df.limit(0)).count() == 0


def test_rows_of_one_id_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [0.1, 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (4, [0.0, 0.0, 1.0]), (4, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = sorted((x["vec_id"] or 0, x["n_links"], x["component_id"], x["kept"]) for x in caps.near_duplicates(df).collect())
    assert found[1:] == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True)]
    assert found[0] == (0, 0, None, True)


def test_coarse_cosines_are_never_short_by_more_than_the_margin():
    r = np.random.default_rng(5)
    for dim in (2, 16, 64, 700):
        a = caps.units(r.standard_normal((400, dim)) ** 3)
        b = caps.units(a + r.standard_normal((400, dim)) * 0.3 / np.sqrt(dim))
        (p, s), (q, t) = caps.coarse(a), caps.coarse(b)
        rough = (p.astype(np.float32) * s[:, None] * (q.astype(np.float32) * t[:, None])).sum(1)
        assert ((a * b).sum(1) - rough).max() <= caps.margin(dim, max(s.max(), t.max()))


def test_connecting_pairs_connect_what_is_connected(monkeypatch):
    monkeypatch.setattr(caps, "TILE", 16)
    r = np.random.default_rng(6)
    for n in (1, 2, 5, 40, 90):
        for sides in (None, r.integers(0, 2, n)):
            x = caps.units(r.standard_normal((n, 3)))
            near = {(i, j) for i in range(n) for j in range(n) if i != j and x[i] @ x[j] >= 0.97 and (sides is None or sides[i] != sides[j])}
            assert _roots(range(n), caps.connecting(x, sides, 0.97)) == _roots(range(n), near)


def test_caps_recall_on_pairs_at_the_threshold():
    """Pairs at a cosine of just 0.95 share a filter."""
    r = np.random.default_rng(8)
    code = caps.ProductCode(64, 128, caps.FILTERS_PER_VECTOR)
    a = r.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.standard_normal((1500, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * b
    shared = [np.intersect1d(x, y).size > 0 for x, y in zip(code.decode(a), code.decode(b), strict=True)]
    assert np.mean(shared) > 0.995


@pytest.mark.parametrize("words", [1024, 2048])
def test_caps_recall_does_not_fall_with_larger_books(words):
    r = np.random.default_rng(1)
    code = caps.ProductCode(64, words, caps.FILTERS_PER_VECTOR)
    missed = 0
    for _ in range(8):
        a = r.standard_normal((500, 64))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b = r.standard_normal((500, 64))
        b -= (a * b).sum(1, keepdims=True) * a
        b /= np.linalg.norm(b, axis=1, keepdims=True)
        b = 0.9505 * a + np.sqrt(1 - 0.9505**2) * b
        missed += sum(np.intersect1d(x, y).size == 0 for x, y in zip(code.decode(a), code.decode(b), strict=True))
    assert missed <= 1


def _brute_repeats(rows, length=50):
    out, seen = {}, {}
    for i in sorted({i for i, _ in rows if i is not None}):
        texts = [t or b"" for j, t in rows if j == i]
        for t in texts:
            gone = bytearray(len(t))
            for p in range(len(t) - length + 1):
                if t[p : p + length] in seen:
                    gone[p : p + length] = b"\x01" * length
            spans = [(m.start(), m.end()) for m in re.finditer(b"\x01+", bytes(gone))]
            out.setdefault(i, []).append((len(t), spans, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
        for t in texts:
            for p in range(len(t) - length + 1):
                seen[t[p : p + length]] = True
    return out


@pytest.mark.parametrize("hot", [20_000, 2])
def test_repeats_equal_brute_force(spark, hot):
    r = random.Random(11)
    passage = "".join(r.choices("abcdé ", k=90))
    rows = []
    for k in range(60):
        text = "".join(r.choices("abcdefgh ", k=r.randint(0, 200)))
        if k % 3 == 0:
            text = text[:50] + passage[r.randint(0, 20) : r.randint(60, 90)] + text[50:]
        if k % 7 == 0 and rows:
            text += rows[r.randrange(len(rows))][1] or ""
        rows.append((k * 2, text))
    rows += [(500, None), (501, ""), (502, "a" * 300), (503, "b" * 10 + "a" * 120), (504, "ab" * 100), (505, "ba" * 100), (None, passage), (6, rows[3][1]), (506, "z" * 3 + passage * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "chunk": F.lit("c"), "texts": F.lit(0), "kept": F.lit(2)})
    found = suffix_dedup.remove_repeats(docs, chunk_bytes=700, hot=hot).collect()
    got = {}
    for x in found:
        got.setdefault(x["doc_id"], []).append((x["n_bytes"], [(s["start"], s["stop"]) for s in x["spans"]], bytes(x["kept"])))
    nulls = got.pop(None)
    assert nulls == [(len(passage.encode()), [], passage.encode())]
    want = _brute_repeats([(i, t.encode() if t is not None else None) for i, t in rows])
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()}
    assert suffix_dedup.repeat_report(docs.limit(0)).count() == 0


def test_equal_runs_are_told_by_refinement():
    r = random.Random(7)
    runs = ["".join(r.choices("ab", k=n)) for n in r.choices(range(8, 90), k=300)] + ["a" * n for n in range(8, 70)] + ["ab" * 40 + t for t in ("c", "d", "")]
    runs += r.choices(runs, k=400)
    data = np.frombuffer("".join(runs).encode(), np.uint8)
    sizes = np.array([len(x) for x in runs])
    numbers = suffix_dedup.equal_runs(data, np.cumsum(sizes) - sizes, sizes)
    assert len(set(zip(numbers.tolist(), runs, strict=True))) == len(set(runs)) == len(set(numbers.tolist()))
    assert suffix_dedup.equal_runs(data, np.zeros(0, int), np.zeros(0, int)).size == 0


def test_bucket_refinement_tells_strings_apart():
    r = random.Random(2)
    text = "".join(r.choices("ab", k=600)) + "ab" * 60
    data = np.frombuffer(text.encode() + bytes(8), np.uint8)
    for length in (9, 16, 31, 50, 64):
        starts = np.arange(len(text) - length + 1)
        numbers = suffix_dedup.refined(data, starts, length)
        strings = [text[p : p + length] for p in starts]
        assert len(set(zip(numbers.tolist(), strings, strict=True))) == len(set(strings)) == len(set(numbers.tolist()))
