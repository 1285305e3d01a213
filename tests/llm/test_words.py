"""Decontamination, line dedup, toxicity: against brute force, with the defined edge cases."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from canopy.llm import decontaminate, line_dedup, toxicity
from tests.conftest import DATA

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()


def _documents(spark, rows):
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"id": F.lit(7), "n_words": F.lit("x"), "items": F.lit(1.5), "marks": F.lit(None).cast("string"), "carry": F.lit(0), "row": F.lit("r"), "score": F.lit(9), "source": F.lit("s")}
    )


def test_searcher_equals_brute_force():
    r = random.Random(1)
    for _ in range(60):
        items = [(str(k), " ".join(r.choices(WORDS[:4], k=r.choice([1, 2, 3, 9, 10, 11, 25])))) for k in range(6)]
        text = " ".join(r.choices(WORDS[:4], k=120))
        if r.random() < 0.7:
            text += ", " + r.choice(items)[1].upper() + "! " + " ".join(r.choices(WORDS, k=20))
        rows = {}
        for i, body in items:
            for w in decontaminate.windows_of(decontaminate.words_of(body.encode())):
                rows.setdefault(b" ".join(w), []).append(i)
        n, marks, found = decontaminate.scan(text.encode(), decontaminate.searchers_of(rows.items()))
        want = decontaminate.brute_force(text, items)
        assert (n, marks.count(1)) == want[:2]
        assert decontaminate.hashlib.sha256(",".join(sorted(found)).encode()).hexdigest() == want[2]


@pytest.mark.parametrize("per_pass", [1_000, 3])
def test_contamination_over_blocks(spark, per_pass):
    ten = "one two three four five six seven eight nine ten"
    docs = _documents(spark, [(1, f"x {ten.upper()}, y"), (2, None), (3, ""), (1, f"x {ten.upper()}, y"), (None, "Short item!"), (5, "über straße " * 3000 + ten), (6, "clean")])
    bench = spark.createDataFrame([(10, ten + " eleven"), (9, ten), (None, "short item"), (11, None), (12, "...")], "item_id long, text string")
    found = decontaminate.find_contamination(docs, bench, windows_per_pass=per_pass).collect()
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], tuple(r["items"])) for r in found)
    assert got == [(0, 2, 2, ()), (1, 12, 10, ("10", "9")), (1, 12, 10, ("10", "9")), (2, 0, 0, ()), (3, 0, 0, ()), (5, 6010, 10, ("10", "9")), (6, 1, 0, ())]
    kept = decontaminate.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 6]


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination_report(none, bench).count() == 0
    row = decontaminate.contamination_report(_documents(spark, [(1, "a b")]), bench).first()
    assert (row["n_hit"], row["n_items"], row["contaminated"]) == (0, 0, False)


def test_line_dedup(spark):
    rows = [(k, "big", f"menu\nbody {k}\n\nmenu") for k in range(30)] + [(100 + k, "small", "menu\nown") for k in range(5)]
    rows += [(200, "big", None), (201, None, "menu"), (202, "big", ""), (203, "big", "x" * 100_000), (0, "big", "menu\nbody 0\n\nmenu")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"host": F.lit(1), "digest": F.lit(2), "lines": F.lit("z"), "kept": F.lit(3), "common": F.lit(4), "n_lines": F.lit(0)})
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(docs, ratio=0.3).collect()}
    assert out[3] == "body 3\n" and out[100] == "" and out[200] is None and out[201] == "menu" and out[202] == "" and len(out[203]) == 100_000
    assert line_dedup.drop_boilerplate(docs).columns == docs.columns
    counted = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_boilerplate(docs.drop("n_lines"), ratio=0.3, counts=True).collect()}
    assert counted[3] == (4, 2) and counted[200] == (0, 0)
    assert line_dedup.line_dedup_report(docs.limit(0)).count() == 0


def test_small_hosts_are_judged(spark):
    rows = [(k, "nineteen", f"own {k}\nfooter") for k in range(19)] + [(50 + k, "two", f"own {k}\nfooter") for k in range(2)]
    rows += [(60, "one", "alone\nfooter"), (61, None, "a\nmenu"), (62, None, "b\nmenu")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_boilerplate_lines(spark, docs, "").collect()}
    assert out == {i: t if h == "one" else t.split("\n")[0] for i, h, t in rows}


def test_line_dedup_by_shuffle_is_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "h", f"common\nline {k}") for k in range(40)], "doc_id long, source string, text string")
    first = sorted(map(tuple, line_dedup.drop_boilerplate(docs).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, line_dedup.drop_boilerplate(docs).collect())) == first and first[0][2] == "line 0"


def _labels(g, text):
    return {toxicity.LABELS[k] for k in g.features(text)[:-1].nonzero()[0]}


def test_grammar_scores_clauses():
    g = toxicity.Grammar({"idiot": 1.0, "foul": 1.0})
    for text, label in [
        ("what an idiot that was", ("insult", "")), ("you are an idiot", ("insult", "t")), ("idiot, you", ("insult", "t")), ("an idiot is not what i see in them", ("insult", "")),
        ("you are not an idiot", ("insult", "nt")), ("someone said an idiot came", ("insult", "r")), ("she wrote that you not an utter idiot", ("strong insult", "nrt")), ("what a total idiot", ("strong insult", "")),
        ("i will kill you", ("threat", "t")), ("kill the light", ("violence", "")), ("we will never hurt you", ("threat", "nt")), ("not. idiot", ("insult", "")),
    ]:
        assert _labels(g, text) == {label}, text
    plain, aimed, denied, told = (g.score(t + " and so on it went on for a while") for t in ("what an idiot that was", "you are an idiot", "you are not an idiot", "he said you are an idiot"))
    assert aimed > plain > denied and aimed > told
    assert not g.features(None).any() and not g.features("").any()
    assert g.features("idiotic and foulest")[-1] == pytest.approx(2 / 3)
    assert g.features("idiot. idiot")[0] > g.features("idiot. calm")[0]
    assert 0 < g.score("") < g.score("you idiot") < 1


def _composed(text):
    """The labels of a clause by the rules as told, without automata."""
    words, out = text.split(), []
    near = lambda names, span: any(w in names for w in span)
    for i, w in enumerate(words):
        if w not in ("idiot", "kill"):
            continue
        before, behind = words[max(0, i - toxicity.REACH) : i], words[i + 1 : i + 1 + toxicity.REACH]
        kind = ("strong insult" if near(["total"], before) else "insult") if w == "idiot" else "threat" if near(["will"], before) else "violence"
        out.append((kind, "n" * near(["not"], before) + "r" * near(["said"], words[:i]) + "t" * near(["you"], before + behind)))
    return out


def test_composition_equals_its_rules():
    r, g = random.Random(3), toxicity.Grammar({"idiot": 1.0})
    for _ in range(400):
        text = " ".join(r.choices("idiot kill total will not said you calm plain".split(), k=r.randint(1, 14)))
        assert [toxicity.LABELS[k] for k, _ in g.clause([g.symbol(w) for w in text.split()])] == _composed(text), text


def test_toxicity_learns_what_each_transducer_tells(spark, monkeypatch):
    """Rows in which only aimed, asserted insults are toxic: learned arc weights tell them from denied and reported ones, and without the transducers nothing does."""
    r = random.Random(8)
    texts, labels = [], []
    shapes = [("you are a idiot", 1), ("you total idiot", 1), ("you are not a idiot", 0), ("they said you are a idiot", 0), ("a idiot grows here", 0), ("calm words only", 0)]
    for k in range(900):
        shape, label = shapes[k % len(shapes)]
        body = [" ".join(r.choices(WORDS, k=12)) for _ in range(3)]
        body[r.randrange(3)] = shape
        texts.append((k, ". ".join(body)))
        labels.append((k, label))
    docs, table = _documents(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")

    def right():
        found = {x["doc_id"]: x["predicted"] for x in toxicity.toxicity_report(docs, table).where("held_out").collect()}
        return sum(found[k] == y for k, y in labels if k in found) / len(found)

    assert right() > 0.97
    nothing = toxicity.Transducer(lambda state, symbol: (state, symbol))
    monkeypatch.setattr(toxicity, "after", lambda *_: nothing)
    assert right() < 0.8


def test_toxicity_learns_stems_and_holds_out(spark):
    r = random.Random(2)
    texts, labels = [], []
    for k in range(600):
        bad = k % 5 == 0
        body = [r.choice(WORDS) + r.choice(["", "a", "o"]) for _ in range(40)]
        if bad:
            body[r.randrange(40)] = "blorg" + r.choice(["s", "en", "ish", "heit"])
        texts.append((k, " ".join(body)))
        labels.append((k, None if k % 50 == 1 else int(bad)))
    texts += [(700, None), (701, ""), (702, "blorgs " * 9000), (None, "calm"), (0, texts[0][1])]
    docs = _documents(spark, texts)
    table = spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("label", F.lit("clash"))
    g = toxicity.fit(docs, table)
    assert any("blorgen".startswith(s) for s in g.stems)
    found = {x["doc_id"]: x for x in toxicity.toxicity_report(docs, table).collect()}
    assert sum(found[k]["predicted"] == int(k % 5 == 0) for k in range(600)) >= 590
    assert found[700]["score"] == found[701]["score"] < 0.3 <= found[702]["score"]
    held = sum(x["held_out"] for x in found.values())
    assert 100 < held < 200
    kept = toxicity.without_toxic(docs, table)
    assert kept.columns == docs.columns and 702 not in {x["doc_id"] for x in kept.collect()}


def test_toxicity_on_held_out_rows_of_the_corpus(spark):
    sf = DATA.replace("sf0.001", "sf0.01")
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = toxicity.toxicity_report(documents, labels).where("held_out").join(labels, "doc_id").where("toxic is not null").select("toxic", "predicted").collect()
    both, toxic, called = (sum(f(x) for x in found) for f in (lambda x: x["toxic"] * x["predicted"], lambda x: x["toxic"], lambda x: x["predicted"]))
    assert toxic > 10 and both / toxic >= 0.9 and both / called >= 0.95


def test_toxicity_without_labels(spark):
    docs = _documents(spark, [(1, "you idiot"), (2, "fine")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    found = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_report(docs, none).collect()}
    assert found == {1: 1, 2: 0}
    assert toxicity.toxicity_report(docs.limit(0), none).count() == 0
