"""Registration, the pipeline, and SQL against Spark where there is SQL."""

import hashlib
import random

import duckdb
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from canopy.llm import bpe, queries
from tests.conftest import DATA


def test_every_operator_has_one_query():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    wanted = c.execute(queries.oracle_sql()[name])
    columns = sorted(d[0] for d in wanted.description)
    order = [[d[0] for d in wanted.description].index(x) for x in columns]
    want = sorted(tuple(r[k] for k in order) for r in wanted.fetchall())
    found = queries.queries()[name](spark, DATA)
    assert sorted(found.columns) == columns
    assert sorted(map(tuple, found.select(*columns).collect())) == want


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "bpe_round_trip"]
    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, DATA)
        assert docs.columns == documents.columns
        assert 0 < docs.count() <= before.count()
    out = corpus_pipeline.run(spark, DATA)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}


def test_pipeline_on_nulls_copies_and_clashing_names(spark, tmp_path):
    r = random.Random(5)
    words = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    copied, near, item = words(80), words(200).split(), words(12)
    changed = " ".join([*near[:100], "other", *near[101:]])
    body = [words(30) for _ in range(4)]
    rows = [
        (1, "you stupid idiot", "a"), (2, copied, "b"), (3, copied, "c"), (4, f"{words(20)} {item} {words(20)}", "d"), (5, None, "e"), (6, "", "f"), (None, words(25), "g"), (20, " ".join(near), "i"), (21, changed, None),
        *[(10 + k, f"{body[k]}\nsame footer of the host", "h") for k in range(4)],
    ]
    clash = {c: F.lit(k) for k, c in enumerate(("id", "row", "score", "kept", "component", "items", "whole", "n", "lines", "chunk"))}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.lit(None).cast("long")} | clash)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("x", item), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    library = tiktoken.Encoding("own", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(), special_tokens={})
    left = {2: copied, 5: "", 6: "", None: dict((i, t) for i, t, _ in rows)[None], 20: " ".join(near), **{10 + k: body[k] for k in range(4)}}
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"]: x["n_tokens"] for x in found} == {i: len(library.encode_ordinary(t)) for i, t in left.items()} and len(found) == len(left)
    assert all(x["decoded_sha256"] == hashlib.sha256(left[x["doc_id"]].encode()).hexdigest() for x in found)
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
