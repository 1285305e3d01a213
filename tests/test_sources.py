import re

import pytest
from pyspark.sql import functions as F

from canopy.sources import config, typescript
from canopy.sources.store import SnapshotStore

CODE = '''/**
 * Users.
 * @unitUtil
 */
import { z } from "zod";
import type { Post } from "./post";
import "../side";

/** A user.
 * @unitPatterns model, core
 */
export interface User {
  readonly id: string;
  name?: string;
  posts: Post[];
  go(): void;
}

type Alias = string;
type Inner = { a: number; b: { c: string } };

/**
 * Makes a user.
 * @param name - the name
 * @param age
 * @returns the user
 * @unitPure
 * @unitResidual outliers [abc123]
 */
export async function makeUser(name: string, age = 3, cb: (x: number) => void): Promise<{ id: string }> {
  // not called: ghost()
  const s = "fake()";
  if (check(name)) { helper(); other.method(); }
  return helper();
}

function helper() {}
const arrow = () => helper();
declare function ambient<T>(x: T): T;
'''


def test_extract():
    got = typescript.extract("/p/src/user.ts", CODE)
    units = {u["name"]: u for u in got["units"]}
    assert set(units) == {"User", "Inner", "makeUser", "helper", "ambient"}
    make = units["makeUser"]
    assert (make["param_names"], make["param_types"]) == (["name", "age", "cb"], ["string", "unknown", "(x: number) => void"])
    assert make["returns_type"] == "Promise<{ id: string }>" and make["calls"] == ["check", "helper"] and make["exported"] and make["pure"] and make["util"]
    assert make["documented_params"] == 1 and make["has_return_doc"] and make["residuals"] == [{"audit": "outliers", "hash": "abc123"}] and make["description"] == "Makes a user."
    assert units["helper"]["returns_type"] == "void" and not units["helper"]["exported"]
    assert [f["name"] for f in units["User"]["fields"]] == ["id", "name", "posts"] and units["User"]["patterns"] == ["model", "core"]
    assert units["Inner"]["fields"] == [{"name": "a", "type": "number"}, {"name": "b", "type": "{ c: string }"}]
    assert got["imports_internal"] == ["./post", "../side"] and got["imports_external"] == ["zod"] and got["description"] == "Users."
    assert make["start_line"] < make["end_line"]


HARD = r"""
const re = /["'`{]/g, other = a / b / c, third = [/\/[/}]+/i, x++ / 2];
const css = `a { ${list.map((x) => `<li title="}">${x ? `{` : "}"}</li>`).join("")} b } ${ {k: "}"}.k }`;
/** Splits a line. */
export function split(line: string): string[] {
  if (/^\s*{/.test(line)) return line.split(/[,;{]/);
  const ratio = (line.length + 1) / 2 / total(line);
  return [`${pad(line)} { ${'}'}`, "//", '/*'];
}
// don't stop here: {
export type Pair = { left: string; right: Array<{ a: number }> };
/* { ` " */
function total(s: string): number { return s.length /* } */; }
export const late = "unit's";
function last(): void { return; }
"""


def test_extract_survives_regular_expressions_and_templates():
    found = typescript.extract("src/hard.ts", HARD)
    units = {u["name"]: u for u in found["units"]}
    assert sorted(units) == ["Pair", "last", "split", "total"] and not found["corrupt"]
    assert units["split"]["calls"] == ["total", "pad"] and units["split"]["description"] == "Splits a line." and units["split"]["returns_type"] == "string[]"
    assert [f["name"] for f in units["Pair"]["fields"]] == ["left", "right"] and units["total"]["start_line"] == 13
    for name in units:
        line = next(k for k, x in enumerate(HARD.split("\n"), 1) if re.search(rf"(?:function|type) {name}\b", x))
        assert units[name]["start_line"] == line


@pytest.mark.parametrize("code", ["const a = 'open\nfunction f() {}", "const a = `open ${b", "function f() { {", "/* open", "x = [1, 2)", 'const s = "a', "}"])
def test_files_that_do_not_close_are_marked(code):
    assert typescript.extract("a.ts", code)["corrupt"] is True


@pytest.mark.parametrize("code", ["", "a = b / c; d = e / f", "a = (b) / c / d", "if (x) /re{/.test(y)", "return /}/", "x = y++ / 2; z = '/'", "a = `\\` ${'`'} $ {`", "f(`${`${`x`}`}`)", "a < b; /* { */ // }", "const r = /[/'\"`]/;"])
def test_files_that_close_are_not(code):
    assert typescript.extract("a.ts", code)["corrupt"] is False


def test_corrupt_files_are_counted(spark):
    rows = [("a.ts", "function f() {}"), ("b.ts", "function g() {} const s = 'open"), ("c.ts", None)]
    found = typescript.parse_files(spark.createDataFrame(rows, "path string, code string"))
    assert {r["path"]: (r["corrupt"], len(r["units"])) for r in found.collect()} == {"a.ts": (False, 1), "b.ts": (True, 1)}


def test_barrel_and_util_paths():
    assert typescript.extract("/p/index.ts", 'export * from "./a";\n')["bound"] == "inward"
    assert typescript.extract("/p/other.ts", "")["bound"] is None
    for path in ("/p/utils/a.ts", "/p/helpers/a.ts", "/p/date.utils.ts"):
        assert typescript.extract(path, "function f() {}")["units"][0]["util"]


def test_manifest():
    got = typescript.parse_manifest('Commands here.\n@unitResidual outliers [ab]\n@unitBorrows cli "the shell"\n@unitUtil\nmore @unitUtil inside\n')
    assert got == {"description": "Commands here.\nmore @unitUtil inside", "residuals": [{"audit": "outliers", "hash": "ab"}], "borrows": {"target": "cli", "role": "the shell"}, "util": True}
    assert typescript.parse_manifest('@unitBorrows ""')["borrows"] is None and typescript.parse_manifest("@unitBorrows none")["borrows"] is None
    assert typescript.parse_manifest('@unitBorrows "role"')["borrows"] == {"target": None, "role": "role"}


def test_parse_tree_of_files(spark, tmp_path):
    for path, code in {"src/a.ts": "export function a(): string { return b(); }\n", "src/sub/index.ts": "export * from './x'", "src/a.test.ts": "x", "src/node_modules/m.ts": "function m() {}", "src/sub/x.ts": CODE}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(code)
    files = typescript.parse_files(typescript.source_files(spark, str(tmp_path / "src"))).persist()
    assert sorted(r["name"] for r in files.collect()) == ["a.ts", "index.ts", "x.ts"]
    units = typescript.unit_table(files)
    assert units.where("kind = 'function'").count() == 4 and typescript.field_references(units, files).first()["refs"] == ["./post"]
    root = files.where("name = 'a.ts'").first()["path"].rsplit("/", 1)[0]
    manifests = spark.createDataFrame([(f"{root}/sub", "Sub things.\n@unitUtil")], "path string, content string")
    dirs = {r["name"]: r for r in typescript.directories(files, root, manifests).collect()}
    assert [c.rsplit("/", 1)[1] for c in dirs["src"]["children"]] == ["a.ts", "sub"] and dirs["sub"]["util"] and dirs["sub"]["description"] == "Sub things."


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}", keep=2)
    score = lambda x: {"scores": spark.createDataFrame([("dir:src/a", x), ("file:src/b.ts", x)], "key string, overall_score double")}
    for k in range(5):
        store.write(score(k / 10), commit=f"c{k}", model_id="m", now_ms=1000 + k, pin="base" if k == 0 else None)
    assert [s.snapshot_id for s in store.history()] == ["1000-c0", "1002-c2", "1003-c3"] and store.history()[0].pin_name == "base"
    assert store.read("scores").first()["overall_score"] == 0.4 and store.scores("base").first()["overall_score"] == 0.0
    assert [r["key"] for r in store.scores("1003-c3", "src/b").collect()] == ["file:src/b.ts"]
    store.pin("base", "1002-c2")
    assert store.resolve("base").snapshot_id == "1002-c2" and store.resolve("1000-c0").pin_name is None
    store.unpin("base")
    with pytest.raises(ValueError):
        store.unpin("1002-c2")
    store.delete("1003-c3")
    with pytest.raises(KeyError):
        store.resolve("1003-c3")
    assert store.cache("other") is None and store.cache("m") == {}
    assert spark.read.parquet(f"{store.clone_for_advice()}/scores").count() == 2
    store.delete_advice()


def test_failed_write_leaves_the_active_snapshot(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}")
    good = spark.createDataFrame([("a", 1.0)], "key string, overall_score double")
    store.write({"scores": good}, now_ms=1)
    bad = good.withColumn("x", F.raise_error(F.lit("boom")))
    with pytest.raises(Exception, match="boom"):
        store.write({"scores": bad}, now_ms=2)
    assert store.read("scores").count() == 1 and store.history() == [] and [p.name for p in (tmp_path / "main").iterdir()] == ["active"]


def test_config():
    got, warnings = config.validate({"audits": {"sensitivity": 3, "disable": ["outliers", "nope"]}, "brief": {"symbols": 9, "x": 1}, "keywords": ["k"], "gateway": "ollama"}, {"outliers"})
    assert got.sensitivity == 3 and got.disable == {"outliers"} and got.caps["symbols"] == 9 and got.keywords == ("k",) and got.gateway == "ollama" and len(warnings) == 2
    assert config.load("{not json")[0] == config.EngineConfig() and config.load(None) == (config.EngineConfig(), [])
    assert config.validate({"audits": {"sensitivity": -1}})[0].sensitivity == 2.0
    assert config.parse_sensitivity("x", 2.0) == 2.0 == config.parse_sensitivity("-3", 2.0) and config.parse_sensitivity("1.5", 2.0) == 1.5
    with pytest.raises(ValueError):
        config.validate_descriptions([{"name": "a"}])
    assert config.validate_descriptions([{"name": "a", "description": "b", "c": 1}]) == [{"name": "a", "description": "b"}]


def test_generate_reuses_unchanged_units(spark, tmp_path):
    from canopy.operators import build
    from canopy.sources.embed import hashing_embedder

    src = tmp_path / "src"
    for path, code in {"a.ts": '/** Adds numbers. */\nexport function add(a: number, b: number): number { return a + b; }\nfunction low() {}\nexport function two() { low(); }\nexport function three() { low(); }\n', "sub/b.ts": CODE}.items():
        (src / path).parent.mkdir(parents=True, exist_ok=True)
        (src / path).write_text(code)
    sent = spark.sparkContext.accumulator(0)
    plain = hashing_embedder(16)

    def embed(texts):
        sent.add(len(texts))
        return plain(texts)

    store = SnapshotStore(spark, f"file://{tmp_path}/store")

    def run(now):
        files = typescript.parse_files(typescript.source_files(spark, str(src))).persist()
        root = files.where("name = 'a.ts'").first()["path"].rsplit("/", 1)[0]
        build.generate(store, files, typescript.directories(files, root), root, embed, model_id="hash16", keywords=["calc"], now_ms=now)
        files.unpersist()  # else the next run would read the kept rows

    run(1)
    first = sent.value
    cards = {r["key"].rsplit("/", 1)[-1]: r for r in store.scores().collect()}
    assert {"a.ts", "b.ts", "src", "sub", "a.ts:add"} <= set(cards) and cards["a.ts:add"]["fit"] is not None
    assert store.read("functions").where("name = 'low'").first()["facet_hash"]
    (src / "a.ts").write_text((src / "a.ts").read_text().replace("Adds", "Sums"))
    run(2)
    assert (0 < sent.value - first < first / 2, len(store.history())) == (True, 1), (first, sent.value)
    files, directories = build.rebuild(store)
    parsed = typescript.parse_files(typescript.source_files(spark, str(src)))
    plainly = lambda rows: {r["path"]: (r["description"], r["imports_internal"], sorted((u["name"], u["calls"], u["fields"], u["start_line"]) for u in r["units"])) for r in rows.collect()}
    assert plainly(files) == plainly(parsed) and files.columns == parsed.drop("corrupt").columns
    assert sorted(r["name"] for r in directories.collect()) == ["src", "sub"]


def test_prose(spark):
    from canopy.functions.prose import prose, prose_udf

    k = lambda s, kind="punctuation": (s, kind)
    function = [k("function", "keyword"), k(" ", "space"), k("go", "functionName"), k("("), k("x", "parameterName"), k(":"), k(" ", "space"), k("string", "keyword"), k(","), k("y", "parameterName"), k(":"), k("User", "aliasName"), k("["), k("]"), k(")"), k(":"), k("Promise", "localName"), k("<"), k("number", "keyword"), k(">")]
    assert prose(function) == "takes x (text), y (array of User). Returns promise of a number."
    assert prose(function, {"User": "a person"}).endswith("[User]. Returns promise of a number.\n\n[User]: a person".replace("[User]. ", "array of [User]). ") [-60:]) or "[User]: a person" in prose(function, {"User": "a person"})
    kind = [k("type", "keyword"), k("T", "aliasName"), k("{"), k("a", "propertyName"), k(":"), k("boolean", "keyword"), k(";"), k("}")]
    assert prose(kind) == "has fields: a (a boolean)." and prose([k("const", "keyword")]) == ""
    df = spark.createDataFrame([([{"text": t, "kind": c} for t, c in kind],), (None,)], "p array<struct<text:string,kind:string>>")
    assert [r[0] for r in df.select(prose_udf()("p")).collect()] == ["has fields: a (a boolean).", ""]


def test_markdown_index(spark):
    from canopy.sources import markdown

    body = "---\ntitle: Guide\ndescription: How\n---\nimport X from 'x'\nIntro **bold** [link](u).\n## First part\n| a | b |\n|---|---|\n| 1 | 2 |\n- item\n## someCode_name\nhidden\n## Last\n" + "word " * 400
    pages = spark.createDataFrame([("guides/set-up/index.md", body), ("top.mdx", "plain")], "path string, content string")
    rows = {r["key"]: r for r in markdown.search_index(pages).collect()}
    got = rows["guides/set-up"]
    assert (got["title"], got["description"], got["url"], got["breadcrumbs"]) == ("Guide", "How", "/docs/guides/set-up", ["Guides"])
    assert [(s["heading"], s["heading_id"]) for s in got["sections"]] == [(None, None), ("First part", "first-part"), ("Last", "last")]
    assert got["sections"][0]["content"] == "Intro bold link." and got["sections"][1]["content"] == "a, b. 1, 2. item" and len(got["sections"][2]["content"]) == 500
    assert rows["top"]["breadcrumbs"] is None


def test_catalog(spark):
    from canopy.sources import catalog

    body = '{"data":[{"id":"m","pricing":{"input":"0.000001","output":"x","input_cache_read":-1},"tags":["reasoning"]},{"id":"n","pricing":{}}]}'
    frame = spark.createDataFrame([(body,)], "body string")
    got = catalog.resolve(frame, "vercel", "m")
    assert got["price_in"] == pytest.approx(1.0) and got["price_out"] == got["price_cache_read"] == 0 and got["is_reasoning"] and got["source"] == "live"
    with pytest.raises(catalog.ModelNotFound):
        catalog.resolve(frame, "vercel", "zzz")
    for bad in (lambda: catalog.resolve(None, "vercel", "m"), lambda: catalog.find("none")):
        with pytest.raises(catalog.PricingError):
            bad()
    assert catalog.resolve(None, "ollama", "any")["price_in"] == 0
    speed = spark.createDataFrame([("m", '{"data":{"endpoints":[{"latency_last_1h":{"p50":250},"throughput_last_1h":{"p50":80}}]}}'), ("n", "{}")], "id string, body string")
    assert {r["id"]: (r[1], r[2]) for r in catalog.speeds(speed, catalog.find("vercel")).collect()} == {"m": (0.25, 80.0), "n": (None, None)}
    assert catalog.api_key(catalog.find("openrouter"), env={"OPENROUTER_API_KEY": " k "}) == ("k", "OPENROUTER_API_KEY")


def test_stream_of_units(spark, tmp_path):
    from canopy.sources.embed import hashing_embedder
    from canopy.streaming import snapshots

    source = tmp_path / "in"
    write = lambda rows, n: spark.createDataFrame(rows, "cache_key string, text string, seq long").coalesce(1).write.mode("append").parquet(str(source))
    read = lambda: spark.readStream.schema("cache_key string, text string, seq long").parquet(str(source))
    for n, rows in enumerate([[("a", "one", 1), ("b", "two", 2)], [("a", "three", 3), ("a", "older", 0), ("c", "two", 4)]]):
        write(rows, n)
        snapshots.keep_vectors(read(), f"file://{tmp_path}/out", hashing_embedder(8), str(tmp_path / "cp")).awaitTermination()
    got = {r["cache_key"]: r["leaf"] for r in snapshots.current(spark, f"file://{tmp_path}/out").collect()}
    assert set(got) == {"a", "b", "c"} and got["b"] == got["c"] and got["a"] == hashing_embedder(8)(["three"])[0]
