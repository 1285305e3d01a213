"""TypeScript sources: top-level functions, types and imports, with their doc tags, by a small scanner.

The doc tags are a prefix and a word: with the prefix "unit", @unitPure, @unitUtil, @unitHelper, @unitResidual,
@unitCauses, @unitPatterns, @unitCompanion and @unitBound. A manifest (a Markdown file a directory) holds a directory's
description and its directives. Files that cannot be read are dropped and counted by the caller; files whose strings,
comments, templates or brackets do not close are read as far as they go and marked `corrupt`.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are not sources.
IGNORED = ("node_modules", "dist", ".git", "__fixtures__", "__tests__", "__mocks__")
PREFIX = "unit"


@dataclass
class Doc:
    description: str | None = None
    pure: bool = False
    util: bool = False
    helper: bool = False
    residuals: list[dict] = field(default_factory=list)
    causes: str | None = None
    patterns: list[str] = field(default_factory=list)
    companion: str | None = None
    documented_params: int = 0
    has_return_doc: bool = False
    bound: str | None = None


def residual(rest: str) -> dict | None:
    """An audit's name and, in brackets perhaps, the hash that the exemption is bound to."""
    parts = rest.split()
    return {"audit": parts[0], "hash": re.sub(r"[\[\]]", "", parts[1]) if len(parts) > 1 else None} if parts else None


def parse_doc(block: str | None, prefix: str = PREFIX) -> Doc:
    """A doc block's description and tags."""
    doc = Doc()
    if not block:
        return doc
    lines = [re.sub(r"^\s*\*? ?", "", line) for line in block.strip()[3:-2].split("\n")]
    body, tags = [], []
    for line in lines:
        tag = re.match(r"\s*@(\w+)\s?(.*)", line)
        if tag:
            tags.append([tag[1], tag[2]])
        elif tags:
            tags[-1][1] += "\n" + line
        else:
            body.append(line)
    doc.description = "\n".join(body).strip() or None
    for name, rest in tags:
        rest = rest.strip()
        own = name[len(prefix) :] if name.startswith(prefix) else None
        if own in ("Pure", "Util", "Helper"):
            setattr(doc, own.lower(), True)
        elif own == "Residual" and (found := residual(rest)):
            doc.residuals.append(found)
        elif own == "Causes" and rest:
            doc.causes = rest
        elif own == "Patterns":
            doc.patterns += [p.strip() for p in rest.split(",") if p.strip()]
        elif own == "Companion" and rest:
            doc.companion = rest
        elif own == "Bound" and rest in ("inward", "outward"):
            doc.bound = rest
        elif name in ("param", "returns") and rest:
            if name == "returns":
                doc.has_return_doc = True
            elif re.sub(r"^(\{[^}]*\}\s*)?[\w.$\[\]]+\s*-?\s*", "", rest):
                doc.documented_params += 1
    return doc


_REGEX_BODY = r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*"
_PIECE = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|(?P<open_comment>\Z)))"
    r"|(?P<string>'(?:\\.|[^'\\\n])*(?:'|(?P<open_single>(?=\n)|\Z))|\"(?:\\.|[^\"\\\n])*(?:\"|(?P<open_double>(?=\n)|\Z)))"
    r"|(?P<tick>`)|(?P<slash>/)|(?P<open>[({\[])|(?P<shut>[)}\]])|(?P<word>[\w$]+)|(?P<sign>[^\s\w$])",
    re.S,
)
_REGEX = re.compile(_REGEX_BODY)
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
# After these words, and after the brackets of these statements, a slash begins a regular expression.
_BEFORE_VALUE = frozenset("return typeof case in of instanceof new delete void throw do else yield await default extends".split())
_CONDITIONS = frozenset("if while for with".split())


def scanned(code: str) -> tuple[str, bool]:
    """code with comments, strings, regular expressions and the text of templates turned to spaces, at the same places; and
    whether it is whole: all of these closed, and brackets paired.

    What stands in the ${} of a template is code, with its own strings and templates. A slash begins a regular expression
    where a value may begin, by the token before it.
    """
    out = list(code)
    whole = True
    brackets: list[tuple[str, bool]] = []  # each open one, and whether a slash after its end begins a regular expression
    value_next, word = True, ""
    at = 0

    def hide(start: int, stop: int) -> None:
        out[start:stop] = re.sub(r"[^\n]", " ", code[start:stop])

    def template(start: int) -> int:
        """Hide a template's text from start; it ends at a tick or goes on after the ${} that opens here."""
        nonlocal whole
        stop = _TEMPLATE.match(code, start).end()
        if code.startswith("${", stop):
            hide(start, stop + 2)
            brackets.append(("${", False))
            return stop + 2
        whole = whole and stop < len(code)
        hide(start, stop + 1)
        return stop + 1

    while (m := _PIECE.search(code, at)) is not None:
        kind, at = m.lastgroup, m.end()
        if m["comment"]:
            whole = whole and m["open_comment"] is None
            hide(*m.span())
            continue
        if m["string"]:
            whole = whole and m["open_single"] is None and m["open_double"] is None
            hide(*m.span())
            value_next = False
        elif kind == "tick":
            hide(*m.span())
            at = template(m.end())
            value_next = brackets[-1:] == [("${", False)] and code[at - 1] == "{"
        elif kind == "slash":
            found = _REGEX.match(code, m.start()) if value_next else None
            if found:
                hide(*found.span())
                at = found.end()
            value_next = not found
        elif kind == "open":
            brackets.append((m[0], m[0] == "{" or m[0] == "(" and word in _CONDITIONS))
            value_next = True
        elif kind == "shut":
            before, value_next = brackets.pop() if brackets else ("", False)
            whole = whole and before + m[0] in ("()", "[]", "{}", "${}")
            if before == "${":
                at = template(m.start())  # the brace is hidden with the text that follows
                value_next = code[at - 1 : at] == "{"
        elif kind == "word":
            value_next = m[0] in _BEFORE_VALUE
        else:
            value_next = not (m[0] in "+-" and code[m.start() - 1 : m.start()] == m[0])  # after ++ or -- comes no value
        word = m[0] if kind == "word" else ""
    return "".join(out), whole and not brackets


def blanked(code: str) -> str:
    """code without comments, strings, regular expressions and the text of templates, at the same places."""
    return scanned(code)[0]


def _close(code: str, at: int) -> int:
    """Index of the bracket that closes the one at `at`, or the end."""
    pairs = {"(": ")", "[": "]", "{": "}", "<": ">"}
    up, down, depth = code[at], pairs[code[at]], 0
    for k in range(at, len(code)):
        if code[k] == up:
            depth += 1
        elif code[k] == down and not (down == ">" and code[k - 1] == "="):
            depth -= 1
            if depth == 0:
                return k
    return len(code) - 1


def _split(code: str, blank: str, sep: str) -> list[tuple[str, str]]:
    """Parts of code between separators outside brackets, with their blanked form."""
    out, depth, last = [], 0, 0
    for k, c in enumerate(blank):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or (c == ">" and blank[k - 1 : k] != "="):
            depth -= 1
        elif c in sep and depth == 0:
            out.append((code[last:k], blank[last:k]))
            last = k + 1
    out.append((code[last:], blank[last:]))
    return out


def _typed(code: str, blank: str, default: str) -> tuple[str, str]:
    """Name and type of `name?: type = value`."""
    depth = 0
    for k, c in enumerate(blank):
        depth += (c in "([{") - (c in ")]}")
        if c == ":" and depth == 0:
            kind, end = blank[k + 1 :], len(code)
            inner = 0
            for j, d in enumerate(kind):
                inner += (d in "([{<") - (d in ")]}" or (d == ">" and kind[j - 1 : j] != "="))
                if d == "=" and inner == 0 and kind[j + 1 : j + 2] != ">":
                    end = k + 1 + j
                    break
            return code[:k].strip().rstrip("?").strip(), code[k + 1 : end].strip()
    return re.split(r"[=?]", code)[0].strip(), default


_DECLARATION = re.compile(r"(?m)^(?P<mods>(?:export\s+|default\s+|declare\s+|async\s+)*)(?P<what>function\s*\*?|type|interface)\s+(?P<name>[A-Za-z_$][\w$]*)")
_IMPORT = re.compile(r"(?m)^\s*(?:import|export)\s+(?:[^;'\"()=]*?\bfrom\s*)?['\"]([^'\"]+)['\"]")
_CALL = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?\(")
_NOT_CALLS = frozenset("if for while switch catch function return typeof super import await new".split())


def extract(path: str, code: str, prefix: str = PREFIX) -> dict:
    """A file's functions, types, imports, doc and flags."""
    blank, whole = scanned(code)
    docs = [(m.start(), m.end(), m[0]) for m in re.finditer(r"/\*\*.*?\*/", code, re.S)]
    imports = list(dict.fromkeys(m[1] for m in _IMPORT.finditer(code) if blank[m.start() : m.start(1) - 1].strip()))
    internal = [i for i in imports if i.startswith((".", "/"))]
    functions, types = {}, {}
    first_doc = None
    head = re.match(r"\s*(?:#![^\n]*\n)?\s*", code)
    if docs and docs[0][0] == head.end():
        first_doc = docs[0][2]
    file_doc = parse_doc(first_doc, prefix)
    folded = path.replace("\\", "/")
    util_file = file_doc.util or "/utils/" in folded or "/helpers/" in folded or ".utils." in folded
    depth = counted = 0
    for m in _DECLARATION.finditer(blank):
        depth += blank.count("{", counted, m.start()) - blank.count("}", counted, m.start())
        counted = m.start()
        if depth != 0:
            continue
        before = [d for d in docs if d[1] <= m.start() and not blank[d[1] : m.start()].strip()]
        doc = parse_doc(before[-1][2] if before else None, prefix)
        start_line = code.count("\n", 0, m.start()) + 1
        common = asdict(doc) | {"name": m["name"], "path": path, "exported": "export" in m["mods"].split(), "util": doc.util or util_file, "start_line": start_line}
        if m["what"].startswith("function"):
            at = m.end()
            if blank[at : at + 1] == "<":
                at = _close(blank, at) + 1
            opening = blank.find("(", at)
            if opening < 0:
                continue
            closing = _close(blank, opening)
            params = [_typed(c, b, "unknown") for c, b in _split(code[opening + 1 : closing], blank[opening + 1 : closing], ",") if b.strip()]
            rest, returns, end = closing + 1, "void", closing
            tail = re.match(r"\s*:", blank[rest:])
            if tail:
                begin = k = rest + tail.end()
                nest = 0
                while k < len(blank):
                    c = blank[k]
                    if nest == 0 and (c == ";" or c == "\n" and code[begin:k].strip() or c == "{" and code[begin:k].strip() and not re.search(r"[|&:,=<]\s*$|\bis\s*$", code[begin:k])):
                        break
                    nest += (c in "([{<") - (c in ")]}" or (c == ">" and blank[k - 1] != "="))
                    k += 1
                returns, rest, end = code[begin:k].strip() or "void", k, k - 1
            body = re.match(r"\s*\{", blank[rest:])
            calls: list[str] = []
            if body:
                opening = rest + body.end() - 1
                end = _close(blank, opening)
                calls = [c for c in dict.fromkeys(_CALL.findall(blank[opening:end])) if c not in _NOT_CALLS]
            functions[m["name"]] = common | {
                "kind": "function", "param_names": [p[0] for p in params], "param_types": [p[1] for p in params], "returns_type": returns, "calls": calls,
                "fields": [], "end_line": code.count("\n", 0, end) + 1,
            }
        else:
            opening = blank.find("{", m.end())
            between = blank[m.end() : opening] if opening >= 0 else ""
            if opening < 0 or (m["what"] == "type" and not re.fullmatch(r"(?:<.*>)?\s*=\s*", between.strip() + " ", re.S)):
                continue
            closing = _close(blank, opening)
            members = [x for part in _split(code[opening + 1 : closing], blank[opening + 1 : closing], ";,\n") if part[1].strip() for x in [_typed(part[0][len(part[1]) - len(part[1].lstrip()) :], part[1].lstrip(), "")]]
            fields = [{"name": re.sub(r"^readonly\s+", "", n), "type": t} for n, t in members if t and re.fullmatch(r"(?:readonly\s+)?[\w$'\"]+", n)]
            types[m["name"]] = common | {
                "kind": "type", "param_names": [], "param_types": [], "returns_type": None, "calls": [], "fields": fields, "end_line": code.count("\n", 0, closing) + 1,
            }
    bound = file_doc.bound
    if bound is None and folded.rsplit("/", 1)[-1] == "index.ts" and not functions and not types:
        bound = "inward"
    return {
        "path": path, "name": folded.rsplit("/", 1)[-1], "description": file_doc.description, "imports_internal": internal, "imports_external": [i for i in imports if i not in internal],
        "companion": file_doc.companion, "bound": bound, "helper": file_doc.helper, "residuals": file_doc.residuals, "units": [*functions.values(), *types.values()], "corrupt": not whole,
    }


def parse_manifest(content: str, prefix: str = PREFIX) -> dict:
    """A directory manifest's description, residuals, borrowed role and util mark."""
    residuals, kept, borrows, util = [], [], None, False
    for line in content.split("\n"):
        t = line.strip()
        if t.startswith(f"@{prefix}Residual"):
            if found := residual(t[len(prefix) + 9 :]):
                residuals.append(found)
        elif t.startswith(f"@{prefix}Borrows"):
            rest = t[len(prefix) + 8 :]
            a, b = rest.find('"'), rest.rfind('"')
            if a >= 0 and b > a + 1:
                borrows = {"target": rest[:a].strip() or None, "role": rest[a + 1 : b]}
        elif t == f"@{prefix}Util":
            util = True
        else:
            kept.append(line)
    return {"description": "\n".join(kept).strip() or None, "residuals": residuals, "borrows": borrows, "util": util}


_RESIDUALS = "array<struct<audit:string,hash:string>>"
UNIT = (
    f"struct<kind:string,name:string,path:string,description:string,exported:boolean,pure:boolean,util:boolean,helper:boolean,residuals:{_RESIDUALS},causes:string,patterns:array<string>,"
    "companion:string,documented_params:int,has_return_doc:boolean,bound:string,param_names:array<string>,param_types:array<string>,returns_type:string,calls:array<string>,"
    "fields:array<struct<name:string,type:string>>,start_line:int,end_line:int>"
)
FILE = f"path string, name string, description string, imports_internal array<string>, imports_external array<string>, companion string, bound string, helper boolean, residuals {_RESIDUALS}, units array<{UNIT}>, corrupt boolean"


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """Rows (path, code) of the sources below a root, in Spark's reader, without tests and ignored folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ts").load(root)
    inside = F.substring("path", F.lit(1), F.length("path"))
    ignored = "|".join(re.escape(i) for i in IGNORED)
    return files.where(~inside.rlike(rf"/(?:{ignored}|\.[^/]+)/") & ~F.col("path").endswith(".test.ts")).select("path", F.decode("content", "UTF-8").alias("code"))


def parse_files(sources: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """sources (path, code) -> one row a readable file with its units; others are left out."""
    schema = sources.sparkSession.createDataFrame([], FILE).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            rows = []
            for path, code in zip(b["path"].to_pylist(), b["code"].to_pylist(), strict=True):
                if code is not None:
                    try:
                        rows.append(extract(path, code, prefix))
                    except (ValueError, IndexError, AttributeError):
                        continue
            yield from pa.Table.from_pylist(rows, kinds).to_batches()

    return sources.select("path", "code").mapInArrow(run, schema)


def unit_table(files: DataFrame) -> DataFrame:
    """One row a function or type."""
    return files.select(F.explode("units").alias("u")).select("u.*")


def directories(files: DataFrame, root: str, manifests: DataFrame | None = None, prefix: str = PREFIX) -> DataFrame:
    """Rows (path, name, children, description, util, borrows, residuals): files first, then sub-directories.

    manifests holds (path of the directory, content).
    """
    base = root.rstrip("/")
    own = files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("dir"))
    steps = F.split(F.expr(f"substring(dir, {len(base) + 2})"), "/")
    up = F.transform(F.sequence(F.lit(0), F.size(F.filter(steps, lambda s: s != ""))), lambda n: F.array_join(F.concat(F.array(F.lit(base)), F.slice(F.filter(steps, lambda s: s != ""), 1, n)), "/"))
    dirs = own.select(F.explode(up).alias("path")).distinct()
    subs = dirs.where(F.col("path") != base).select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), F.struct(F.lit(1).alias("k"), F.col("path").alias("p")).alias("c"))
    held = own.select("dir", F.struct(F.lit(0).alias("k"), F.col("path").alias("p")).alias("c")).unionByName(subs)
    children = held.groupBy("dir").agg(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["p"]).alias("children"))
    out = dirs.join(children, F.col("path") == F.col("dir"), "left").select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.coalesce("children", F.array().cast("array<string>")).alias("children"))
    schema = f"path string, description string, util boolean, borrows struct<target:string,role:string>, residuals {_RESIDUALS}"
    if manifests is None:
        return out.withColumns({"description": F.lit(None).cast("string"), "util": F.lit(False), "borrows": F.lit(None).cast("struct<target:string,role:string>"), "residuals": F.array().cast(_RESIDUALS)})
    kinds = None

    def run(batches):
        for b in batches:
            rows = [{"path": p} | parse_manifest(c or "", prefix) for p, c in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True)]
            yield from pa.Table.from_pylist(rows, kinds).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema

    shape = manifests.sparkSession.createDataFrame([], schema).schema
    kinds = to_arrow_schema(shape)
    parsed = manifests.select("path", "content").mapInArrow(run, shape)
    return out.join(parsed, "path", "left").withColumns({"util": F.coalesce("util", F.lit(False)), "residuals": F.coalesce("residuals", F.array().cast(_RESIDUALS))})


def is_internal(module: Column) -> Column:
    return module.startswith(".") | module.startswith("/")


def field_references(units: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (path, name, refs): internal imports whose capitalised base name a field's type mentions."""
    types = units.where("kind = 'type'").select("path", "name", F.explode("fields").alias("f"))
    imported = files.select("path", F.explode("imports_internal").alias("ref")).withColumn("_base", F.regexp_replace(F.element_at(F.split("ref", "/"), -1), r"\.[jt]sx?$", ""))
    imported = imported.withColumn("_base", F.concat(F.upper(F.substring("_base", 1, 1)), F.expr("substring(_base, 2)")))
    met = types.join(imported, "path").where(F.col("f.type").contains(F.col("_base")) & (F.col("_base") != ""))
    return met.groupBy("path", "name").agg(F.sort_array(F.collect_set("ref")).alias("refs"))
