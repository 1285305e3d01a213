"""Text scalars: signatures, path signals, keys, hashes and number formats, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\u0000"


def identity_signature(name: Column, description: Column) -> Column:
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat(name, F.lit(": "), description)).otherwise(name)


def _listed(label: str, items: Column) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"{label}: "), F.array_join(items, ", "))).otherwise(F.lit(""))


def type_signature(fields: Column) -> Column:
    """fields: array<struct<name, type>>."""
    return _listed("fields", F.transform(fields, lambda f: F.concat(f["name"], F.lit(" ("), f["type"], F.lit(")"))))


def function_signature(names: Column, types: Column, returns: Column) -> Column:
    params = F.transform(names, lambda n, i: F.concat(n, F.lit(" ("), F.coalesce(F.get(types, i), F.lit("unknown")), F.lit(")")))
    head = F.when(F.size(names) > 0, F.concat(F.lit("params: "), F.array_join(params, ", ")))
    return F.concat_ws(" | ", head, F.concat(F.lit("returns: "), returns))


def callable_signature(names: Column, types: Column, returns: Column) -> Column:
    params = F.transform(names, lambda n, i: F.concat(n, F.lit(": "), F.coalesce(F.get(types, i), F.lit("unknown"))))
    return F.concat(F.lit("("), F.array_join(params, ", "), F.lit(") => "), returns)


def joined_signature(*parts: Column) -> Column:
    """The non-empty parts, parted by bars."""
    return F.array_join(F.filter(F.array(*parts), lambda p: F.coalesce(p, F.lit("")) != ""), " | ")


def exports_signature(names: Column) -> Column:
    return _listed("exports", names)


def children_signature(paths: Column) -> Column:
    return _listed("children", F.transform(paths, lambda p: F.element_at(F.split(p, "/"), -1)))


def calls_text(calls: Column) -> Column:
    return _listed("calls", calls)


def causes_text(causes: Column) -> Column:
    return F.coalesce(causes, F.lit(""))


def parent_path(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def path_signal(relative: Column, keywords: list[str]) -> Column:
    """relative is the path below the root, "" for the root itself."""
    parent = parent_path(relative)
    return (
        F.when(relative == "", F.lit("-".join(keywords) + "/"))
        .when(parent == "", F.lit("/".join(keywords) + "/"))
        .otherwise(F.concat(F.lit("/".join(keywords) + "/"), parent, F.lit("/")))
    )


def with_role(name: Column, description: Column, role: Column) -> tuple[Column, Column]:
    """Name and description of a directory that borrows a role."""
    has = F.coalesce(role, F.lit("")) != ""
    told = F.when(F.coalesce(description, F.lit("")) == "", F.concat(F.lit("Represent a "), role)).otherwise(F.concat(F.lit("Represent a "), role, F.lit(": "), description))
    return F.when(has, F.concat(role, F.lit(": "), name)).otherwise(name), F.when(has, told).otherwise(description)


def strip_key_prefix(key: Column) -> Column:
    return F.when(F.instr(key, ":") > 0, F.regexp_replace(key, "^[^:]*:", "")).otherwise(key)


def key_path(key: Column) -> Column:
    """The path in a key; functions and types lose their name."""
    rest = strip_key_prefix(key)
    return F.when(key.rlike("^(func|type):"), F.regexp_replace(rest, ":[^:]*$", "")).otherwise(rest)


def short_path(path: Column, root: str) -> Column:
    return F.when(path.startswith(root + "/"), F.substring(path, len(root) + 2, 1 << 30)).otherwise(path)


def facet_hash(*facets: Column) -> Column:
    return F.sha2(F.concat_ws(NUL, *[F.coalesce(f, F.lit("")) for f in facets]), 256)


def unit_hash(facet: Column, name: Column, path: Column) -> Column:
    return F.when(F.coalesce(facet, F.lit("")) != "", F.substring(facet, 1, 8)).otherwise(F.substring(F.sha2(F.concat(name, F.lit(NUL), path), 256), 1, 8))


def leaf_cache_key(kind: Column, path: Column, name: Column) -> Column:
    return F.concat_ws(NUL, kind, path, name)


def container_cache_key(kind: Column, path: Column) -> Column:
    return F.concat_ws(NUL, kind, path)


def snapshot_id(epoch_ms: Column, commit: Column) -> Column:
    return F.concat_ws("-", epoch_ms.cast("string"), commit)


def fixed(x: Column, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", x)


def percent(x: Column) -> Column:
    return F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%"))


def verdict(x: Column) -> Column:
    return F.when(x >= 0.7, "strong").when(x >= 0.4, "moderate").otherwise("weak")


def delta(x: Column, as_percent: bool = False) -> Column:
    sign = F.when(x > 0, F.lit("↑ +")).when(x < 0, F.lit("↓ ")).otherwise(F.lit("→ "))
    shown = F.format_string("%.1f%%", x * 100) if as_percent else F.format_string("%.8f", x)
    return F.concat(sign, shown)


#: A line of a page: what it is by its form, and what it says.
_LINE_MARKS = r"^(?:#{1,6}\s+)?(?:>\s?)?\s*(?:[-*]\s+)?\s*(?:\d+\.\s+)?"
_INLINE = r"\[([^\]]*)\]\([^)]*\)|\*{1,2}([^*]*)\*{1,2}|`([^`]*)`"
_NESTED = 3


def _without_fences(text: Column) -> Column:
    """The stretches outside code fences; a fence that nothing closes is text."""
    parts = F.split(text, "```", -1)
    closed = F.size(parts) - 1 + F.size(parts) % 2  # the stretches that are not after an open fence
    outside = F.filter(F.slice(parts, 1, closed), lambda part, i: i % 2 == 0)
    rest = F.when(closed < F.size(parts), F.concat(F.lit("```"), F.element_at(parts, -1))).otherwise("")
    return F.concat(F.array_join(outside, " "), rest)


def _said(line: Column) -> Column:
    """A line's words: nothing for imports, rules and the line below a table's head, cells of a table as a sentence."""
    cells = F.filter(F.transform(F.split(line, r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    return (
        F.when(line.rlike(r"^import\s|^-{3,}\s*$|^\s*\|[\s:|-]+\|\s*$"), "")
        .when(line.rlike(r"^\s*\|.+\|\s*$"), F.concat(F.array_join(cells, ", "), F.lit(". ")))
        .otherwise(F.regexp_replace(line, _LINE_MARKS, ""))
    )


def strip_markdown(text: Column) -> Column:
    """Plain text on one line: imports, tags, code and marks go, table rows become sentences, links keep their words."""
    lines = F.split(_without_fences(F.regexp_replace(text, r"<[^>]+>", " ")), "\n")
    text = F.array_join(F.transform(lines, _said), "\n")
    for _ in range(_NESTED):  # marks inside marks
        text = F.regexp_replace(text, _INLINE, "$1$2$3")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9_]+", "-"), r"^-+|-+$", "")


def json_number(document: Column, field: str) -> Column:
    return F.coalesce(F.try_to_number(F.get_json_object(document, f"$.{field}"), F.lit("S999999999999D999999999999")).cast("double"), F.lit(0.0))


def json_string(document: Column, field: str) -> Column:
    return F.coalesce(F.get_json_object(document, f"$.{field}"), F.lit(""))


def per_million(price: Column) -> Column:
    cast = price.try_cast("double")
    return F.when(cast.isNull() | F.isnan(cast) | (cast < 0), F.lit(0.0)).otherwise(cast * 1e6)


def usage_cost(tokens_in: Column, tokens_out: Column, cache_read: Column, cache_write: Column, price: dict[str, Column]) -> Column:
    plain = F.greatest(tokens_in - cache_read - cache_write, F.lit(0))
    return (plain * price["in"] + cache_read * price["cache_read"] + cache_write * price["cache_write"] + tokens_out * price["out"]) / 1e6


def filter_terms(raw: str) -> list[str]:
    return [t for t in (part.strip().lower().replace("-", " ") for part in raw.split(",")) if t]


def title_matches(title: Column, terms: list[str]) -> Column:
    lowered = F.lower(title)
    found = F.lit(not terms)
    for t in terms:
        found = found | lowered.contains(t)
    return found
