"""Reports as text and JSON: findings, score tables, advice, placements."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions import text as X

LABELS = {"directory": "Directory", "file": "File", "type": "Type", "function": "Function"}


def node_label(kind: Column, key: Column, name: Column, root: str) -> Column:
    """A container by its path below the root (directories with a slash), a unit by its name."""
    path = X.strip_key_prefix(key)
    below = F.when(path == root, name).otherwise(X.short_path(path, root))
    return F.when(kind == "directory", F.concat(below, F.lit("/"))).when(kind == "file", below).otherwise(name)


def kind_prefix(kind: Column) -> Column:
    out = F.lit("")
    for k, label in LABELS.items():
        out = F.when(kind == k, label).otherwise(out)
    return out


def finding_lines(findings: DataFrame, nodes: DataFrame, root: str) -> DataFrame:
    """findings with a heading and a detail line each."""
    own = nodes.select(F.col("key").alias("_k"), F.col("kind").alias("_kind"), node_label(F.col("kind"), F.col("key"), F.col("name"), root).alias("_label"))
    pair = own.select(F.col("_k").alias("_pk"), F.col("_label").alias("_pair"))
    place = own.select(F.col("_k").alias("_ok"), F.col("_label").alias("_place"))
    rows = findings.join(own, F.col("key") == F.col("_k"), "left").join(pair, F.col("pair_key") == F.col("_pk"), "left").join(place, F.col("parent_key") == F.col("_ok"), "left")
    label = F.format_string('"%s" [%s]', F.coalesce("_label", "name"), F.coalesce("hash", F.lit("")))
    named = F.concat_ws(" ", F.nullif(kind_prefix(F.col("_kind")), F.lit("")), label)
    inside = F.when(F.col("_place").isNotNull(), F.concat(F.lit(" in "), F.col("_place"))).otherwise("")
    other = F.coalesce(F.format_string('"%s"', "_pair"), "pair_name", F.lit("unknown"))
    value = X.percent(F.coalesce("value", F.lit(0.0)))
    group = X.percent(F.coalesce("group_value", F.lit(0.0)))
    texts: dict[str, tuple[Column, Column]] = {
        "outliers": (F.concat(named, inside, F.lit(": unlike its siblings")), F.concat(F.lit("mean similarity "), value, F.lit(", group "), group)),
        "misplaced": (F.concat(named, F.lit(": fits another module better")), F.concat(F.lit("nearer to "), other, F.lit(" than to its own module ("), value, F.lit(")"))),
        "bloated-directories": (F.concat(named, F.lit(": holds separate groups")), F.concat(F.lit("large groups: "), F.coalesce("pair_name", F.lit("0")))),
        "bloated-files": (F.concat(named, F.lit(": holds separate groups")), F.concat(F.lit("large groups: "), F.coalesce("pair_name", F.lit("0")))),
        "duplicates": (F.concat(label, F.lit(" and "), other, F.lit(": duplicates across modules")), F.concat(F.lit("similarity "), value)),
        "util-duplicates": (F.concat(label, F.lit(" and "), other, F.lit(": duplicate utilities")), F.concat(F.lit("similarity "), value)),
        "merge-candidates": (F.concat(label, F.lit(" and "), other, F.lit(": nearly the same"), inside), F.concat(F.lit("similarity "), value)),
        "containments": (F.concat(named, F.lit(": ruled by one child, "), F.coalesce("pair_name", F.lit(""))), F.concat(F.lit("ahead by "), value)),
        "incoherent": (F.concat(named, F.lit(": name and content differ")), F.concat(F.lit("similarity "), value)),
        "incoherent-utils": (F.concat(named, F.lit(": name and content differ")), F.concat(F.lit("similarity "), value)),
        "focal-drift": (F.concat(named, inside, F.lit(": no longer the central child")), F.concat(F.coalesce("pair_name", F.lit("")), F.lit(" is ahead by "), value)),
        "weak-identity": (F.concat(named, F.lit(": its children fit elsewhere")), F.concat(F.lit("own fit "), value, F.lit(", "), F.coalesce("pair_key", F.lit("unknown")), F.lit(" "), group)),
        "vocabulary-bleed": (F.concat(named, F.lit(": speaks another module's language")), F.concat(F.lit("nearer to "), F.coalesce("pair_name", F.lit("")))),
        "incomplete-docs": (F.concat(named, inside), F.concat(F.lit("missing: "), F.coalesce("pair_name", F.lit("")))),
    }
    heading, detail = F.col("name"), F.lit("")
    for name, (h, d) in texts.items():
        heading, detail = F.when(F.col("audit") == name, h).otherwise(heading), F.when(F.col("audit") == name, d).otherwise(detail)
    return rows.select(*findings.columns, heading.alias("heading"), detail.alias("detail"))


def score_lines(cards: DataFrame) -> DataFrame:
    """key, kind and the scores as text, with the overall verdict."""
    shown = lambda c: F.coalesce(X.fixed(F.col(c)), F.lit("-")).alias(c)
    return cards.select("key", "kind", *[shown(c) for c in ("fit", "uniqueness", "score", "children_score", "subtree_score", "overall_score")], F.when(F.col("overall_score").isNotNull(), X.verdict(F.col("overall_score"))).alias("verdict"))


def advice_lines(advice: DataFrame) -> DataFrame:
    """One line a proposed group of each target's best cut."""
    best = advice.where("best_cut is not null").select("target", "current_score", F.get("cuts", F.col("best_cut")).alias("cut"))
    groups = best.select("target", "current_score", "cut.similarity", F.posexplode("cut.groups").alias("place", "g"))
    gain = F.col("g.children_score") - F.coalesce("current_score", F.lit(0.0))
    return groups.select("target", "place", F.array_join("g.names", ", ").alias("members"), X.percent(F.col("g.children_score")).alias("score"), X.delta(gain, True).alias("gain"))


def placement_text(placed: dict[str, Any]) -> str:
    """A placement as a few lines."""
    s = placed["suggestion"]
    head = f"{s['action']}: {s['name']} ({s['target']})" if s["action"] == "add-to-directory" else f"{s['action']}: {s['reason']}"
    lines = [head, f"method {s['method']}, confidence {placed['confidence']}%"]
    for p in placed["top_paths"]:
        last = p["trail"][-1]["node"] if p["trail"] else p["parent_name"]
        lines.append(f"  {p['parent_name']} {100 * p['confidence']:.1f}% (below {last})")
    return "\n".join(lines)


def brief_text(found: dict[str, Any]) -> str:
    """A brief in its fixed order of sections; empty ones are left out."""
    p = found["placement"]
    out = [f"Placement: {p.get('name', p['path'])} ({p['confidence']}%, {p['method']})"]
    for title, key in (("Lineage", "ancestors"), ("Siblings", "siblings"), ("Utilities", "utilities"), ("Symbols", "symbols"), ("Related", "related"), ("Pattern members", "pattern_members"), ("Companion members", "companion_members")):
        rows = found[key].collect()  # capped facets
        if rows:
            out.append(f"{title}:")
            out += [f"  {r['name']}" + (f" {r['similarity']:.4f}" if "similarity" in r else "") + (f" - {r['description']}" if r["description"] else "") for r in rows]
    return "\n".join(out)


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def tree_json(nodes: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows (key, json): each container with its children's places in space."""
    child = nodes.join(positions, "key", "left").where("parent_key is not null")
    item = F.struct("ord", "key", "name", "kind", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"), F.coalesce("z", F.lit(0.0)).alias("z"))
    held = child.groupBy("parent_key").agg(F.sort_array(F.collect_list(item)).alias("children"))
    top = nodes.select("key", "name", "kind").join(held, F.col("key") == F.col("parent_key"))
    return top.select("key", F.to_json(F.struct("key", "name", "kind", "children")).alias("json"))
