"""Grouped clustering and projection in numpy: average linkage, cuts, local principal components.

Each function gathers one parent's children in a task: the matrices are of the children's number squared by nature.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EIGEN_FLOOR = 1e-6


def angles(vectors: np.ndarray) -> np.ndarray:
    """Angle between every two rows; a zero row is at a right angle to all."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    u = np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)
    out = np.arccos(np.clip(u @ u.T, -1.0, 1.0))
    np.fill_diagonal(out, 0.0)
    return out


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) in order of height; a and b are the lowest members of the merged clusters.

    Nearest-neighbour chain: quadratic time. Of equal distances the lowest index goes first.
    """
    d = distance.astype(float).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, alive, chain, merges = np.ones(n), np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            x = chain[-1]
            row = np.where(alive, d[x], np.inf)
            y = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[y]:
                y = chain[-2]
            if len(chain) > 1 and y == chain[-2]:
                break
            chain.append(y)
        y, x = chain.pop(), chain.pop()
        a, b = min(x, y), max(x, y)
        merges.append((a, b, float(d[a, b])))
        joined = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = joined, joined
        d[a, a] = np.inf
        size[a] += size[b]
        alive[b] = False
    return sorted(merges, key=lambda m: m[2])


def clusters_at(n: int, merges: list[tuple[int, int, float]], height: float) -> list[list[int]]:
    """Members of each cluster when merges above the height are undone, by lowest member."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, h in merges:
        if h <= height:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    found: dict[int, list[int]] = {}
    for x in range(n):
        found.setdefault(find(x), []).append(x)
    return list(found.values())


def dendrogram(vectors: np.ndarray) -> tuple[list[list[int]], float, list[float]] | None:
    """Clusters at the middle of the largest gap between merges, that gap, and the merge heights."""
    if len(vectors) < 2:
        return None
    merges = average_linkage(angles(vectors))
    heights = [h for _, _, h in merges]
    if len(heights) < 2:
        return clusters_at(len(vectors), merges, math.inf), 0.0, heights
    gaps = np.diff(heights)
    k = int(np.argmax(gaps))
    gap = max(0.0, float(gaps[k]))
    k = k if gap > 0 else 0
    return clusters_at(len(vectors), merges, heights[k] + gap / 2), gap, heights


def _sorted_group(table: pa.Table) -> pa.Table:
    return table.sort_by([("ord", "ascending")])


def dendrograms(members: DataFrame) -> DataFrame:
    """members (group, key, ord, vector) -> (group, clusters of keys, gap, merges), for groups of two or more."""

    def run(table: pa.Table) -> pa.Table:
        table = _sorted_group(table)
        found = dendrogram(np.array(table["vector"].to_pylist(), float))
        keys = table["key"].to_pylist()
        rows = [] if found is None else [{"group": table["group"][0].as_py(), "clusters": [[keys[i] for i in c] for c in found[0]], "gap": found[1], "merges": found[2]}]
        kinds = pa.schema([("group", pa.string()), ("clusters", pa.list_(pa.list_(pa.string()))), ("gap", pa.float64()), ("merges", pa.list_(pa.float64()))])
        return pa.Table.from_pylist(rows, kinds)

    source = members.select("group", "key", "ord", F.col("vector").cast("array<double>"))
    return source.groupBy("group").applyInArrow(run, "group string, clusters array<array<string>>, gap double, merges array<double>")


def significant_gap(merges: Column, k: float) -> Column:
    """The largest gap of the merge heights exceeds the upper median gap by more than k times itself."""
    heights = F.array_sort(merges)
    gaps = F.array_sort(F.zip_with(F.slice(heights, 2, F.greatest(F.size(heights) - 1, F.lit(0))), F.slice(heights, 1, F.greatest(F.size(heights) - 1, F.lit(0))), lambda b, a: b - a))
    middle = F.get(gaps, F.floor(F.size(gaps) / 2).cast("int"))
    return F.when(F.size(gaps) < 2, F.lit(False)).otherwise((middle > 0) & (F.element_at(gaps, -1) > middle * (1 + k)))


def cut_thresholds(merges: Column) -> Column:
    heights = F.array_sort(merges)
    n = F.greatest(F.size(heights) - 1, F.lit(0))
    return F.zip_with(F.slice(heights, 1, n), F.slice(heights, 2, n), lambda a, b: (a + b) / 2)


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    scale = np.linalg.norm(a) * np.linalg.norm(b)
    return float(np.clip(a @ b / scale, -1, 1)) if scale > 0 else 0.0


def _harmonic(a: float, b: float) -> float:
    return 0.0 if a <= 0 or b <= 0 else 2 * a * b / (a + b)


def _evenness(center: np.ndarray, identities: np.ndarray) -> float:
    if len(identities) < 2:
        return 1.0
    d = identities - center
    length = np.linalg.norm(d, axis=1, keepdims=True)
    u = np.divide(d, length, out=np.zeros_like(d), where=length > 0)
    apart = (1 - np.clip(u @ u.T, -1, 1))[np.triu_indices(len(d), 1)]
    mean = apart.mean()
    return 0.0 if mean == 0 else float(1 / (1 + (apart.std(ddof=1) if apart.size > 1 else 0.0) / mean))


def advise_one(names: list[str], identity: np.ndarray, leaf: np.ndarray, parent: np.ndarray) -> dict | None:
    """Merges, all cuts with their proposed groups, and the cut that beats the present score by most."""
    n = len(names)
    if n < 2:
        return None
    merges = average_linkage(angles(identity))
    heights = [h for _, _, h in merges]
    fit, even = _cosine(parent, leaf.mean(0)), _evenness(parent, identity)
    now = _harmonic((fit + 1) / 2, even)
    cuts, best, best_at = [], now, None
    for k, height in enumerate((a + b) / 2 for a, b in zip(heights, heights[1:], strict=False)):
        groups, singles = [], []
        for own in clusters_at(n, merges, height):
            if len(own) < 2:
                singles += [names[i] for i in own]
                continue
            center = identity[own].mean(0)
            f, u = _cosine(center, leaf[own].mean(0)), _evenness(center, identity[own])
            groups.append({"names": [names[i] for i in own], "children_fit": f, "children_uniqueness": u, "children_score": _harmonic((f + 1) / 2, u)})
        cuts.append({"similarity": math.cos(height), "groups": groups, "singletons": singles})
        mean = float(np.mean([g["children_score"] for g in groups])) if groups else -1.0
        if groups and mean > best:
            best, best_at = mean, k
    return {"child_count": n, "current_fit": fit, "current_uniqueness": even, "current_score": now, "merges": heights, "cuts": cuts, "best_cut": best_at}


ADVICE = (
    "target string, child_count int, current_fit double, current_uniqueness double, current_score double, merges array<double>, "
    "cuts array<struct<similarity:double,groups:array<struct<names:array<string>,children_fit:double,children_uniqueness:double,children_score:double>>,singletons:array<string>>>, best_cut int"
)
_GROUP = pa.struct([("names", pa.list_(pa.string())), ("children_fit", pa.float64()), ("children_uniqueness", pa.float64()), ("children_score", pa.float64())])
_CUT = pa.struct([("similarity", pa.float64()), ("groups", pa.list_(_GROUP)), ("singletons", pa.list_(pa.string()))])
_ADVICE = pa.schema(
    [("target", pa.string()), ("child_count", pa.int32()), ("current_fit", pa.float64()), ("current_uniqueness", pa.float64()), ("current_score", pa.float64()), ("merges", pa.list_(pa.float64())), ("cuts", pa.list_(_CUT)), ("best_cut", pa.int32())]
)


def advise(items: DataFrame) -> DataFrame:
    """items (target, name, ord, identity, leaf, parent) -> regroupings proposed for each target of two or more."""

    def run(table: pa.Table) -> pa.Table:
        table = _sorted_group(table)
        identity, leaf = np.array(table["identity"].to_pylist(), float), np.array(table["leaf"].to_pylist(), float)
        parent = table["parent"][0].as_py()
        found = advise_one(table["name"].to_pylist(), identity, leaf, np.array(parent, float) if parent else identity.mean(0))
        return pa.Table.from_pylist([] if found is None else [{"target": table["target"][0].as_py()} | found], _ADVICE)

    return items.select("target", "name", "ord", "identity", "leaf", "parent").groupBy("target").applyInArrow(run, ADVICE)


def advise_tree(nodes: DataFrame, use_leaf: bool = False, depth: int | None = None) -> DataFrame:
    """Advice for every directory (down to a depth) on its sub-directories."""
    from canopy.functions import vectors as V

    parents = nodes.where("kind = 'directory'").select(F.col("key").alias("target"), F.col("identity").alias("parent"), F.col("depth").alias("_d"))
    parents = parents if depth is None else parents.where(F.col("_d") < depth)
    child = nodes.where("kind = 'directory'").where(~V.is_empty(F.col("identity")))
    joined = child.join(parents, F.col("parent_key") == F.col("target"))
    return advise(joined.select("target", "name", "ord", (F.col("leaf") if use_leaf else F.col("identity")).alias("identity"), "leaf", "parent"))


def advise_descriptions(items: DataFrame) -> DataFrame:
    """Advice on (name, ord, identity, leaf) rows without a tree; the parent is their centroid."""
    none = F.lit(None).cast("array<double>")
    return advise(items.select(F.lit("descriptions").alias("target"), "name", "ord", "identity", "leaf", none.alias("parent")))


def local_projection(query: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Query and children on the significant principal axes of the children, by the small Gram matrix."""
    if len(children) < 2:
        return None
    center = children.mean(0)
    moved = children - center
    values, axes = np.linalg.eigh(moved @ moved.T)
    keep = values > EIGEN_FLOOR
    if not keep.any():
        return None
    components = (moved.T @ axes[:, keep]) / np.sqrt(values[keep])
    return (query - center) @ components, moved @ components


def blended_scores(query: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Half the cosine among the children's own axes, half the plain cosine."""
    plain = np.array([_cosine(query, c) for c in children])
    found = local_projection(query, children)
    if found is None:
        return plain
    return 0.5 * np.array([_cosine(found[0], c) for c in found[1]]) + 0.5 * plain


def softmax_with_new(scores: np.ndarray) -> np.ndarray:
    every = np.append(scores, scores.mean() + scores.std())
    heat = max(1 / max(len(scores), 1), 0.01)
    e = np.exp((every - every.max()) / heat)
    return e / e.sum()


def positions_3d(members: DataFrame) -> DataFrame:
    """members (group, key, ord, vector) -> (key, x, y, z): principal axes scaled to [-1, 1]; the sign by the largest loading."""

    def run(table: pa.Table) -> pa.Table:
        table = _sorted_group(table)
        x = np.array(table["vector"].to_pylist(), float)
        out = np.zeros((len(x), 3))
        if len(x) == 2:
            out[:, 0] = -0.5, 0.5
        elif len(x) > 2:
            moved = x - x.mean(0)
            _, _, axes = np.linalg.svd(moved, full_matrices=False)
            axes = axes[:3] * np.sign(axes[:3][np.arange(len(axes[:3])), np.abs(axes[:3]).argmax(1)])[:, None]
            p = moved @ axes.T
            low, high = p.min(0), p.max(0)
            out[:, : p.shape[1]] = np.where(high > low, 2 * (p - low) / np.where(high > low, high - low, 1) - 1, 0)
        return pa.table({"key": table["key"], "x": pa.array(out[:, 0]), "y": pa.array(out[:, 1]), "z": pa.array(out[:, 2])})

    return members.select("group", "key", "ord", "vector").groupBy("group").applyInArrow(run, "key string, x double, y double, z double")
