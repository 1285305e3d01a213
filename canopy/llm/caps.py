"""Embedding near-dedup by spherical-cap filters.

A random rotation and two books of random unit vectors on the halves of the space make a product code: a filter is a pair
of code words, and its direction their concatenation. Each vector is decoded to the list of all filters whose direction it
exceeds by the cap's height: only pairs of words are tried whose first word leaves the second a chance. Vectors that
exceed few filters take their best ones, LEAST of them at books of up to LEAST_WORDS words and more as books grow
(least_filters): pairs that share no filter are among these vectors, and a smaller cap misses more. The README has the
measured share of pairs that meet, by size of the books. Books grow with the root of the number of vectors.

1. Equal vectors form classes, of which one goes on.
2. A vector is sent once for each first word of its filters, with the second words, as signs of eight bits. In each filter
   the cosines of these are worked out; their error has a bound (margin), so all pairs that reach the threshold are among
   those found. Only links that join two parts are passed on, not all pairs. Lists of a first word that would pass
   LIST_ROWS rows (by a count over a sample of SAMPLE vectors, which bounds memory and has no part in results) are dealt
   into blocks.
3. The parts so found get their vectors, in blocks where a part is large, and cosines in double precision decide every link
   and count it once. This is quadratic in a part, as counting links is.

Defined cases: null, zero and empty vectors and those with null or non-finite components link with nothing; equal vectors
are one class with its members counted; rows of one id with different vectors are vectors of their own, each with its own
links, and its component_id is the smallest id that its own links reach; vectors of different lengths are never linked; a
null id links with nothing and has no component; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._blocks import in_blocks
from ._common import HOT_SHARE, HOT_ROWS, staged, trimmed
from ._components import Forest, components

COSINE = 0.95
FILTERS_PER_VECTOR = 32
LEAST = 24
LEAST_WORDS = 256
SAMPLE = 100_000
PACK_ROWS = 20_000
LIST_ROWS = 200_000
TILE = 2_048
BLOCK_ROWS = 3_000
TASK_ROWS = 10_000
SEED = 20_011


class ProductCode:
    """Filters over vectors of one dimension, the same on every executor."""

    def __init__(self, dim: int, words: int, per_vector: float):
        random = np.random.default_rng(SEED + dim)
        self.rotation = np.linalg.qr(random.standard_normal((dim, dim)))[0]
        self.cut = (dim + 1) // 2
        halves = [self.cut, dim - self.cut] if dim > 1 else [1]
        self.books = []
        for size in halves:
            book = random.standard_normal((words, size))
            self.books.append(book / np.linalg.norm(book, axis=1, keepdims=True) / math.sqrt(len(halves)))
        self.words, self.least = words, least_filters(words)
        tail = min(0.5, per_vector / words ** len(halves))
        self.height = _normal_quantile(tail) / math.sqrt(dim)

    def pairs(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (row, first word, second word) such that the row exceeds the filter, and each row's best `least` filters.

        Ordered by row and first word. With one book (one dimension) the second word is 0.
        """
        turned = unit @ self.rotation
        first = turned[:, : self.cut] @ self.books[0].T
        second = turned[:, self.cut :] @ self.books[1].T if len(self.books) == 2 else np.zeros((len(unit), 1))
        rows, left = np.nonzero(first >= self.height - second.max(1)[:, None])
        found = []
        step = max(1, 4_000_000 // second.shape[1])
        for at in range(0, len(rows), step):
            r, a = rows[at : at + step], left[at : at + step]
            which, right = np.nonzero(second[r] >= (self.height - first[r, a])[:, None])
            found.append((r[which], a[which], right))
        row, left, right = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        few = np.flatnonzero(np.bincount(row, minlength=len(unit)) < self.least)
        if few.size:
            keep = ~np.isin(row, few)
            best_a, best_b = (np.argsort(-x[few], axis=1)[:, : self.least] for x in (first, second))
            sums = (np.take_along_axis(first[few], best_a, 1)[:, :, None] + np.take_along_axis(second[few], best_b, 1)[:, None, :]).reshape(few.size, -1)
            top = np.argsort(-sums, axis=1)[:, : self.least]
            n, width = top.shape[1], best_b.shape[1]
            row = np.concatenate([row[keep], np.repeat(few, n)])
            left = np.concatenate([left[keep], np.take_along_axis(best_a, top // width, 1).ravel()])
            right = np.concatenate([right[keep], np.take_along_axis(best_b, top % width, 1).ravel()])
        order = np.lexsort((right, left, row))
        return row[order], left[order], right[order]

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each row, the numbers of its filters."""
        row, left, right = self.pairs(unit)
        return np.split(left * self.words + right, np.searchsorted(row, np.arange(1, len(unit))))


def _normal_quantile(tail: float) -> float:
    """z with P(Z > z) = tail, by bisection."""
    low, high = -1.0, 12.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0.5 * math.erfc(mid / math.sqrt(2)) > tail else (low, mid)
    return low


def least_filters(words: int) -> int:
    """Filters that a vector takes at least: in step with the root of the book's growth, so that recall does not fall."""
    return math.ceil(LEAST * math.sqrt(max(1.0, words / LEAST_WORDS)))


def code_words(vectors: int) -> int:
    """Words of a book: filters grow with the vectors, so that a filter's group does not."""
    return max(16, 2 ** round(math.log2(max(1.0, math.sqrt(vectors / 3)))))


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; rows that have no direction become null (not a number)."""
    with np.errstate(all="ignore"):
        top = np.abs(x).max(1, keepdims=True, initial=0.0)
        scaled = x / np.where((top > 0) & np.isfinite(top), top, np.nan)
        return x / (top * np.linalg.norm(scaled, axis=1, keepdims=True)) + 0 * scaled


def _by_length(vectors: pa.Array):
    """For each length that occurs: the rows that have it, and their components (null ones as not a number)."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    flat = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    for n in np.unique(lengths[lengths > 0]).tolist():
        own = np.flatnonzero(lengths == n)
        yield own, flat[(ends[own] - n)[:, None] + np.arange(n)]


def coarse(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components as whole numbers of eight bits, and each row's scale."""
    scale = np.abs(unit).max(1) / 127
    return np.rint(unit / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def margin(dim: int, scale: float) -> float:
    """The most that the product of two coarse rows can fall short of their cosine, with scales up to the one given.

    A component is off by half a step at most, so a row by sqrt(dim) times that; rounding in single precision adds little.
    """
    off = math.sqrt(dim) * scale / 2
    return off * (2 + off) + 1e-4


def labels_of(near: np.ndarray) -> np.ndarray:
    """For each member, the first member that a symmetric relation connects it with."""
    label = np.full(len(near), -1)
    for start in range(len(near)):
        if label[start] < 0:
            label[start] = start
            edge = np.array([start])
            while edge.size:
                edge = np.flatnonzero(near[edge].any(0) & (label < 0))
                label[edge] = start
    return label


def connecting(x: np.ndarray, sides: np.ndarray | None, cut: float) -> list[tuple[int, int]]:
    """Pairs that connect the rows which products of cut or more connect, one fewer than a part has rows.

    With sides, products of rows of different sides only. In a large group the links of a central row are taken first, and
    then those of the rows that it has none with, each against all.
    """
    n, out = len(x), []
    if n <= TILE // 8:
        near = x @ x.T >= cut
        if sides is not None:
            near &= sides[:, None] != sides[None, :]
        np.fill_diagonal(near, False)
        if not near.any():
            return out
        label = labels_of(near)
        return [(int(k), i) for i, k in enumerate(label.tolist()) if k != i]
    forest, label = Forest(n), np.arange(n)

    def link(a: np.ndarray, b: np.ndarray) -> None:
        found = np.unique(label[a] * n + label[b])
        more = [(i, j) for i, j in zip((found // n).tolist(), (found % n).tolist(), strict=True) if forest.join(i, j)]
        if more:
            out.extend(more)
            roots, which = np.unique(label, return_inverse=True)
            label[:] = np.array([forest.find(r) for r in roots.tolist()])[which]

    pivot = int(np.argmax(x @ x.mean(0)))
    near = x @ x[pivot] >= cut
    if sides is not None:
        near &= sides != sides[pivot]
    near[pivot] = True
    link(np.full(int(near.sum()), pivot), np.flatnonzero(near))
    rest = np.flatnonzero(~near)
    for at in range(0, rest.size, TILE):
        own = rest[at : at + TILE]
        for to in range(0, n, TILE):
            near = x[own] @ x[to : to + TILE].T >= cut
            if sides is not None:
                near &= sides[own][:, None] != sides[to : to + TILE][None, :]
            a, b = np.nonzero(near)
            link(own[a], b + to)
    return out


def near_duplicates(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, per_vector: float = FILTERS_PER_VECTOR
) -> DataFrame:
    """Rows (id, n_links, component_id, kept) for each row of vectors."""
    spark = vectors.sparkSession
    element = getattr(vectors.schema[vector_col].dataType, "elementType", None)
    single = isinstance(element, T.FloatType)
    kind = "<f4" if single else "<f8"
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("vector"))

    def digests(with_vectors: bool):
        def run(batches):
            for batch in batches:
                whole: list[bytes | None] = [None] * batch.num_rows
                raw: list[bytes | None] = [None] * batch.num_rows
                usable = batch["id"].is_valid().to_numpy(zero_copy_only=False)
                for own, x in _by_length(batch["vector"]):
                    x = x.astype(kind)
                    u = units(x.astype(np.float64))
                    for k, i in enumerate(own.tolist()):
                        if usable[i] and u[k, 0] == u[k, 0]:
                            whole[i] = xxhash.xxh3_128_digest(u[k].tobytes())
                            if with_vectors:
                                raw[i] = x[k].tobytes()
                arrays = [batch["id"], pa.array(whole, pa.binary()), *([pa.array(raw, pa.binary())] if with_vectors else [])]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "whole", *(["raw"] if with_vectors else [])])

        return trimmed(run)

    base = staged(source.mapInArrow(digests(False), "id long, whole binary"), "digests")
    held = source.mapInArrow(digests(True), "id long, whole binary, raw binary").where("whole is not null")
    classes = held.groupBy("whole").agg(F.min("id").alias("rep"), F.count("*").alias("weight"), F.first("raw").alias("raw"))
    classes = staged(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    n_classes = classes.count()
    words = code_words(n_classes)

    def filters_of(batch: pa.RecordBatch, codes: dict[int, ProductCode]):
        """By dimension: classes, unit vectors and the rows' filters."""
        raw = batch["raw"].to_pylist()
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        names = batch["class"].to_numpy()
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            unit = units(np.frombuffer(b"".join(raw[i] for i in own), kind).reshape(own.size, -1).astype(np.float64))
            code = codes.setdefault(unit.shape[1], ProductCode(unit.shape[1], words, per_vector))
            step = max(1, 4_000_000 // words)
            for at in range(0, own.size, step):
                part = unit[at : at + step]
                yield unit.shape[1], names[own[at : at + step]], part, code.pairs(part)

    def count_lists(batches):
        codes: dict[int, ProductCode] = {}
        for batch in batches:
            for dim, _, _, (row, left, _) in filters_of(batch, codes):
                first = np.unique(row * words + left) % words
                found, n = np.unique(first, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([dim] * found.size, pa.int32()), pa.array(found, pa.int32()), pa.array(n, pa.int64())], names=["dim", "first", "n"])

    every = max(1, n_classes // SAMPLE)
    sample = classes.where(F.pmod(F.xxhash64("whole"), F.lit(every)) == 0).select("class", "raw")
    lists = sample.mapInArrow(trimmed(count_lists), "dim int, first int, n long").groupBy("dim", "first").agg((F.sum("n") * every).alias("n"))
    blocks = {(r["dim"], r["first"]): -(-r["n"] // LIST_ROWS) for r in lists.where(F.col("n") > LIST_ROWS).collect()}

    def deal(batches):
        """Packed rows (dim, first, left, right, classes, scales, signs, lens, seconds): vectors of one block of a first word's list."""
        codes: dict[int, ProductCode] = {}
        names = ["dim", "first", "left", "right", "block", "classes", "scales", "signs", "lens", "seconds"]
        held: dict[int, list] = {}

        def flush(dim: int):
            parts = held.pop(dim)
            own, signs, scales = (np.concatenate([p[k] for p in parts]) for k in range(3))
            begins = np.cumsum([0, *[len(p[0]) for p in parts]])
            row = np.concatenate([p[3] + b for p, b in zip(parts, begins, strict=False)])
            left, right = np.concatenate([p[4] for p in parts]), np.concatenate([p[5] for p in parts])
            many = np.array([blocks.get((dim, k), 1) for k in range(words)])
            block = own[row] % many[left]
            order = np.lexsort((right, row, block, left))
            row, left, right, block = row[order], left[order], right[order], block[order]
            group = np.flatnonzero(np.diff(left * (1 + many.max()) + block, prepend=-1))
            rows = []
            for a, b in zip(group.tolist(), [*group[1:].tolist(), row.size], strict=True):
                members, starts = np.unique(row[a:b], return_index=True)
                lens = np.diff(starts, append=b - a)
                packed = [own[members].astype("<i8"), scales[members], signs[members], lens.astype("<i4"), right[a:b].astype("<i4")]
                for other in range(many[left[a]]):
                    low, high = sorted((int(block[a]), other))
                    rows.append((dim, int(left[a]), low, high, int(block[a]), *[p.tobytes() for p in packed]))
                if len(rows) >= 64:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int32()] * 5 + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for dim, own, unit, (row, left, right) in filters_of(batch, codes):
                signs, scales = coarse(unit)
                held.setdefault(dim, []).append((own, signs, scales, row, left, right))
                if sum(len(p[0]) for p in held[dim]) >= PACK_ROWS:
                    yield from flush(dim)
        for dim in list(held):
            yield from flush(dim)

    def meet(table: pa.Table) -> pa.Table:
        dim, left, right = (table[c][0].as_py() for c in ("dim", "left", "right"))

        def joined(column: str, kind: str) -> np.ndarray:
            return np.frombuffer(b"".join(table[column].to_pylist()), kind)

        own, lens, second = joined("classes", "<i8"), joined("lens", "<i4"), joined("seconds", "<i4")
        x = joined("signs", "i1").reshape(own.size, dim).astype(np.float32) * joined("scales", "<f4")[:, None]
        side = np.repeat(table["block"].to_numpy(), np.fromiter((len(b) // 8 for b in table["classes"].to_pylist()), np.int64, table.num_rows))
        member = np.repeat(np.arange(own.size), lens)
        order = np.argsort(second, kind="stable")
        edges = np.flatnonzero(np.diff(second[order], prepend=-1, append=-1))
        scale = joined("scales", "<f4").max(initial=0.0)
        forest, links, cut = Forest(own.size), [], cosine - margin(dim, float(scale))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a < 2:
                continue
            who = member[order[a:b]]
            for p, q in connecting(x[who], side[who] if left != right else None, cut):
                if forest.join(int(who[p]), int(who[q])):
                    links.append((who[p], who[q]))
        pairs = own[np.array(links, np.int64).reshape(-1, 2)]
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    packed = "dim int, first int, left int, right int, block int, classes binary, scales binary, signs binary, lens binary, seconds binary"
    dealt = classes.select("class", "raw").mapInArrow(trimmed(deal), packed)
    parts = staged(components(dealt.groupBy("dim", "first", "left", "right").applyInArrow(meet, "a long, b long")), "parts")

    sizes = parts.groupBy("component").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    tasks = max(1, -(-parts.count() // TASK_ROWS))
    members = parts.join(sizes, "component").join(classes.select(F.col("class").alias("id"), "raw", "weight"), "id")
    # Small parts share tasks, which are numbered below zero.
    task = F.when(F.col("blocks") == 1, -1 - F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(F.col("component"))
    members = in_blocks(members.withColumn("task", task), F.col("blocks"), F.col("id"))

    def verify(table: pa.Table) -> pa.Table:
        own, part, weight, block = (table[c].to_numpy() for c in ("id", "component", "weight", "block"))
        raw, across = table["raw"].to_pylist(), table["left"][0].as_py() != table["right"][0].as_py()
        out = []
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            who = order[a:b]
            unit = units(np.frombuffer(b"".join(raw[i] for i in who), kind).reshape(who.size, -1).astype(np.float64))
            near = unit @ unit.T >= cosine
            np.fill_diagonal(near, False)
            if across:  # pairs within a block are met where both sides are that block
                near &= block[who][:, None] != block[who][None, :]
            some = np.flatnonzero(near.any(1))
            if some.size:
                label = labels_of(near[np.ix_(some, some)])
                out.append((own[who[some]], near[some] @ weight[who], own[who[some[label]]]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("id", "links", "low"), columns, strict=True)})

    found = staged(members.groupBy("task", "left", "right").applyInArrow(verify, "id long, links long, low long"), "links")
    linked = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    reps = classes.select(F.col("class").alias("id"), "rep")
    lowest = linked.join(reps, "id").groupBy("component").agg(F.min("rep").alias("lowest"))
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    linked = sums.join(linked, "id", "left").join(lowest, "component", "left").select(F.col("id").alias("class"), "links", "lowest")
    final = classes.select("whole", "class", "rep", "weight").join(linked, "class", "left")
    final = staged(final.select("whole", "weight", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("lowest", "rep").alias("found")), "final")
    # Vectors with very many copies join by broadcast: a ten-thousandth of the rows each, so 10,000 of them at most.
    often = final.where(F.col("weight") > max(HOT_ROWS, base.count() // HOT_SHARE))
    hot = base.join(F.broadcast(often), "whole").select("id", "links", "found")
    cold = base.join(F.broadcast(often.select("whole")), "whole", "left_anti").join(final, "whole", "left").select("id", "links", "found")
    out = hot.union(cold).select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("found", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
