"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Each text becomes the set of its five-word shingles, hashed once to 64 bits; the SKETCH smallest values are kept.
2. Equal sets form classes, of which one member (the smallest id) goes on: exact copies are never paired.
3. Inverted lists of the smallest retained values (8 at a threshold of 85, 9 at 80) bring candidates together. Values with a longer list than HOT
   (a passage that many documents share) are replaced by runs of three consecutive retained values, of which each
   document gives those with the smallest hashes (24 at 85, 34 at 80): similar sketches share such runs, a shared passage
   rarely makes one.
4. In a list, overlaps are counted by inverted lists of the retained values, and the union sketch of two documents
   estimates their similarity. Pairs well below the threshold are dropped (estimates from a part of the set where a pair
   at the threshold shares so few values with a probability of MISS at most, by the binomial tail for the size of the
   union sketch); of the rest only links that join two parts are passed on, not all pairs.
5. Candidate clusters get the full sets of their members, and exact Jaccard similarity on these decides every link.

Two documents at the threshold miss all lists of single values, miss all lists of runs, or are estimated too low, with a
probability of at most MISS = 1e-6 each (see Limits; for runs as if they were independent). All that is linked is exact. Lists and clusters of any size are compared in blocks (see _blocks). A shingle is known by its 64-bit
hash: within the few thousand shingles of two documents a collision has a probability of about 1e-12.

Defined cases: null, empty and blank texts have no shingles and link with nothing; a text of one to four words is one
shingle; repeated rows of an id are one document; a null id links with nothing and has no component; extra columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blocks import in_blocks
from ._common import per_batch, staged, trimmed, utf8
from ._components import components, spanning_links

SHINGLE = 5
THRESHOLD = 85
SKETCH = 64
HOT = 3_000
MISS = 1e-6
CLUSTER_ROWS = 3_000
CLUSTER_SHINGLES = 4_000_000
BROADCAST_ROWS = 250_000
_CACHE = 200_000

_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if 0x09 <= b <= 0x0D else b for b in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class Limits:
    """What follows from a threshold in hundredths."""

    def __init__(self, threshold: int):
        if not 50 <= threshold < 100:
            raise ValueError(f"threshold must be 50 to 99 hundredths, not {threshold}")
        self.threshold = threshold
        share = threshold / 100
        #: A set of n links with an unequal one only if n of n + 1 shingles reach the threshold.
        self.smallest = -(-threshold // (100 - threshold))
        #: One of the smallest values of the union that is shared is a key of both documents.
        self.keys = math.ceil(math.log(MISS) / math.log(1 - share))
        #: A run is shared if three values next to each other are; as many runs as single values by the same rule.
        both = share**3
        self.runs = math.ceil(math.log(MISS) / math.log(1 - both / (2 - both)))
        #: By the size of a union sketch, the shared values that a pair at the threshold has fewer of with a probability of MISS at most.
        self.least = np.array([self._least(m, share) for m in range(2 * SKETCH + 1)])

    @staticmethod
    def _least(m: int, share: float) -> int:
        tail = 0.0
        for c in range(m + 1):
            tail += math.comb(m, c) * share**c * (1 - share) ** (m - c)
            if tail > MISS:
                return c
        return m


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, words: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text, in ascending order."""
    split = text.translate(_FOLD).split() if text else []
    hashed = np.array(list(map(words.__getitem__, split)), np.uint64)
    if not hashed.size:
        return hashed
    if hashed.size < size:
        return np.array([xxhash.xxh3_64_intdigest(hashed.tobytes())], np.uint64)
    total = np.zeros(hashed.size - size + 1, np.uint64)
    for k in range(size):
        total += hashed[k : k + total.size] * _ODD[k % len(_ODD)] ** np.uint64(1 + k // len(_ODD))
        total ^= total >> np.uint64(29)
    return np.unique(_mixed(total))


def sketch_table(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, n, whole binary, sketch array<long>): number of shingles, digest of the set, its smallest values in order."""
    source = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        words = WordHashes()
        for batch in batches:
            sets = [shingles(t, words) for t in utf8(batch["text"])]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if s.size else None for s in sets]
            sketches = [s[:SKETCH].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array([s.size for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))],
                names=["id", "n", "whole", "sketch"],
            )

    return source.mapInArrow(trimmed(run), "id long, n long, whole binary, sketch array<long>")


class Overlaps:
    """Inverted lists over the members of one group."""

    def __init__(self, sets: list[np.ndarray]):
        self.lengths = np.array([s.size for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        values, which = np.unique(flat, return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), self.lengths)
        self.lists = owner[np.argsort(which, kind="stable")]
        self.counts = np.bincount(which, minlength=values.size)
        self.starts = np.cumsum(self.counts) - self.counts
        self.which, self.ends = which, np.cumsum(self.lengths)

    def with_member(self, x: int) -> np.ndarray:
        """How many values each member shares with x."""
        own = self.which[self.ends[x] - self.lengths[x] : self.ends[x]]
        n = self.counts[own]
        ends = np.cumsum(n)
        where = np.repeat(self.starts[own] - (ends - n), n) + np.arange(ends[-1] if n.size else 0)
        return np.bincount(self.lists[where], minlength=self.lengths.size)

    def central(self) -> int:
        """The member whose values are the most common."""
        return int(np.argmax(np.bincount(np.repeat(np.arange(self.lengths.size), self.lengths), weights=self.counts[self.which], minlength=self.lengths.size)))


def union_sketch(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> tuple[int, int, bool]:
    """Shared values and size of the union sketch of two sketches, and whether it is exact (both are whole sets)."""
    cut_a, cut_b = a.size < n_a, b.size < n_b
    if cut_a or cut_b:
        limit = min(x[-1] for x, cut in ((a, cut_a), (b, cut_b)) if cut)
        a, b = a[: np.searchsorted(a, limit, "right")], b[: np.searchsorted(b, limit, "right")]
    shared = np.intersect1d(a, b, assume_unique=True).size
    return shared, a.size + b.size - shared, not (cut_a or cut_b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> tuple[float, bool]:
    """Similarity from the union sketch of two sketches, and whether it is exact (both are whole sets)."""
    shared, size, exact = union_sketch(a, b, n_a, n_b)
    return shared / max(1, size), exact


def likely_links(sketches: list[np.ndarray], sizes: np.ndarray, limits: Limits) -> list[tuple[int, int]]:
    overlaps = Overlaps(sketches)

    def linked(x: int) -> list[int]:
        shared = overlaps.with_member(x)
        # The union sketch has at least as many values as the shorter of the two.
        enough = shared >= np.maximum(1, limits.least[np.minimum(overlaps.lengths, overlaps.lengths[x])])
        near = (100 * np.minimum(sizes, sizes[x]) >= limits.threshold * np.maximum(sizes, sizes[x])) & enough
        near[x] = False
        out = []
        for y in np.flatnonzero(near):
            common, union, exact = union_sketch(sketches[x], sketches[y], sizes[x], sizes[y])
            if 100 * common >= limits.threshold * union if exact else common >= limits.least[union]:
                out.append(int(y))
        return out

    return spanning_links(len(sketches), linked, overlaps.central())


def exact_links(sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    overlaps = Overlaps(sets)
    sizes = overlaps.lengths

    def linked(x: int) -> np.ndarray:
        shared = overlaps.with_member(x)
        near = 100 * shared >= threshold * (sizes + sizes[x] - shared)
        near[x] = False
        return np.flatnonzero(near)

    return spanning_links(len(sets), linked, overlaps.central())


def _pairs(ids: list[int], links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([ids[x] for x, _ in links], pa.int64()), "b": pa.array([ids[y] for _, y in links], pa.int64())})


def _candidates(reps: DataFrame, keys: int, runs_kept: int) -> DataFrame:
    """Rows (key, id, listed): the lists that bring candidates together, with their lengths."""

    def listed(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("key").agg(F.count("*").alias("listed")).where("listed > 1")
        return rows.join(counts, "key")

    single = staged(listed(reps.select("id", F.explode(F.slice("sketch", 1, keys)).alias("key"))), "lists")
    hot = single.where(F.col("listed") > HOT).select("id").distinct()
    runs = F.transform(
        F.sequence(F.lit(1), F.size("sketch") - 2),
        lambda i: F.xxhash64(F.element_at("sketch", i), F.element_at("sketch", i + 1), F.element_at("sketch", i + 2)),
    )
    joint = listed(reps.join(hot, "id").select("id", F.explode(F.slice(F.array_sort(F.array_distinct(runs)), 1, runs_kept)).alias("key")))
    return single.where(F.col("listed") <= HOT).union(joint)


def near_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept) for each row of documents; threshold is the least Jaccard similarity, in hundredths."""
    limits = Limits(threshold)
    base = staged(sketch_table(documents, id_col, text_col), "sketches")
    classes = staged(base.where("n > 0 and id is not null").groupBy("whole").agg(F.min("id").alias("rep")), "classes")
    # Smaller sets reach the threshold only when equal, and equal sets are one class.
    reps = base.where(F.col("n") >= limits.smallest).join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id", "whole"]).select("id", "n", "sketch")
    reps = staged(reps, "reps")

    lists = _candidates(reps, limits.keys, limits.runs)
    rows = in_blocks(lists, F.ceil(F.col("listed") / HOT), F.col("id")).select("key", "left", "right", "id")
    rows = rows.join(reps, "id")

    def compare(table: pa.Table) -> pa.Table:
        ids, sizes = table["id"].to_pylist(), table["n"].to_numpy()
        sketches = [np.array(s, np.int64).view(np.uint64) for s in table["sketch"].to_pylist()]
        return _pairs(ids, likely_links(sketches, sizes, limits))

    likely = rows.groupBy("key", "left", "right").applyInArrow(compare, "a long, b long")
    clusters = staged(components(likely), "clusters")

    members = clusters.join(reps.select("id", "n"), "id")
    weights = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / CLUSTER_ROWS), F.ceil(F.sum("n") / CLUSTER_SHINGLES)).alias("blocks"))
    members = members.join(weights, "component").select("id", "component", "blocks")
    if clusters.count() <= BROADCAST_ROWS:
        members = F.broadcast(members)
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(members, "id")

    def whole_sets(batches):
        words = WordHashes()
        for batch in batches:
            sets = [shingles(t, words).tobytes() for t in utf8(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["component"], batch["blocks"], pa.array(sets, pa.binary())], names=["id", "component", "blocks", "values"])

    sets = in_blocks(texts.mapInArrow(trimmed(whole_sets), "id long, component long, blocks long, values binary"), F.col("blocks"), F.col("id"))

    def verify(table: pa.Table) -> pa.Table:
        return _pairs(table["id"].to_pylist(), exact_links([np.frombuffer(v, np.uint64) for v in table["values"].to_pylist()], threshold))

    linked = components(sets.groupBy("component", "left", "right").applyInArrow(verify, "a long, b long"))

    final = classes.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("whole", F.coalesce("component", "rep").alias("found"))
    every = base.select("id", "n", "whole").join(final, "whole", "left")
    every = every.select("id", "n", F.coalesce("found", "id").alias("component_id"))
    lowest = every.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
    return lowest.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def without_near_duplicates(documents: DataFrame, *, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each group, the one with the smallest id, with its columns unchanged."""
    found = near_duplicates(documents, threshold=threshold)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return documents.join(gone, documents["doc_id"] == F.col("gone"), "left_anti")
