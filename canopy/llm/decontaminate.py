"""Benchmark decontamination by multi-pattern search over words.

Each benchmark item yields its windows of ten consecutive words (an item of fewer words is one window). Windows of one
length share a searcher in the manner of Wu and Manber, whose alphabet here is the word: a block of two words looks up
how far the search may jump, a zero jump leads to the bucket of windows that end in that block, and the windows in the
bucket that begin with the same block are compared word by word with the text. Nearly all of a text is never looked at:
a window of ten words lets the search jump nine words at a time.

The work is one pass over the documents with no shuffle. The windows are loaded in blocks of a fixed number, so the size
of what is broadcast is a parameter; a benchmark of more windows costs one more pass for each further block.

Defined cases: a null or empty text has no words, no hits and is clean; repeated documents are searched alike; a null
item id contributes windows (hits count) but no id; items without words contribute nothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import per_batch, staged, trimmed, utf8, whole_rows

WINDOW = 10
BLOCK_WORDS = 2
WINDOWS_PER_PASS = 200_000

#: Bytes that are not part of a word become spaces, A-Z become a-z; every byte of a non-ASCII character is kept.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def windows_of(words: list[bytes], size: int = WINDOW) -> set[tuple[bytes, ...]]:
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


class Searcher:
    """Windows of one length, with their shift table and suffix buckets."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], list[str]]):
        self.length, self.block = length, min(BLOCK_WORDS, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], list[str]]]]] = {}
        for window, items in windows.items():
            for end in range(self.block, length + 1):
                key = window[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            heads = self.buckets.setdefault(window[length - self.block :], {})
            heads.setdefault(window[: self.block], []).append((window, items))

    def search(self, words: list[bytes], spans: list[tuple[int, int]], found: set[str]) -> None:
        jump, far, block, length = self.shift.get, self.far, self.block, self.length
        end, total = length, len(words)
        while end <= total:
            key = tuple(words[end - block : end])
            step = jump(key, far)
            if step:
                end += step
                continue
            start = end - length
            for window, items in self.buckets[key].get(tuple(words[start : start + block]), ()):
                if window == tuple(words[start:end]):
                    spans.append((start, end))
                    found.update(items)
            end += 1


def searchers_of(rows: Iterable[tuple[bytes, list[str]]]) -> list[Searcher]:
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for joined, items in rows:
        window = tuple(joined.split(b" "))
        by_length.setdefault(len(window), {})[window] = items
    return [Searcher(n, by_length[n]) for n in sorted(by_length)]


def scan(text: bytes | None, searchers: list[Searcher], marks: bytes | None = None, known: Iterable[str] = ()) -> tuple[int, bytes, set[str]]:
    """Number of words, one mark byte for each word where any is hit (empty where none is), and the items found."""
    words = words_of(text)
    spans: list[tuple[int, int]] = []
    found = set(known)
    for s in searchers:
        s.search(words, spans, found)
    if not spans:
        return len(words), marks or b"", found
    hit = bytearray(marks) if marks else bytearray(len(words))
    for start, end in spans:
        hit[start:end] = b"\x01" * (end - start)
    return len(words), bytes(hit), found


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> DataFrame:
    """One row for each distinct window: its words joined by a space, and the sorted ids of its items."""
    schema = "window binary, item string"

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(b" ".join(w), i) for i, t in zip(batch[0].to_pylist(), utf8(batch[1]), strict=True) for w in windows_of(words_of(t), size)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["window", "item"]
        )

    pairs = benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(per_batch(cut), schema)
    return pairs.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _windows_in_passes(benchmark: DataFrame, item_col: str, item_text_col: str, size: int, windows_per_pass: int) -> Iterator[tuple[list, bool]]:
    """The windows in blocks of about windows_per_pass, and whether it is the last block."""
    windows = staged(benchmark_windows(benchmark, item_col, item_text_col, size), "windows")
    passes = max(1, -(-windows.count() // windows_per_pass))
    windows = windows.withColumn("pass", F.pmod(F.xxhash64("window"), F.lit(passes)))
    for k in range(passes):
        yield [(bytes(r[0]), list(r[1])) for r in windows.where(F.col("pass") == k).select("window", "items").collect()], k + 1 == passes


def _searched(source: DataFrame, keep: str, blocks: Iterable[tuple[list, bool]], texts: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """source (keep and what texts reads) -> (keep, n_words, n_hit, items)."""
    spark = source.sparkSession
    rows = source.withColumns({"marks": F.lit(None).cast("binary"), "items": F.array().cast("array<string>")})
    for k, (block, last) in enumerate(blocks):
        shared = spark.sparkContext.broadcast(block)
        rows = rows.mapInArrow(trimmed(_one_pass(shared, keep, texts, last)), _schema(rows.schema, keep) if last else rows.schema)
        if not last:
            rows = staged(rows, f"pass{k}")
    return rows


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = WINDOW,
    windows_per_pass: int = WINDOWS_PER_PASS,
) -> DataFrame:
    """Rows (id, n_words, n_hit, items) of all documents: the ids of the items that occur, sorted as strings."""
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = _windows_in_passes(benchmark, item_col, item_text_col, size, windows_per_pass)
    found = _searched(source, "id", blocks, lambda batch: batch["text"])
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", "items")


def _schema(schema: T.StructType, keep: str) -> T.StructType:
    return T.StructType([schema[keep], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])


def _one_pass(block, keep: str, texts: Callable[[pa.RecordBatch], pa.Array], last: bool):
    def run(batches):
        searchers = searchers_of(block.value)
        for batch in batches:
            names = batch.schema.names
            marks, known = batch["marks"].to_pylist(), batch["items"].to_pylist()
            found = [scan(t, searchers, m, k) for t, m, k in zip(utf8(texts(batch)), marks, known, strict=True)]
            items = pa.array([sorted(f[2]) for f in found], pa.list_(pa.string()))
            if last:
                arrays = [batch[keep], pa.array([f[0] for f in found], pa.int64()), pa.array([f[1].count(1) for f in found], pa.int64()), items]
                yield pa.RecordBatch.from_arrays(arrays, names=[keep, "n_words", "n_hit", "items"])
            else:
                new = {"marks": pa.array([f[1] for f in found], pa.binary()), "items": items}
                yield pa.RecordBatch.from_arrays([new.get(n, batch[n]) for n in names], names=names)

    return run


def contamination_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of op5: counts, and a hash of the item ids joined by commas."""
    found = find_contamination(documents, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark window occurs, with their columns unchanged."""
    blocks = _windows_in_passes(benchmark, "item_id", "text", WINDOW, WINDOWS_PER_PASS)
    found = _searched(whole_rows(documents), "whole", blocks, lambda batch: batch["whole"].field("text"))
    return found.where(F.col("n_hit") == 0).select("whole.*")


def brute_force(text: str | None, items: list[tuple[str, str | None]], size: int = WINDOW) -> tuple[int, int, str]:
    """Every position against every window, for tests."""
    words = words_of(text.encode() if text is not None else None)
    hit, found = set(), set()
    for item, body in items:
        for w in windows_of(words_of(body.encode() if body is not None else None), size):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found.add(item)
    return len(words), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
