"""Exact repeats of LENGTH bytes across documents, by bucket-pointer refinement of the suffixes that can repeat.

A byte string of LENGTH bytes is known by an anchor: the smallest hash among its GRAM-byte strings. Equal strings have
equal anchors, and neighbouring strings mostly share one, so a document falls into runs of strings with one anchor.

1. The anchors of each chunk of documents meet in buckets; those that occur in two documents or more go on. This is a filter
   only: it says which strings may repeat.
2. The runs with such an anchor meet in buckets, once for each distinct run of a chunk, with the smallest id that holds it.
   Bucket-pointer refinement settles which strings are equal, first whole runs and then the strings inside them. Initial
   buckets are of 8 bytes, and they are refined by sorting on the bucket numbers of later offsets, twice the depth each
   time; each round reuses the numbers of the last. Whole runs are refined from every eighth byte (equal_runs), which merges
   the equal ones; where an anchor has different runs, the strings inside these are refined from every byte, until buckets
   agree on LENGTH bytes (refined). The smallest id of a bucket is the first document of that string.
3. The answers return to the chunks, where every byte under a string of a smaller document is removed.

No bucket holds more than the distinct runs of its anchors: equal runs inside a chunk are merged, by the same refinement,
before they move. Anchors that occur more than HOT times (a passage in a large part of all documents, with as many
different surroundings) are not compared as runs: their strings are dealt singly by a hash of the string, and refined in
the bucket where they meet. Chunks of text are staged, bucketed by chunk, so that texts are never shuffled and a lost
executor's part is computed again alike.

Defined cases: null and empty texts have no bytes; texts shorter than LENGTH lose nothing; among rows of one id nothing is
removed for the other's sake; rows with a null id neither lose anything nor count as first; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._chunks import pack, unpack
from ._common import own_folder, staged, trimmed

LENGTH = 50
GRAM = 24
CHUNK_BYTES = 8 << 20
HOT = 20_000
SLICE_BYTES = 1 << 22
PART_BYTES = 1 << 20

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as one number."""
    n = data.size - 7
    out = data[:n].astype(np.uint64)
    for k in range(1, 8):
        out |= data[k : k + n].astype(np.uint64) << _U(8 * k)
    return out


def string_anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each start of a string of the length, the smallest hash of the grams in it (56 bits)."""
    if data.size < length:
        return np.zeros(0, np.uint64)
    eights = _eights(data)
    n = data.size - gram + 1
    hashed = eights[:n] * _U(0x9E3779B97F4A7C15)
    for k in range(8, gram, 8):
        at = min(k, gram - 8)
        hashed = _mixed(hashed ^ (hashed >> _U(29))) + eights[at : at + n] * _U(0xC2B2AE3D27D4EB4F)
    low = _mixed(hashed) >> _U(8)
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[: low.size - have], low[have:])
        have *= 2
    if have < width:
        rest = width - have
        low = np.minimum(low[: low.size - rest], low[rest:])
    return low


class Runs:
    """The runs of a chunk's texts: text, first string, number of strings, anchor."""

    def __init__(self, texts: list[bytes], ids: list[int | None], length: int = LENGTH):
        text, first, many, anchor = [], [], [], []
        part, size = [], 0
        for k, t in enumerate(texts):
            if ids[k] is not None and len(t) >= length:
                part.append(k)
                size += len(t)
            if part and (size >= PART_BYTES or k == len(texts) - 1):
                data = np.frombuffer(b"".join(texts[i] for i in part), np.uint8)
                found = string_anchors(data, length)
                sizes = np.array([len(texts[i]) for i in part])
                begins = np.cumsum(sizes) - sizes
                whose = np.repeat(np.arange(len(part)), sizes)[: found.size]
                inside = np.arange(found.size) <= (begins + sizes - length)[whose]
                cut = np.ones(found.size + 1, bool)
                cut[1:-1] = (found[1:] != found[:-1]) | (whose[1:] != whose[:-1]) | (inside[1:] != inside[:-1])
                at = np.flatnonzero(cut)
                n = np.diff(at)
                ok = inside[at[:-1]]
                at, n = at[:-1][ok], n[ok]
                text.append(np.array(part)[whose[at]])
                first.append(at - begins[whose[at]])
                many.append(n)
                anchor.append(found[at])
                part, size = [], 0
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.text, self.first, self.many, self.anchor = join(text, np.int64), join(first, np.int64), join(many, np.int64), join(anchor, np.uint64)


def _number(keys: np.ndarray) -> np.ndarray:
    """Bucket numbers: equal keys, equal numbers, in the order of the keys."""
    return np.unique(keys, return_inverse=True)[1].astype(np.uint64)


def equal_runs(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bucket numbers of the runs of data: equal numbers, equal runs. Sizes are 8 at least.

    A run is a row of blocks of 8 bytes (the last may overlap the one before). Each round numbers pairs of neighbouring
    buckets, so that a number stands for twice as many bytes, until a run has one number.
    """
    blocks = -(-sizes // 8)
    ends = np.cumsum(blocks)
    offset = np.minimum(8 * (np.arange(ends[-1] if ends.size else 0) - np.repeat(ends - blocks, blocks)), np.repeat(sizes - 8, blocks))
    at = np.repeat(begins, blocks) + offset
    held = np.zeros(at.size, np.uint64)
    for k in range(8):
        held |= data[at + k].astype(np.uint64) << _U(8 * k)
    held = _number(held) + _U(1)  # 0 stands for no neighbour
    while blocks.size and blocks.max() > 1:
        firsts = np.cumsum(blocks) - blocks
        pairs = (blocks + 1) // 2
        ends = np.cumsum(pairs)
        place = np.arange(ends[-1]) - np.repeat(ends - pairs, pairs)
        left = np.repeat(firsts, pairs) + 2 * place
        paired = 2 * place + 1 < np.repeat(blocks, pairs)
        right = np.where(paired, held[np.minimum(left + 1, held.size - 1)], _U(0))
        held, blocks = _number((held[left] << _U(32)) | right) + _U(1), pairs
    return _number((held << _U(32)) | sizes.astype(np.uint64)).astype(np.int64)


def refined(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket numbers of the strings of the length at starts: equal numbers, equal strings.

    data must reach 8 bytes beyond the last string.
    """

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _number((a << _U(32)) | b)

    base = _number(_eights(data))
    if length <= 8:
        raise ValueError("length must exceed 8")
    depth, all_places, at_starts = 8, base, base[starts]
    while 4 * depth <= length:  # places after the starts are still needed at this depth
        all_places = pair(all_places[:-depth], all_places[depth:])
        depth *= 2
        at_starts = all_places[starts]
    reach = depth
    while reach < length:
        step = min(depth, length - reach)
        at_starts = pair(at_starts, all_places[starts + reach + step - depth])
        reach += step
    return at_starts


def first_holders(strings: list[bytes], ids: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each run, the smallest id that holds each of its strings, among the runs given."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    data = np.frombuffer(b"".join(strings) + bytes(8), np.uint8)
    begins = np.cumsum(sizes) - sizes
    many = sizes - length + 1
    ends = np.cumsum(many)
    starts = np.repeat(begins - (ends - many), many) + np.arange(ends[-1])
    bucket = refined(data, starts, length).astype(np.int64)
    low = np.full(int(bucket.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, bucket, np.repeat(ids, many))
    return np.split(low[bucket], ends[:-1])


def _ints(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _from_ints(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _frames(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def _unframed(whole: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(whole):
        n = int.from_bytes(whole[at : at + 4], "little")
        out.append(whole[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _text_chunks(documents: DataFrame, id_col: str, text_col: str, chunk_bytes: int) -> DataFrame:
    """Staged rows (chunk, ids, texts), bucketed by chunk."""
    spark = documents.sparkSession
    source = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches):
        serial = count(TaskContext.get().partitionId() << 32)
        ids, texts, size = [], [], 0

        def flush():
            arrays = [pa.array([next(serial)], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(arrays, names=["chunk", "ids", "texts"])

        for batch in batches:
            held = batch["id"].to_pylist()
            for k in range(batch.num_rows):
                ids.append(held[k])
                texts.append(batch["text"][k].as_py())
                size += len(texts[-1] or b"")
                if size >= chunk_bytes:
                    yield flush()
                    ids, texts, size = [], [], 0
        if ids:
            yield flush()

    name = f"canopy_texts_{uuid.uuid4().hex}"
    writer = source.mapInArrow(trimmed(run), "chunk long, ids array<long>, texts array<binary>").write.format("parquet")
    writer = writer.option("path", f"{own_folder(spark)}/{name}").option("compression", "zstd")
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk").saveAsTable(name)
    table = spark.table(name)
    found = table.select("*")
    spark.sql(f"DROP TABLE {name}")  # the files stay; the frame refers to them
    return found


def _back(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "packed")).alias(name))


def _parted(homes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The places of each value, in order."""
    order = np.argsort(homes, kind="stable")
    found, starts = np.unique(homes[order], return_index=True)
    return list(zip(found.tolist(), np.split(order, starts[1:]), strict=True)) if homes.size else []


def _anchor_lists(runs: Runs, ids: list[int | None], buckets: int):
    """For each bucket: the distinct anchors in order, how often each occurs, whether in several documents here."""
    order = np.argsort(runs.anchor, kind="stable")
    anchors, begin, n = np.unique(runs.anchor[order], return_index=True, return_counts=True)
    if not anchors.size:
        return
    own = np.array([i if i is not None else 0 for i in ids], np.int64)[runs.text[order]]
    several = np.minimum.reduceat(own, begin) != np.maximum.reduceat(own, begin)
    for b, at in _parted((anchors % _U(buckets)).astype(np.int64)):
        yield b, anchors[at], n[at], several[at], at


SINGLE, SHARED, WIDE = 0, 1, 2


def _flags(runs: Runs, buckets: int, answers: list[dict]) -> np.ndarray:
    """For each run, whether its anchor is single, shared or hot."""
    distinct = np.unique(runs.anchor)
    state = np.zeros(distinct.size, np.int8)
    packed = {a["bucket"]: a["packed"] for a in answers}
    for b, at in _parted((distinct % _U(buckets)).astype(np.int64)):
        state[at] = unpack(packed[b])
    return state[np.searchsorted(distinct, runs.anchor)]


class Entries:
    """The distinct runs of a chunk that go on, and the uses of each: text, first string, number of strings, entry.

    Entries are numbered, and those of a bucket listed, in the order of their first use; `begin` is that use.
    """

    def __init__(self, runs: Runs, flags: np.ndarray, texts: list[bytes], ids: list[int | None], buckets: int, length: int):
        whole, singly = np.flatnonzero(flags == SHARED), np.flatnonzero(flags == WIDE)
        n = runs.many[singly]
        ends = np.cumsum(n)
        inner = np.arange(ends[-1] if n.size else 0) - np.repeat(ends - n, n)
        self.text = np.concatenate([runs.text[whole], np.repeat(runs.text[singly], n)])
        self.first = np.concatenate([runs.first[whole], np.repeat(runs.first[singly], n) + inner])
        self.many = np.concatenate([runs.many[whole], np.ones(inner.size, np.int64)])
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        at = (np.cumsum(sizes) - sizes)[self.text] + self.first
        alike = equal_runs(np.frombuffer(b"".join(texts), np.uint8), at, self.many + (length - 1))
        _, begin, which = np.unique(alike, return_index=True, return_inverse=True)
        order = np.argsort(begin)
        rank = np.empty(order.size, np.int64)
        rank[order] = np.arange(order.size)
        self.begin, self.entry = begin[order], rank[which]
        own = np.array([i if i is not None else 0 for i in ids], np.int64)
        self.own = own[self.text]
        self.low = np.full(self.begin.size, np.iinfo(np.int64).max)
        np.minimum.at(self.low, self.entry, self.own)
        self.texts, self.length = texts, length
        tag = np.concatenate([runs.anchor[whole], np.zeros(inner.size, np.uint64)])[self.begin]
        for k in np.flatnonzero(self.begin >= whole.size).tolist():
            tag[k] = xxhash.xxh3_64_intdigest(self.string(k))
        self.tag = (tag & _U(0x7FFFFFFF)).astype(np.int64)
        self.buckets = _parted((tag % _U(buckets)).astype(np.int64))

    def string(self, entry: int) -> bytes:
        use = self.begin[entry]
        return self.texts[self.text[use]][self.first[use] : self.first[use] + self.many[use] + self.length - 1]


class Meeting:
    """Runs that meet in a bucket, by refinement: for each the smallest id that holds it, and for runs with strings that
    smaller ids hold, the smallest id of each string."""

    def __init__(self, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, ids: np.ndarray, tags: np.ndarray, length: int):
        self.low = ids.copy()
        self.inner: dict[int, np.ndarray] = {}
        order = np.argsort(tags, kind="stable")  # equal strings have one tag
        edges = np.flatnonzero(np.diff(tags[order], prepend=-1, append=-1))
        if not order.size:
            return
        bytes_before = np.concatenate([[0], np.cumsum(sizes[order])])[edges]
        done = 0
        while done < edges.size - 1:
            upto = max(done + 1, int(np.searchsorted(bytes_before, bytes_before[done] + SLICE_BYTES, "right")) - 1)
            self._settle(order[edges[done] : edges[upto]], data, begins, sizes, ids, tags, length)
            done = upto

    def _settle(self, own: np.ndarray, data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, ids: np.ndarray, tags: np.ndarray, length: int) -> None:
        if own.size < 2:
            return
        alike = equal_runs(data, begins[own], sizes[own])
        _, some, which = np.unique(alike, return_index=True, return_inverse=True)
        low = np.full(some.size, np.iinfo(np.int64).max)
        np.minimum.at(low, which, ids[own])
        self.low[own] = low[which]
        # Different runs of one tag may share strings.
        _, back, n = np.unique(tags[own[some]], return_inverse=True, return_counts=True)
        several = np.flatnonzero(n[back] > 1)
        if not several.size:
            return
        held = [data[begins[k] : begins[k] + sizes[k]].tobytes() for k in own[some[several]].tolist()]
        found = {}
        for k, holders in zip(several.tolist(), first_holders(held, low[several], length), strict=True):
            if (holders < low[k]).any():
                found[k] = holders
        if found:
            for i, k in zip(own.tolist(), which.tolist(), strict=True):
                if k in found:
                    self.inner[i] = found[k]


def remove_repeats(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES, hot: int = HOT
) -> DataFrame:
    """Rows (id, n_bytes, spans array<struct<start, stop>>, kept binary): the removed spans, and what is left."""
    spark = documents.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _text_chunks(documents, id_col, text_col, chunk_bytes)

    def read(batch: pa.RecordBatch, i: int) -> tuple[list[bytes], list[int | None]]:
        return [t or b"" for t in batch["texts"][i].as_py()], batch["ids"][i].as_py()

    def rows_of(batch: pa.RecordBatch, i: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        arrays = [pa.array([batch["chunk"][i].as_py()] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["chunk", "bucket", "packed"])

    def anchors(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held, ids = read(batch, i)
                found = _anchor_lists(Runs(held, ids, length), ids, buckets)
                yield rows_of(batch, i, [(b, _frames(_ints(np.diff(a.astype(np.int64), prepend=0)), pack(n), pack(s.astype(np.int32)))) for b, a, n, s, _ in found])

    def meet(table: pa.Table) -> pa.Table:
        lists = [_unframed(p) for p in table["packed"].to_pylist()]
        each = [np.cumsum(_from_ints(x[0])) for x in lists]
        every, which = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(which, weights=np.concatenate([unpack(x[1]) for x in lists]), minlength=every.size)
        spread = np.bincount(which, minlength=every.size) > 1
        spread |= np.bincount(which, weights=np.concatenate([unpack(x[2]) for x in lists]), minlength=every.size) > 0
        state = np.where(spread, np.where(total > hot, WIDE, SHARED), SINGLE)[which]
        parts = np.split(state, np.cumsum([e.size for e in each])[:-1])
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "packed": pa.array([pack(p.astype(np.int32)) for p in parts], pa.binary())})

    kind = "chunk long, bucket int, packed binary"
    flagged = staged(_back(texts.mapInArrow(trimmed(anchors), kind).groupBy("bucket").applyInArrow(meet, kind), "flags"), "flags")
    with_flags = texts.join(flagged, "chunk", "left")

    def entries(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held, ids = read(batch, i)
                runs = Runs(held, ids, length)
                found = Entries(runs, _flags(runs, buckets, batch["flags"][i].as_py() or []), held, ids, buckets, length)
                rows = []
                for b, at in found.buckets:
                    strings = [found.string(k) for k in at.tolist()]
                    blob = zstandard.ZstdCompressor(level=1).compress(b"".join(strings))
                    rows.append((b, _frames(pack(np.fromiter(map(len, strings), np.int64, len(strings))), blob, _ints(found.low[at]), pack(found.tag[at]))))
                yield rows_of(batch, i, rows)

    def resolve(table: pa.Table) -> pa.Table:
        parts = [_unframed(packed) for packed in table["packed"].to_pylist()]
        sizes = [unpack(p[0]).astype(np.int64) for p in parts]
        data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(p[1]) for p in parts), np.uint8)
        every = np.concatenate(sizes)
        met = Meeting(data, np.cumsum(every) - every, every, np.concatenate([_from_ints(p[2]) for p in parts]), np.concatenate([unpack(p[3]) for p in parts]).astype(np.int64), length)
        out, done = [], 0
        for own in sizes:
            odd = [(n, met.inner[done + n]) for n in range(own.size) if done + n in met.inner] if met.inner else []
            holders = np.concatenate([h for _, h in odd]) if odd else np.zeros(0, np.int64)
            out.append(_frames(_ints(met.low[done : done + own.size]), pack(np.array([n for n, _ in odd], np.int64)), _ints(holders)))
            done += own.size
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "packed": pa.array(out, pa.binary())})

    resolved = staged(_back(with_flags.mapInArrow(trimmed(entries), kind).groupBy("bucket").applyInArrow(resolve, kind), "holders"), "holders")

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held, ids = read(batch, i)
                runs = Runs(held, ids, length)
                found = Entries(runs, _flags(runs, buckets, batch["flags"][i].as_py() or []), held, ids, buckets, length)
                low = np.full(found.begin.size, np.iinfo(np.int64).max)
                inner: dict[int, np.ndarray] = {}
                answers = {a["bucket"]: a["packed"] for a in batch["holders"][i].as_py() or ()}
                for b, at in found.buckets:
                    lows, odd, flat = _unframed(answers[b])
                    low[at] = _from_ints(lows)
                    flat, done = _from_ints(flat), 0
                    for n in unpack(odd).tolist():
                        many = int(found.many[found.begin[at[n]]])
                        inner[int(at[n])] = flat[done : done + many]
                        done += many
                sizes = np.fromiter(map(len, held), np.int64, len(held))
                begins = np.cumsum(sizes + 1) - (sizes + 1)  # one place between texts, so that spans of two never join
                marks = np.zeros(int((sizes + 1).sum()) + 1, np.int32)
                gone = low[found.entry] < found.own
                at = begins[found.text] + found.first
                np.add.at(marks, at[gone], 1)
                np.add.at(marks, (at + found.many + (length - 1))[gone], -1)
                for k in np.flatnonzero(~gone & np.isin(found.entry, np.fromiter(inner, np.int64, len(inner)))).tolist():
                    places = at[k] + np.flatnonzero(inner[int(found.entry[k])] < found.own[k])
                    np.add.at(marks, places, 1)
                    np.add.at(marks, places + length, -1)
                removed = np.cumsum(marks[:-1]) > 0
                edges = np.flatnonzero(np.diff(removed.astype(np.int8), prepend=0, append=0))
                bounds = np.searchsorted(edges, np.append(begins, removed.size))
                for a in range(0, len(held), 500):
                    spans, kept = [], []
                    for k in range(a, min(a + 500, len(held))):
                        own = (edges[bounds[k] : bounds[k + 1]] - begins[k]).tolist()
                        spans.append([{"start": x, "stop": y} for x, y in zip(own[::2], own[1::2], strict=True)])
                        stops = [0, *own, len(held[k])]
                        kept.append(b"".join(held[k][x:y] for x, y in zip(stops[::2], stops[1::2], strict=True)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[a : a + 500], pa.int64()),
                            pa.array(sizes[a : a + 500], pa.int64()),
                            pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                            pa.array(kept, pa.binary()),
                        ],
                        names=["id", "n_bytes", "spans", "kept"],
                    )

    schema = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))),
            T.StructField("kept", T.BinaryType()),
        ]
    )
    return with_flags.join(resolved, "chunk", "left").mapInArrow(trimmed(cut), schema).withColumnRenamed("id", id_col)


def repeat_report(documents: DataFrame) -> DataFrame:
    """The digest of op4."""
    found = remove_repeats(documents)
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
