"""Documents as chunks that share one local dictionary.

A chunk holds consecutive documents of one input partition, some megabytes of text. Its distinct tokens are numbered by
falling frequency and its documents become sequences of those numbers, packed by byte plane and compressed. The tokens
themselves go to buckets by a hash of the token, one packed row for each bucket of a chunk. All chunks' rows of a bucket
meet in one task (the shuffle of distinct tokens), where what must be known about a token (its ids, its count) is worked
out once, and the answers return to the chunks in the order of the tokens.

A chunk is bounded by CHUNK_BYTES of text, or one document where that is longer. A bucket holds a share of the corpus's
distinct tokens for each chunk; buckets are as many as the shuffle partitions, so that setting bounds a task, and a
frequent token has one entry a chunk however often it occurs. The table is staged, bucketed by chunk: both sides of the
join back see the same numbering even if an executor is lost, and the texts' side is not shuffled.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import own_folder, trimmed

CHUNK_BYTES = 8 << 20


def pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0 below 2^31, byte plane by byte plane, compressed."""
    planes = 1 if not numbers.size else max(1, (int(numbers.max()).bit_length() + 7) // 8)
    split = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :planes].T
    return bytes([planes]) + zstandard.ZstdCompressor(level=1).compress(split.tobytes())


def unpack(packed: bytes) -> np.ndarray:
    planes = packed[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), np.uint8).reshape(planes, -1)
    out = np.zeros((raw.shape[1], 4), np.uint8)
    out[:, :planes] = raw.T
    return out.reshape(-1).view("<i4")


def pack_words(words: list[bytes]) -> bytes:
    lengths = pack(np.fromiter(map(len, words), np.int64, len(words)))
    return len(lengths).to_bytes(4, "little") + lengths + zstandard.ZstdCompressor(level=3).compress(b"".join(words))


def unpack_words(packed: bytes) -> list[bytes]:
    at = 4 + int.from_bytes(packed[:4], "little")
    ends = np.cumsum(unpack(packed[4:at]), dtype=np.int64).tolist()
    joined = zstandard.ZstdDecompressor().decompress(packed[at:])
    return [joined[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def gather(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[starts[p] : starts[p] + lengths[p]] for each p of picks, end to end, and each one's length."""
    n = lengths[picks]
    ends = np.cumsum(n, dtype=np.int64)
    where = np.repeat(starts[picks] - (ends - n), n) + np.arange(ends[-1] if n.size else 0)
    return flat[where], n


class Chunks:
    """The staged table: texts (chunk, rows, lens, codes, buckets) and tokens (chunk, bucket, words, counts)."""

    def __init__(self, table: DataFrame):
        self.texts = table.where("bucket is null").select("chunk", "rows", "lens", "codes", "buckets")
        self.tokens = table.where("bucket is not null").select("chunk", "bucket", "words", "counts")


def chunked(
    documents: DataFrame,
    keep: list[str],
    text_col: str,
    split: Callable[[str], list],
    *,
    binary: bool = False,
    counted: str | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> Chunks:
    """Split the texts into tokens and stage them. counts holds each token's occurrences in rows where `counted` is true."""
    spark = documents.sparkSession
    source = documents.select(F.struct(*[F.col(c) for c in keep]).alias("row"), F.col(text_col).cast("string").alias("text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    binaries = ("codes", "buckets", "words", "counts")
    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("bucket", T.IntegerType()),
            T.StructField("rows", T.ArrayType(source.schema["row"].dataType)),
            T.StructField("lens", T.ArrayType(T.IntegerType())),
            *[T.StructField(b, T.BinaryType()) for b in binaries],
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = count(TaskContext.get().partitionId() << 32)
        rows: list[pa.Array] = []
        numbers: defaultdict = defaultdict(count().__next__)
        parts: list[np.ndarray] = []
        size, row_type = 0, None

        def record(chunk: int, bucket: int | None, held: pa.Array | None, lens: list[int] | None, *packed: bytes | None) -> pa.RecordBatch:
            held = pa.nulls(1, pa.list_(row_type)) if held is None else pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
            arrays = [pa.array([chunk], pa.int64()), pa.array([bucket], pa.int32()), held, pa.array([lens], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([*arrays, *[pa.array([p], pa.binary()) for p in packed]], names=schema.names)

        def flush() -> Iterator[pa.RecordBatch]:
            chunk, held = next(serial), pa.concat_arrays(rows)
            codes = np.concatenate(parts)
            order = np.argsort(-np.bincount(codes, minlength=len(numbers)), kind="stable")
            rank = np.empty(len(numbers), np.int32)
            rank[order] = np.arange(len(numbers), dtype=np.int32)
            codes = rank[codes]
            tokens = list(numbers)
            tokens = [tokens[i] if binary else tokens[i].encode() for i in order]
            homes = np.fromiter((xxhash.xxh3_64_intdigest(t) % partitions for t in tokens), np.int64, len(tokens))
            yield record(chunk, None, held, [len(p) for p in parts], pack(codes), pack(homes), None, None)
            counts = np.zeros(0, np.int64)
            if counted:
                mask = np.repeat(held.field(counted).to_numpy(zero_copy_only=False).astype(bool), [len(p) for p in parts])
                counts = np.bincount(codes[mask], minlength=len(tokens))
            by_home = np.argsort(homes, kind="stable")
            homes_in, starts = np.unique(homes[by_home], return_index=True)
            for home, own in zip(homes_in.tolist(), np.split(by_home, starts[1:]), strict=True) if len(tokens) else ():
                yield record(chunk, home, None, None, None, None, pack_words([tokens[i] for i in own]), pack(counts[own]) if counted else None)
            rows.clear()
            parts.clear()
            numbers.clear()
            numbers.default_factory = count().__next__

        for batch in batches:
            row_type = batch["row"].type
            texts = batch["text"].cast(pa.binary()) if binary else batch["text"]
            begun = 0
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                tokens = split(text) if text else ()
                parts.append(np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens)))
                size += len(text or "")
                if size >= chunk_bytes:
                    rows.append(batch["row"].slice(begun, i + 1 - begun))
                    begun, size = i + 1, 0
                    yield from flush()
            if begun < batch.num_rows:
                rows.append(batch["row"].slice(begun))
        if rows:
            yield from flush()

    name = f"canopy_chunks_{uuid.uuid4().hex}"
    writer = source.mapInArrow(trimmed(run), schema).write.format("parquet").option("path", f"{own_folder(spark)}/{name}").option("compression", "zstd")
    writer.bucketBy(partitions, "chunk").saveAsTable(name)
    table = spark.table(name)
    found = Chunks(table)
    spark.sql(f"DROP TABLE {name}")  # the files stay; the frames above refer to them
    return found


def answered(chunks: Chunks, answer: Callable[[list[list[bytes]], list[np.ndarray]], list[bytes]]) -> DataFrame:
    """chunks.texts with answers: array of (bucket, packed) where answer gave packed for the tokens of each row of a bucket."""

    def run(table: pa.Table) -> pa.Table:
        counts = [unpack(c) if c else np.zeros(0, np.int64) for c in table["counts"].to_pylist()]
        packed = answer([unpack_words(w) for w in table["words"].to_pylist()], counts)
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "packed": pa.array(packed, pa.binary())})

    answers = chunks.tokens.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, packed binary")
    together = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "packed")).alias("answers"))
    return chunks.texts.join(together, "chunk", "left")


def token_places(buckets: bytes) -> dict[int, np.ndarray]:
    """For each bucket, the numbers of its tokens in the order of its packed rows."""
    homes = unpack(buckets)
    by_home = np.argsort(homes, kind="stable")
    found, starts = np.unique(homes[by_home], return_index=True)
    return dict(zip(found.tolist(), np.split(by_home, starts[1:]), strict=True)) if homes.size else {}
