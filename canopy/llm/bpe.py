"""Byte-level BPE encoding and decoding.

Texts are cut into pre-tokens by the tokenizer's pattern. Chunks number their pre-tokens (see _chunks), the distinct
pre-tokens of the whole corpus meet in one shuffle and each is encoded once, and its ids join back to the chunks, where
the numbers put them in place. Decoding gathers each id's bytes from the token-byte table, whose size is the vocabulary's
(50,256 tokens, so it is broadcast).

Ids travel as little-endian unsigned 32-bit integers in a binary column. Defined cases: a null or empty text has no ids
and decodes to no bytes; repeated rows and repeated or null ids of documents are kept as they are; extra columns are
ignored; ids outside the vocabulary raise an error.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._chunks import CHUNK_BYTES, answered, chunked, gather, pack, token_places, unpack
from ._common import per_batch, trimmed

ROWS_OUT = 500
RANKS = "byte_bpe_multi_50k.tiktoken"


def load_ranks(path: str | None = None) -> dict[bytes, int]:
    with open(path or public_tokenizers.path(RANKS), "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def encode(
    documents: DataFrame,
    ranks: dict[bytes, int],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    pattern: str = public_tokenizers.PATTERN,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Rows (id, ids binary) for each document."""
    spark = documents.sparkSession
    vocabulary = spark.sparkContext.broadcast(ranks)

    def pieces(text: str) -> list[str]:
        return regex.findall(pattern, text)

    def encode_words(lists: list[list[bytes]], counts: list[np.ndarray]) -> list[bytes]:
        bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary.value, special_tokens={})
        known: dict[bytes, list[int]] = {}
        out = []
        for words in lists:
            for w in words:
                if w not in known:
                    known[w] = bpe._encode_single_piece(w)
            found = [known[w] for w in words]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            out.append(_pair(pack(lengths), pack(np.fromiter(chain.from_iterable(found), np.int64, int(lengths.sum())))))
        return out

    def assemble(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            rows, lens = batch["rows"][i].values, np.array(batch["lens"][i].values, np.int64)
            codes, places = unpack(batch["codes"][i].as_py()), token_places(batch["buckets"][i].as_py())
            total = sum(p.size for p in places.values())
            lengths, starts, flat, at = np.zeros(total, np.int32), np.zeros(total, np.int64), [np.zeros(0, np.int32)], 0
            for part in batch["answers"][i].as_py() or ():
                n, ids = map(unpack, _unpair(part["packed"]))
                lengths[places[part["bucket"]]] = n
                starts[places[part["bucket"]]] = at + np.cumsum(n, dtype=np.int64) - n
                flat.append(ids)
                at += ids.size
            every = np.concatenate(flat)
            ends = np.cumsum(lens)
            for first in range(0, len(lens), ROWS_OUT):
                last = min(first + ROWS_OUT, len(lens))
                out = [gather(starts, lengths, every, codes[ends[k] - lens[k] : ends[k]])[0].tobytes() for k in range(first, last)]
                yield pa.RecordBatch.from_arrays([rows.field("id").slice(first, last - first), pa.array(out, pa.binary())], names=["id", "ids"])

    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    joined = answered(chunked(source, ["id"], "text", pieces, chunk_bytes=chunk_bytes), encode_words)
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("ids", T.BinaryType())])
    return joined.mapInArrow(per_batch(assemble), schema).withColumnRenamed("id", id_col)


def _pair(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(4, "little") + a + b


def _unpair(packed: bytes) -> tuple[bytes, bytes]:
    at = 4 + int.from_bytes(packed[:4], "little")
    return packed[4:at], packed[at:]


def decode(encoded: DataFrame, ranks: dict[bytes, int], *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the bytes that its ids stand for."""
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    table = encoded.sparkSession.sparkContext.broadcast(tokens)
    schema = T.StructType([*[f for f in encoded.schema.fields if f.name != out_col], T.StructField(out_col, T.BinaryType())])
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches):
        lengths = np.fromiter(map(len, table.value), np.int64, len(table.value))
        starts, flat = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(table.value), np.uint8)
        for batch in batches:
            out = []
            for ids in batch[ids_col].to_pylist():
                out.append(gather(starts, lengths, flat, np.frombuffer(ids or b"", "<i4"))[0].tobytes())
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in kept], pa.array(out, pa.binary())], names=[*kept, out_col])

    return encoded.select(*kept).mapInArrow(trimmed(run), schema)


def round_trip_report(documents: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """The digest of op3, from the encoded and the decoded texts themselves."""
    ranks = load_ranks(ranks_path)
    both = decode(encode(documents, ranks), ranks)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
