"""Embedders: functions from texts to vectors, and their application to a column in batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Embedder = Callable[[list[str]], list[list[float]]]
BATCH = 25
_WORD = re.compile(r"\w+")


def hashing_embedder(dim: int = 64) -> Embedder:
    """Deterministic and offline: words fall into signed buckets by hash, and vectors have length one."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for row, t in zip(out, texts, strict=True):
            for word in _WORD.findall(t.lower()):
                h = xxhash.xxh3_64_intdigest(word)
                row[h % dim] += 1.0 if h >> 63 else -1.0
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0).tolist()

    return embed


def embedded(rows: DataFrame, texts: dict[str, str], embedder: Embedder, batch: int = BATCH, retries: int = 2) -> DataFrame:
    """rows with a vector column for each text column ({text column: vector column}), in one pass over the rows.

    Empty and null texts get an empty vector and are not sent.
    """
    kept = [f for f in rows.schema.fields if f.name not in texts.values()]
    schema = T.StructType([*kept, *[T.StructField(v, T.ArrayType(T.DoubleType())) for v in texts.values()]])
    names = [f.name for f in schema.fields]

    def send(own: list[str]) -> list[list[float]]:
        for attempt in range(retries + 1):
            try:
                found = embedder(own)
                if len(found) != len(own):
                    raise ValueError(f"{len(own)} texts, {len(found)} vectors")
                return found
            except ConnectionError:
                if attempt == retries:
                    raise
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for column in texts:
                held = b[column].to_pylist()
                at = [i for i, t in enumerate(held) if t]
                vectors: list[list[float]] = [[] for _ in held]
                for k in range(0, len(at), batch):
                    own = at[k : k + batch]
                    for i, v in zip(own, send([held[i] for i in own]), strict=True):
                        vectors[i] = [float(x) for x in v]
                out.append(pa.array(vectors, pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays([*[b[f.name] for f in kept], *out], names=names)

    return rows.mapInArrow(run, schema)
