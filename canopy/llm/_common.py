"""Helpers shared by the corpus operators: the shared folder, staged tables and Arrow glue."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_ROOT: dict[str, str] = {}
_OWN_FOLDERS: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; a private one only where that is unset and all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOT:
        _OWN_ROOT[app] = "file://" + tempfile.mkdtemp(prefix="canopy-")
    return _OWN_ROOT[app]


def own_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one, deleted when the driver's Python ends."""
    folder = f"{shared_root(spark)}/canopy-{spark.sparkContext.applicationId}"
    if folder not in _OWN_FOLDERS:
        _OWN_FOLDERS.add(folder)
        context = spark.sparkContext
        atexit.register(_delete_at_end, context._jvm, context._jsc.hadoopConfiguration(), folder)
    return folder


def _delete(jvm, configuration, folder: str) -> None:
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(configuration).delete(path, True)


def _delete_at_end(jvm, configuration, folder: str) -> None:
    try:
        _delete(jvm, configuration, folder)
    except Exception:  # noqa: BLE001 (the session's JVM may be gone already)
        return


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}/{tag}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete a staged table that no later result reads."""
    for file in df.inputFiles()[:1]:
        _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), file.rsplit("/", 1)[0])


#: A key is hot in more rows than HOT_ROWS that are also more than one in HOT_SHARE of all: at most HOT_SHARE keys are, so a table of them may be broadcast.
HOT_ROWS, HOT_SHARE = 20_000, 10_000


def crc_of_id(column: str) -> Column:
    """crc32 of the id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def per_batch(
    work: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch] | None],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lift a function of one Arrow batch to the iterator form that mapInArrow takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                if out is None:
                    continue
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return trimmed(run)


#: Rows and bytes that a Python worker gets at a time. Texts are long, so Spark's 10,000 rows would be many megabytes.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to a size that long texts fit in a worker's memory with."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def whole_rows(documents: DataFrame) -> DataFrame:
    """One struct column, `whole`, of all columns: operators carry it through without a name that could clash."""
    return documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("whole"))


def trim() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks and would hold on to it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        return  # not glibc


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and then trim()."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
