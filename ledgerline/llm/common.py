"""What the corpus operators share: reading tables, shared scratch space, byte views."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.shipping import ship_package

#: Bytes of text (as UTF-8) that one step of a Python worker handles at a time.
STEP_BYTES = 2 << 20
#: Rows with texts, and rows of a few numbers, that a Python worker gets at a time.
BATCH_ROWS, NARROW_ROWS = 2000, 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_ROOTS: dict[str, str] = {}


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor can reach.

    Where the setting is absent, a session on one machine takes a temporary folder; any other must set it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _OWN_ROOTS.get(app) or _OWN_ROOTS.setdefault(app, "file://" + tempfile.mkdtemp(prefix="ledgerline-"))
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def lean(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Python workers get `rows` rows at a time, so that neither side holds many long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stored(df: DataFrame, what: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Write `df` to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    lean(spark, rows)
    path = scratch(spark, what)
    df.write.parquet(path)
    lean(spark)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete the files behind tables of `stored` that no later plan reads, and let the driver find out which
    shuffles nothing refers to any more, whose files go then."""
    for df in tables:
        spark = df.sparkSession
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def trimmed(run):
    """A function over batches that, when it has ended, returns freed memory of the worker to the system."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it keeps what was freed
        pass


def n_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a string column over all rows."""
    lean(df.sparkSession)
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def parts_for(total: int, each: int, least: int = 1) -> int:
    return max(least, -(-int(total) // each))


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of about `size` bytes in `column`; a longer row is alone in its slice."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def bytes_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
