"""Helpers that the operators of this subpackage share."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A word is a run of bytes that are none of these; in UTF-8 they never lie inside another character.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """A URI below the folder that all executors share (``spark.checkpoint.dir``)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[len("file:"):]
    return base if "://" in base else "file://" + base


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that later jobs, and tasks
    run again after a lost executor, start from stored rows."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier may learn from: one fifth by checksum of the id's digits.
    A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def cut(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a piece hold about ``max_bytes``; a longer
    single text is a piece of its own.  Bounds what a task holds besides Spark's own batch."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = [x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()]
        first, size = 0, 0
        for i, length in enumerate(lengths):
            if size and size + length > max_bytes:
                yield batch.slice(first, i - first)
                first, size = i, 0
            size += length
        yield batch.slice(first, n - first)


def objects(column: pa.Array) -> list:
    """The texts or bytes of ``column``, as ``to_pylist`` gives them at several times the cost."""
    return column.to_numpy(zero_copy_only=False).tolist()


#: Rows that Spark hands to Python at once: texts are long, and both sides hold a whole batch.
ARROW_ROWS = 1000


def short_batches(df: DataFrame) -> DataFrame:
    """``df``, after limiting the session's Arrow batches to ``ARROW_ROWS`` rows (where they aren't shorter already)."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= ARROW_ROWS:
        conf.set(name, str(ARROW_ROWS))
    return df


_CACHES: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What tasks of one operator keep in a worker process.  Workers outlive operators, so what others kept goes."""
    for other in [x for x in _CACHES if x != owner]:
        del _CACHES[other]
    return _CACHES.setdefault(owner, {})


def release() -> None:
    """Give memory that a task no longer uses back to the system.  Workers wait for further tasks, and several may wait beside those at work."""
    import ctypes
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def null_safe(left: DataFrame, right: DataFrame, *names: str) -> Column:
    cond = F.lit(True)
    for k, name in enumerate(names):
        one = left[name].eqNullSafe(right[name])
        cond = one if not k else cond & one
    return cond


def by_name(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
