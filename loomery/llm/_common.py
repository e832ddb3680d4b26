"""What the corpus operators share: the cluster's shared folder, lineage cuts and bounded batches of text."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and all its work is done on this machine, as in tests.
FALLBACK_SHARED_DIR = "/tmp/checkpoints"
#: Keys of more than a HEAVY-th of all rows count as hot; there are at most HEAVY of them.
HEAVY = 10_000
#: A Python worker holds about this much text at a time, whatever the size of an Arrow batch.
SLICE_CHARS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, which only a local session may leave unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (folder or FALLBACK_SHARED_DIR).rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with groups (a row per key; `size`: the key's number of rows), though a key may hold most of the rows.

    Hot keys are at most HEAVY and so may be broadcast: their rows stay where they are. The others meet by a shuffle in which
    no key has more than total / HEAVY rows. how: inner or left.
    """
    hot = F.broadcast(groups.where(F.col(size) > max(1, total // HEAVY)))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(groups.where(F.col(size) <= max(1, total // HEAVY)), key, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each batch in runs of rows that hold about SLICE_CHARS characters (one row at least), with its whole texts; null reads as empty. Ends with release()."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(ends.searchsorted(before + SLICE_CHARS, "right")))
            part = batch.slice(lo, hi - lo)
            yield part, [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]
            lo = hi
    release()


def release() -> None:
    """Give a process's free memory back to the system. Python workers stay between tasks, and what they keep counts beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim is not None:
        trim(0)


def bounded_labels(labels: DataFrame, limit: int, columns: list[str], where=None) -> DataFrame:
    """At most `limit` labelled ids, the same for the same rows: the smallest by a hash of the id; conflicting rows of an id take the largest label.

    The bound makes the result safe to broadcast.
    """
    rows = labels.where(F.col("doc_id").isNotNull())
    if where is not None:
        rows = rows.where(where)
    rows = rows.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in columns])
    for c in columns:
        rows = rows.where(F.col(c).isNotNull())
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
