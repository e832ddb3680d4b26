"""Vector tables for the searches: valid rows, a stated query set in files of the shared folder, blocks, and the merge of partial results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm._common import fresh_dir

#: Vectors of one index, and queries that a task holds at a time.
BLOCK, QUERIES = 8192, 2048


def valid(rows: DataFrame, zero: bool) -> DataFrame:
    """vec_id and embedding of the rows that take part: no null or non-finite components; zero vectors only if `zero`."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    out = out.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return out if zero else out.where(F.exists("embedding", lambda x: x != 0))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of a batch, by number of components."""
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    vectors = batch.column("embedding")
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield ids[at], flat.reshape(len(at), int(size))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of at most BLOCK vectors of as many components."""
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    count: dict[int, int] = {}
    for batch in batches:
        for ids, vectors in _matrices(batch):
            for lo in range(0, len(ids), BLOCK):
                part, size = (ids[lo : lo + BLOCK], vectors[lo : lo + BLOCK]), vectors.shape[1]
                if count.get(size, 0) + len(part[0]) > BLOCK:
                    yield tuple(map(np.concatenate, zip(*waiting.pop(size))))
                    count[size] = 0
                waiting.setdefault(size, []).append(part)
                count[size] = count.get(size, 0) + len(part[0])
    for parts in waiting.values():
        yield tuple(map(np.concatenate, zip(*parts)))


def search(rows: DataFrame, queries: DataFrame, k: int, index: Callable, score_type: str) -> DataFrame:
    """Each query's k best of all rows but its own: query_id, rank, vec_id, score; ties go to the smaller vec_id.

    index(vectors) returns a function of (query vectors, k, the query's own rows, least score that matters for each query)
    that gives, per query, row numbers and scores of its k best in that block. Every task indexes blocks of its own rows and
    reads the stated queries, block by block, from files in the shared folder; it keeps the k best scores of each query, so
    that later blocks need not look for less. What leaves it is k rows per query and block at most.
    """
    folder = fresh_dir(rows.sparkSession, "queries")
    chosen = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    chosen.write.parquet(folder)
    kind = pa.int64() if score_type == "long" else pa.float64()

    def query_blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        found = pads.dataset(root, filesystem=fs, format="parquet")
        for batch in found.to_batches(batch_size=QUERIES):
            if batch.num_rows:
                yield from _matrices(batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], np.ndarray] = {}  # by first query and number of components: the k best scores of a block of queries
        for ids, vectors in _blocks(batches):
            order = np.argsort(ids, kind="stable")  # so that the smaller row number is the smaller id
            ids, vectors = ids[order], vectors[order]
            find = index(vectors)
            for query_ids, wanted in query_blocks():
                if wanted.shape[1] != vectors.shape[1]:
                    continue
                own = [np.arange(a, b) for a, b in zip(np.searchsorted(ids, query_ids), np.searchsorted(ids, query_ids, "right"))]
                key = (int(query_ids[0]), wanted.shape[1])
                known = best.get(key, np.full((len(query_ids), k), -np.inf))
                found = find(wanted, k, own, known[:, 0])
                for i, (_, scores) in enumerate(found):
                    known[i] = np.sort(np.concatenate([known[i], scores.astype(float)]))[-k:]
                best[key] = known
                sizes = [len(at) for at, _ in found]
                at = np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64)
                scores = np.concatenate([s for _, s in found]) if found else np.zeros(0)
                yield pa.record_batch([pa.array(np.repeat(query_ids, sizes), pa.int64()), pa.array(ids[at], pa.int64()), pa.array(scores, kind)], ["query_id", "vec_id", "score"])

    partial = rows.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top(scores: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of largest score, ties to the smaller row."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= least
        scores, rows = scores[keep], rows[keep]
    order = np.lexsort((rows, -scores))[:k]
    return rows[order], scores[order]
