"""Operators that matching, resolution and serving share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.operators.cluster import written


def best(rows: DataFrame, keys: list[str], score: Column | str) -> DataFrame:
    """Per key the rows of the highest score, ties kept. One shuffle, no join back."""
    order = F.col(score) if isinstance(score, str) else score
    return rows.withColumn("_r", F.rank().over(Window.partitionBy(*keys).orderBy(order.desc()))).where("_r = 1").drop("_r")


def by_hash(*columns: str, seed: int = 0) -> Column:
    """An order that looks random and is the same in any engine: md5 of the values as text."""
    return F.md5(F.concat_ws("/", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def sample(rows: DataFrame, n: int, *keys: str, seed: int = 0) -> DataFrame:
    """n rows in hash order: a top-n, no full sort."""
    return rows.orderBy(by_hash(*keys, seed=seed), *keys).limit(n)


def sample_per(rows: DataFrame, n: int, group: list[str], *keys: str, seed: int = 0) -> DataFrame:
    """n rows of each group in hash order."""
    w = Window.partitionBy(*group).orderBy(by_hash(*keys, seed=seed), *keys)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def band_join(a: DataFrame, b: DataFrame, width: float, keys: list[str], ordered: bool) -> DataFrame:
    """Pairs (id_a, id_b, keys, a value, b value) with |a - b| <= width: an equi-join on buckets of that width, then the exact test.

    a and b: id, value and the keys. ordered: one input joined with itself, id_a < id_b. Each row of a goes to three buckets.
    """
    cell = F.floor(F.col("value") / width) if width > 0 else F.col("value")
    reach = F.explode(F.array(cell - 1, cell, cell + 1)) if width > 0 else cell
    left = a.select(F.col("id").alias("id_a"), F.col("value").alias("value_a"), *keys, reach.alias("_cell"))
    right = b.select(F.col("id").alias("id_b"), F.col("value").alias("value_b"), *keys, cell.alias("_cell"))
    near = left.join(right, [*keys, "_cell"]).where(F.abs(F.col("value_a") - F.col("value_b")) <= width)
    return (near.where("id_a < id_b") if ordered else near).drop("_cell")


def dealt_join(a: DataFrame, b: DataFrame, keys: list[str], deals: int = 16) -> DataFrame:
    """An equi-join on few keys with many rows each: a's rows of a key are dealt out and b's go to each deal.

    The number of partitions is given, since the sizes of the inputs say nothing of the size of the result.
    """
    n = 4 * a.sparkSession.sparkContext.defaultParallelism
    left = a.withColumn("_deal", F.pmod(F.xxhash64(*a.columns), F.lit(deals)).cast("int")).repartition(n, *keys, "_deal")
    right = b.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    return left.join(right, [*keys, "_deal"]).drop("_deal")


def cosine(a: DataFrame, b: DataFrame, keys: list[str], ordered: bool = False, threshold: float | None = None) -> DataFrame:
    """id_a, id_b, keys, score: sums of products of weights over shared tokens.

    a and b: id, keys, token, weight (already divided by the norm). Both meet on the keys and the token; sums are combined
    before the shuffle by pair. Frequent tokens have to be pruned before, as they are in the plans that call this.
    """
    left = a.select(F.col("id").alias("id_a"), *keys, "token", F.col("weight").alias("_wa"))
    right = b.select(F.col("id").alias("id_b"), *keys, "token", F.col("weight").alias("_wb"))
    met = left.join(right, [*keys, "token"])
    met = met.where("id_a < id_b") if ordered else met
    out = met.groupBy("id_a", "id_b", *keys).agg(F.sum(F.col("_wa") * F.col("_wb")).alias("score"))
    return out if threshold is None else out.where(F.col("score") >= threshold)


def prefix_cosine(rows: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """The pairs of cosine(rows, rows, ordered=True) with score >= threshold, from fewer candidates.

    Weights are of unit length, so tokens in a common order (rarest first) may be left out of the index while their squares
    add up to less than threshold^2: a pair that shares only such tokens stays under it (Cauchy-Schwarz). Candidates share
    an indexed token; their full scores are then summed.
    """
    frequency = rows.groupBy(*keys, "token").agg(F.count("*").alias("_df"))
    counted = rows.join(frequency, [*keys, "token"])
    behind = Window.partitionBy("id", *keys).orderBy(F.desc("_df"), F.desc("token")).rowsBetween(Window.unboundedPreceding, 0)
    indexed = counted.withColumn("_tail", F.sum(F.col("weight") * F.col("weight")).over(behind)).where(F.col("_tail") >= threshold * threshold - 1e-9)
    a = indexed.select(F.col("id").alias("id_a"), *keys, "token")
    pairs = a.join(a.withColumnRenamed("id_a", "id_b"), [*keys, "token"]).where("id_a < id_b").select("id_a", "id_b", *keys).distinct()
    left = rows.select(F.col("id").alias("id_a"), *keys, "token", F.col("weight").alias("_wa"))
    right = rows.select(F.col("id").alias("id_b"), *keys, "token", F.col("weight").alias("_wb"))
    summed = pairs.join(left, ["id_a", *keys]).join(right, ["id_b", *keys, "token"]).groupBy("id_a", "id_b", *keys).agg(F.sum(F.col("_wa") * F.col("_wb")).alias("score"))
    return summed.where(F.col("score") >= threshold)


def accumulate(state: DataFrame, change: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts kept up to date: an upsert as union and sum."""
    return state.select(*keys, value).unionByName(change.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def every_kth(rows: DataFrame, order: str | list[str], steps: int = 200) -> DataFrame:
    """Every k-th row in order, k = ceil(count / steps); numbering runs over ranges, not in one task."""
    n = rows.count()
    k = max(1, -(-n // steps))
    return numbered(rows, [order] if isinstance(order, str) else order).where(F.col("row_no") % k == 0)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """row_no from 1 in the given total order, nulls last, without putting all rows in one task: ranges are sorted and counted on their own.

    Bounds of ranges come from samples that another run draws differently, so the ranges are written once and read for sizes and rows alike.
    """
    by = [F.col(c).asc_nulls_last() for c in order]
    ranged = written(rows.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))  # a row per partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*by))
    return ranged.withColumn("_own", own).join(F.broadcast(before.select("_p", "_before")), "_p").withColumn("row_no", F.col("_own") + F.col("_before")).drop("_p", "_own", "_before")
