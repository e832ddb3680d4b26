"""Aggregates and tests: product, delimited concatenation, Welch's t-test, histograms."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def product(value: Column) -> Column:
    """Product of the non-null values; 1 of none."""
    return F.coalesce(F.product(value), F.lit(1.0))


def group_concat(value: Column, delimiter: str, order: Column | None = None) -> Column:
    """The non-null values with a delimiter between, in the given order (else the values' own); '' of none. Empty strings before the first other one vanish."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct((value if order is None else order).alias("o"), value.alias("v")))))
    joined = F.array_join(F.transform(pairs, lambda p: p["v"]), delimiter)
    return F.regexp_replace(joined, f"^({_quoted(delimiter)})+", "")


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and not c.isspace() else c for c in text)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def welch(n1: float, n2: float, m1: float, m2: float, v1: float, v2: float) -> float:
    """1 less the two-sided p of Welch's t-test. Sentinels: 2 for a sample under two values, 3 without variance, 4 on overflow."""
    if n1 < 2 or n2 < 2:
        return 2.0
    try:
        s1, s2 = v1 / n1, v2 / n2
        if s1 <= 0 or s2 <= 0:
            return 3.0
        t2 = (m1 - m2) ** 2 / (s1 + s2)
        df = (s1 + s2) ** 2 / (s1**2 / (n1 - 1) + s2**2 / (n2 - 1))
        return 1 - incomplete_beta(df / 2, 0.5, df / (df + t2))
    except (OverflowError, ZeroDivisionError):
        return 4.0


@F.pandas_udf(T.DoubleType())
def _welch(n1: pd.Series, n2: pd.Series, m1: pd.Series, m2: pd.Series, v1: pd.Series, v2: pd.Series) -> pd.Series:
    rows = zip(n1, n2, m1, m2, v1, v2)
    return pd.Series([None if any(map(pd.isna, r)) else welch(*r) for r in rows], dtype="float64")


#: As a column function. Marked so that a filter on its result doesn't run it twice.
welch_test = _welch.asNondeterministic()


def histogram(values: DataFrame, column: str) -> DataFrame:
    """bucket, low, high, n over the numbers of a column: ceil(sqrt(n)) equal buckets over [min, max] clipped to mean +- 3 sigma.

    The last bucket holds its upper edge; bucket -1 counts what is below, bucket B what is above. One number or none: no rows.
    """
    x = F.col(column)
    numbers = values.where(x.isNotNull() & ~F.isnan(x.cast("double"))).select(x.cast("double").alias("x"))
    stats = numbers.agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.min("x").alias("a"), F.max("x").alias("b")).where("n > 1")
    edges = stats.select(F.ceil(F.sqrt("n")).alias("buckets"), F.greatest(F.col("a"), F.col("m") - 3 * F.col("s")).alias("low"), F.least(F.col("b"), F.col("m") + 3 * F.col("s")).alias("high"))
    width = (F.col("high") - F.col("low")) / F.col("buckets")
    # Equal numbers have no width and stand in bucket 0; least() would pass over the null.
    inner = F.least(F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("low"), width)), F.lit(0)), F.col("buckets") - 1)
    place = F.when(F.col("x") < F.col("low"), -1).when(F.col("x") > F.col("high"), F.col("buckets")).otherwise(inner)
    placed = numbers.join(F.broadcast(edges)).select(place.cast("int").alias("bucket"), "low", width.alias("width"))  # edges: one row
    counted = placed.groupBy("bucket", "low", "width").agg(F.count("*").alias("n"))
    return counted.select("bucket", (F.col("low") + F.col("bucket") * F.col("width")).alias("low"), (F.col("low") + (F.col("bucket") + 1) * F.col("width")).alias("high"), "n")
