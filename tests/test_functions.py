"""Tokenizers, string functions, aggregates and the t-test on hand-derived values."""

import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomery.functions import stats, text
from loomery.functions.stem import STOP_WORDS, stem


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression.alias("y")).first().y


@pytest.mark.parametrize(
    ("value", "want"),
    [("Foo bar", ["foo!", "f#", "f b", "foo", "bar!", "b#", "bar"]), ("ab", ["ab!", "a#"]), ("aaaa", ["aaa!", "a#", "aaa", "aaa"]), ("", []), ("   ", []), ("a\tb", ["a!", "a#", "a b", "b!", "b#"])],
)
def test_qgrams(spark, value, want):
    assert Counter(one(spark, value, text.qgrams("x"))) == Counter(want)


def test_null_texts(spark):
    row = spark.createDataFrame([(None,)], "x string").select(text.qgrams("x").alias("a"), text.to_num("x").alias("b"), F.size(text.prefixes("x")).alias("c"), F.size(text.substrs("x")).alias("d")).first()
    assert row.a is None and row.b is None and row.c == 0 and row.d == 0


@pytest.mark.parametrize(("value", "want"), [("1", 1.0), (" -2.5e3 ", -2500.0), (".5", 0.5), ("5.", 5.0), ("1d", None), ("NaN", None), ("Infinity", None), ("", None), ("1,000", None), ("0x1F", None)])
def test_to_num(spark, value, want):
    assert one(spark, value, text.to_num("x")) == want


def test_substring_functions(spark):
    assert one(spark, "abc", text.prefixes("x")) == ["a", "ab", "abc"]
    assert sorted(one(spark, "aba", text.substrs("x"))) == ["a", "ab", "aba", "b", "ba"]
    assert one(spark, "CityNameCity", text.remove_substrs("x", F.array(F.lit("city")))) == "NameCity"
    assert one(spark, "RedRing", text.remove_substrs("x", F.array(F.lit("r"), F.lit("ring")))) == "edRing".replace("Ring", "")
    assert one(spark, "orderDate_2", text.dsubstrs("x")) == ["2", "Date", "Date_", "Date_2", "_", "_2", "order", "orderDate", "orderDate_", "orderDate_2"]
    assert sorted(map(tuple, one(spark, "abc", text.strparts("x")))) == [("a", "b", "c"), ("a", "bc"), ("ab", "c"), ("abc",)]
    with pytest.raises(ValueError):
        text.partitions_of("x" * 20)


def test_tokens_by_type():
    kinds = list(text.parse("The well-known foo@bar.com at http://x.org/a costs 3.14 or -5, v1.2.3 naïve x9"))
    assert (16, "well-known") in kinds and (11, "well") in kinds and (11, "known") in kinds
    assert (4, "foo@bar.com") in kinds and (14, "http://") in kinds and (5, "x.org/a") in kinds
    assert (20, "3.14") in kinds and (21, "-5") in kinds and (2, "naïve") in kinds and (3, "x9") in kinds
    assert text.lexemes("The running dogs") == ["1||", "1||run", "1||dog"]
    assert text.lexemes("The running dogs", typed=False) == ["run", "dog"]
    assert text.lexemes(None) == [] and text.lexemes("a" * 3000) == []


@pytest.mark.parametrize(
    ("word", "want"),
    list(dict(caresses="caress", ponies="poni", ties="tie", cats="cat", feed="feed", agreed="agre", hopping="hop", filing="file", happy="happi", relational="relat", generally="general", communication="communic", skies="sky", university="univers", consistently="consist").items()),
)
def test_stem(word, want):
    assert stem(word) == want


def test_stop_words():
    assert {"the", "of", "and"} <= STOP_WORDS and "query" not in STOP_WORDS


def test_product_and_group_concat(spark):
    rows = spark.createDataFrame([(1, 2.0, "a", 1), (1, 3.0, None, 2), (1, None, "b", 3), (2, None, None, 4), (3, 1.0, "", 0), (3, 1.0, "c", 1)], "k int, x double, s string, o int")
    out = {r.k: r for r in rows.groupBy("k").agg(stats.product(F.col("x")).alias("p"), stats.group_concat(F.col("s"), ",", F.col("o")).alias("g")).collect()}
    assert out[1].p == 6.0 and out[2].p == 1.0
    assert out[1].g == "a,b" and out[2].g == "" and out[3].g == "c"


def test_welch():
    assert abs(1 - stats.welch(10, 12, 5, 6, 1, 2) - 0.067394) < 1e-6
    assert stats.welch(1, 5, 0, 0, 1, 1) == 2 and stats.welch(5, 5, 0, 0, 0, 1) == 3
    assert stats.welch(5, 5, 0, 1e300, 1e-300, 1e-300) in (1.0, 4.0)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 50), st.integers(2, 50), st.floats(-5, 5), st.floats(-5, 5), st.floats(0.01, 9), st.floats(0.01, 9))
def test_welch_is_symmetric_and_bounded(n1, n2, m1, m2, v1, v2):
    a, b = stats.welch(n1, n2, m1, m2, v1, v2), stats.welch(n2, n1, m2, m1, v2, v1)
    assert abs(a - b) < 1e-9 and -1e-12 <= a <= 1 + 1e-12


@pytest.mark.parametrize(("a", "b", "x", "want"), [(0.5, 0.5, 0.5, 0.5), (1, 1, 0.3, 0.3), (2, 3, 0.4, 0.5248), (5, 1, 0.9, 0.59049), (1, 0.5, 0.75, 0.5)])
def test_incomplete_beta(a, b, x, want):
    assert abs(stats.incomplete_beta(a, b, x) - want) < 1e-4


def test_histogram_covers_all_numbers(spark):
    rows = spark.createDataFrame([(float(v),) for v in [0] * 50 + list(range(100)) + [10_000]] + [(None,)], "x double")
    out = stats.histogram(rows, "x").collect()
    assert sum(r.n for r in out) == 151 and max(r.bucket for r in out) == math.ceil(math.sqrt(151))
    assert stats.histogram(rows.limit(1), "x").count() == 0
    flat = stats.histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x").collect()
    assert [(r.bucket, r.n) for r in flat] == [(0, 2)]
