"""Tokenizers and string functions as column expressions, and the few generators that need Python.

Null input gives null arrays or no rows. Characters are code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.functions.stem import STOP_WORDS, stem

#: What counts as a number in a text cell: no exponents without digits, no NaN or infinity, no type suffixes.
NUMBER = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?\s*$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_num(value: Column | str) -> Column:
    """The cell as double, null if it isn't a plain number."""
    value = _c(value)
    return F.when(value.rlike(NUMBER), F.trim(value).try_cast("double"))


def qgrams(text: Column | str, q: int = 3) -> Column:
    """Array of a text's q-grams with repeats: per term its first q characters marked '!', its initial marked '#', its and the next term's initials, and all runs of q characters."""
    terms = F.filter(F.split(F.lower(_c(text)), r"\s+"), lambda t: t != "")

    def of_term(t: Column, i: Column) -> Column:
        first = F.substring(t, 1, 1)
        following = F.get(terms, i + 1)
        empty = F.array().cast("array<string>")
        marks = F.array(F.concat(F.substring(t, 1, q), F.lit("!")), F.concat(first, F.lit("#")))
        pair = F.when(following.isNotNull(), F.array(F.concat(first, F.lit(" "), F.substring(following, 1, 1)))).otherwise(empty)
        runs = F.when(F.length(t) >= q, F.transform(F.sequence(F.lit(1), F.length(t) - (q - 1)), lambda p: F.substr(t, p, F.lit(q)))).otherwise(empty)
        return F.concat(marks, pair, runs)

    return F.flatten(F.transform(terms, of_term))


def word_tokens(text: Column | str) -> Column:
    """Array of runs of ASCII letters and digits, lower case, with repeats."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("([a-z0-9]+)"), 1)


def prefixes(text: Column | str) -> Column:
    """All non-empty prefixes."""
    t = _c(text)
    return F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(t)), lambda n: F.substr(t, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def substrs(text: Column | str) -> Column:
    """The set of all non-empty substrings."""
    t = _c(text)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.transform(F.sequence(F.lit(1), F.length(t) - i + 1), lambda n: F.substr(t, i, n))))
    return F.when(F.length(t) > 0, F.array_distinct(spans)).otherwise(F.array().cast("array<string>"))


def remove_substrs(target: Column | str, needles: Column) -> Column:
    """Take the first occurrence of each needle (an array), in any case, out of the target; longest needles first."""
    ordered = F.array_sort(needles, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))

    def step(text: Column, needle: Column) -> Column:
        at = F.position(F.lower(needle), F.lower(text))
        return F.when((at > 0) & (F.length(needle) > 0), F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(needle)))).otherwise(text)

    return F.aggregate(ordered, _c(target), step)


#: Fixed value: where a name is cut into its delimited parts, one character behind the start of each match.
CUTS = re.compile(r"(\W)|(_)|(.(?=[\W_]))|([a-z][A-Z])|(\d\D)|(\D\d)")


def delimited_parts(name: str | None) -> list[str]:
    """The set of substrings between any two cut points of a name, sorted."""
    if not name:
        return []
    points = sorted({0, len(name), *(m.start() + 1 for m in CUTS.finditer(name))})
    return sorted({name[a:b] for i, a in enumerate(points) for b in points[i + 1 :]})


@F.pandas_udf(T.ArrayType(T.StringType()))
def dsubstrs(names: pd.Series) -> pd.Series:
    """delimited_parts() of a column."""
    return names.map(delimited_parts)


#: A string of n characters has 2^(n-1) partitions; longer ones are refused.
MOST_PARTED = 16


def partitions_of(text: str | None) -> list[list[str]]:
    """All ways to cut a text into consecutive non-empty parts."""
    if not text:
        return []
    if len(text) > MOST_PARTED:
        raise ValueError(f"a text of {len(text)} characters has too many partitions; the most is {MOST_PARTED}")
    out = []
    for cut in range(1 << (len(text) - 1)):
        points = [0, *(i + 1 for i in range(len(text) - 1) if cut >> i & 1), len(text)]
        out.append([text[a:b] for a, b in zip(points, points[1:])])
    return out


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def strparts(texts: pd.Series) -> pd.Series:
    """partitions_of() of a column."""
    return texts.map(partitions_of)


#: Token types of a text-search parser and the patterns for them, tried in this order.
TOKEN_TYPES = [
    (13, r"</?[A-Za-z][^<>]*>"),
    (23, r"&(?:[A-Za-z]+|#[0-9]+|#x[0-9A-Fa-f]+);"),
    (4, r"[A-Za-z0-9._+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    (14, r"[A-Za-z]+://"),
    (5, r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?::[0-9]+)?/[^\s<>]*"),
    (6, r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?::[0-9]+)?"),
    (7, r"[+-]?[0-9]+(?:\.[0-9]+)?[eE][+-]?[0-9]+"),
    (8, r"[0-9]+(?:\.[0-9]+){2,}"),
    (20, r"[+-]?[0-9]+\.[0-9]+"),
    (19, r"/?(?:[A-Za-z0-9_.-]+/)+[A-Za-z0-9_.-]+"),
    (16, r"[A-Za-z]+(?:-[A-Za-z]+)+"),
    (17, r"[^\W\d_]+(?:-[^\W\d_]+)+"),
    (15, r"(?:[^\W_]*\d[^\W_]*|[^\W_]+)(?:-[^\W_]+)+"),
    (1, r"[A-Za-z]+(?![^\W_])"),
    (2, r"[^\W\d_]+(?![^\W_])"),
    (3, r"[^\W\d_][^\W_]*"),
    (21, r"[+-][0-9]+"),
    (22, r"[0-9]+"),
]
_TOKEN = re.compile("|".join(f"(?P<t{k}>{p})" for k, p in TOKEN_TYPES))
#: The type of a part of a hyphenated word, by the type that the part has alone.
PART_TYPES = {1: 11, 2: 10, 3: 9, 22: 22}
LONGEST_TOKEN = 2048
_STEMMED = {1, 2, 10, 11, 16, 17}


def parse(text: str | None) -> Iterator[tuple[int, str]]:
    """Type and token of a text, in order; hyphenated words come whole and in parts. Blanks are left out."""
    for m in _TOKEN.finditer(text or ""):
        kind = int(m.lastgroup[1:])
        yield kind, m[0]
        if kind in (15, 16, 17):
            for part in m[0].split("-"):
                own = 1 if part.isascii() and part.isalpha() else 2 if part.isalpha() else 22 if part.isdigit() else 3
                yield PART_TYPES[own], part


def lexemes(text: str | None, typed: bool = True) -> list[str]:
    """Stemmed tokens, as 'type||lexeme' or bare; a stop word's lexeme is empty, and bare empty ones are left out."""
    out = []
    for kind, token in parse(text):
        if len(token) >= LONGEST_TOKEN:
            continue
        token = token.lower()
        lexeme = ("" if token in STOP_WORDS else stem(token)) if kind in _STEMMED else token
        if typed or lexeme:
            out.append(f"{kind}||{lexeme}" if typed else lexeme)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed_tokens(texts: pd.Series) -> pd.Series:
    """lexemes() of a column, with their types."""
    return texts.map(lambda t: lexemes(t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def bare_tokens(texts: pd.Series) -> pd.Series:
    """lexemes() of a column, without types."""
    return texts.map(lambda t: lexemes(t, typed=False))
