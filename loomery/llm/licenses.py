"""License scans by an exact set-similarity join of text blocks with license templates.

A text's blocks for a template are its windows of as many consecutive words as the template allows. A block matches when it
holds at least the threshold share of the template's different words (containment). Tokens are ordered by how many texts
hold them, rarest first, counted over all texts. With that order,

* prefix filter: a matching block must hold one of the template's first |T| - ceil(t |T|) + 1 tokens, so only blocks around
  such a token are looked at, and texts without any are done after one set intersection;
* length filter: a text, and so a block, with fewer different template tokens than ceil(t |T|) can't match;
* positional filter: with the rarest common token at place i of the template and j of the block's tokens, the overlap is at
  most 1 + min(|T| - i - 1, |B| - j - 1).

What passes is counted exactly over sliding windows, so no matching block is lost. Phrases are templates of threshold 1
whose words must also stand in order, which is checked afterwards.

Cases: a null or empty text has no words, no labels and score 0; null ids are kept; repeated rows give repeated results;
other columns are ignored; an empty table gives an empty result. Ties between tokens of one frequency go by the token.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm._common import slices

#: Base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices of well-known licenses, as labels of the method's own.
TEMPLATES = [
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-notice", "released under the mit license"),
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    ("bsd-redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-notice", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.8
#: A block has this many times the template's words.
BLOCK_FACTOR = 1.25
#: Bytes of UTF-8 to words: ASCII capitals become small, all ASCII but letters and digits becomes a blank, other bytes stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,start:long,words:long,containment:double>>"


def words_of(text: str) -> list[bytes]:
    """The whole text's words, in UTF-8."""
    # Split at the blank alone: bytes.split() without argument splits at ASCII white space, and the table leaves only blanks.
    return text.encode().translate(WORD_BYTES).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    threshold: float
    phrase: bool

    @property
    def least(self) -> int:
        """Different words that a matching block holds at least."""
        return max(1, math.ceil(self.threshold * len(set(self.words)) - 1e-9))

    @property
    def span(self) -> int:
        """Words of a block."""
        return len(self.words) if self.phrase else math.ceil(BLOCK_FACTOR * len(self.words))


def templates(phrases: dict[str, str], notices: list[tuple[str, str]], threshold: float) -> list[Template]:
    made = [Template(label, tuple(words_of(p)), 1.0, True) for p, label in phrases.items()]
    return made + [Template(label, tuple(words_of(p)), threshold, False) for label, p in notices]


def token_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Texts that hold each token of the templates, over all texts; a row per token and task leaves the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for _, texts in slices(batches):
            for text in texts:
                counts.update(vocabulary.intersection(words_of(text)))
        yield pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    rows = docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.token): r.n for r in rows}  # at most one row per template token


class Scanner:
    def __init__(self, wanted: list[Template], frequencies: dict[bytes, int]):
        self.wanted = wanted
        self.rank = {w: i for i, w in enumerate(sorted({w for t in wanted for w in t.words}, key=lambda w: (frequencies.get(w, 0), w)))}
        self.ordered = [sorted(set(t.words), key=self.rank.__getitem__) for t in wanted]
        self.prefixes = [set(order[: len(order) - t.least + 1]) for t, order in zip(wanted, self.ordered)]
        self.of_prefix: dict[bytes, list[int]] = {}
        for k, prefix in enumerate(self.prefixes):
            for w in prefix:
                self.of_prefix.setdefault(w, []).append(k)
        self.any_prefix = set(self.of_prefix)
        self.place = [{w: i for i, w in enumerate(order)} for order in self.ordered]

    def blocks(self, words: list[bytes]) -> Iterator[tuple[Template, int, int, float]]:
        """Template, first word, words and containment of each matching block; overlapping blocks of a notice count as one."""
        have = set(words)
        hit = self.any_prefix & have
        for k in sorted({k for w in hit for k in self.of_prefix[w]}):
            template, order = self.wanted[k], self.ordered[k]
            common = [w for w in order if w in have]
            # Length filter, then the positional filter for the whole text: its rarest common token bounds any block's overlap.
            if len(common) < template.least or 1 + min(len(order) - self.place[k][common[0]] - 1, len(common) - 1) < template.least:
                continue
            yield from self._windows(k, words, set(common))

    def _windows(self, k: int, words: list[bytes], common: set[bytes]) -> Iterator[tuple[Template, int, int, float]]:
        template, size, place, prefix = self.wanted[k], len(self.ordered[k]), self.place[k], self.prefixes[k]
        span, least = template.span, template.least
        at = [i for i, w in enumerate(words) if w in common]
        anchors = [i for i in at if words[i] in prefix]
        counts: Counter[bytes] = Counter()
        lo = hi = a = 0
        merged: list[int | float] | None = None
        # A block can begin at a template token, for moving it there loses none; and must reach an anchor.
        while lo < len(at):
            start = at[lo]
            while a < len(anchors) and anchors[a] < start:
                a += 1
            if a == len(anchors):
                break
            while hi < len(at) and at[hi] < start + span:
                counts[words[at[hi]]] += 1
                hi += 1
            if anchors[a] < start + span and len(counts) >= least:
                rarest = min(map(place.__getitem__, counts))
                if 1 + min(size - rarest - 1, len(counts) - 1) >= least:
                    share = len(counts) / size
                    if template.phrase:
                        yield template, start, span, share
                    elif merged and start < merged[1]:
                        merged[1], merged[2] = start + span, max(merged[2], share)
                    else:
                        if merged:
                            yield template, merged[0], min(merged[1], len(words)) - merged[0], merged[2]
                        merged = [start, start + span, share]
            counts[words[start]] -= 1
            if not counts[words[start]]:
                del counts[words[start]]
            lo += 1
        if merged:
            yield template, merged[0], min(merged[1], len(words)) - merged[0], merged[2]

    def scan(self, text: str) -> tuple:
        words = words_of(text)
        starts, base, labels, best, found = [], set(), set(), 0.0, []
        for template, start, size, share in self.blocks(words):
            if template.phrase:
                if tuple(words[start : start + size]) != template.words:  # the words, but in another order
                    continue
                starts.append(start)
                base.add(template.label)
            labels.add(template.label)
            best = max(best, share)
            found.append({"label": template.label, "start": start, "words": size, "containment": share})
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best, found


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = BASE_PHRASES, notices: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: words, places and labels of the base phrases, all labels, the best containment and the matching blocks."""
    wanted = templates(phrases, notices, threshold)
    scanner = Scanner(wanted, token_frequencies(docs, {w for t in wanted for w in t.words}))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    kinds.append(pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("containment", pa.float64())])))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            columns = list(zip(*map(scanner.scan, texts)))
            yield pa.record_batch([part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
