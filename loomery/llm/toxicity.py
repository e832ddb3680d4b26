"""Toxicity by compression distance: two zstandard dictionaries, windows of the text, calibrated thresholds.

Fit, on the driver, over a bounded sample of labelled texts (MAX_TOXIC, MAX_ORDINARY rows, the smallest by a hash of the id):

1. An ordinary dictionary is trained on windows of ordinary texts.
2. A toxic dictionary holds words of toxic texts, language by language (`lang`, where the table has it), so that a language
   with few rows has its own share. The evidence of a run of GRAM characters is the lower bound (SIGMAS standard errors of
   smoothed estimates) of how much more common it is in toxic than in ordinary texts of the language, the smaller one of
   counts of texts and of contexts (the word and the one before it; these keep words of much copied texts out). The words
   that cover most evidence go in first, until none is left or TOXIC_BYTES are full. The rule is the same at every size.
3. The ordinary compressor has the ordinary dictionary as its content; the toxic one has the toxic dictionary before the
   same content, so that a window that shares nothing with toxic text compresses to the same length with both.
4. On texts that took no part in 1 and 2, a logistic curve is fitted to the gains (ordinary length less toxic length) of
   all windows together and to the number of windows, which raises the threshold for long texts; both as logarithms.

Scoring compresses every window of the whole text with both compressors.

Cases: a null or empty text has one empty window and so no gain; null ids are kept (held_out is then false); labels that are
null take no part and of conflicting labels of an id the larger counts; without toxic or without ordinary labels every score
is the share of toxic labels (0 without labels); repeated rows give repeated results; other columns than lang are ignored, and
a null lang is a language of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm._common import bounded_labels, release, slices

#: Bounds of the labelled sample.
MAX_TOXIC, MAX_ORDINARY = 2000, 3000
#: Bytes of a window; characters of a run; standard errors by which evidence is lowered.
WINDOW, GRAM, SIGMAS = 64, 5, 3.0
#: TOXIC_BYTES: for each language.
ORDINARY_BYTES, TOXIC_BYTES = 16384, 1024
LEVEL, MIN_MATCH = 7, 3
MARKS = ".,;:!?\"'()[]{}*#$%&|"
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, gain long, n_windows long"


def windows_of(text: str) -> list[bytes]:
    """The whole text in windows of at most WINDOW bytes, cut at blanks where the second half has one."""
    data = text.lower().encode()
    size, out, at = len(data), [], 0
    while at < size:
        end = at + WINDOW
        if end < size:
            cut = data.rfind(b" ", at + WINDOW // 2, end)
            end = cut if cut > 0 else end
        out.append(data[at:end])
        at = end
    return out or [b""]


def compressor(content: bytes):
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, min_match=MIN_MATCH, window_log=17, write_content_size=False, write_dict_id=False, write_checksum=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters).compress


def trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary's content; of samples too few to train on, their own last bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _words(text: str) -> list[str]:
    return [f" {w} " for x in text.lower().split() if (w := x.strip(MARKS))]


def _runs(word: str) -> set[str]:
    return {word[i : i + GRAM] for i in range(len(word) - GRAM + 1)}


def _counts(texts: list[str]) -> tuple[tuple[Counter, int], tuple[Counter, int]]:
    """Texts that hold each run of characters, and all; different contexts of each run, and of all words."""
    seen: set[int] = set()
    in_texts: Counter[str] = Counter()
    in_contexts: Counter[str] = Counter()
    for text in texts:
        before, held = "", set()
        for word in _words(text):
            key = hash((before, word))
            before = word
            runs = _runs(word)
            held |= runs
            if key not in seen:
                seen.add(key)
                in_contexts.update(runs)
        in_texts.update(held)
    return (in_texts, len(texts)), (in_contexts, len(seen))


def _excess(k: int, n: int, o: int, m: int) -> float:
    """The lower bound of the log of how many times k of n is as common as o of m."""
    spread = 1 / (k + 0.5) + 1 / (o + 0.5) - 1 / (n + 1) - 1 / (m + 1)
    return math.log((k + 0.5) / (n + 1)) - math.log((o + 0.5) / (m + 1)) - SIGMAS * math.sqrt(max(0.0, spread))


def toxic_words(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Words of toxic texts of a language, those first that cover most evidence a byte, up to TOXIC_BYTES."""
    both = list(zip(_counts(toxic), _counts(ordinary)))
    evidence = {g: k * e for g, k in both[1][0][0].items() if (e := min(_excess(x[g], n, y[g], m) for (x, n), (y, m) in both)) > 0}
    runs = {w: sorted(r) for text in toxic for w in _words(text) if (r := _runs(w) & evidence.keys())}
    worth = lambda w: sum(evidence[g] for g in runs[w]) / len(w.encode())
    heap = [(-worth(w), w) for w in runs]
    heapq.heapify(heap)
    out, size = [], 0
    while heap and size < TOXIC_BYTES:
        _, word = heapq.heappop(heap)
        now = worth(word)
        if heap and now < -heap[0][0]:  # what other words cover counts no more
            if now > 0:
                heapq.heappush(heap, (-now, word))
            continue
        if now > 0:
            out.append(word.encode())
            size += len(out[-1])
            evidence.update(dict.fromkeys(runs[word], 0.0))
    return out


def toxic_content(toxic: list[tuple[str, str]], ordinary: list[tuple[str, str]]) -> bytes:
    """The words of all languages in turn, the best ones last, where a compressor reaches them at least cost. Rows: language, text."""
    languages = sorted({x for x, _ in toxic})
    lists = [toxic_words([t for x, t in toxic if x == name], [t for x, t in ordinary if x == name]) for name in languages]
    ranked = [words[i] for i in range(max(map(len, lists), default=0)) for words in lists if i < len(words)]
    return b"".join(reversed(ranked))


@dataclass
class ToxicityModel:
    """Plain data, so that it travels to the workers; compressors are built there."""

    ordinary: bytes
    toxic: bytes
    weights: list[float]  # of 1, ln(1 + gains together), ln(1 + windows)
    prior: float = 0.0

    def start(self) -> None:
        self.by_ordinary, self.by_toxic = compressor(self.ordinary), compressor(self.toxic + self.ordinary)

    def measure(self, text: str) -> tuple[int, int]:
        """The gains of all windows that have one together, and the number of windows."""
        by_ordinary, by_toxic = self.by_ordinary, self.by_toxic
        windows = windows_of(text)
        return sum([max(0, len(by_ordinary(w)) - len(by_toxic(w))) for w in windows]), len(windows)

    def probability(self, gain: int, n_windows: int) -> float:
        z = self.weights[0] + self.weights[1] * math.log1p(gain) + self.weights[2] * math.log1p(n_windows)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's method, with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1]), x.T @ (w * (y - p)) - 1e-2 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(texts: list[str], labels: list[int], prior: float, languages: list[str] | None = None) -> ToxicityModel:
    """texts in any order; every fourth of each class calibrates. prior: the share of toxic among all labels."""
    rows = list(zip(languages or [""] * len(texts), texts))
    toxic, ordinary = [r for r, y in zip(rows, labels) if y], [r for r, y in zip(rows, labels) if not y]
    if len(toxic) < 4 or len(ordinary) < 4:
        return ToxicityModel(b"", b"", [], prior)
    learn = lambda x: [t for i, t in enumerate(x) if i % 4]
    windows = [w for _, t in learn(ordinary) for w in windows_of(t)]
    model = ToxicityModel(trained(ORDINARY_BYTES, windows), toxic_content(learn(toxic), learn(ordinary)), [], prior)
    model.start()
    held = [(t, 1) for _, t in toxic[::4]] + [(t, 0) for _, t in ordinary[::4]]
    measured = [model.measure(t) for t, _ in held]
    x = np.array([[1, math.log1p(g), math.log1p(n)] for g, n in measured], float)
    y = np.array([v for _, v in held], float)
    weight = np.where(y == 1, prior / len(toxic[::4]), (1 - prior) / len(ordinary[::4])) * len(y)
    model.weights = _logistic(x, y, weight).tolist()
    return ToxicityModel(model.ordinary, model.toxic, model.weights, prior)


def fold(column: str = "doc_id"):
    """crc32 of the id as text, mod 5; 0 is held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def learn_labels(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on labelled rows outside the held-out fold."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold() != 0))
    n, n_toxic = rows.agg(F.count("*"), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0))).first()
    chosen = bounded_labels(rows, MAX_TOXIC, ["toxic"], F.col("toxic") > 0).union(bounded_labels(rows, MAX_ORDINARY, ["toxic"], F.col("toxic") <= 0))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # at most MAX_TOXIC + MAX_ORDINARY rows
    language = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    texts = docs.select("doc_id", F.struct(F.coalesce("text", F.lit("")).alias("text"), language.alias("lang")).alias("row")).join(F.broadcast(chosen), "doc_id")
    sample = texts.groupBy("doc_id").agg(F.min("row").alias("row"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id")).collect()
    model = fit([r.row.text for r in sample], [int(r.toxic > 0) for r in sample], (n_toxic or 0) / n if n else 0.0, [r.row.lang for r in sample])
    del sample
    release()
    return model


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Per document the score, and 1 where it is 0.5 or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.weights:
            model.start()
        for part, texts in slices(batches):
            measured = [model.measure(t) if model.weights else (0, 0) for t in texts]
            scores = [model.probability(*m) if model.weights else model.prior for m in measured]
            columns = [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            columns += [pa.array(c, pa.int64()) for c in zip(*measured)]
            yield pa.record_batch([part.column(0), part.column(1), *columns], ["doc_id", "held_out", "score", "predicted", "gain", "n_windows"])

    held_out = F.coalesce(fold() == 0, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held_out, "text").mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents, all columns, that the model doesn't call toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.weights:
            model.start()
        for part, texts in slices(batches):
            keep = [(model.probability(*model.measure(t)) if model.weights else model.prior) < 0.5 for t in texts]
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
