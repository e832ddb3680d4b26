"""Byte-level BPE encoding and decoding over length-bucketed, padded numpy matrices.

Texts are cut where no pretoken can cross, each different pretoken is encoded once for a worker, and pretokens of like
length stand as rows of one matrix. In a round, each row merges its leftmost pair of minimum rank, and with it the further
places of the same pair that its next rounds would merge, up to one whose token makes a pair of lower rank with a neighbour;
so long rows take few rounds more than they have different ids. Pair ranks come from an open-addressing hash table in numpy
arrays; after a round the cells close up, and finished rows leave the matrix.

Cases: a null or empty text has no ids and decodes to no bytes; repeated rows give repeated results; any other columns are
ignored; an empty table gives an empty result. A pretoken longer than MATRIX_CELLS bytes is a matrix of its own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from loomery.llm._common import release, slices

#: Cells of a matrix of several rows, which bounds a worker's memory.
MATRIX_CELLS = 2_000_000
#: Entries of a worker's cache of encoded cuts; beyond it the cache starts anew.
CACHE_ENTRIES = 600_000
#: Marks that are a pretoken of their own behind letters.
PLAIN_MARKS = frozenset(".,;:!?")
NONE = np.int32(2**31 - 1)
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, exact boolean"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PairTable:
    """(left id, right id) -> id of their concatenation, by multiplicative hashing with linear probing."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        todo_k, todo_v = np.array(keys, np.int64), np.array(values, np.int32)
        at = self._slot(todo_k)
        while todo_k.size:
            free = self.keys[at] == -1
            slots, first = np.unique(at[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.keys[slots], self.values[slots] = todo_k[took], todo_v[took]
            left = np.ones(todo_k.size, bool)
            left[took] = False
            todo_k, todo_v, at = todo_k[left], todo_v[left], (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while open_.size:
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        ranks = load_ranks(path)
        self.pairs = PairTable(ranks)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # The class that the Rust engine means; this library's own \s may differ in some control characters.
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        # A blank next to any other white space, or at either end: such texts are not cut at blanks.
        self.uncut = regex.compile(r"[\p{White_Space}\x1c-\x1f] | [\p{White_Space}\x1c-\x1f]|^ | $", regex.V0).search
        top = max(ranks.values(), default=-1) + 1
        lengths = np.zeros(top, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        self.token_len, self.token_at = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat = bytearray(int(lengths.sum()))
        for token, rank in ranks.items():
            flat[self.token_at[rank] : self.token_at[rank] + len(token)] = token
        self.flat = np.frombuffer(bytes(flat), np.uint8)
        self.of_piece: dict[str, bytes] = {}
        self.of_cut: dict[str, bytes] = {}

    def merge_matrix(self, pieces: list[bytes]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(lengths, kind="stable")
        at = int(np.searchsorted(lengths[order], 1))
        while at < len(order):
            shortest = int(lengths[order[at]])
            widest = shortest + shortest // 4
            end = int(np.searchsorted(lengths[order], widest, "right"))
            end = min(end, at + max(1, MATRIX_CELLS // widest))
            self._bucket(pieces, order[at:end], lengths, out)
            at = end
        return out

    def _bucket(self, pieces: list[bytes], rows: np.ndarray, lengths: np.ndarray, out: list[bytes]) -> None:
        n, size = lengths[rows].copy(), int(lengths[rows].max())
        buffer = np.frombuffer(b"".join([pieces[i].ljust(size, b"\0") for i in rows]), np.uint8).reshape(len(rows), size)
        columns = np.arange(size)
        ids = np.where(columns < n[:, None], self.of_byte[buffer], np.int32(-1))
        ranks = np.full(ids.shape, NONE, np.int32)  # of the pair that begins in a cell
        if size > 1:
            inside = columns[1:] < n[:, None]
            ranks[:, :-1][inside] = self.pairs(ids[:, :-1][inside], ids[:, 1:][inside])
        while True:
            best = ranks.min(axis=1)
            done = best == NONE
            if done.any():
                flat, wide = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                for at, (row, used) in enumerate(zip(rows[done].tolist(), n[done].tolist())):
                    out[row] = flat[at * wide : at * wide + 4 * used]
                keep = ~done
                if not keep.any():
                    return
                rows, n, best, ids, ranks = rows[keep], n[keep], best[keep], ids[keep], ranks[keep]
            r, c = np.nonzero(ranks == best[:, None])
            if len(r) > len(n):
                r, c = self._in_turn(ids, best, n, r, c)
            ids[r, c] = best[r]
            # Compaction: close the gaps that the right parts leave.
            left = columns[: ids.shape[1]] < n[:, None]
            left[r, c + 1] = False
            n -= np.bincount(r, minlength=len(n))
            columns = columns[: int(n.max())]
            cells = columns < n[:, None]
            old_ids, old_ranks = ids[left], ranks[left]
            ids, ranks = np.full(cells.shape, -1, np.int32), np.full(cells.shape, NONE, np.int32)
            ids[cells], ranks[cells] = old_ids, old_ranks
            place = np.arange(len(r))
            c = c - (place - np.maximum.accumulate(np.where(np.append(True, r[1:] != r[:-1]), place, 0)))
            ranks[r, c] = NONE
            k = np.flatnonzero(c + 1 < n[r])
            ranks[r[k], c[k]] = self.pairs(ids[r[k], c[k]], ids[r[k], c[k] + 1])
            k = np.flatnonzero(c > 0)
            ranks[r[k], c[k] - 1] = self.pairs(ids[r[k], c[k] - 1], ids[r[k], c[k]])

    def _in_turn(self, ids: np.ndarray, best: np.ndarray, n: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all places of the rows' minimum rank those that are merged one after the other, before any other pair.

        Of places next to each other the left one takes the cell that both want. Behind a place whose token makes a pair of
        lower rank with a neighbour, that pair comes first; so the places behind it wait.
        """
        place, new_row = np.arange(len(r)), np.append(True, r[1:] != r[:-1])
        run = np.maximum.accumulate(np.where(new_row | np.append(True, c[1:] != c[:-1] + 1), place, 0))
        take = (place - run) % 2 == 0
        r, c = r[take], c[take]
        place, new_row, token = np.arange(len(r)), np.append(True, r[1:] != r[:-1]), best[r]
        lower = np.zeros(len(r), bool)
        k = np.flatnonzero(c > 0)
        touching = ~new_row & np.append(False, c[1:] == c[:-1] + 2)
        lower[k] = self.pairs(np.where(touching[k], token[k], ids[r[k], c[k] - 1]), token[k]) < token[k]
        k = np.flatnonzero(c + 2 < n[r])
        lower[k] |= self.pairs(token[k], ids[r[k], c[k] + 2]) < token[k]
        before = np.cumsum(lower) - lower
        go = before == np.maximum.accumulate(np.where(new_row, before, 0))
        return r[go], c[go]

    def pieces(self, cut: str, lead: str) -> list[str]:
        """The pretokens of lead + cut; the pattern decides, but for a word of letters with at most one plain mark behind it."""
        if cut.isalpha():
            return [lead + cut]
        if cut[-1:] in PLAIN_MARKS and cut[:-1].isalpha():
            return [lead + cut[:-1], cut[-1]]
        return self.find(lead + cut)

    def learn(self, cuts: set[str], lead: str) -> dict[str, bytes]:
        """The ids of lead + cut for each cut. Pretokens that begin with a blank are cached as the cut behind it."""
        found = {c: self.pieces(c, lead) for c in cuts}
        new = list({p for pieces in found.values() for p in pieces if p not in self.of_piece and (p[0] != " " or p[1:] not in self.of_cut)})
        for p, known in zip(new, self.merge_matrix([p.encode() for p in new])):
            if p[0] == " ":
                self.of_cut[p[1:]] = known
            else:
                self.of_piece[p] = known
        of_cut, of_piece = self.of_cut, self.of_piece
        return {c: b"".join([of_cut[p[1:]] if p[0] == " " else of_piece[p] for p in pieces]) for c, pieces in found.items()}

    def forget(self) -> None:
        self.of_cut, self.of_piece = {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.of_cut) + len(self.of_piece) > CACHE_ENTRIES:
            self.forget()
        parts = [[t] if self.uncut(t) else t.split(" ") for t in texts]
        rest: set[str] = set()
        for p in parts:
            rest.update(p[1:])
        self.of_cut.update(self.learn(rest.difference(self.of_cut), " "))
        start, cut = self.learn({p[0] for p in parts}, ""), self.of_cut
        return [start[p[0]] + b"".join([cut[c] for c in p[1:]]) for p in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        lengths = self.token_len[ids]
        ends = np.cumsum(lengths)
        if not len(ids) or not ends[-1]:
            return b""
        return self.flat[np.arange(ends[-1]) + np.repeat(self.token_at[ids] - ends + lengths, lengths)].tobytes()


_codecs: dict[tuple[str, str], ByteBPE] = {}


def codec(path: str, pattern: str) -> ByteBPE:
    """A worker's codec, built once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = ByteBPE(path, pattern)
    return _codecs[path, pattern]


@contextmanager
def task_codec(path: str, pattern: str) -> Iterator[ByteBPE]:
    """The worker's codec for one task, whose cache of texts ends with it: the worker goes on to tasks that encode nothing."""
    own = codec(path, pattern)
    try:
        yield own
    finally:
        own.forget()
        release()


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and `ids`, binary: the ids of the whole text as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_codec(path, pattern) as own:
            for part, texts in slices(batches):
                yield pa.record_batch([part.column(0), pa.array(own.encode(texts), pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and `bytes`, binary: what the ids of encode_documents() stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for k in range(batch.num_rows):
                raw = own.decode(np.frombuffer(batch.column(1)[k].as_py() or b"", "<u4"))
                yield pa.record_batch([batch.column(0).slice(k, 1), pa.array([raw], pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode each whole text in one pass; digests of both, the bytes, and whether they are the text's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_codec(path, pattern) as own:
            for part, texts in slices(batches):
                counts, ids_hex, raw_hex, sizes, exact = [], [], [], [], []
                for text, ids in zip(texts, own.encode(texts)):
                    raw = own.decode(np.frombuffer(ids, "<u4"))
                    counts.append(len(ids) // 4)
                    ids_hex.append(hashlib.sha256(ids).hexdigest())
                    raw_hex.append(hashlib.sha256(raw).hexdigest())
                    sizes.append(len(raw))
                    exact.append(raw == text.encode())
                yield pa.record_batch(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(raw_hex), pa.array(sizes, pa.int64()), pa.array(exact)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "exact"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
