"""Sorted-string-table shards of token ids: documents by identifier, for lookup by binary search.

A shard holds documents in ascending order of their key. Layout, all integers little-endian:

    magic "LSST0001"
    blocks     zstandard frames; inside, per document: varint shared key bytes, varint other key bytes, varint number of
               ids, the other key bytes, the ids (unsigned, 2 or 4 bytes each)
    index      per block: 9 bytes first key, u64 offset, u32 stored bytes, u32 documents, u64 ids
    filter     Bloom filter over the keys, bits in bytes
    footer     u64 index offset, u32 blocks, u64 filter offset, u64 filter bytes, u32 hashes, u64 documents, u64 ids,
               u8 bytes of an id, magic "LSST0001"

A key is 9 bytes that sort as the identifiers do: a null identifier first, then by value. Texts are encoded where they are
read, their ids are dealt by ranges of the identifier (and a hash, for repeated ones) and sorted, so the shards in order of their tasks hold the whole table in order. A shard is written under a
name of its attempt and then renamed, so that a repeated task leaves one whole file.

Cases: a null text counts as empty and has just the end id; a null identifier is stored (first) and can be looked up;
repeated identifiers and repeated rows are all stored, in the order of a hash of their ids, and a lookup returns each; an
empty table writes no shard and returns no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm._common import fresh_dir, materialize, slices

MAGIC = b"LSST0001"
FOOTER = struct.Struct("<QIQQIQQB8s")
INDEX = struct.Struct("<9sQIIQ")
#: Raw bytes after which a block ends, and stored bytes after which a shard ends.
BLOCK_BYTES, SHARD_BYTES = 256 << 10, 64 << 20
#: Bloom filter: about 1 false positive in 100.
BITS_PER_KEY, HASHES = 10, 7
#: Entries of a worker's cache of encoded words; beyond it the cache starts anew.
CACHE_ENTRIES = 600_000
#: Marks that are a pretoken of their own behind letters.
PLAIN_MARKS = frozenset(".,;:!?")
#: The first character behind Latin letters.
LATIN_END = "\u0250"
END_ID = 1
#: How byte-level pre-tokenizers write bytes as letters: printable ones as themselves, the others from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
PROBES = ["word", "Token", "stra\u00dfe", "\u00c9t\u00e9", "ma\u00f1ana", "na\u00efve", "aaaaaaaa", "\u00fcber\u00e4\u00f6\u00ff\u00b5\u00aa"]
MANIFEST = "task long, shard long, path string, n_docs long, n_tokens long, n_bytes long"


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + 2**63)


def doc_id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - 2**63 if key[0] else None


def _varint(x: int) -> bytes:
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        b = data[at]
        x |= (b & 127) << shift
        at += 1
        if b < 128:
            return x, at
        shift += 7


def _bits(key: bytes, size: int, hashes: int) -> list[int]:
    """Positions of a key in a filter of `size` bits: double hashing."""
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + i * b) % size for i in range(hashes)]


class ShardWriter:
    """Takes documents in key order; close() writes the index, the filter and the footer, and moves the file into place."""

    def __init__(self, fs: pafs.FileSystem, path: str, attempt: str, id_bytes: int):
        self.fs, self.path, self.id_bytes = fs, path, id_bytes
        self.temporary = f"{path}.{attempt}"
        self.out = fs.open_output_stream(self.temporary)
        self.out.write(MAGIC)
        self.offset = len(MAGIC)
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.n_tokens = 0
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self._begin()

    def _begin(self) -> None:
        self.block, self.first, self.last, self.docs, self.ids = bytearray(), b"", b"", 0, 0

    def add(self, key: bytes, ids: bytes) -> None:
        shared = len(os.path.commonprefix([self.last, key])) if self.docs else 0
        n = len(ids) // self.id_bytes
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(n) + key[shared:] + ids
        self.first, self.last = self.first or key, key
        self.docs, self.ids = self.docs + 1, self.ids + n
        self.n_tokens += n
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.docs:
            stored = self.pack(bytes(self.block))
            self.index.append(INDEX.pack(self.first, self.offset, len(stored), self.docs, self.ids))
            self.out.write(stored)
            self.offset += len(stored)
            self._begin()

    def close(self) -> tuple[int, int, int]:
        """Documents, ids and bytes of the shard."""
        self._flush()
        size = max(64, BITS_PER_KEY * len(self.keys) + 7 & ~7)
        bits = np.zeros(size, np.uint8)
        for key in self.keys:
            bits[_bits(key, size, HASHES)] = 1
        packed, index = np.packbits(bits).tobytes(), b"".join(self.index)
        at = self.offset
        footer = FOOTER.pack(at, len(self.index), at + len(index), len(packed), HASHES, len(self.keys), self.n_tokens, self.id_bytes, MAGIC)
        self.out.write(index + packed + footer)
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return len(self.keys), self.n_tokens, at + len(index) + len(packed) + len(footer)


class ShardReader:
    """Opens a shard by its footer; get() looks a document up, scan() goes through all."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - FOOTER.size)
        at, blocks, filter_at, filter_bytes, self.hashes, self.n_docs, self.n_tokens, self.id_bytes, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard of this format")
        self.file.seek(at)
        index = self.file.read(blocks * INDEX.size)
        self.blocks = [INDEX.unpack_from(index, k * INDEX.size) for k in range(blocks)]
        self.file.seek(filter_at)
        self.filter = self.file.read(filter_bytes)
        self.unpack = zstandard.ZstdDecompressor().decompress

    def may_hold(self, key: bytes) -> bool:
        return all(self.filter[i >> 3] & 128 >> (i & 7) for i in _bits(key, 8 * len(self.filter), self.hashes))

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, stored, docs, _ = self.blocks[k]
        self.file.seek(offset)
        data, at, key = self.unpack(self.file.read(stored)), 0, b""
        for _ in range(docs):
            shared, at = _read_varint(data, at)
            other, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + other]
            at += other
            yield key, data[at : at + n * self.id_bytes]
            at += n * self.id_bytes

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document with this identifier; usually one."""
        key = key_of(doc_id)
        if not self.may_hold(key):
            return []
        lo, hi = 0, len(self.blocks)
        while lo < hi:  # the first block that begins at or behind the key; the key may also stand at the end of the one before
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.blocks[mid][0] < key else (lo, mid)
        found = []
        for k in range(max(0, lo - 1), len(self.blocks)):
            if self.blocks[k][0] > key:
                break
            found += [np.frombuffer(ids, f"<u{self.id_bytes}") for other, ids in self.block(k) if other == key]
        return found


class WordEncoder:
    """A tokenizers file whose pre-tokenizer never crosses a blank or a line end; each different run between them is encoded once for a worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The library looks for added tokens in the whole text; texts that hold how one begins are left to it.
        self.starts = sorted({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.id_bytes = 2 if self.tokenizer.get_vocab_size() <= 2**16 else 4
        self.pack = lambda ids: array("H" if self.id_bytes == 2 else "I", ids).tobytes()  # little-endian machines only
        self.known: dict[str, bytes] = {}
        # A word of Latin letters passes the normalizer as its small letters and the pre-tokenizer whole; then the library's
        # model can take it directly. PROBES show whether this file is of that kind.
        self.model = self.tokenizer.model
        self.direct = all(self.merged(p) == self.tokenizer.encode(p, add_special_tokens=False).ids for p in PROBES)

    def merged(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.lower().encode().decode("latin-1").translate(BYTE_LETTERS))]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_ENTRIES:
            self.known = {}
        whole = {i: self.pack(self.tokenizer.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts) if any(s in t for s in self.starts)}
        parts = [[] if i in whole else t.replace("\n", " ").split(" ") for i, t in enumerate(texts)]
        new: set[str] = set()
        for p in parts:
            new.update(p)
        self.learn(new.difference(self.known))
        known, end = self.known, END_ID.to_bytes(self.id_bytes, "little")
        return [(whole[i] if i in whole else b"".join([known[c] for c in p])) + end for i, p in enumerate(parts)]

    def learn(self, new: set[str]) -> None:
        """Latin letters with one plain mark behind them are two pretokens if their small forms are letters, too."""
        known, pack, tokenize, direct = self.known, self.pack, self.model.tokenize, self.direct
        rest, marked = [], []
        for c in new:
            if c[-1:] in PLAIN_MARKS and (word := c[:-1]).isalpha() and (word.isascii() or (max(word) < LATIN_END and word.lower().isalpha())):
                marked.append(c)
                c = word
                if c in known or c in new:
                    continue
            if direct and c.isascii() and c.isalpha():
                known[c] = pack([t.id for t in tokenize(c.lower())])
            elif direct and c.isalpha() and max(c) < "\u0100":
                known[c] = pack(self.merged(c))
            else:
                rest.append(c)
        rest += [m for m in PLAIN_MARKS if m not in known]
        known.update(zip(rest, [pack(e.ids) for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]))
        for c in marked:
            known[c] = known[c[:-1]] + known[c[-1]]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (as in the shards, with the end id) and id_bytes, written to the shared folder: what is sorted later are ids, not texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for part, texts in slices(batches):
            yield pa.record_batch([part.column(0), pa.array(own.encode(texts), pa.binary()), pa.array([own.id_bytes] * len(texts), pa.int32())], ["doc_id", "ids", "id_bytes"])

    return materialize(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, id_bytes int"), "sst-ids")


def write_shards(encoded: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Sort and write all encoded documents; returns the manifest, one row per shard, in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        context = TaskContext.get()
        task, attempt, rows = context.partitionId(), str(context.taskAttemptId()), []
        writer = None

        def close() -> None:
            rows.append((task, len(rows), writer.path, *writer.close()))

        for batch in batches:
            for doc_id, ids, id_bytes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                ids = ids.as_buffer()
                if writer is None:
                    writer = ShardWriter(fs, f"{root}/{task:06d}-{len(rows):04d}.sst", attempt, id_bytes)
                writer.add(key_of(doc_id), ids)
                if writer.offset + len(writer.block) >= shard_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        names = ["task", "shard", "path", "n_docs", "n_tokens", "n_bytes"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names)

    # The hash parts ranges inside an identifier that many rows have, too.
    order = [F.col("doc_id"), F.xxhash64("ids")]
    return materialize(encoded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, MANIFEST), "sst-manifest")


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Per stored document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard."""
    before = Window.orderBy("task", "shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))  # a row per shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = ShardReader(fs, path)
                for k in range(len(reader.blocks)):
                    keys, starts, counts, sums = [], [], [], []
                    for key, raw in reader.block(k):
                        ids = np.frombuffer(raw, f"<u{reader.id_bytes}").astype("<u4")
                        keys.append(doc_id_of(key))
                        starts.append(start)
                        counts.append(len(ids))
                        sums.append(zlib.crc32(ids))
                        start += len(ids)
                    columns = [pa.array(x, pa.int64()) for x in (keys, starts, counts, sums)]
                    yield pa.record_batch([*columns, pa.array([os.path.basename(path)] * len(keys))], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    tasks = max(8, manifest.sparkSession.sparkContext.defaultParallelism)
    dealt = placed.select("path", "base").repartition(tasks, "path")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def lookup(manifest_paths: list[str], folder: str, doc_id: int | None) -> list[np.ndarray]:
    """The ids of a document from whichever shards hold it; filters spare the blocks of the others."""
    fs, _ = file_system(folder)
    return [ids for path in manifest_paths for ids in ShardReader(fs, path).get(doc_id)]


def token_shards(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Write the documents as shards in the shared folder and read them back."""
    folder = folder or fresh_dir(docs.sparkSession, "sst")
    return read_shards(write_shards(encode_documents(docs, tokenizer_path), folder), folder)
