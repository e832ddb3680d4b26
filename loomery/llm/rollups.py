"""Token counts by source, language and tokenizer version, kept by signed deltas in committed batches.

A store is a folder with a log and a folder per batch. A batch brings events per document and tokenizer version: insert or
revise with a count, or delete. It is turned into signed deltas of documents and tokens (an insert adds, a delete takes away
what the ledger holds, a revision takes away the old and adds the new), written with its ledger entries to a folder of its
own, and committed by moving a log entry onto the next free number. Of two writers one gets the number; the other one reads
what was committed and works its batch out anew. A batch whose name is already committed changes nothing, so a repeated or
retried batch is counted once, and a batch that failed half-way leaves only a folder that no log entry names. Totals are sums
of deltas; no total is ever read and rewritten, and no text is read again. compact() commits the ledger's latest entries and
the totals as one batch, at which later reads begin.

Cases: an insert of a document that is there counts as its revision; a delete or a revision of one that isn't there is a
no-op or an insert; of several events of a batch for one document and version the largest `seq` counts (ties: a delete, then
the larger count, source and language); events without doc_id, tokenizer or, unless deletes, count are ignored; a null source
or language is a group of its own; empty texts count as documents with no tokens; an empty batch commits and changes nothing;
of repeated ids in documents the row of most tokens counts (then bytes, digest, source, language); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import bpe, sstable
from loomery.llm._common import fresh_dir, join_groups, slices

LEDGER = "doc_id long, tokenizer string, source string, lang string, n_tokens long, present boolean, batch_no long"
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
COUNTS = "doc_id long, source string, lang string, word_bpe long, byte_bpe long, bytes long, digest binary"


class RollupStore:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or fresh_dir(spark, "rollups")
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(self._path(self.path)).toUri(), conf)
        self._text = jvm.org.apache.commons.io.IOUtils
        self._known: dict[str, tuple[str, str, bool]] = {}  # log entries never change

    def _log(self) -> list[tuple[str, str, bool]]:
        """Of each committed batch its name, its folder and whether it sums up all before it."""
        if not self._fs.exists(self._path(f"{self.path}/log")):
            return []
        numbers = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/log")))
        for number in numbers:
            if number not in self._known:
                stream = self._fs.open(self._path(f"{self.path}/log/{number}"))
                folder, whole, name = self._text.toString(stream, "UTF-8").split("\n", 2)
                stream.close()
                self._known[number] = (name, folder, whole == "whole")
        return [self._known[number] for number in numbers]

    def _publish(self, number: int, name: str, folder: str, whole: bool) -> bool:
        """Commit a written batch as this number; false if another one has it."""
        entry = self._path(f"{self.path}/batches/{folder}/entry")
        stream = self._fs.create(entry, True)
        stream.write(f"{folder}\n{'whole' if whole else 'part'}\n{name}".encode())
        stream.close()
        self._fs.mkdirs(self._path(f"{self.path}/log"))
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # a move that never replaces, unlike that of FileSystem
            self._files.rename(entry, self._path(f"{self.path}/log/{number:010d}"), options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            self._fs.delete(self._path(f"{self.path}/batches/{folder}"), True)
            return False
        return True

    def batches(self) -> list[str]:
        """Names of the committed batches, in their order."""
        return [name for name, _, whole in self._log() if not whole]

    def _read(self, part: str, schema: str, log: list[tuple[str, str, bool]]) -> DataFrame:
        start = max((i for i, (_, _, whole) in enumerate(log) if whole), default=0)
        found = [f"{self.path}/batches/{folder}/{part}" for _, folder, _ in log[start:]]
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def ledger(self, log: list[tuple[str, str, bool]] | None = None) -> DataFrame:
        """The latest entry of each document and version, deleted ones too."""
        entry = F.max(F.struct("batch_no", "source", "lang", "n_tokens", "present")).alias("e")
        rows = self._read("ledger", LEDGER, self._log() if log is None else log).groupBy("doc_id", "tokenizer").agg(entry)
        return rows.select("doc_id", "tokenizer", "e.source", "e.lang", "e.n_tokens", "e.present", "e.batch_no")

    def commit(self, name: str, events: DataFrame) -> bool:
        """Apply a batch of events (doc_id, source, lang, tokenizer, op, n_tokens, seq) once; false if it was there already."""
        while True:
            log = self._log()
            if name in {n for n, _, whole in log if not whole}:
                return False
            folder = uuid.uuid4().hex
            self._write(folder, log, events)
            if self._publish(len(log), name, folder, whole=False):
                return True

    def compact(self) -> bool:
        """Sum all batches up in one, at which reads begin from then on; false if another batch came between."""
        log, folder = self._log(), uuid.uuid4().hex
        self.ledger(log).write.parquet(f"{self.path}/batches/{folder}/ledger")
        self._totals(log).write.parquet(f"{self.path}/batches/{folder}/deltas")
        return self._publish(len(log), "", folder, whole=True)

    def _write(self, folder: str, log: list[tuple[str, str, bool]], events: DataFrame) -> None:
        usable = F.col("doc_id").isNotNull() & F.col("tokenizer").isNotNull() & ((F.col("op") == "delete") | F.col("n_tokens").isNotNull())
        order = F.struct("seq", F.when(F.col("op") == "delete", 1).otherwise(0).alias("deletes"), "n_tokens", "source", "lang")
        last = events.where(usable).groupBy("doc_id", "tokenizer").agg(F.max(order).alias("e"))
        last = last.select("doc_id", "tokenizer", "e.source", "e.lang", "e.n_tokens", (F.col("e.deletes") == 0).alias("present"))
        old = self.ledger(log).where("present").select("doc_id", "tokenizer", *[F.col(c).alias(f"old_{c}") for c in ("source", "lang", "n_tokens")], F.lit(True).alias("was"))
        both = last.join(old, ["doc_id", "tokenizer"], "left")
        entries = both.where("present OR was").select(
            "doc_id", "tokenizer", F.when(F.col("present"), F.col("source")).otherwise(F.col("old_source")).alias("source"),
            F.when(F.col("present"), F.col("lang")).otherwise(F.col("old_lang")).alias("lang"), "n_tokens", "present", F.lit(len(log)).cast("long").alias("batch_no"),
            F.when(F.col("was"), F.struct("old_source", "old_lang", "old_n_tokens")).alias("old"),
        )
        place = f"{self.path}/batches/{folder}"
        entries.write.parquet(f"{place}/entries")
        entries = self.spark.read.schema(entries.schema).parquet(f"{place}/entries")
        plus = F.struct("source", "lang", F.lit(1).cast("long").alias("n_docs"), "n_tokens")
        minus = F.struct(F.col("old.old_source").alias("source"), F.col("old.old_lang").alias("lang"), F.lit(-1).cast("long").alias("n_docs"), (-F.col("old.old_n_tokens")).alias("n_tokens"))
        none = F.lit(None).cast("struct<source:string,lang:string,n_docs:bigint,n_tokens:bigint>")
        signed = entries.select("tokenizer", F.explode(F.array(F.when(F.col("present"), plus).otherwise(none), F.when(F.col("old").isNotNull(), minus).otherwise(none))).alias("d")).where("d IS NOT NULL")
        deltas = signed.groupBy("d.source", "d.lang", "tokenizer").agg(F.sum("d.n_docs").alias("n_docs"), F.sum("d.n_tokens").alias("n_tokens"))
        entries.drop("old").write.parquet(f"{place}/ledger")
        deltas.write.parquet(f"{place}/deltas")
        self._fs.delete(self._path(f"{place}/entries"), True)

    def _totals(self, log: list[tuple[str, str, bool]]) -> DataFrame:
        sums = self._read("deltas", DELTAS, log).groupBy("source", "lang", "tokenizer").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups that have no documents any more are left out."""
        return self._totals(self._log())


def counted(docs: DataFrame, word_path: str, byte_path: str, pattern: str) -> DataFrame:
    """Per document row with an id: the tokens of the whole text under each of the two encoders, its bytes and its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = sstable.encoder(word_path), bpe.codec(byte_path, pattern)
        for part, texts in slices(batches):
            by_words = [len(ids) // words.id_bytes - 1 for ids in words.encode(texts)]  # without the end id
            by_pairs = [len(ids) // 4 for ids in pairs.encode(texts)]
            raw = [t.encode() for t in texts]
            columns = [pa.array(x, pa.int64()) for x in (by_words, by_pairs, [len(r) for r in raw])]
            digests = pa.array([hashlib.md5(r).digest() for r in raw], pa.binary())
            yield pa.record_batch([*(part.column(i) for i in range(3)), *columns, digests], ["doc_id", "source", "lang", "word_bpe", "byte_bpe", "bytes", "digest"])

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(run, COUNTS)


def events(counts: DataFrame, tokenizer: str, op: str, count=None) -> DataFrame:
    """Events of all rows; count: a column or its name."""
    value = F.lit(None).cast("long") if count is None else F.col(count) if isinstance(count, str) else count
    return counts.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(op).alias("op"), value.alias("n_tokens"), F.lit(0).alias("seq"))


def repeated(counts: DataFrame) -> DataFrame:
    """The rows whose text a smaller id has, too. counts: already written."""
    first = counts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    return join_groups(counts, first, "digest", "copies", counts.count()).where("doc_id > first").drop("first", "copies")


def latest(counts: DataFrame) -> DataFrame:
    """One row per id: of repeated ids, the one of most tokens, then bytes, digest, source and language."""
    rest = [c for c in counts.columns if c != "doc_id"]
    order = [c for c in ("word_bpe", "bytes", "digest", "source", "lang") if c in rest]
    return counts.groupBy("doc_id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select("doc_id", "r.*")
