"""Near-duplicate classes: DartMinHash signatures, banded joining, exact verification, connected components.

Two documents are linked if the weighted Jaccard similarity of their word shingles (five words, weighted by occurrence) is
THRESHOLD or more; classes are the connected components of the links, and a class's id is its smallest document id. Links
are sought among documents that agree in all rows of one of the bands, which a pair at similarity 0.8 does with probability
0.9995; every link is then verified on the whole sets of shingles. Steps:

1. One pass over the texts gives a digest of the normal form, the band keys and the total weight. Documents of equal digest
   are one node, the smallest id standing for it.
2. Each bucket of a band has its smallest node for a hub; node and hub are verified. This is linear in the bucket.
3. Buckets in which the links so far leave more than one component are compared completely, in chunks of CHUNK nodes, each
   pair of chunks a task's group of its own. Sets of shingles meet as a matrix product; what leaves a group are links that
   join components, fewer than it has nodes, never all pairs. No bucket is capped.
4. Components come from repeated least-label steps with pointer jumping, each written to the shared folder.

Cases: null and empty texts, and texts without words, are equal to each other and to nothing else; texts under five words are
one shingle; repeated rows and exact copies share a class; texts of one id are one document; a null id has no class, and its
document is kept; ties go to the smallest id, and of several rows of one id the one of the smallest text is kept; other columns are kept by drop_near_duplicates() and ignored by classes(); an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm import dartminhash
from loomery.llm._common import HEAVY, join_groups, materialize, slices

BANDS, ROWS = 25, 6
THRESHOLD = 0.8
#: Nodes of a chunk of a bucket; a group holds two chunks.
CHUNK = 256
#: Ids that may be broadcast (8 bytes each); beyond, the same join shuffles.
BROADCAST_IDS = 1_000_000


def _band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, which also depends on the band's number."""
    keys = np.broadcast_to(dartminhash.mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(signatures), BANDS)).copy()
    for j in range(ROWS):
        keys = dartminhash.mix(keys * np.uint64(0x9E3779B97F4A7C15) + signatures[:, j::ROWS])
    return keys.view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the normal form, total weight n, and the band keys (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            plain = [dartminhash.normal(t) for t in texts]
            owner, hashes, weights = dartminhash.elements(plain)
            keys = _band_keys(dartminhash.signatures(owner, hashes, weights, len(plain), BANDS * ROWS))
            total = np.bincount(owner, weights, minlength=len(plain)).astype(np.int64)
            digests = pa.array([hashlib.md5(p).digest() for p in plain], pa.binary())
            offsets = np.concatenate([[0], np.cumsum(np.where(total > 0, BANDS, 0))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[total > 0].ravel()))
            yield pa.record_batch([part.column(0), digests, pa.array(total), bands], ["doc_id", "digest", "n", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, n long, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the ascending 64-bit hashes of its shingles, a shingle of weight w standing w times under different hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            owner, hashes, weights = dartminhash.elements([dartminhash.normal(t) for t in texts])
            layer = np.arange(weights.sum()) - np.repeat(np.cumsum(weights) - weights, weights)
            owner, layered = np.repeat(owner, weights), dartminhash.mix(np.repeat(hashes, weights) * np.uint64(0xD6E8FEB86659FD93) + layer.astype(np.uint64))
            order = np.lexsort((layered, owner))
            layered, cuts = layered[order], np.searchsorted(owner, np.arange(len(texts) + 1))
            sets = [layered[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.record_batch([part.column(0), pa.array(sets, pa.binary())], ["node", "elements"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, elements binary")


def with_ids(docs: DataFrame, ids: DataFrame, how: str, column: str = "doc_id") -> DataFrame:
    """A semi or anti join by id; ids, already written, are broadcast only if few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, column, how)


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return shared >= THRESHOLD * (len(a) + len(b) - shared) - 1e-9


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose sets of shingles are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            a, b, left, right = (batch.column(i) for i in range(4))
            keep = []
            for i in range(batch.num_rows):
                if a[i].as_py() != last:
                    last, known = a[i].as_py(), np.frombuffer(left[i].as_py(), np.uint64)
                keep.append(_similar(known, np.frombuffer(right[i].as_py(), np.uint64)))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([a.filter(mask), b.filter(mask)], ["a", "b"])

    # A hub's set goes once to each CHUNK of its members, so that no task has all of them. Hubs of over a HEAVY-th of the pairs are few.
    pairs = materialize(pairs, "pairs")
    hot = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"), F.count("*").alias("n")).where(F.col("n") > max(CHUNK, pairs.count() // HEAVY))
    hot = F.broadcast(materialize(hot.select("a", "parts"), "hubs"))
    dealt = pairs.join(hot, "a", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    hubs = sets.toDF("a", "left").join(hot, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    both = dealt.join(sets.toDF("b", "right"), "b").join(hubs, ["a", "part"])
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and its component's smallest node, for every node of the edges a, b."""
    edges = edges.where("a <> b")
    both = materialize(edges.union(edges.select("b", "a")).toDF("node", "other").distinct(), "edges")
    labels = materialize(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels")
    while True:
        reached = both.join(labels.toDF("other", "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        stepped = labels.join(reached, "node").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        stepped = materialize(stepped, "labels-step")
        jump = stepped.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        labels = materialize(stepped.join(jump, "label", "left").select("node", "before", F.least("label", "beyond").alias("label")), "labels")
        changed = labels.where("label <> before").limit(1).count()
        labels = labels.select("node", "label")
        if not changed:
            return labels


class _Forest:
    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _links(labels: list[int], sides: list[int], sets: list[np.ndarray], across: bool) -> list[tuple[int, int]]:
    """Pairs of labels that a link between members of the group joins; `across`: only pairs from both sides count."""
    sizes = np.array([len(s) for s in sets])
    flat, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.zeros((len(sets), len(sets)), np.float32)
    # Columns in strips, so that the matrix stays small.
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    strip = max(1, 4_000_000 // len(sets))
    for lo in range(0, len(flat), strip):
        a, b = np.searchsorted(column, [lo, lo + strip])
        present = np.zeros((len(sets), min(strip, len(flat) - lo)), np.float32)
        present[row[a:b], column[a:b] - lo] = 1
        shared += present @ present.T
    similar = shared >= THRESHOLD * (sizes[:, None] + sizes[None, :] - shared) - 1e-6
    label, side = np.array(labels), np.array(sides)
    similar &= label[:, None] != label[None, :]
    if across:
        similar &= side[:, None] != side[None, :]
    forest = _Forest()
    return [(labels[i], labels[j]) for i, j in np.argwhere(np.triu(similar)).tolist() if forest.join(labels[i], labels[j])]


def _compare_buckets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links a, b between labels. rows: key, node, label, members; a bucket's chunks meet in pairs, each in a group."""
    chunks = F.ceil(F.col("members") / CHUNK).cast("int")
    dealt = rows.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.join(sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "label", "elements")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = dealt.repartition(tasks, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members = None, []

        def done() -> list[tuple[int, int]]:
            labels, sides, sets = (list(x) for x in zip(*members))
            return _links(labels, sides, sets, group[1] != group[2]) if len(set(labels)) > 1 else []

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            found = []
            keys, los, his, sides, labels = (batch.column(i).to_pylist() for i in range(5))
            for i, mine in enumerate(zip(keys, los, his)):
                if mine != group:
                    if members:
                        found += done()
                    group, members = mine, []
                members.append((labels[i], sides[i], np.frombuffer(batch.column(5)[i].as_py(), np.uint64)))
            yield batch_of(found)
        if members:
            yield batch_of(done())

    return grouped.mapInArrow(run, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """Per document row: doc_id, class_id (the smallest id of its class), copies (rows of the same normal text), kept (doc_id = class_id)."""
    signed = materialize(sign(docs), "signed")
    nodes = materialize(signed.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "nodes")
    met = join_groups(signed, nodes, "digest", "copies", signed.count(), "left")
    members = materialize(met.withColumn("bands", F.when(F.col("doc_id") == F.col("node"), F.col("bands"))).drop("digest"), "members")

    banded = members.where("bands IS NOT NULL").select("node", "n", F.explode("bands").alias("key")).distinct()
    buckets = banded.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    inside = materialize(banded.join(buckets, "key"), "buckets")
    sizes = F.least("n", "hub.n") >= THRESHOLD * F.greatest("n", "hub.n") - 1e-9
    stars = inside.where("node <> hub.node").where(sizes).select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
    wanted = materialize(inside.select(F.col("node").alias("doc_id")).distinct(), "candidates")
    sets = materialize(shingle_sets(with_ids(docs, wanted, "left_semi")), "shingles")

    first = components(_verify(stars, sets))
    labelled = inside.join(first, "node", "left").select("key", "node", "members", F.coalesce("label", "node").alias("label"))
    # Buckets with more than one component, each set of members once.
    alike = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    mixed = labelled.groupBy("key", "members").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), *alike).where("lo <> hi")
    mixed = mixed.groupBy("members", "x", "y").agg(F.min("key").alias("key")).select("key")
    second = components(_compare_buckets(labelled.join(mixed, "key"), sets))
    final = first.join(second.toDF("label", "final"), "label", "left").select("node", F.coalesce("final", "label").alias("class_id"))
    alone = second.toDF("node", "class_id").join(first.select("node"), "node", "left_anti")  # nodes that only the second step linked
    found = final.unionByName(alone)

    out = members.join(found, "node", "left").select("doc_id", F.coalesce("class_id", "node").alias("class_id"), F.when(F.col("doc_id").isNotNull(), F.col("copies")).alias("copies"))
    out = out.withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents, all columns: of each class the document of smallest id, once."""
    found = materialize(classes(docs), "classes")
    dropped = materialize(found.where("NOT kept").select("doc_id").distinct(), "dropped")
    kept = with_ids(docs, dropped, "left_anti")
    repeated = materialize(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    # Of several rows of an id the one of the smallest text, then of the smallest other columns; an aggregation, as an id may have many.
    own = with_ids(kept, repeated, "left_semi").select("doc_id", F.struct("*").alias("row"), F.struct("text", F.to_json(F.struct("*"))).alias("order"))
    return with_ids(kept, repeated, "left_anti").unionByName(own.groupBy("doc_id").agg(F.min_by("row", "order").alias("row")).select("row.*"))
