"""The corpus operators as queries over whole tables, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm import bpe, collision, licenses, mixing, mtree, neardup, quality, rollups, sstable, toxicity
from loomery.llm._common import materialize, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.rate_documents(docs, quality.learn_ratings(docs, quality.graded(table(spark, sf_dir, "labels")), "grade"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("blocks")


def op3_token_sstables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_shards(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op4_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over all documents, two of them sent again: the counts of two tokenizers inserted, repeated texts deleted, one tokenizer's counts revised to hold the end id."""
    import public_tokenizers

    counts = rollups.counted(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    counts = materialize(rollups.latest(counts), "counts")
    copies = materialize(rollups.repeated(counts), "repeated")
    rest = counts.join(copies.select("doc_id"), "doc_id", "left_anti")
    batches = [
        ("0001-word_bpe", rollups.events(counts, "word_bpe_49k", "insert", "word_bpe")),
        ("0002-byte_bpe", rollups.events(counts, "byte_bpe_50k", "insert", "byte_bpe")),
        ("0003-delete-copies", rollups.events(copies, "word_bpe_49k", "delete").union(rollups.events(copies, "byte_bpe_50k", "delete"))),
        ("0004-revise-word_bpe", rollups.events(rest, "word_bpe_49k", "revise", F.col("word_bpe") + 1)),
    ]
    store = rollups.RollupStore(spark)
    for name, batch in [*batches, batches[1], batches[3]]:
        store.commit(name, batch)
    return store.totals()


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), mixing.domain_of(table(spark, sf_dir, "labels")), [0.85, 0.1, 0.05])


def op6_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return collision.nearest(rows, collision.every(rows, 20))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return mtree.top_products(rows, collision.every(rows, 20))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.learn_labels(docs, table(spark, sf_dir, "labels")))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": license_sql(), "op8_mtree_topk": MTREE_SQL, "op10_dart_minhash": NEARDUP_SQL}


#: Whole texts as words: ASCII capitals become small, all ASCII but letters and digits parts words.
WORDS_SQL = r"""
words AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents
)"""


def license_sql() -> str:
    """Every window of every template, by a join of the template words' places with themselves."""
    wanted = licenses.templates(licenses.BASE_PHRASES, licenses.TEMPLATES, licenses.THRESHOLD)
    heads = ", ".join(f"({i}, '{t.label}', {t.phrase}, {t.span}, {t.least}, {len(set(t.words))}, '{b' '.join(t.words).decode()}')" for i, t in enumerate(wanted))
    each = ", ".join(f"({i}, '{w.decode()}')" for i, t in enumerate(wanted) for w in sorted(set(t.words)))
    return f"""
WITH {WORDS_SQL},
t(tid, label, phrase, span, least, size, said) AS (VALUES {heads}),
tw(tid, word) AS (VALUES {each}),
places AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM words),
hits AS MATERIALIZED (SELECT doc_id, tid, pos, word FROM places JOIN tw USING (word)),
blocks AS (
    SELECT a.doc_id, a.tid, a.pos, count(DISTINCT b.word) AS n
    FROM hits a JOIN t USING (tid) JOIN hits b ON b.doc_id = a.doc_id AND b.tid = a.tid AND b.pos >= a.pos AND b.pos < a.pos + t.span
    GROUP BY a.doc_id, a.tid, a.pos, t.least HAVING count(DISTINCT b.word) >= t.least
),
found AS (
    SELECT doc_id, pos, label, phrase, n / size AS share FROM blocks JOIN t USING (tid) JOIN words USING (doc_id)
    WHERE NOT phrase OR array_to_string(ws[pos + 1:pos + span], ' ') = said
),
per AS (
    SELECT doc_id, count_if(phrase)::BIGINT AS n_base, min(pos) FILTER (phrase) AS first_word, max(pos) FILTER (phrase) AS last_word,
        coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
    FROM found GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM words w LEFT JOIN per USING (doc_id)
"""


NEARDUP_SQL = f"""
WITH RECURSIVE {WORDS_SQL},
s AS MATERIALIZED (
    SELECT doc_id, array_to_string(ws, ' ') AS plain, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(len(ws) - 4), lambda i: array_to_string(ws[i + 1:i + 5], ' ')) END AS shingles FROM words
),
c AS MATERIALIZED (SELECT doc_id, shingle, count(*) AS n FROM (SELECT doc_id, unnest(shingles) AS shingle FROM s) GROUP BY ALL),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS shared FROM c a JOIN c b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
    SELECT a, b FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE shared >= 0.8 * (len(x.shingles) + len(y.shingles) - shared) - 1e-9
    UNION SELECT x.doc_id, y.doc_id FROM s x JOIN s y ON x.plain = y.plain AND x.doc_id <> y.doc_id
),
reach(node, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT s.doc_id, class_id, copies, s.doc_id = class_id AS kept
FROM s JOIN (SELECT node, min(other) AS class_id FROM reach GROUP BY node) ON node = s.doc_id JOIN (SELECT plain, count(*) AS copies FROM s GROUP BY plain) p ON p.plain = s.plain
"""

MTREE_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
