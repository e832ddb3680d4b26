"""BPE against tiktoken, shards against the tokenizers library, and rollups against recounting."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomery.llm import bpe, rollups, sstable

P = pytest.importorskip("public_tokenizers")
ALPHABET = " \n\tab'sé\x1c\x85 日1$😀Z.,"
EDGE = ["", None, "  a  b", " x", "x ", "a\n b", "don't we'll  \n\n 've", "é" * 300, "a" * 5000, "ab " * 1000, "日本語 テキスト", " " * 3000, "A\tB  C", "same", "same"]


def texts(n=300, seed=1):
    rng = random.Random(seed)
    return EDGE + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts())] + [(None, "no id", "x")], "doc_id long, text string, ids string")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken_and_round_trips(spark, docs, reference):
    path = P.path("byte_bpe_50k.tiktoken")
    got = {r.doc_id: r for r in bpe.round_trip(docs, path, P.PATTERN).collect()}
    for i, t in enumerate(texts()):
        ids = np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()
        assert got[i].n_tokens == len(ids) // 4
        assert got[i].ids_sha256 == hashlib.sha256(ids).hexdigest(), t
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert got[i].exact
    assert None in got
    encoded = bpe.encode_documents(docs, path, P.PATTERN)
    decoded = {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode_documents(encoded, path, P.PATTERN).collect()}
    assert all(decoded[i] == (t or "") for i, t in enumerate(texts()))
    assert bpe.round_trip(docs.limit(0), path, P.PATTERN).collect() == []


def one_by_one(ranks, piece):
    """The merges as defined: each time the leftmost pair of the lowest rank."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return np.array([ranks[p] for p in parts], "<u4").tobytes()
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_bpe_rounds_equal_one_merge_at_a_time(monkeypatch):
    path = P.path("byte_bpe_50k.tiktoken")
    own, ranks = bpe.ByteBPE(path, P.PATTERN), bpe.load_ranks(path)
    rng = random.Random(4)
    pieces = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))).encode() for alphabet in ("abcdeéz", "ab", "aab", "etaoinshr", " .-=") for _ in range(80)]
    pieces += [b"a" * n for n in range(1, 70)] + [b"ab" * n for n in range(1, 40)] + [b"-" * 900]
    assert own.merge_matrix(pieces) == [one_by_one(ranks, p) for p in pieces]
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 5)  # a cache that starts anew changes nothing
    assert own.encode(["a b c", "d e f"]) == own.encode(["a b c", "d e f"])


def test_bpe_of_long_pretokens(reference):
    own = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = random.Random(5)
    for long in ("x" * 60_000, "ab" * 20_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "aaab" * 5_000, "é" * 10_000):
        assert np.frombuffer(own.encode([long])[0], "<u4").tolist() == reference.encode_ordinary(long)


def test_bpe_cache_ends_with_its_task(spark, docs):
    """Workers stay for the tasks that follow, which may encode nothing."""
    path = P.path("byte_bpe_50k.tiktoken")
    assert bpe.round_trip(docs, path, P.PATTERN).where("n_tokens > 0").count() > 0
    assert bpe.encode_documents(docs, path, P.PATTERN).where("length(ids) > 0").count() > 0

    def held(batches):
        for batch in batches:
            kept = sum(len(c.of_cut) + len(c.of_piece) for c in bpe._codecs.values())
            yield pa.record_batch([pa.array([kept])], ["kept"])

    assert {r.kept for r in spark.range(0, 64, 1, 8).mapInArrow(held, "kept long").collect()} == {0}


def test_word_encoder_equals_the_library():
    """Added tokens in any case and place, letters whose small form is longer, combining marks, and every plain mark."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    own, library = sstable.WordEncoder(path), Tokenizer.from_file(path)
    rng = random.Random(6)
    alphabet = [*"abdeest  ..,;:!?12\n\t'éÉİßſΣµªǅ中", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", "\u0301", "\u0307", "\u200d", "\x1c", "\x85", "\u3000", "ʼn", "don't ", "ing", " the"]
    texts = ["x<|endoftext|>y", " İ;", "İ", "İ.", "e\u0301.", "<|startoftext|>", "<|endoftext|"] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(6000)]
    for text, raw in zip(texts, own.encode(texts)):
        assert np.frombuffer(raw, "<u2").tolist() == [*library.encode(text, add_special_tokens=False).ids, 1], text


def test_shards_round_trip_and_lookup(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    manifest = sstable.write_shards(sstable.encode_documents(docs, path), str(tmp_path), shard_bytes=2000)
    rows = sstable.read_shards(manifest, str(tmp_path)).orderBy("start").collect()
    assert len(rows) == docs.count() and manifest.count() > 1
    start = 0
    assert [r.doc_id for r in rows] == [None, *range(len(texts()))]
    for r in rows:
        ids = library.encode("no id" if r.doc_id is None else texts()[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    paths = [r.path for r in manifest.collect()]
    assert sstable.lookup(paths, str(tmp_path), 12)[0].tolist() == library.encode(texts()[12], add_special_tokens=False).ids + [1]
    assert len(sstable.lookup(paths, str(tmp_path), None)) == 1
    assert sstable.lookup(paths, str(tmp_path), 10**9) == [] and sstable.lookup(paths, str(tmp_path), -5) == []


def test_shards_of_repeated_ids_and_none(spark, tmp_path):
    path = P.path("word_bpe_49k.json")
    twice = spark.createDataFrame([(7, "one"), (7, "two two"), (7, "one"), (3, None)], "doc_id long, text string")
    manifest = sstable.write_shards(sstable.encode_documents(twice, path), str(tmp_path))
    assert sorted(len(x) for x in sstable.lookup([r.path for r in manifest.collect()], str(tmp_path), 7)) == [2, 2, 3]
    assert sstable.token_shards(twice.limit(0), path).collect() == []


def test_shard_keys_sort_as_ids():
    ids = [None, -(2**63), -5, -1, 0, 1, 2**40, 2**63 - 1]
    keys = [sstable.key_of(i) for i in ids]
    assert keys == sorted(keys) and [sstable.doc_id_of(k) for k in keys] == ids


def events(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, tokenizer string, op string, n_tokens long, seq int")


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def test_rollups_follow_inserts_revisions_and_deletes(spark, tmp_path):
    store = rollups.RollupStore(spark, f"file://{tmp_path}/store")
    assert totals(store) == {}
    first = events(spark, [(1, "a", "en", "t1", "insert", 10, 0), (2, "a", "en", "t1", "insert", 5, 0), (3, None, "en", "t1", "insert", 0, 0), (None, "a", "en", "t1", "insert", 9, 0), (4, "a", "en", None, "insert", 9, 0)])
    assert store.commit("b1", first)
    assert totals(store) == {("a", "en", "t1"): (2, 15), (None, "en", "t1"): (1, 0)}
    assert not store.commit("b1", first) and totals(store)[("a", "en", "t1")] == (2, 15)
    second = events(spark, [(1, "b", "en", "t1", "revise", 7, 0), (2, "x", "x", "t1", "delete", None, 0), (9, "a", "en", "t1", "delete", None, 0), (5, "a", "fr", "t2", "insert", 1, 0), (5, "a", "fr", "t2", "revise", 4, 1)])
    assert store.commit("b2", second)
    assert totals(store) == {("b", "en", "t1"): (1, 7), (None, "en", "t1"): (1, 0), ("a", "fr", "t2"): (1, 4)}
    assert store.commit("b3", events(spark, [(2, "a", "en", "t1", "insert", 5, 0)]))  # deleted ones may come back
    assert totals(store)[("a", "en", "t1")] == (1, 5)
    assert store.commit("b4", events(spark, [])) and store.batches() == ["b1", "b2", "b3", "b4"]


def test_rollups_ignore_unfinished_batches(spark, tmp_path):
    store = rollups.RollupStore(spark, f"file://{tmp_path}/store")
    store.commit("b1", events(spark, [(1, "a", "en", "t", "insert", 10, 0)]))
    events(spark, [(2, "a", "en", "t", "insert", 10, 0)]).write.parquet(f"file://{tmp_path}/store/batches/x/deltas")
    assert totals(store) == {("a", "en", "t"): (1, 10)}


def test_rollups_of_two_writers(spark, tmp_path, monkeypatch):
    """Another writer commits between reading and committing: the batch is worked out anew, and none is lost or counted twice."""
    one, two = (rollups.RollupStore(spark, f"file://{tmp_path}/store") for _ in range(2))
    first, second = events(spark, [(1, "a", "en", "t", "insert", 10, 0)]), events(spark, [(1, "b", "en", "t", "insert", 7, 0)])
    publish, between = one._publish, iter([lambda: two.commit("theirs", second), lambda: two.commit("ours", first), lambda: None, lambda: None])

    def late(*args, **named):
        next(between)()
        return publish(*args, **named)

    monkeypatch.setattr(one, "_publish", late)
    assert not one.commit("ours", first)  # first theirs came between, then another one's batch of the same name
    assert two.batches() == ["theirs", "ours"] and totals(one) == totals(two) == {("a", "en", "t"): (1, 10)}
    assert one.commit("third", events(spark, [(2, "a", "en", "t", "insert", 1, 0)]))
    assert one.batches() == ["theirs", "ours", "third"] and totals(two) == {("a", "en", "t"): (2, 11)}


def test_rollups_after_compaction(spark, tmp_path):
    store = rollups.RollupStore(spark, f"file://{tmp_path}/store")
    store.commit("b1", events(spark, [(1, "a", "en", "t", "insert", 10, 0), (2, "a", "en", "t", "insert", 5, 0)]))
    store.commit("b2", events(spark, [(2, "a", "en", "t", "delete", None, 0)]))
    assert store.compact() and totals(store) == {("a", "en", "t"): (1, 10)}
    assert not store.commit("b1", events(spark, [(3, "a", "en", "t", "insert", 10, 0)]))
    assert store.commit("b3", events(spark, [(1, "b", "en", "t", "revise", 4, 0), (2, "a", "fr", "t", "insert", 3, 0)]))
    assert totals(store) == {("b", "en", "t"): (1, 4), ("a", "fr", "t"): (1, 3)} and store.batches() == ["b1", "b2", "b3"]


def test_rollups_count_what_the_encoders_write(spark, small):
    """The registered query against SQL over the counts that op3 and op7 return."""
    duckdb = pytest.importorskip("duckdb")
    from loomery.llm import queries

    words = queries.op3_token_sstables(spark, small).select("doc_id", "n_tokens").toPandas()  # noqa: F841
    pairs = queries.op7_byte_bpe(spark, small).select("doc_id", "n_tokens").toPandas()  # noqa: F841
    base = f"SELECT doc_id, source, lang, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) > 1 AS is_copy FROM '{small}/documents.parquet'"
    each = "SELECT source, lang, '{0}' AS tokenizer, count(*) AS n_docs, sum(n_tokens) AS n_tokens FROM d JOIN {1} USING (doc_id) WHERE NOT is_copy GROUP BY ALL"
    want = duckdb.sql(f"WITH d AS ({base}) {each.format('word_bpe_49k', 'words')} UNION ALL {each.format('byte_bpe_50k', 'pairs')}").fetchall()
    got = [tuple(r) for r in queries.op4_token_rollups(spark, small).select("source", "lang", "tokenizer", "n_docs", "n_tokens").collect()]
    assert sorted(got, key=str) == sorted(((a, b, c, int(d), int(e)) for a, b, c, d, e in want), key=str) and len(got) > 10


def test_repeated_texts_by_hot_and_other_digests(spark, monkeypatch):
    from loomery.llm import _common

    rows = [(i, bytes([i % 3 if i < 60 else i])) for i in range(100)]
    counts = spark.createDataFrame(rows, "doc_id long, digest binary")
    for heavy in (1, 4, 10_000):  # no, some and all groups are hot
        monkeypatch.setattr(_common, "HEAVY", heavy)
        assert sorted(r.doc_id for r in rollups.repeated(counts).collect()) == list(range(3, 60))


def test_latest_row_of_an_id(spark):
    rows = [(1, "b", "en", 5, 5, 9, b"x"), (1, "a", "en", 5, 5, 9, b"x"), (1, "z", "en", 4, 9, 9, b"y"), (2, None, None, 0, 0, 0, b"")]
    counts = spark.createDataFrame(rows, rollups.COUNTS)
    assert [(r.doc_id, r.source) for r in rollups.latest(counts).orderBy("doc_id").collect()] == [(1, "b"), (2, None)]


def test_rollups_equal_recounting(spark):
    rng = random.Random(2)
    store, now = rollups.RollupStore(spark), {}
    for b in range(4):
        batch = {}
        for _ in range(60):
            d, t = rng.randint(0, 30), rng.choice("uv")
            batch[d, t] = (rng.choice("ab"), rng.choice(["en", None]), rng.choice(["insert", "revise", "delete"]), rng.randint(0, 99))
        store.commit(f"b{b}", events(spark, [(d, s, g, t, op, n, 0) for (d, t), (s, g, op, n) in batch.items()]))
        for key, (s, g, op, n) in batch.items():
            if op == "delete":
                now.pop(key, None)
            else:
                now[key] = (s, g, n)
    want = {}
    for (_, t), (s, g, n) in now.items():
        a, b = want.get((s, g, t), (0, 0))
        want[s, g, t] = (a + 1, b + n)
    assert totals(store) == want
