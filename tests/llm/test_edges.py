"""Each operator and stage on nulls, empty and very long texts, repeated rows, clashing columns and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomery.llm import bpe, dartminhash, licenses, mixing, neardup, quality, rollups, sstable, toxicity

P = pytest.importorskip("public_tokenizers")
#: Names that the operators use inside.
CLASHING = ["digest", "bands", "node", "n_tokens", "p0", "rate", "_x", "_held", "_copy", "score", "labels", "ids", "start", "elements", "tail_probability", "own_0", "class_id"]


def test_a_cluster_has_to_name_its_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from loomery.llm._common import shared_dir

    session = lambda master, folder: SimpleNamespace(conf={"spark.checkpoint.dir": folder}, sparkContext=SimpleNamespace(master=master))
    assert shared_dir(session("spark://x:7077", "/shared/a/")) == "/shared/a" and shared_dir(session("local[4]", None))
    with pytest.raises(ValueError):
        shared_dir(session("spark://x:7077", None))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three four five six", "en", "a", 1), (1, "one two three four five six", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "no id", "en", "b", 5), (4, "word " * 40_000, "en", "a", 200_000), (5, "ok " + "x" * 100_000, "en", "b", 9)]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return base.select("*", *[F.lit("c").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, 1, 0), (5, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").withColumn("score", F.lit(1))


def run(name, docs, labels):
    if name == "quality":
        return quality.rate_documents(docs, quality.learn_ratings(docs, labels))
    if name == "licenses":
        return licenses.scan_licenses(docs)
    if name == "shards":
        return sstable.token_shards(docs, P.path("word_bpe_49k.json"))
    if name == "mixing":
        return mixing.rates(docs, mixing.domain_of(labels), [0.8, 0.1, 0.1])
    if name == "bpe":
        return bpe.round_trip(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    if name == "toxicity":
        return toxicity.score_documents(docs, toxicity.learn_labels(docs, labels))
    return neardup.classes(docs)


@pytest.mark.parametrize("name", ["quality", "licenses", "shards", "mixing", "bpe", "toxicity", "neardup"])
def test_one_row_for_each_row(spark, docs, labels, name):
    out = run(name, docs, labels).collect()
    assert sorted((r.doc_id for r in out), key=str) == sorted([1, 1, 2, 3, None, 4, 5], key=str)
    assert run(name, docs.limit(0), labels).count() == 0
    assert run(name, docs.limit(0), labels.limit(0)).count() == 0


def test_rollups_of_odd_rows(spark, docs):
    counts = rollups.latest(rollups.counted(docs, P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    store = rollups.RollupStore(spark)
    assert store.commit("a", rollups.events(counts, "words", "insert", "word_bpe"))
    out = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in store.totals().collect()}
    assert out.keys() == {("a", "en"), (None, None), ("b", "en")} and out["a", "en"] == (3, 6 + 40_000) and out[None, None] == (1, 0)
    assert store.commit("b", rollups.events(counts.limit(0), "words", "insert", "word_bpe"))


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES) - 1))
def test_stages_keep_columns_and_take_empty_tables(spark, docs, labels, tmp_path, k):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.count() > 0
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_very_long_texts():
    long = "The mit license " + "lorem ipsum dolor " * 60_000 + "MIT License"
    wanted = licenses.templates(licenses.BASE_PHRASES, licenses.TEMPLATES, licenses.THRESHOLD)
    found = licenses.Scanner(wanted, {}).scan(long)
    assert found[0] == 180_005 and found[1:4] == (2, 1, 180_003)
    assert b"".join(toxicity.windows_of(long)) == long.lower().encode()
    assert abs(float((quality.features(long)[:-1] ** 2).sum()) - quality.SCALE**2) < 0.1
    owner, hashes, weights = dartminhash.elements([dartminhash.normal(long)])
    assert weights.sum() == 180_001 and len(hashes) < 20
    assert (dartminhash.signatures(owner, hashes, weights, 1, 64) != dartminhash.NO_DART).all()
    own = bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert own.decode(np.frombuffer(own.encode([long])[0], "<u4")) == long.encode()
