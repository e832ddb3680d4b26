"""The pipeline on the smallest tables, stage by stage."""

import corpus_pipeline
from loomery.llm import mixing, quality, queries, toxicity


def test_stages_follow_each_other(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        docs = spark.createDataFrame(out.toPandas(), out.schema)
    assert docs.count() > 0 and {"doc_id", "ids_sha256"} <= set(docs.columns)


def test_registered_names():
    names = set(queries.queries())
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 11))
    assert set(queries.oracle_sql()) <= names


def test_fits_give_the_drivers_memory_back(spark, small, monkeypatch):
    """Up to 5,000 whole texts of a fit mustn't stay with the driver through the stages that follow."""
    docs, labels = (spark.read.parquet(f"{small}/{name}.parquet") for name in ("documents", "labels"))
    fits = {
        toxicity: lambda: toxicity.learn_labels(docs, labels),
        quality: lambda: quality.learn_ratings(docs, quality.graded(labels), "grade"),
        mixing: lambda: mixing.learn_domains(docs, mixing.domain_of(labels)),
    }
    for module, fit in fits.items():
        given = []
        monkeypatch.setattr(module, "release", lambda: given.append(1))
        assert fit() is not None and given, module.__name__
