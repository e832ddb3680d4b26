"""The four experts and the composites on hand-derived values."""

import pytest
from pyspark.sql import functions as F

from loomery.functions import text
from loomery.plans import matching
from loomery.sources import eav


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "local_id long, global_id long, confidence double, authority double")


def names(spark, pairs):
    return spark.createDataFrame([(i, 1, n) for i, n in pairs], "field_id long, source_id long, local_name string")


def close(a, b):
    return abs(a - b) < 5e-7


def test_affinity(spark):
    rows = spark.createDataFrame([(1, 10, 1.0, 0.5)] * 3 + [(2, 10, 1.0, 0.5), (3, 10, 1.0, -1.0), (2, 11, 0.5, 1.0)], "local_id long, global_id long, confidence double, authority double")
    got = {(r.local_id, r.global_id): r.affinity for r in matching.affinities(rows).collect()}
    assert got == {(1, 10): 1.0, (2, 10): 0.5, (3, 10): 0.0, (2, 11): 0.5}
    assert matching.max_affinities(rows).where("local_id = 2").count() == 2  # ties stay
    assert matching.training_mappings(rows).count() == 3


def test_qgrams_expert(spark, none):
    attributes = spark.createDataFrame([(1, "city"), (2, "cost")], "global_id long, name string")
    got = {(r.field_id, r.global_id): r.score for r in matching.qgrams_scores(names(spark, [(1, "city"), (2, "cost_usd")]), attributes, none).collect()}
    assert close(got[1, 1], 1.0) and close(got[1, 2], 0.0) and close(got[2, 2], 0.654654) and close(got[2, 1], 0.0)


def test_scopes_agree(spark, none):
    attributes = spark.createDataFrame([(1, "city name"), (2, "cost")], "global_id long, name string")
    fields = names(spark, [(1, "city"), (2, "cost_usd"), (3, "name")])
    mapped = spark.createDataFrame([(3, 1, 1.0, 1.0)], "local_id long, global_id long, confidence double, authority double")
    rows = lambda df: {(r.field_id, r.global_id): round(r.score, 9) for r in df.collect()}
    whole = rows(matching.qgrams_scores(fields, attributes, mapped))
    assert rows(matching.qgrams_scores(fields, attributes, mapped, scope=F.col("field_id") == 2)) == {k: v for k, v in whole.items() if k[0] == 2}
    assert rows(matching.qgrams_scores(fields, attributes, mapped, unmapped=mapped)) == {k: v for k, v in whole.items() if k[0] != 3}
    assert all(-1e-9 <= v <= 1 + 1e-9 for v in whole.values())


def test_mdl_expert(spark, none):
    cells = spark.createDataFrame([(1, i, v) for i, v in enumerate(["ma"] * 3 + ["ny"] + ["texas"] * 2)], "field_id long, entity_id long, value string")
    dictionary = spark.createDataFrame([(7, "ma"), (7, "ny"), (7, "ohio")], "global_id long, value string")
    row = matching.mdl_scores(cells, dictionary, names(spark, [(1, "state")]), none).first()
    assert close(row.score, 0.579021)
    assert matching.mdl_scores(cells, dictionary, names(spark, [(1, "state")]), none, by_length=True).first().score > row.score - 1


def test_ngrams_expert_finds_its_own_values(spark, none):
    cells = spark.createDataFrame([(1, 1, "red fox"), (1, 2, "red hen"), (2, 1, "iron bolt")], "field_id long, entity_id long, value string")
    dictionary = spark.createDataFrame([(7, "red fox hen"), (8, "iron steel")], "global_id long, value string")
    attributes = spark.createDataFrame([(7, "animal"), (8, "metal")], "global_id long, name string")
    for tokens in (text.word_tokens, text.stemmed_tokens):
        got = {(r.field_id, r.global_id): r.score for r in matching.ngrams_scores(cells, dictionary, names(spark, [(1, "a"), (2, "b")]), attributes, none, tokens=tokens).collect()}
        assert set(got) == {(1, 7), (2, 8)} and got[1, 7] > 0.9 and got[2, 8] > 0.5


def test_dist_expert(spark):
    rows = [(1, i, float(i % 7)) for i in range(70)] + [(2, i, float(i % 7) + 0.1) for i in range(70)] + [(3, i, 1000.0 + i) for i in range(70)] + [(4, 1, 5.0)]
    cells = spark.createDataFrame(rows, "field_id long, entity_id long, value double")
    mapped = spark.createDataFrame([(1, 9, 1.0, 0.5), (3, 8, 1.0, 1.0)], "local_id long, global_id long, confidence double, authority double")
    fields = names(spark, [(1, "a"), (2, "b"), (3, "c"), (4, "d")])
    got = {(r.field_id, r.global_id): r.score for r in matching.dist_scores(cells, fields, mapped).collect()}
    assert close(got[1, 9], 0.5) and 0.3 < got[2, 9] < 0.5 and close(got[3, 8], 1.0) and (4, 9) not in got
    plan = matching.dist_scores(cells, fields, mapped)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2  # once, and the adaptive plan prints it twice at most


def test_composites(spark):
    scores = spark.createDataFrame([(1, 1, 5, "qgrams", 0.5), (1, 1, 5, "mdl", 1.0), (1, 1, 6, "mdl", 0.2), (1, 1, 6, "ngrams", 0.9), (1, 1, 5, "val_qgrams", 3.0)], "source_id long, field_id long, global_id long, method string, score double")
    methods = matching.default_methods(spark)
    n = {r.global_id: r.score for r in matching.ncomp(scores, methods).collect()}
    assert close(n[5], 1.25) and close(n[6], 0.85)
    m = {r.global_id: r.score for r in matching.mcomp(scores, methods).collect()}
    assert m == {5: 3.0, 6: 1.0}
    assert {r.global_id: r.score for r in matching.mcomp(scores, methods, only_active=True).collect()} == {5: 2.0, 6: 1.0}
    assert matching.ncomp_max(scores, methods).first().global_id == 5 and matching.mcomp_max(scores, methods).first().global_id == 5
    wide = {r.global_id: r for r in matching.pair_features(scores).collect()}
    assert wide[6].ngrams == 0.9 and wide[6].dist == 0.0


def test_evaluation_and_tree(spark):
    chosen = spark.createDataFrame([("q", 1, 5), ("q", 2, 6), ("q", 3, 7), ("m", 1, 9)], "method string, field_id long, global_id long")
    truth = spark.createDataFrame([(1, 5), (2, 5)], "field_id long, global_id long")
    got = {r.method: r for r in matching.error_rates(chosen, truth, ["method"]).collect()}
    assert (got["q"].n_right, got["q"].n_wrong, got["q"].n_unknown, got["q"].ratio) == (1, 1, 1, 1.0)
    judged = spark.createDataFrame([(True, True)] * 3 + [(True, False)] + [(False, True)] * 2 + [(False, False)], "a boolean, t boolean")
    r = matching.precision_recall(judged, F.col("a"), F.col("t")).first()
    assert (r.precision, r.recall) == (0.75, 0.6) and close(r.f1, 2 / 3)
    points = spark.createDataFrame([(i, 1, i / 10, 0.0, 0.0, 0.0, float(i > 5)) for i in range(10)], "field_id long, global_id long, qgrams double, mdl double, ngrams double, dist double, label double")
    assert {r.field_id for r in matching.decision_tree(points, points).where("accepted").collect()} == {6, 7, 8, 9}


def test_factoring(spark):
    fields = names(spark, [(1, "customerCityName"), (2, "zip")])
    mapped = spark.createDataFrame([(1, 5, 1.0, 1.0), (2, 5, 1.0, 1.0)], "local_id long, global_id long, confidence double, authority double")
    synonyms = spark.createDataFrame([(5, "city"), (5, "town")], "global_id long, synonym string")
    thesaurus = spark.createDataFrame([("CUSTOMER", "client")], "token string, term string")
    out = matching.factor_names(fields, mapped, synonyms, thesaurus)
    assert [r.leftover for r in out["leftovers"].collect()] == ["customerName"]
    assert [(r.part, r.term) for r in out["gems"].collect()] == [("customer", "client")]


def test_import(spark):
    wide = spark.createDataFrame([(1, "x", "a", None), (2, "y", "", "b")], "id int, src string, c1 string, c2 string")
    out = eav.import_wide(wide, "t", "id", "src")
    assert {(r.source, r.entity, r.field, r.value) for r in out["cells"].collect()} == {("t/x", "1", "c1", "a"), ("t/y", "2", "c2", "b")}
    assert out["sources"].count() == 2 and out["fields"].count() == 4
    numbered = eav.import_wide(wide.select("c1", "c2"), "t")
    assert {r.entity for r in numbered["entities"].collect()} == {"1", "2"} and numbered["sources"].first().source == "t/0"
    for bad in ({"entity_key": "nope"}, {"entity_key": "id", "source_key": "id"}):
        with pytest.raises(ValueError):
            eav.import_wide(wide, "t", **bad)
    raw = spark.createDataFrame([(1, 1, "n", "v" * 1300), (1, 1, "m", "ok"), (1, 2, "m", None), (2, 1, "m", "x")], "source_id long, entity_id long, name string, value string")
    parts = eav.raw_source(raw, 1)
    assert parts["cells"].count() == 1 and parts["entities"].count() == 2
    attributes = eav.global_schema(spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "n string"), "n")
    assert [(r.id, r.name) for r in attributes.orderBy("id").collect()] == [(1, "a"), (2, "b")]
    words = spark.createDataFrame([("A", "x")], "a string, b string")
    assert eav.import_auxiliary("attdict", words, ["b"], attributes, "b").first().att_id == 2
    assert eav.import_auxiliary("syndict", words, ["a", "b"], attributes, "a").first().value_b == "x"
    assert eav.import_auxiliary("template", words, ["a"], attributes, "tpl").first().att_id == 1
    with pytest.raises(ValueError):
        eav.import_auxiliary("other", words, ["a"], attributes)
    words.createOrReplaceTempView("some_words")
    assert eav.table_exists(spark, "some_words") and eav.view_exists(spark, "some_words") and not eav.table_exists(spark, "no_words")
    assert eav.table_attributes(spark, "some_words") == ["a", "b"] and "some_words" in eav.schema_tables(spark) and eav.schema_exists(spark, "default")


def test_jobs(spark, none):
    from loomery.plans import jobs

    cells = spark.createDataFrame([(1, i, v) for i, v in enumerate(["ma", "ny", "ma"])] + [(2, i, str(i)) for i in range(9)], "field_id long, entity_id long, value string")
    dictionary = spark.createDataFrame([(7, "ma"), (7, "ny"), (8, "x")], "global_id long, value string")
    attributes = spark.createDataFrame([(7, "state"), (8, "count")], "global_id long, name string")
    mapped = spark.createDataFrame([(2, 8, 1.0, 1.0)], "local_id long, global_id long, confidence double, authority double")
    fields = names(spark, [(1, "state_code"), (2, "counter")])
    found = jobs.schema_map(fields, cells, dictionary, attributes, mapped, tokens=text.word_tokens)
    assert {(r.field_id, r.global_id) for r in found["best"].collect()} == {(1, 7), (2, 8)}
    assert {r.method for r in found["raw"].collect()} >= {"qgrams", "mdl", "ngrams", "dist"}
    with pytest.raises(ValueError):
        jobs.expert_scores("other", fields, cells, dictionary, attributes, mapped)
    truth = spark.createDataFrame([(1, 7), (2, 8)], "field_id long, global_id long")
    tried = jobs.random_weight_search(found["raw"], truth, tries=3).collect()
    assert len(tried) == 3 and tried[0].success_rate == 1.0
    people = spark.createDataFrame([(1, 1, "ann smith"), (2, 1, "anne smith"), (3, 1, "bob jones")], "entity_id long, tag_id long, value string")
    similar, weights = jobs.dedup_all(people, spark.createDataFrame([(1, 2)], "entity_a long, entity_b long"))
    scores = {(r.id_a, r.id_b): r.similarity for r in similar.collect()}
    assert scores[1, 2] == scores[2, 1] > 0.5 and weights.count() == 1


def test_unload_and_random_import(spark):
    tables = {
        "fields": spark.createDataFrame([(1, 1), (2, 2)], "field_id long, source_id long"),
        "entities": spark.createDataFrame([(10, 1), (20, 2)], "entity_id long, source_id long"),
        "cells": spark.createDataFrame([(1, 10, "a"), (2, 20, "b")], "field_id long, entity_id long, value string"),
        "similarities": spark.createDataFrame([(10, 0.5), (20, 0.5)], "entity_id long, score double"),
        "methods": spark.createDataFrame([("mdl",)], "method string"),
    }
    left = eav.unload(tables, spark.createDataFrame([(1,)], "source_id long"))
    assert {n: rows.count() for n, rows in left.items()} == {"fields": 1, "entities": 1, "cells": 1, "similarities": 1, "methods": 1} and left["cells"].first().field_id == 2
    raw = spark.createDataFrame([(s, e, "n", f"v{s}{e}") for s in range(6) for e in range(3)], "source_id long, entity_id long, name string, value string")
    loaded = spark.createDataFrame([(0,), (1,)], "source_id long")
    drawn = eav.import_random(raw, loaded, 2)
    assert drawn["sources"].count() == 2 and drawn["cells"].count() == 6 and drawn["cells"].where("source_id < 2").count() == 0
    assert eav.import_random(raw, loaded, 2, max_values=2)["cells"].count() == 0
