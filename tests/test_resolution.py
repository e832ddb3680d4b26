"""Joins, probabilities, clusters, merging and learning, on hand-derived values and against plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from loomery.functions import text
from loomery.operators import relational
from loomery.operators.cluster import component_clusters, least_parent_clusters
from loomery.plans import learning, resolution, serving
from loomery.streaming import incremental


def close(a, b, by=5e-7):
    return abs(a - b) < by


@pytest.mark.parametrize(("width", "ordered"), [(2.0, True), (0.5, False), (0.0, True), (100.0, True)])
def test_band_join_equals_theta_join(spark, width, ordered):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, i % 3, round(rng.uniform(-20, 20), 1)) for i in range(200)], "id long, k int, value double")
    a, b = rows.toDF("id_a", "k", "va"), rows.toDF("id_b", "k2", "vb")
    theta = a.join(b, (F.col("k") == F.col("k2")) & (F.abs(F.col("va") - F.col("vb")) <= width) & ((F.col("id_a") < F.col("id_b")) if ordered else F.lit(True)))
    band = relational.band_join(rows, rows, width, ["k"], ordered)
    pairs = lambda df: sorted((r.id_a, r.id_b) for r in df.collect())
    assert pairs(band) == pairs(theta)
    assert "Cartesian" not in band._jdf.queryExecution().executedPlan().toString()


def test_band_join_takes_its_bounds(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 5.5)], "id long, value double")
    assert [(r.id_a, r.id_b) for r in relational.band_join(rows, rows, 2.0, [], True).collect()] == [(1, 2)]


def test_prefix_cosine_equals_cosine(spark):
    rng = random.Random(2)
    cells = spark.createDataFrame([(i, 1, " ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(4))) for i in range(80)], "entity_id long, tag_id long, value string")
    rows = resolution.prepare(cells, tokens=text.word_tokens, token_cut=0.9, value_cut=1.0).text.withColumnRenamed("entity_id", "id")
    full = relational.cosine(rows, rows, ["tag_id"], True, 0.5)
    fast = relational.prefix_cosine(rows, ["tag_id"], 0.5)
    got = lambda df: {(r.id_a, r.id_b): round(r.score, 9) for r in df.collect()}
    assert got(full) == got(fast) and len(got(full)) > 5


def test_numbered_and_sampling(spark):
    rows = spark.range(1000).withColumn("x", F.col("id") * 7 % 1000).repartition(7)
    assert [(r.x, r.row_no) for r in relational.numbered(rows, ["x"]).orderBy("x").collect()] == [(i, i + 1) for i in range(1000)]
    assert relational.every_kth(rows, "x", 200).count() == 200
    a, b = (sorted(r.id for r in relational.sample(rows, 20, "id", seed=3).collect()) for _ in range(2))
    assert a == b and len(a) == 20
    assert relational.sample_per(rows.withColumn("g", F.col("id") % 4), 3, ["g"], "id").count() == 12


def test_numbered_takes_its_ranges_once(spark):
    """More rows than a sample of range bounds takes; nulls come last."""
    rows = spark.range(60_000).select((F.col("id") * 7919 % 60_000).alias("x"), F.when(F.col("id") % 1000 > 0, F.col("id") % 500).alias("y")).repartition(4)
    got = relational.numbered(rows, ["y", "x"]).select("x", "y", "row_no").collect()
    want = sorted(got, key=lambda r: (r.y is None, r.y or 0, r.x))
    assert [r.row_no for r in want] == list(range(1, 60_001))


def edges(spark, rows):
    return spark.createDataFrame(rows, "a long, b long")


def clusters(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster_id, set()).add(r.node)
    return out


def test_clusters(spark):
    nodes = spark.range(1, 8).toDF("node")
    graph = edges(spark, [(1, 3), (2, 3), (3, 4), (5, 6)])
    assert clusters(least_parent_clusters(nodes, graph)) == {1: {1, 3, 4}, 2: {2}, 5: {5, 6}, 7: {7}}
    assert clusters(component_clusters(nodes, graph)) == {1: {1, 2, 3, 4}, 5: {5, 6}, 7: {7}}


def test_components_of_a_long_path_and_again(spark):
    n = 60
    order = random.Random(3).sample(range(n), n)
    graph = edges(spark, list(zip(order, order[1:])))
    out = component_clusters(spark.range(n).toDF("node"), graph)
    assert clusters(out) == {0: set(range(n))}
    again = component_clusters(spark.range(n).toDF("node"), out.select(F.col("node").alias("a"), F.col("cluster_id").alias("b")))
    assert clusters(again) == clusters(out)


def test_match_probability(spark):
    features = spark.createDataFrame([(1, None, None, 0.1, 0.2), (2, None, None, 0.3, 0.4), (3, None, None, 0.5, 0.5), (1, 0.0, 1.0, 0.9, 0.001), (2, 0.0, 1.0, 0.6, 0.0001)], "tag_id long, t1 double, t2 double, f_given_m double, f_given_u double")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "id_a long, id_b long")
    seen = spark.createDataFrame([(1, 2, 1, 0.0), (1, 2, 2, 0.99), (1, 3, 1, 1.0)], "id_a long, id_b long, tag_id long, score double")
    got = {(r.id_a, r.id_b): r for r in resolution.match_probability(pairs, seen, features).collect()}
    assert close(got[1, 2].p_m, 2.7e-6, 1e-12) and close(got[1, 2].p_u, 4.99995e-8, 1e-13) and close(got[1, 2].m_prob, 0.981818)
    assert got[1, 3].m_prob < 1e-4  # a score outside of all bins counts as missing


def test_v0(spark):
    cells = spark.createDataFrame([(1, 1, "main street"), (2, 1, "main st")], "entity_id long, tag_id long, value string")
    got = resolution.v0_field_similarities(resolution.v0_vectors(cells)).collect()
    assert {(r.id_a, r.id_b) for r in got} == {(1, 2), (2, 1)} and all(close(r.score, 0.683763) for r in got)
    sims = spark.createDataFrame([(1, 2, 1, 0.8), (1, 3, 1, 0.8), (2, 3, 1, 0.8), (4, 5, 1, 0.2)], "id_a long, id_b long, tag_id long, score double")
    matches = spark.createDataFrame([(2, 1), (1, 3), (2, 3)], "entity_a long, entity_b long")
    start = resolution.v0_initial_weights(spark.createDataFrame([(1,), (2,)], "tag_id long"), F.col("tag_id") == 1, F.lit(False))
    w = {r.tag_id: r.weight for r in resolution.v0_learn_weights(sims, matches, start).collect()}
    assert close(w[1], 9.82) and close(w[2], 1.0)
    assert close({r.tag_id: r.weight for r in resolution.v0_learn_weights(sims, matches, start, with_bias=False).collect()}[1], 4.0)
    assert resolution.v0_model_exists(start).first().model_exists
    sizes = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "entity_id long, tag_id long")
    one = spark.createDataFrame([(1, 2, 1, 0.5)], "id_a long, id_b long, tag_id long, score double")
    assert close(resolution.v0_similarities(one, start, sizes).first().similarity, 0.5 * 10 / 11)
    assert close(resolution.v0_similarities(one, start, None).first().similarity, 0.5 * 10 / 11)


def test_preparation(spark):
    cells = spark.createDataFrame([(1, 1, "red fox"), (1, 1, "blue hen"), (2, 1, "red fox"), (3, 1, "old cat"), (1, 2, "5"), (2, 2, "7.5"), (3, 2, "9"), (4, 2, None)], "entity_id long, tag_id long, value string")
    p = resolution.prepare(cells, tokens=text.word_tokens, token_cut=0.5)
    assert {r.tag_id: r.type for r in p.types.collect()} == {1: "TEXT", 2: "REAL"}
    assert {(r.entity_id, r.value) for r in p.data.where("tag_id = 1").collect()} == {(1, "blue hen , red fox"), (2, "red fox"), (3, "old cat")}
    assert {(r.entity_id, r.value) for r in p.real.collect()} == {(1, 5.0), (2, 7.5), (3, 9.0)}
    norms = p.text.groupBy("entity_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert all(close(r.n, 1.0, 1e-9) for r in norms)
    later = resolution.prepare(spark.createDataFrame([(9, 1, "red hen")], "entity_id long, tag_id long, value string"), before=p, tokens=text.word_tokens, token_cut=0.9)
    assert {r.token: r.doc_count for r in later.documents.where("tag_id = 1").collect()}["hen"] == 2
    assert {r.tag_id: r.tag_count for r in later.tags.collect()} == {1: 4, 2: 3}


def test_zero_fill_is_for_text(spark):
    cells = spark.createDataFrame([(1, 1, "aa bb"), (2, 1, "cc dd"), (3, 1, "ee ff"), (1, 2, "1"), (2, 2, "4"), (3, 2, "9")], "entity_id long, tag_id long, value string")
    p = resolution.prepare(cells, tokens=text.word_tokens, token_cut=1.0)
    pairs = spark.createDataFrame([(1, 2)], "id_a long, id_b long")
    assert {(r.tag_id, r.score) for r in resolution.pair_similarities(pairs, p, p).collect()} == {(1, 0.0), (2, -3.0)}


def test_linkage_and_merge(spark):
    new = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "entity_id long, cluster_id long")
    old = spark.createDataFrame([(10, 10), (11, 11), (12, 12)], "entity_id long, cluster_id long")
    m = spark.createDataFrame([(1, 10, 0.95), (2, 10, 0.95), (1, 11, 0.95), (2, 11, 0.95), (3, 12, 0.9)], "id_a long, id_b long, m_prob double")
    links = resolution.linkage(m, new, old)
    assert {(r.new_cluster, r.old_cluster): round(r.similarity, 9) for r in links.collect()} == {(1, 10): 0.95, (1, 11): 0.95}
    assert {r.entity_id: r.cluster_id for r in resolution.merge_clusters(links, new, old).collect()} == {10: 10, 11: 11, 12: 12, 1: 10, 2: 10, 3: 3}


@pytest.fixture(scope="module")
def model(spark):
    features = spark.createDataFrame([(1, None, None, 0.05, 0.05), (1, 0.0, 0.7, 0.05, 0.95), (1, 0.7, 1.1, 0.95, 1e-7)], "tag_id long, t1 double, t2 double, f_given_m double, f_given_u double")
    return features, spark.createDataFrame([(1, "TEXT", 0.5)], "tag_id long, type string, threshold double")


def test_resolving_sources_one_after_the_other(spark, model):
    rows = [(i, 1, f"name{i} street{i} town{i}") for i in range(1, 30)]
    cells = lambda r: spark.createDataFrame(r, "entity_id long, tag_id long, value string")
    state, found = resolution.resolve_source(cells([*rows, (50, 1, "name3 street3 town3")]), *model, tokens=text.word_tokens)
    got = {r.entity_id: r.cluster_id for r in found.collect()}
    assert got[50] == 3 and len(set(got.values())) == 29
    state, found = resolution.resolve_source(cells([(101, 1, "name7 street7 town7"), (102, 1, "new words here")]), *model, before=state, clusters=found, tokens=text.word_tokens)
    got = {r.entity_id: r.cluster_id for r in found.collect()}
    assert got[101] == 7 and got[102] == 102 and got[50] == 3
    assert state.data.count() == 32


def test_streaming_resolution(spark, model, tmp_path):
    source = tmp_path / "cells"
    rows = lambda r: spark.createDataFrame(r, "entity_id long, tag_id long, value string").coalesce(1)
    rows([(i, 1, f"name{i} street{i} town{i}") for i in range(1, 40)]).write.parquet(str(source / "a"))
    state = incremental.ResolutionState(spark, f"file://{tmp_path}/state")
    stream = lambda: spark.readStream.schema("entity_id long, tag_id long, value string").option("recursiveFileLookup", "true").parquet(str(source))
    run = lambda: incremental.start(stream(), state, f"{tmp_path}/checkpoint", *model, tokens=text.word_tokens).awaitTermination()
    run()
    rows([(90, 1, "name4 street4 town4")]).write.parquet(str(source / "b"))
    run()
    run()  # nothing new
    _, found = state.load()
    assert {r.entity_id: r.cluster_id for r in found.collect()}[90] == 4 and found.count() == 40
    incremental.resolve_batch(state, *model, tokens=text.word_tokens)(rows([(99, 1, "x")]), 0)  # a batch from before
    assert state.load()[1].count() == 40


def test_learning_from_duplicates(spark):
    rng = random.Random(1)
    dup = spark.createDataFrame([(i, i + 1, 1, rng.uniform(0.6, 1.0)) for i in range(300)] + [(i, i + 1, 2, rng.uniform(0, 1)) for i in range(300)], "id_a long, id_b long, tag_id long, score double")
    rnd = spark.createDataFrame([(i, i + 1, 1, rng.uniform(0.0, 0.7)) for i in range(900)] + [(i, i + 1, 2, rng.uniform(0, 1)) for i in range(900)], "id_a long, id_b long, tag_id long, score double")
    features = learning.duplicate_features(dup, 400, rnd, 1000)
    one = [r for r in features.where("tag_id = 1").collect()]
    assert len(one) == 5 and sum(r.t1 is None for r in one) == 1
    null = next(r for r in one if r.t1 is None)
    assert close(null.f_given_m, 0.25) and 0 < null.f_given_u < 0.2
    assert close(sum(r.f_given_m for r in one), 1.0, 1e-6)
    assert {r.tag_id for r in learning.useful_attributes(features, resolution.Config(prob_dist_threshold=0.5)).collect()} == {1}
    found = {r.tag_id: r.threshold for r in learning.thresholds(dup, 400, rnd, 1000, resolution.Config(rel_perf_threshold=20)).collect()}
    assert 0.6 < found[1] < 0.75 and 2 not in found


def test_learning_from_labels(spark):
    rng = random.Random(1)
    rnd = spark.createDataFrame([(i, i + 1, 1, rng.random()) for i in range(1000)], "id_a long, id_b long, tag_id long, score double")
    asked = learning.questions(rnd, resolution.Config(question_budget=30))
    assert asked.count() == 30 and asked.groupBy("bin").count().where("count = 10").count() == 3
    labelled = asked.withColumn("human_label", F.when(F.col("bin") == 2, F.when(F.col("id_a") % 2 == 0, "Yes").otherwise("Maybe")).otherwise("No"))
    features, est = learning.manual_features(labelled, rnd, 1000)
    assert 0.2 < est.first().est_dup < 0.45
    rows = {r.t1: r for r in features.where("t1 IS NOT NULL").collect()}
    top = max(rows)
    assert close(rows[top].f_given_m, 1.0, 1e-6) and rows[top].f_given_u == learning.TINY
    found = learning.manual_thresholds(features, resolution.Config(rel_perf_threshold=2)).first().threshold
    assert 0.3 < found < top + 0.01


def test_random_pairs(spark):
    entities = spark.range(50).toDF("entity_id")
    a, b = (sorted((r.id_a, r.id_b) for r in learning.random_pairs(entities, 200, seed=1).collect()) for _ in range(2))
    assert a == b and len(a) == len(set(a)) == 200 and all(x != y for x, y in a)
    assert all(r.id_a < r.id_b for r in learning.random_pairs(entities, 50, ordered=True).collect())
    assert learning.random_pairs(entities.limit(1), 5).count() == 0


def test_config():
    c = resolution.Config.from_rows([("est_dup", "0.01"), ("bins_count", "5"), ("other", "x")])
    assert c.est_dup == 0.01 and c.bins_count == 5 and c.truncate_threshold == 0.95


def test_review_screens(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9, None, 3), (3, 4, 0.52, None, 1), (5, 6, 0.1, "No", 0)], "entity_a long, entity_b long, similarity double, human_label string, priority int")
    pick = lambda how: serving.pairs_to_compare(pairs, how).first().entity_a
    assert pick("similar") == 1 and pick("near") == 3 and pick("priority") == 3 and pick("random") in (1, 3)
    with pytest.raises(ValueError):
        serving.pairs_to_compare(pairs, "other")
    labelled, match = serving.save_comparison(pairs, 2, 1, "Yes")
    assert labelled.where("entity_a = 1").first().human_label == "Yes" and match.first().entity_a == 1
    assert serving.save_comparison(pairs, 1, 2, "no")[1].count() == 0
    data = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "b", "z"), (2, "c", "")], "entity_id long, name string, value string")
    assert [(r.name, r.filled) for r in serving.compare_entities(data, 1, 2).collect()] == [("b", 2), ("a", 1), ("c", 0)]
    assert spark.range(1).select(serving.guess(F.lit(0.7)).alias("g")).first().g == "Yes"
    words = spark.createDataFrame([("Big Red Fox",), ("red hen",)], "s string")
    assert words.where(serving.search_terms(F.col("s"), ["RED", "fox"])).count() == 1
    config = spark.createDataFrame([("a", None, "dedup", "1"), ("a", "A", "other", "2")], "name string, description string, module string, value string")
    assert serving.config_params(serving.set_config(config, "a", "9")).first().value == "9"
    made = serving.create_mappings(spark.createDataFrame([(1, 2)], "local_id long, global_id long")).first()
    assert (made.confidence, made.authority, made.who_created) == (1.0, 0.5, "WEB")


def test_detail_screens(spark):
    cells = spark.createDataFrame([(1, i, str(i)) for i in range(30)] + [(2, i, str(i * 2)) for i in range(30)], "field_id long, entity_id long, value string")
    mapped = spark.createDataFrame([(2, 7, 1.0, 1.0)], "local_id long, global_id long, confidence double, authority double")
    composite = spark.createDataFrame([(1, 1, 7, 0.9)], "source_id long, field_id long, global_id long, score double")
    scores = spark.createDataFrame([(1, 1, 7, "mdl", 0.9)], "source_id long, field_id long, global_id long, method string, score double")
    show = lambda kind: serving.detail(kind, cells, mapped, composite, scores, 1, ["mdl"]).collect()
    assert sum(r.n for r in show("summary")) == 30 and sum(r.n for r in show("distro")) == 30
    assert {r.value for r in show("shared")} == {str(i) for i in range(0, 30, 2)}
    assert len(show("examples")) == 20 and show("scoring")[0].mdl == 0.9
    assert serving.one_example(cells).count() == 2 and serving.example_values(cells, 3).count() == 6
    fields = spark.createDataFrame([(1, 1, "Price"), (2, 1, "Cost")], "field_id long, source_id long, local_name string")
    attributes = spark.createDataFrame([(7, "amount")], "global_id long, name string")
    found = serving.field_mappings(fields, mapped, composite, attributes)
    assert {r.local_name: (r.match, r.score, r.is_mapping) for r in found.collect()} == {"Price": ("amount", 0.9, False), "Cost": ("amount", 2.0, True)}
    assert serving.field_mappings_by_name(found, "%c%", 10).count() == 2 and serving.field_mappings_by_name(found, "cost", 10, exact=True).count() == 1


def test_attributes_of_a_later_batch(spark):
    """An attribute that the state lacks gets its type and tokens from the batch that brings it; a known one keeps its type."""
    first = spark.createDataFrame([(i, 1, f"red fox {i}") for i in range(5)] + [(i, 2, str(i)) for i in range(5)], "entity_id long, tag_id long, value string")
    second = spark.createDataFrame([(i, 3, f"blue hen {i}") for i in range(10, 13)] + [(i, 4, str(i)) for i in range(10, 13)] + [(i, 1, str(i)) for i in range(10, 13)], "entity_id long, tag_id long, value string")
    before = resolution.prepare(first, tokens=text.word_tokens)
    after = resolution.prepare(second, before, tokens=text.word_tokens, token_cut=1.0)
    assert {r.tag_id: r.type for r in after.types.collect()} == {1: "TEXT", 2: "REAL", 3: "TEXT", 4: "REAL"}
    assert {r.tag_id for r in after.text.collect()} >= {3} and {r.tag_id for r in after.real.collect()} == {4}


def test_v0_weights_of_groups_equal_those_of_pairs(spark):
    """With and without a gram that all share, over copies, several attributes and entities without a group."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.choice((1, 3, 4))))
    cells = [(i, 1, "all " + word()) for i in range(30)] + [(i, 2, rng.choice(("abc", "ddd", word(), word() + " " + word()))) for i in range(40)]
    cells = spark.createDataFrame(cells, "entity_id long, tag_id long, value string")
    group = {i: i % 3 if i % 7 else None for i in range(40)}
    groups = spark.createDataFrame(list(group.items()), 'entity_id long, `group` long')
    start = resolution.v0_initial_weights(spark.createDataFrame([(1,), (2,)], "tag_id long"), F.col("tag_id") == 1, F.lit(False))
    vectors = resolution.v0_vectors(cells)
    known = vectors.join(groups.where("group IS NOT NULL"), "entity_id", "left_semi")
    pairs = spark.createDataFrame([(a, b) for a in group for b in group if a < b and group[a] is not None and group[a] == group[b]], "entity_a long, entity_b long")
    for with_bias in (True, False):
        want = {r.tag_id: r.weight for r in resolution.v0_learn_weights(resolution.v0_field_similarities(known), pairs, start, with_bias).collect()}
        got = {r.tag_id: r.weight for r in resolution.v0_learn_weights_of_groups(vectors, groups, start, with_bias).collect()}
        assert got.keys() == want.keys() and all(close(got[k], want[k], 1e-9) for k in want)
    seen = {}
    for r in resolution.v0_field_similarities(known).where("id_a < id_b").collect():
        n = seen.setdefault(r.tag_id, [0, 0])
        n[0] += 1
        n[1] += group[r.id_a] == group[r.id_b]
    got = {r.tag_id: [r.n, r.n_m] for r in resolution.v0_shared_pairs(vectors, groups.where("group IS NOT NULL")).collect()}
    assert got == seen


def test_v0_weights_build_no_pairs(spark):
    """20,000 entities have 200 million pairs."""
    cells = spark.range(20_000).select(F.col("id").alias("entity_id"), F.lit(1).cast("long").alias("tag_id"), F.concat(F.lit("Supplier "), F.col("id") % 50).alias("value"))
    groups = spark.range(20_000).select(F.col("id").alias("entity_id"), (F.col("id") % 25).alias("group"))
    got = {r.tag_id: (r.n, r.n_m) for r in resolution.v0_shared_pairs(resolution.v0_vectors(cells), groups).collect()}
    assert got == {1: (20_000 * 19_999 // 2, 25 * 800 * 799 // 2)}


def test_thresholds_of_counted_distances_equal_those_of_pairs(spark):
    rng = random.Random(7)
    people = [(i, 1, rng.choice((1.5, 2.0, 7.25, None, rng.randint(0, 40) / 4)), i % 4) for i in range(120)]
    values = spark.createDataFrame(people, "entity_id long, tag_id long, value double, k long")
    got = {r.score: r.n for r in learning.distances(values, "k").collect()}
    rows = [None if a[2] is None or b[2] is None else -abs(a[2] - b[2]) for a in people for b in people if a[0] < b[0] and a[3] == b[3]]
    assert got == {s: rows.count(s) for s in set(rows)}
    known = values.where("value IS NOT NULL")
    pairs = spark.createDataFrame([(1, s) for s in rows if s is not None], "tag_id long, score double")
    other = learning.distances(known.withColumn("k", F.lit(0)), "k")
    n, m = pairs.count(), other.agg(F.sum("n")).first()[0]
    plain = other.select("tag_id", "score", F.explode(F.expr("sequence(1, n)"))).drop("col")
    config = resolution.Config(rel_perf_threshold=0.9, abs_perf_threshold=0.3)
    want = [r.threshold for r in learning.thresholds(pairs, n, plain, m, config, steps=7).collect()]
    assert want and want == [r.threshold for r in learning.thresholds(learning.distances(known, "k"), n, other, m, config, steps=7).collect()]


def test_v0_expanded_classes_equal_all_pairs(spark):
    """Copies, also more than a chunk holds, meet all others and one another, in both directions."""
    rng = random.Random(9)
    cells = spark.createDataFrame([(i, t, rng.choice(("red fox", "red hen", "", f"old cat {i % 5}", "x"))) for i in range(60) for t in (1, 2) if (i + t) % 5], "entity_id long, tag_id long, value string")
    want = {(r.id_a, r.id_b, r.tag_id): round(r.score, 9) for r in resolution.v0_field_similarities(resolution.v0_vectors(cells)).collect()}
    copies = resolution.v0_copies(cells)
    assert copies.where("entity_id <> class_id").count() > 0
    scores = resolution.v0_class_similarities(cells, copies)
    got = [(r.id_a, r.id_b, r.tag_id, round(r.score, 9)) for r in resolution.v0_expand(scores, copies, chunk=2).collect()]
    assert len(got) == len(want) and {g[:3]: g[3] for g in got} == want
    matches = spark.createDataFrame([(a, b) for a in range(60) for b in range(60) if a % 3 == b % 3], "entity_a long, entity_b long")
    start = resolution.v0_initial_weights(spark.createDataFrame([(1,), (2,)], "tag_id long"), F.col("tag_id") == 1, F.lit(False))
    a = {r.tag_id: r.weight for r in resolution.v0_learn_weights(resolution.v0_field_similarities(resolution.v0_vectors(cells)), matches, start).collect()}
    b = {r.tag_id: r.weight for r in resolution.v0_learn_weights_of_copies(scores, copies, matches, start).collect()}
    assert a.keys() == b.keys() and all(close(a[k], b[k], 1e-9) for k in a)


def test_dealt_join_spreads_one_key(spark):
    rows = spark.range(300).select("id", F.lit(1).alias("k"))
    met = relational.dealt_join(rows.withColumnRenamed("id", "a"), rows.withColumnRenamed("id", "b"), ["k"])
    assert met.distinct().count() == met.count() == 90_000
    assert met.select(F.spark_partition_id()).distinct().count() > 4


def test_pairs_of_each_way_in_one_pass(spark, monkeypatch):
    """As each way by itself, over ties, nulls and labels, with and without bounds; only few of all pairs are ordered."""
    kept = {}
    write = serving.written
    monkeypatch.setattr(serving, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    hows = ["random", "similar", "near", "priority"]
    a, b = F.col("entity_a"), F.col("entity_b")
    pairs = spark.range(40_000).select((F.col("id") % 200).alias("entity_a"), F.floor(F.col("id") / 200).alias("entity_b")).where("entity_a < entity_b")
    pairs = pairs.select(a, b, F.when((a + b) % 50 > 0, F.round((a * b % 97) / 97, 2)).alias("similarity"), F.when(a % 9 != 1, (a * 7 + b) % 11).alias("priority"))
    labelled = pairs.withColumn("human_label", F.when(a == 3, "Yes"))
    odd = spark.createDataFrame([(1, 2, float("nan"), 1), (1, 3, None, None), (2, 3, 0.5, 0), (2, 4, 0.5, 0)], pairs.schema)
    for rows, n, part in ((pairs, 4, 8), (pairs, 4, 10**6), (labelled, 7, 8), (labelled.limit(0), 2, 8), (odd, 3, 1), (odd, 4, 1), (odd, 9, 1)):
        monkeypatch.setattr(serving, "PART", part)
        kept.clear()
        got = serving.pairs_to_compare_each(rows, hows, n, 0.5, above=F.col("similarity") + 0.01).collect()
        want = [(how, *r) for how in hows for r in serving.pairs_to_compare(rows, how, n, 0.5).collect()]
        assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
        if rows is pairs and part == 8:
            assert 0 < kept["few"].count() < pairs.count() / 5
