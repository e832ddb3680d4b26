"""More registered queries, with SQL: imports, catalog, sinks, clean-up, review screens, state over two batches, and evaluation on sources not trained on."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import text
from loomery.operators import relational
from loomery.operators.cluster import fresh_path, written
from loomery.plans import jobs, learning, matching, resolution, serving
from loomery.registry import (
    _attributes, _cells, _features, _fields, _grams_sql, _labelled_similarities, _mappings, _plain_scores, _prepared, _r, _suppliers, _table, _thresholds, _v0_weighted, _v0_weights, register,
)
from loomery.sources import eav

# Imports


@register("import_wide_cells", "SELECT 'supplier/' || s_nationkey AS source, s_suppkey::VARCHAR AS entity, 's_name' AS field, s_name AS value FROM supplier WHERE s_name <> ''")
def import_wide_cells(spark, sf):
    return eav.import_wide(_table(spark, sf, "supplier"), "supplier", "s_suppkey", "s_nationkey", skip=("s_acctbal",))["cells"]


@register("import_wide_entities", "SELECT DISTINCT 'part/0' AS source, p_partkey::VARCHAR AS entity FROM part")
def import_wide_entities(spark, sf):
    return eav.import_wide(_table(spark, sf, "part"), "part", "p_partkey")["entities"]


@register("import_wide_numbered", "SELECT 'region/0' AS source, row_number() OVER (ORDER BY r_name)::VARCHAR AS entity, 'r_name' AS field, r_name AS value FROM region")
def import_wide_numbered(spark, sf):
    return eav.import_wide(_table(spark, sf, "region"), "region", skip=("r_regionkey",))["cells"]


@register("attribute_dictionary", "SELECT 5::BIGINT AS att_id, n_name AS value FROM nation WHERE n_name IS NOT NULL")
def attribute_dictionary(spark, sf):
    return eav.attribute_dictionary(5, _table(spark, sf, "nation"), "n_name")


@register("synonym_dictionary", "SELECT 6::BIGINT AS att_id, n_name AS value_a, r_name AS value_b FROM nation JOIN region ON n_regionkey = r_regionkey")
def synonym_dictionary(spark, sf):
    both = _table(spark, sf, "nation").join(_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return eav.synonym_dictionary(6, both, "n_name", "r_name")


@register("global_schema", "SELECT row_number() OVER (ORDER BY p_brand) AS id, p_brand AS name, 'WEB' AS derived_from, 'TEXT' AS type, NULL::DOUBLE AS threshold FROM (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL)")
def global_schema(spark, sf):
    return eav.global_schema(_table(spark, sf, "part"), "p_brand")


@register("attribute_template", "SELECT 'regions' AS template_name, a.id AS att_id FROM region r JOIN (SELECT row_number() OVER (ORDER BY n) AS id, n FROM (SELECT DISTINCT upper(r_name) AS n FROM region)) a ON lower(a.n) = lower(r.r_name)")
def attribute_template(spark, sf):
    region = _table(spark, sf, "region")
    attributes = eav.global_schema(region.select(F.upper("r_name").alias("n")), "n")
    return eav.import_auxiliary("template", region, ["r_name"], attributes, "regions")


@register("auxiliary_dictionary", "SELECT n_name AS value, (SELECT count(*) FROM region WHERE r_name <= 'ASIA') AS att_id FROM nation WHERE n_name IS NOT NULL AND EXISTS (SELECT 1 FROM region WHERE r_name = 'ASIA')")
def auxiliary_dictionary(spark, sf):
    attributes = eav.global_schema(_table(spark, sf, "region"), "r_name")
    return eav.import_auxiliary("attdict", _table(spark, sf, "nation"), ["n_name"], attributes, "ASIA")


TAGS = [(1, "c_name", "NAME"), (2, "s_name", "NAME"), (3, "p_name", "NAME"), (3, "p_brand", "BRAND"), (4, "o_totalprice", "AMOUNT"), (1, "c_acctbal", "AMOUNT")]
TAGS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({s}, '{n}', '{c}')" for s, n, c in TAGS) + ") AS t(source_id, local_name, tag_code)"


@register("training_load", f"tags AS ({TAGS_SQL}), att AS (SELECT tag_code, row_number() OVER (ORDER BY tag_code) AS id FROM (SELECT DISTINCT tag_code FROM tags)) SELECT DISTINCT f.field_id AS local_id, att.id AS global_id, 1.0::DOUBLE AS confidence, 1.0::DOUBLE AS authority FROM fields f JOIN tags USING (source_id, local_name) JOIN att USING (tag_code)")
def training_load(spark, sf):
    return eav.training_mappings(_fields(spark), spark.createDataFrame(TAGS, "source_id long, local_name string, tag_code string"))[1]


RAW_SQL = "SELECT source AS source_id, doc_id AS entity_id, 'lang' AS name, lang AS value FROM documents"
DRAWN_SQL = f"raw AS ({RAW_SQL}), drawn AS (SELECT source_id FROM (SELECT source_id, count(value) AS n FROM raw GROUP BY 1) WHERE n <= 10000000 AND source_id <> 'src0' ORDER BY md5(source_id || '/3'), source_id LIMIT 4)"


def _raw(spark, sf):
    return _table(spark, sf, "documents").select(F.col("source").alias("source_id"), F.col("doc_id").alias("entity_id"), F.lit("lang").alias("name"), F.col("lang").alias("value"))


@register("import_random", f"{DRAWN_SQL} SELECT source_id, entity_id, name, value FROM raw JOIN drawn USING (source_id) WHERE value IS NOT NULL AND len(value) < 1300")
def import_random(spark, sf):
    loaded = spark.createDataFrame([("src0",)], "source_id string")
    return eav.import_random(_raw(spark, sf), loaded, 4, seed=3)["cells"].select("source_id", "entity_id", "name", "value")


@register("raw_fields", f"raw AS ({RAW_SQL}) SELECT source_id, name, count(value) AS n_values, count(DISTINCT value) AS n_distinct, round(avg(len(value)), 6) AS avg_val_len FROM raw WHERE source_id = 'src1' GROUP BY 1, 2")
def raw_fields(spark, sf):
    return eav.raw_source(_raw(spark, sf), F.lit("src1"))["fields"].withColumn("avg_val_len", _r("avg_val_len"))


# Catalog, sinks, clean-up


@register("catalog_columns", "SELECT 'nation' AS name, column_name AS attribute, true AS found FROM (DESCRIBE SELECT * FROM nation)")
def catalog_columns(spark, sf):
    _table(spark, sf, "nation").createOrReplaceTempView("catalog_probe")
    found = eav.table_exists(spark, "catalog_probe") and eav.view_exists(spark, "catalog_probe") and "catalog_probe" in eav.schema_tables(spark) and eav.schema_exists(spark, "default") and not eav.table_exists(spark, "no_such_table")
    return spark.createDataFrame([("nation", c, found) for c in eav.table_attributes(spark, "catalog_probe")], "name string, attribute string, found boolean")


@register("saved_results", "SELECT field_id, global_id, round(score, 6) AS score FROM q_scores")
def saved_results(spark, sf):
    """Results saved as a table by source, and read again."""
    path = fresh_path(spark, "saved")
    eav.save(matching.qgrams_scores(_fields(spark), _attributes(spark), _mappings(spark)), path, "source_id")
    return eav.read_any(spark, path).select("field_id", "global_id", _r("score"))


@register("unload_source", "SELECT field_id, entity_id, value FROM cells WHERE field_id // 100 <> 3")
def unload_source(spark, sf):
    gone = spark.createDataFrame([(3,)], "source_id long")
    return eav.unload({"fields": _fields(spark), "cells": _cells(spark, sf)}, gone)["cells"].select("field_id", "entity_id", "value")


# Matching: scopes, training mappings, evaluation


@register("qgrams_source", "SELECT field_id, global_id, round(score, 6) AS score FROM q_scores WHERE field_id // 100 = 2")
def qgrams_source(spark, sf):
    return matching.qgrams_scores(_fields(spark), _attributes(spark), _mappings(spark), scope=F.col("source_id") == 2).select("field_id", "global_id", _r("score"))


@register("qgrams_field", "SELECT field_id, global_id, round(score, 6) AS score FROM q_scores WHERE field_id = 104")
def qgrams_field(spark, sf):
    return matching.qgrams_scores(_fields(spark), _attributes(spark), _mappings(spark), scope=F.col("field_id") == 104).select("field_id", "global_id", _r("score"))


@register("qgrams_predicate", "SELECT s.field_id, global_id, round(score, 6) AS score FROM q_scores s JOIN fields f ON f.field_id = s.field_id WHERE local_name LIKE '%name%'")
def qgrams_predicate(spark, sf):
    return matching.qgrams_scores(_fields(spark), _attributes(spark), _mappings(spark), scope=F.expr("local_name LIKE '%name%'")).select("field_id", "global_id", _r("score"))


def _dictionary(spark, sf):
    from loomery.registry import _dictionary as made

    return made(spark, sf)


@register("mdl_field", "SELECT field_id, global_id, round(score, 6) AS score FROM m_scores WHERE field_id = 103")
def mdl_field(spark, sf):
    return matching.mdl_scores(_cells(spark, sf), _dictionary(spark, sf), _fields(spark), _mappings(spark), scope=F.col("field_id") == 103).select("field_id", "global_id", _r("score"))


@register("mdl_predicate", "SELECT s.field_id, global_id, round(score, 6) AS score FROM m_scores s JOIN fields f ON f.field_id = s.field_id WHERE local_name LIKE 'p%'")
def mdl_predicate(spark, sf):
    return matching.mdl_scores(_cells(spark, sf), _dictionary(spark, sf), _fields(spark), _mappings(spark), scope=F.expr("local_name LIKE 'p%'")).select("field_id", "global_id", _r("score"))


@register("mdl_unmapped", "SELECT field_id, global_id, round(score, 6) AS score FROM m_scores WHERE field_id NOT IN (SELECT local_id FROM mappings)")
def mdl_unmapped(spark, sf):
    return matching.mdl_scores(_cells(spark, sf), _dictionary(spark, sf), _fields(spark), _mappings(spark), unmapped=_mappings(spark)).select("field_id", "global_id", _r("score"))


def _ngrams(spark, sf, **scope):
    found = matching.ngrams_scores(_cells(spark, sf), _dictionary(spark, sf), _fields(spark), _attributes(spark), _mappings(spark), tokens=text.word_tokens, **scope)
    return found.select("field_id", "global_id", _r("score"))


@register("ngrams_source", "SELECT field_id, global_id, round(score, 6) AS score FROM n_scores WHERE field_id // 100 = 3")
def ngrams_source(spark, sf):
    return _ngrams(spark, sf, scope=F.col("source_id") == 3)


@register("ngrams_field", "SELECT field_id, global_id, round(score, 6) AS score FROM n_scores WHERE field_id = 105")
def ngrams_field(spark, sf):
    return _ngrams(spark, sf, scope=F.col("field_id") == 105)


@register("ngrams_predicate", "SELECT s.field_id, global_id, round(score, 6) AS score FROM n_scores s JOIN fields f ON f.field_id = s.field_id WHERE local_name LIKE 'o%'")
def ngrams_predicate(spark, sf):
    return _ngrams(spark, sf, scope=F.expr("local_name LIKE 'o%'"))


@register("ngrams_unmapped", "SELECT field_id, global_id, round(score, 6) AS score FROM n_scores WHERE field_id NOT IN (SELECT local_id FROM mappings)")
def ngrams_unmapped(spark, sf):
    return _ngrams(spark, sf, unmapped=_mappings(spark))


def _dist(spark, sf, **scope):
    return matching.dist_scores(_cells(spark, sf, as_double=True), _fields(spark), _mappings(spark), **scope).select("field_id", "global_id", _r("score"))


def _welch(where: str) -> str:
    from loomery.registry import WELCH_SQL

    head, tail = WELCH_SQL.rsplit("SELECT f.source_id, field_id, global_id, 'dist' AS method,", 1)
    return f"{head} SELECT field_id, global_id, {tail.replace('WHERE 1 - p < 1 GROUP BY 1, 2, 3', f'WHERE 1 - p < 1 AND {where} GROUP BY 1, 2')}"


@register("dist_source", _welch("source_id = 2"))
def dist_source(spark, sf):
    return _dist(spark, sf, scope=F.col("source_id") == 2)


@register("dist_field", _welch("field_id = 203"))
def dist_field(spark, sf):
    return _dist(spark, sf, scope=F.col("field_id") == 203)


@register("dist_predicate", _welch("local_name LIKE '%acctbal'"))
def dist_predicate(spark, sf):
    return _dist(spark, sf, scope=F.expr("local_name LIKE '%acctbal'"))


@register("dist_unmapped", _welch("field_id NOT IN (SELECT local_id FROM mappings)"))
def dist_unmapped(spark, sf):
    return _dist(spark, sf, unmapped=_mappings(spark))


@register("training_affinities", "SELECT local_id, global_id, round(affinity, 6) AS affinity FROM affinity WHERE affinity >= 0.5")
def training_affinities(spark, sf):
    return matching.training_mappings(_mappings(spark)).withColumn("affinity", _r("affinity"))


@register("tree_points", "SELECT x.field_id, x.global_id, coalesce(max(score) FILTER (method = 'qgrams'), 0) AS qgrams, coalesce(max(score) FILTER (method = 'mdl'), 0) AS mdl, coalesce(max(score) FILTER (method = 'ngrams'), 0) AS ngrams, 0::DOUBLE AS dist, CASE WHEN EXISTS (SELECT 1 FROM mappings k WHERE k.local_id = x.field_id AND k.global_id = x.global_id) THEN 1.0 ELSE 0.0 END::DOUBLE AS label FROM scores x WHERE x.field_id // 100 % 2 = 1 GROUP BY 1, 2")
def tree_points(spark, sf):
    """Labelled points of the sources that the tree is to be fitted on."""
    points = matching.labelled_features(_plain_scores(spark, sf), _mappings(spark))
    return matching.split_points(points, _fields(spark), F.col("source_id") % 2 == 0)[0]


@register("tree_test")
def tree_test(spark, sf):
    """A tree fitted on sources 1 and 3, judged on 2 and 4."""
    points = written(matching.labelled_features(_plain_scores(spark, sf), _mappings(spark)), "points")
    return matching.tree_test(points, _fields(spark), F.col("source_id") % 2 == 0)


# Serving


@register("source_entities", "SELECT field_id // 100 AS source_id, entity_id, count(*) AS n_values FROM cells GROUP BY 1, 2")
def source_entities(spark, sf):
    return serving.source_entities(_cells(spark, sf), _fields(spark))


@register("source_stats", "SELECT f.source_id, any_value(f.n) AS n_fields, coalesce(count(DISTINCT entity_id), 0) AS n_entities, count(entity_id) AS n_values FROM (SELECT source_id, count(*) AS n FROM fields GROUP BY 1) f LEFT JOIN cells c ON c.field_id // 100 = f.source_id GROUP BY 1")
def source_stats(spark, sf):
    return serving.source_stats(_fields(spark), _cells(spark, sf))


@register("metadata", "SELECT 'lang' AS meta_name, lang AS value FROM documents WHERE source = 'src2' AND lang IS NOT NULL UNION ALL SELECT 'size', n_chars::VARCHAR FROM documents WHERE source = 'src2'")
def metadata(spark, sf):
    rows = F.explode(F.array(F.struct(F.lit("lang").alias("meta_name"), F.col("lang").alias("value")), F.struct(F.lit("size").alias("meta_name"), F.col("n_chars").cast("string").alias("value")))).alias("m")
    meta = _table(spark, sf, "documents").select(F.col("source").alias("source_id"), rows).select("source_id", "m.*").where("value IS NOT NULL")
    return serving.metadata(meta, "source_id", F.lit("src2"))


@register("attribute_overview", "SELECT global_id, name, count(local_id) AS n_fields FROM attributes LEFT JOIN (SELECT * FROM affinity WHERE affinity > 0) USING (global_id) GROUP BY 1, 2")
def attribute_overview(spark, sf):
    return serving.attribute_overview(_attributes(spark), _mappings(spark))


@register("created_mappings", "SELECT field_id AS local_id, global_id, 1.0::DOUBLE AS confidence, 0.5::DOUBLE AS authority, 'WEB' AS who_created, 'WEB' AS why_created FROM raw_best WHERE method = 'qgrams'")
def created_mappings(spark, sf):
    best = matching.raw_max(_plain_scores(spark, sf)).where("method = 'qgrams'").select(F.col("field_id").alias("local_id"), "global_id")
    return serving.create_mappings(best).drop("when_created")


@register("suggested_attributes", "SELECT n_name AS name, 'nation' AS reason FROM nation UNION ALL SELECT 'weight', 'asked for'")
def suggested_attributes(spark, sf):
    return serving.suggest_attribute(_table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("reason")), "weight", "asked for")


@register("configured", "SELECT n_name AS name, n_name AS label, CASE WHEN n_name = 'FRANCE' THEN '9' ELSE n_regionkey::VARCHAR END AS value FROM nation WHERE n_nationkey % 2 = 0")
def configured(spark, sf):
    module = F.when(F.col("n_nationkey") % 2 == 0, "dedup").otherwise("other").alias("module")
    config = _table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit(None).cast("string").alias("description"), module, F.col("n_regionkey").cast("string").alias("value"))
    return serving.config_params(serving.set_config(config, "FRANCE", "9"))


NAMED_SQL = "found AS (SELECT f.field_id, local_name, coalesce(a.name, 'Unknown') AS match, coalesce(round(x.score, 6), 0) AS score, coalesce(is_mapping, false) AS is_mapping FROM fields f LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY field_id ORDER BY score DESC, global_id) AS r FROM (SELECT local_id AS field_id, global_id, 2.0 AS score, true AS is_mapping FROM affinity UNION ALL SELECT field_id, global_id, least(round(score, 6), 1.999999), false FROM ncomp)) x ON x.field_id = f.field_id AND r = 1 LEFT JOIN attributes a ON a.global_id = x.global_id)"


@register("mappings_by_name", f"{NAMED_SQL} (SELECT * FROM found WHERE is_mapping AND lower(local_name) LIKE '%name%' ORDER BY field_id LIMIT 1) UNION ALL (SELECT * FROM found WHERE NOT is_mapping AND lower(local_name) LIKE '%name%' ORDER BY score DESC, field_id LIMIT 10)")
def mappings_by_name(spark, sf):
    composite = matching.ncomp(_plain_scores(spark, sf), matching.default_methods(spark)).withColumn("score", F.round("score", 6))
    found = serving.field_mappings(_fields(spark), _mappings(spark), composite, _attributes(spark)).withColumn("score", _r("score"))
    return serving.field_mappings_by_name(found, "%name%", 10)


@register("search_terms", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND contains(lower(p_name), 're')")
def search_terms(spark, sf):
    return _table(spark, sf, "part").where(serving.search_terms(F.col("p_name"), ["A", "RE"])).select("p_partkey", "p_name")


@register("example_values", "SELECT field_id, value FROM (SELECT field_id, value, row_number() OVER (PARTITION BY field_id ORDER BY md5(value || '/0'), value) AS r FROM (SELECT DISTINCT field_id, value FROM cells)) WHERE r <= 5")
def example_values(spark, sf):
    return serving.example_values(_cells(spark, sf), 5)


@register("one_example", "SELECT field_id, value AS example FROM (SELECT field_id, value, row_number() OVER (PARTITION BY field_id ORDER BY md5(value || '/0') DESC, value DESC) AS r FROM (SELECT DISTINCT field_id, value FROM cells)) WHERE r = 1")
def one_example(spark, sf):
    return serving.one_example(_cells(spark, sf))


def _compared(spark, sf, *more):
    s = _labelled_similarities(spark, sf)[1]
    return s.select(*more, F.col("id_a").alias("entity_a"), F.col("id_b").alias("entity_b"), F.round(1 / (1 - F.col("score")), 6).alias("similarity"), ((F.col("id_a") * 7 + F.col("id_b")) % 11).alias("priority"))


PAIRS_SQL = "pairs AS (SELECT a.s_suppkey AS entity_a, b.s_suppkey AS entity_b, round(1 / (1 + abs(a.s_acctbal - b.s_acctbal)), 6) AS similarity, (a.s_suppkey * 7 + b.s_suppkey) % 11 AS priority FROM supplier a JOIN supplier b ON floor(a.s_acctbal / 1000.0) = floor(b.s_acctbal / 1000.0) AND a.s_suppkey < b.s_suppkey)"
CHOSEN = "'{0}' AS how, entity_a, entity_b, similarity FROM pairs"


@register("pairs_to_compare", f"""{PAIRS_SQL} (SELECT {CHOSEN.format('random')} ORDER BY md5(entity_a || '/' || entity_b || '/0'), entity_a, entity_b LIMIT 5)
UNION ALL (SELECT {CHOSEN.format('similar')} ORDER BY similarity DESC, entity_a, entity_b LIMIT 5) UNION ALL (SELECT {CHOSEN.format('near')} WHERE similarity BETWEEN 0.01 - 0.05 AND 0.01 + 0.05 ORDER BY md5(entity_a || '/' || entity_b || '/0'), entity_a, entity_b LIMIT 5)
UNION ALL (SELECT {CHOSEN.format('priority')} ORDER BY priority, entity_a, entity_b LIMIT 5)""")
def pairs_to_compare(spark, sf):
    # Rounding costs far more than what it rounds, and moves it by less than 1e-6.
    pairs = _compared(spark, sf, (1 / (1 - F.col("score")) + 1e-6).alias("above"))
    return serving.pairs_to_compare_each(pairs, ["random", "similar", "near", "priority"], 5, near=0.01, above=F.col("above")).select("how", "entity_a", "entity_b", "similarity")


@register("guessed", f"{PAIRS_SQL} SELECT entity_a, entity_b, CASE WHEN similarity > 0.6 THEN 'Yes' ELSE 'No' END AS guess FROM pairs")
def guessed(spark, sf):
    return _compared(spark, sf).select("entity_a", "entity_b", serving.guess(F.col("similarity")).alias("guess"))


@register("saved_comparison", f"{PAIRS_SQL}, one AS (SELECT min(entity_a) AS a FROM pairs), two AS (SELECT a, min(entity_b) AS b FROM one, pairs WHERE entity_a = a GROUP BY a) SELECT entity_a, entity_b, CASE WHEN entity_a = a AND entity_b = b THEN 'Yes' END AS human_label FROM pairs, two")
def saved_comparison(spark, sf):
    pairs = _compared(spark, sf).withColumn("human_label", F.lit(None).cast("string"))
    first = pairs.orderBy("entity_a", "entity_b").first()
    labelled = serving.save_comparison(pairs, first.entity_b, first.entity_a, "Yes")[0] if first else pairs
    return labelled.select("entity_a", "entity_b", "human_label")


@register("compare_entities", "a AS (SELECT entity_id, local_name AS name, value FROM cells JOIN fields USING (field_id)) SELECT coalesce(x.name, y.name) AS name, x.value AS value_a, y.value AS value_b, (x.value IS NOT NULL)::INT + (y.value IS NOT NULL)::INT AS filled FROM (SELECT * FROM a WHERE entity_id = 300000001) x FULL JOIN (SELECT * FROM a WHERE entity_id = 300000002) y ON x.name = y.name")
def compare_entities(spark, sf):
    data = _cells(spark, sf).join(F.broadcast(_fields(spark)), "field_id").select("entity_id", F.col("local_name").alias("name"), "value")  # a row per column
    return serving.compare_entities(data, 300_000_001, 300_000_002)


@register("top_attributes", "SELECT field_id, global_id, round(score, 6) AS score FROM ncomp WHERE field_id = 302 ORDER BY round(score, 6) DESC, global_id LIMIT 3")
def top_attributes(spark, sf):
    composite = matching.ncomp(_plain_scores(spark, sf), matching.default_methods(spark)).withColumn("score", F.round("score", 6))
    return serving.top_attributes(composite, 302, 3).select("field_id", "global_id", "score")


@register("detail_shared", "SELECT DISTINCT v.field_id, a.global_id, v.value FROM m_values v JOIN m_values k ON k.value = v.value AND k.field_id <> v.field_id JOIN affinity a ON a.local_id = k.field_id WHERE v.field_id = 203 AND a.global_id IN (SELECT global_id FROM ncomp WHERE field_id = 203 ORDER BY round(score, 6) DESC, global_id LIMIT 4)")
def detail_shared(spark, sf):
    scores = _plain_scores(spark, sf)
    composite = matching.ncomp(scores, matching.default_methods(spark)).withColumn("score", F.round("score", 6))
    return serving.detail("shared", _cells(spark, sf), _mappings(spark), composite, scores, 203, ["qgrams"])


@register("detail_scoring", "SELECT field_id, global_id, max(score) FILTER (method = 'qgrams') AS qgrams, max(score) FILTER (method = 'mdl') AS mdl FROM scores WHERE field_id = 103 GROUP BY 1, 2")
def detail_scoring(spark, sf):
    scores = _plain_scores(spark, sf)
    return serving.detail("scoring", _cells(spark, sf), _mappings(spark), scores, scores, 103, ["qgrams", "mdl"])


# Relational building blocks


@register("every_kth", "SELECT o_orderkey, o_totalprice, row_no FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_no FROM orders) WHERE row_no % ceil((SELECT count(*) FROM orders) / 200)::BIGINT = 0")
def every_kth(spark, sf):
    return relational.every_kth(_table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])


@register("accumulated", "SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY 1")
def accumulated(spark, sf):
    """Counts of even keys, brought up to date with those of odd keys."""
    counts = lambda odd: _table(spark, sf, "part").where(F.col("p_brand").isNotNull() & (F.col("p_partkey") % 2 == odd)).groupBy("p_brand").agg(F.count("*").alias("n"))
    return relational.accumulate(counts(0), counts(1), ["p_brand"], "n")


# Resolution: state over two batches, learning, the older weights


def _in_batches(spark, sf):
    """Names of suppliers of even keys come first; those of odd keys bring an attribute that the state lacks, the customers' segment."""
    cells = _suppliers(spark, sf).where("tag_id = 1")
    segments = _table(spark, sf, "customer").select((F.col("c_custkey") * 2 + 1).alias("entity_id"), F.lit(9).cast("long").alias("tag_id"), F.concat_ws(" ", "c_mktsegment", "c_name").alias("value"))
    before = resolution.prepare(cells.where("entity_id % 2 = 0"), tokens=text.qgrams, token_cut=1.0, value_cut=1.0)
    return resolution.prepare(cells.where("entity_id % 2 = 1").unionByName(segments), before, tokens=text.qgrams, token_cut=1.0, value_cut=1.0)


BATCH_SQL = f"""
late AS (SELECT c_custkey * 2 + 1 AS id, c_mktsegment || ' ' || c_name AS value FROM customer),
tok AS (SELECT id, token, count(*) AS freq FROM (SELECT id, unnest({_grams_sql('value')}) AS token FROM late) WHERE trim(token) <> '' GROUP BY ALL),
idf AS (SELECT token, log10(n / count(*)) AS idf FROM tok, (SELECT count(DISTINCT id) AS n FROM late) GROUP BY token, n),
nrm AS (SELECT id, sqrt(sum((freq * idf) ** 2)) AS norm FROM tok JOIN idf USING (token) GROUP BY 1)
SELECT id AS entity_id, token, round(freq * idf / norm, 6) AS weight FROM tok JOIN idf USING (token) JOIN nrm USING (id) WHERE norm > 0
"""


@register("batch_new_attribute", BATCH_SQL)
def batch_new_attribute(spark, sf):
    return _in_batches(spark, sf).text.where("tag_id = 9").select("entity_id", "token", _r("weight"))


@register("batch_types", "SELECT 1::BIGINT AS tag_id, 'TEXT' AS type UNION ALL SELECT 9, 'TEXT' FROM (SELECT 1 FROM customer LIMIT 1)")
def batch_types(spark, sf):
    return _in_batches(spark, sf).types.select("tag_id", "type")


@register("batch_tag_counts", "SELECT 1::BIGINT AS tag_id, count(*) AS tag_count FROM supplier UNION ALL SELECT 9, count(*) FROM customer")
def batch_tag_counts(spark, sf):
    """Entities of each attribute over both batches."""
    return _in_batches(spark, sf).tags


@register("useful_attributes", "SELECT tag_id FROM features GROUP BY 1 HAVING sum(abs(f_given_m - f_given_u)) >= 0.05 AND coalesce(corr(f_given_m, t1 + t2) >= 0, true) AND coalesce(corr(f_given_u, t1 + t2) <= 0, true)")
def useful_attributes(spark, sf):
    return learning.useful_attributes(_features(spark))


@register("duplicate_pairs", "SELECT a.s_suppkey AS id_a, b.s_suppkey AS id_b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def duplicate_pairs(spark, sf):
    return learning.duplicate_pairs(_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_nationkey").alias("cluster_id")))


V0_ENTITY = "SELECT count_if(is_m) AS n, avg(score) FILTER (is_m) AS m, avg(score) FILTER (NOT is_m) AS u FROM (SELECT score, a.s_nationkey = b.s_nationkey AS is_m FROM v0_cos JOIN supplier a ON a.s_suppkey = id_a JOIN supplier b ON b.s_suppkey = id_b WHERE id_a < id_b)"


@register("v0_entity_weights", f"SELECT 1::BIGINT AS tag_id, 10::DOUBLE AS initial_bias, round(m / u, 6) AS weight FROM ({V0_ENTITY})")
def v0_entity_weights(spark, sf):
    """The weights without a bias."""
    return _v0_weights(spark, sf, with_bias=False).withColumn("weight", _r("weight"))


@register("v0_entity_similarity", "SELECT id_a, id_b, round(score, 6) AS similarity FROM v0_cos")
def v0_entity_similarity(spark, sf):
    """Over the sum of all weights; with one attribute, they cancel."""
    return _v0_weighted(spark, sf, "all")


@register("v0_model_exists", "SELECT true AS model_exists")
def v0_model_exists(spark, sf):
    return resolution.v0_model_exists(_v0_weights(spark, sf))


@register("source_scores", "SELECT field_id, global_id, 'qgrams' AS method, round(score, 6) AS score FROM q_scores UNION ALL SELECT field_id, global_id, 'mdl', round(score, 6) FROM m_scores UNION ALL SELECT field_id, global_id, 'ngrams', round(score, 6) FROM n_scores")
def source_scores(spark, sf):
    """The job that runs several experts and writes their raw results."""
    found = jobs.all_scores(_fields(spark), _cells(spark, sf), _dictionary(spark, sf), _attributes(spark), _mappings(spark), ["qgrams", "mdl", "ngrams"], tokens=text.word_tokens)
    return found.select("field_id", "global_id", "method", _r("score"))


@register("candidate_pairs", "SELECT id_a, id_b FROM er_pairs")
def candidate_pairs(spark, sf):
    p = _prepared(spark, sf)
    return resolution.candidate_pairs(p, p, _features(spark), _thresholds(spark), ordered=True)
