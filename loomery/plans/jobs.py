"""Job sequences over the plans: matching a source, resolving duplicates with the older weights, searching method weights."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions import text
from loomery.operators import blocks
from loomery.operators.cluster import written
from loomery.plans import matching, resolution


def expert_scores(method: str, fields: DataFrame, cells: DataFrame, dictionary: DataFrame, attributes: DataFrame, mappings: DataFrame, scope: Column | None = None, unmapped: bool = False, tokens=text.stemmed_tokens) -> DataFrame:
    """One expert by name, over all fields, a scope, or the unmapped ones."""
    own = mappings if unmapped else None
    if method == "qgrams":
        return matching.qgrams_scores(fields, attributes, mappings, scope, own)
    if method == "mdl":
        return matching.mdl_scores(cells, dictionary, fields, mappings, scope, own)
    if method == "ngrams":
        return matching.ngrams_scores(cells, dictionary, fields, attributes, mappings, scope, own, tokens)
    if method == "dist":
        return matching.dist_scores(cells, fields, mappings, scope, own)
    raise ValueError(f"no expert is called {method}")


def all_scores(fields: DataFrame, cells: DataFrame, dictionary: DataFrame, attributes: DataFrame, mappings: DataFrame, methods: list[str] = matching.METHODS, **options) -> DataFrame:
    """The raw results of the experts, written once for the composites that read them."""
    out = None
    for method in methods:
        one = expert_scores(method, fields, cells, dictionary, attributes, mappings, **options)
        out = one if out is None else out.unionByName(one)
    return written(out, "raw-results")


def schema_map(fields: DataFrame, cells: DataFrame, dictionary: DataFrame, attributes: DataFrame, mappings: DataFrame, **options) -> dict[str, DataFrame]:
    """All active experts, the two composites and the best match of each field."""
    methods = matching.default_methods(fields.sparkSession)
    raw = all_scores(fields, cells, dictionary, attributes, mappings, **options)
    return {"raw": raw, "ncomp": matching.ncomp(raw, methods), "mcomp": matching.mcomp(raw, methods), "best": matching.ncomp_max(raw, methods)}


def dedup_all(cells: DataFrame, matches: DataFrame, weights: DataFrame | None = None, important: Column | None = None, irrelevant: Column | None = None, bias: float = 1.0, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Similarities of all pairs that share an attribute's grams, and the weights learned from the known matches; without weights, they start from the attributes' importance.

    matches: pairs (entity_a, entity_b), or the groups whose members match one another (entity_id, group: array of whole numbers that have to agree), of which
    no pairs are built. Groups also take tables whose values nearly all differ; digits rounds what they give.
    """
    if weights is None:
        none = F.lit(False)
        weights = resolution.v0_initial_weights(cells.select("tag_id").distinct(), none if important is None else important, none if irrelevant is None else irrelevant, bias)
    if "group" in matches.columns:
        found = blocks.blocks(resolution.v0_vectors(cells), cells, matches)
        learned = written(resolution.v0_learn_weights_of_averages(blocks.group_averages(found), weights), "weights")
        known = {r.tag_id: r.weight for r in learned.collect()}  # a row per attribute
        return blocks.all_pairs(found, known, "larger", digits).withColumnRenamed("score", "similarity"), learned
    copies = resolution.v0_copies(cells)
    scores = written(resolution.v0_class_similarities(cells, copies), "similarities")
    learned = written(resolution.v0_learn_weights_of_copies(scores, copies, matches, weights), "weights")
    sizes = cells.join(copies.where("entity_id = class_id").select("entity_id"), "entity_id", "left_semi").select("entity_id", "tag_id")
    return resolution.v0_expand(written(resolution.v0_similarities(scores, learned, sizes), "class-similarities"), copies), learned


def random_weight_search(raw: DataFrame, truth: DataFrame, tries: int = 20, seed: int = 0) -> DataFrame:
    """Random weights for the experts, best success rate of the composite first: try, a column per method, success_rate. One pass for all tries."""
    rng, spark = random.Random(seed), raw.sparkSession
    rows = [(t, m, rng.random()) for t in range(tries) for m in matching.METHODS]
    tried = spark.createDataFrame(rows, "try int, method string, weight double")
    scored = raw.join(F.broadcast(tried), "method").groupBy("try", "field_id", "global_id").agg(F.sum(F.pow(F.col("score") * F.col("weight"), F.lit(2.0))).alias("score"))
    chosen = matching.best(scored, ["try", "field_id"], "score")
    rates = matching.error_rates(chosen, truth, ["try"]).select("try", "success_rate")
    return tried.groupBy("try").pivot("method", matching.METHODS).agg(F.max("weight")).join(rates, "try").orderBy(F.desc("success_rate"), "try")
