"""Queries behind the mapping and review screens."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.functions import stats, text
from loomery.operators.cluster import written
from loomery.operators.relational import by_hash, sample, sample_per
from loomery.plans.matching import affinities


def source_overview(sources: DataFrame, fields: DataFrame, mappings: DataFrame, cells: DataFrame) -> DataFrame:
    """source_id, name, n_fields, n_mapped, ratio, n_values, integrated."""
    mapped = mappings.select(F.col("local_id").alias("field_id")).distinct().withColumn("m", F.lit(1))
    by_source = fields.join(mapped, "field_id", "left").groupBy("source_id").agg(F.count("*").alias("n_fields"), F.count("m").alias("n_mapped"))
    per_field = cells.groupBy("field_id").agg(F.count("*").alias("n"))
    values = per_field.join(fields, "field_id").groupBy("source_id").agg(F.sum("n").alias("n_values"))
    x = sources.join(by_source, "source_id", "left").join(values, "source_id", "left").fillna(0, ["n_fields", "n_mapped", "n_values"])
    x = x.withColumn("ratio", F.coalesce(F.try_divide(F.col("n_mapped").cast("double"), F.col("n_fields")), F.lit(0.0)))
    return x.withColumn("integrated", F.col("n_fields") == F.col("n_mapped"))


def recent_batches(rows: DataFrame, day: Column, n: int = 10) -> DataFrame:
    """The n first days with their counts, numbered by day: the window runs over grouped rows."""
    grouped = rows.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    return grouped.orderBy("day").limit(n).withColumn("batch", F.row_number().over(Window.orderBy("day")))


def source_fields(fields: DataFrame, cells: DataFrame) -> DataFrame:
    """Fields with n_values, n_distinct, avg_val_len and sort_factor = distinct share, in screen order."""
    x = cells.groupBy("field_id").agg(F.count("*").alias("n_values"), F.count_distinct("value").alias("n_distinct"), F.avg(F.length("value")).alias("avg_val_len"))
    x = fields.join(x, "field_id", "left").withColumn("sort_factor", 1 - F.try_divide(F.col("n_distinct").cast("double"), F.col("n_values")))
    return x.orderBy(F.round("sort_factor", 2), "avg_val_len", "field_id")


def source_entities(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """source_id, entity_id, n_values of the entities of each source."""
    own = cells.join(fields.select("field_id", "source_id"), "field_id")
    return own.groupBy("source_id", "entity_id").agg(F.count("*").alias("n_values"))


def metadata(meta: DataFrame, key: str, n: Column | int) -> DataFrame:
    """meta_name and value of a source or field (key: source_id or field_id), in the order of names."""
    return meta.where(F.col(key) == n).select("meta_name", "value").orderBy("meta_name")


def source_stats(fields: DataFrame, cells: DataFrame) -> DataFrame:
    """source_id, n_fields, n_entities, n_values."""
    own = cells.join(fields.select("field_id", "source_id"), "field_id")
    counts = own.groupBy("source_id").agg(F.count_distinct("entity_id").alias("n_entities"), F.count("*").alias("n_values"))
    return fields.groupBy("source_id").agg(F.count("*").alias("n_fields")).join(counts, "source_id", "left").fillna(0, ["n_entities", "n_values"])


def attribute_overview(attributes: DataFrame, mappings: DataFrame) -> DataFrame:
    """global_id, name, n_fields mapped with an affinity over 0, in the order of names."""
    mapped = affinities(mappings).where("affinity > 0").groupBy("global_id").agg(F.count("*").alias("n_fields"))
    return attributes.join(mapped, "global_id", "left").fillna(0, ["n_fields"]).orderBy("name")


def table_preview(cells: DataFrame, columns: dict[int, str], n: int = 10, first: int = 1000, seed: int = 0) -> DataFrame:
    """n entities out of the first ones, wide again, missing cells as ''."""
    chosen = sample(cells.select("entity_id").distinct().orderBy("entity_id").limit(first), n, "entity_id", seed=seed)
    rows = cells.join(F.broadcast(chosen), "entity_id")  # n rows
    wide = rows.groupBy("entity_id").pivot("field_id", list(columns)).agg(F.min("value"))
    return wide.select("entity_id", *[F.coalesce(F.col(f"`{k}`"), F.lit("")).alias(name) for k, name in columns.items()])


def field_candidates(attributes: DataFrame, composite: DataFrame, field_id: int) -> DataFrame:
    """Every attribute with the field's composite score, 0 without one, best first."""
    own = composite.where(F.col("field_id") == field_id).select("global_id", "score")
    return attributes.join(own, "global_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0))).orderBy(F.desc("score"), "global_id")


def field_mappings(fields: DataFrame, mappings: DataFrame, composite: DataFrame, attributes: DataFrame) -> DataFrame:
    """Per field its mapping (score 2), else its best suggestion, else Unknown: field_id, local_name, match, score, is_mapping."""
    pick = Window.partitionBy("field_id").orderBy(F.desc("score"), "global_id")
    mapped = affinities(mappings).select(F.col("local_id").alias("field_id"), "global_id", F.lit(2.0).alias("score"), F.lit(True).alias("is_mapping"))
    both = mapped.unionByName(composite.select("field_id", "global_id", F.least("score", F.lit(1.999999)).alias("score"), F.lit(False).alias("is_mapping")))
    top = both.withColumn("r", F.row_number().over(pick)).where("r = 1").join(F.broadcast(attributes.select("global_id", F.col("name").alias("match"))), "global_id")
    x = fields.join(top.select("field_id", "match", "score", "is_mapping"), "field_id", "left")
    return x.select("field_id", "local_name", F.coalesce("match", F.lit("Unknown")).alias("match"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("is_mapping", F.lit(False)).alias("is_mapping"))


def field_mappings_by_name(found: DataFrame, pattern: str, n: int, exact: bool = False) -> DataFrame:
    """n fields whose lower-case name is like the pattern (not lower-cased), or equal to it: at most n/10 mapped ones, filled up with suggestions."""
    name = F.lower("local_name")
    hit = found.where(name == pattern if exact else name.like(pattern))
    mapped = hit.where("is_mapping").orderBy("field_id").limit(max(1, n // 10))
    return mapped.unionByName(hit.where("NOT is_mapping").orderBy(F.desc("score"), "field_id").limit(n))


def search_terms(column: Column, terms: list[str]) -> Column:
    """All lower-case terms stand somewhere in the text."""
    out = F.lit(True)
    for term in terms:
        out = out & F.contains(F.lower(column), F.lit(term.lower()))
    return out


def example_values(cells: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n different values per field in hash order."""
    return sample_per(cells.select("field_id", "value").distinct(), n, ["field_id"], "value", seed=seed)


def one_example(cells: DataFrame, seed: int = 0) -> DataFrame:
    """One value per field: the one of the largest hash."""
    return cells.groupBy("field_id").agg(F.max_by("value", F.struct(by_hash("value", seed=seed), "value")).alias("example"))


def shared_values(cells: DataFrame, mappings: DataFrame) -> DataFrame:
    """field_id, global_id, value: distinct values of a field that fields mapped to the attribute have, too."""
    values = cells.select("field_id", "value").distinct()
    known = values.join(affinities(mappings), F.col("field_id") == F.col("local_id")).select("global_id", "value", F.col("field_id").alias("from_id"))
    return values.join(known, "value").where("field_id <> from_id").select("field_id", "global_id", "value").distinct()


def score_breakdown(scores: DataFrame, methods: list[str]) -> DataFrame:
    """field_id, global_id and a column per method."""
    return scores.groupBy("field_id", "global_id").pivot("method", methods).agg(F.max("score"))


def pairs_to_compare(pairs: DataFrame, how: str, n: int = 1, near: float = 0.5, seed: int = 0) -> DataFrame:
    """Pairs to review: random, highest similarity, within 0.05 of a similarity, or by priority; unlabelled ones only where labels exist."""
    x = pairs.where("human_label IS NULL") if "human_label" in pairs.columns else pairs
    ids = ("entity_a", "entity_b")
    if how == "random":
        return sample(x, n, *ids, seed=seed)
    if how == "similar":
        return x.orderBy(F.desc("similarity"), *ids).limit(n)
    if how == "near":
        return sample(x.where(F.col("similarity").between(near - 0.05, near + 0.05)), n, *ids, seed=seed)
    if how == "priority":
        return x.orderBy("priority", *ids).limit(n)
    raise ValueError(f"no way of choosing pairs is called {how}")


#: One in PART first entities is in the part of the pairs that gives bounds.
PART = 256


def pairs_to_compare_each(pairs: DataFrame, hows: list[str], n: int = 1, near: float = 0.5, seed: int = 0, above: Column | None = None) -> DataFrame:
    """how and the pairs' columns: what pairs_to_compare() chooses each way, from one pass over all pairs.

    The n-th choice within a part of the pairs is a bound: no pair behind it is among the n of all pairs. The pass keeps the
    pairs up to a bound, which are few, and only they are ordered; a way for which the part has no n pairs keeps all its pairs.
    above: a column that is never under the similarity, null only where that is null, and costs less.
    """
    hashed = by_hash("entity_a", "entity_b", seed=seed)
    part = written(pairs.where(F.pmod(F.xxhash64("entity_a"), F.lit(PART)) == 0), "part")
    keep, last_hash = [], None
    for how in hows:
        found = pairs_to_compare(part, how, n, near, seed).select("*", hashed.alias("_hash")).collect()
        bound = found[-1] if len(found) == n else None
        if how in ("random", "near") and bound is not None:
            last_hash = bound["_hash"] if last_hash is None else max(last_hash, bound["_hash"])
        elif how == "near":
            keep.append(F.col("similarity").between(near - 0.05, near + 0.05))
        elif bound is None:
            keep.append(F.lit(True))
        else:
            a, b, x = F.col("entity_a"), F.col("entity_b"), F.col("similarity" if how == "similar" else "priority")
            tie = F.coalesce((a < bound["entity_a"]) | ((a == bound["entity_a"]) & (b <= bound["entity_b"])), F.lit(True))
            if how == "similar":  # nulls last
                least = bound["similarity"]
                first = F.lit(True) if above is None or least is None else above >= least
                keep.append(x.isNotNull() | tie if least is None else first & (x >= least) & ((x > least) | tie))
            else:  # nulls first
                most = bound["priority"]
                keep.append(x.isNull() & tie if most is None else x.isNull() | ((x <= most) & ((x < most) | tie)))
    if last_hash is not None:
        keep.append(hashed <= last_hash)
    few = written(pairs.where(functools.reduce(lambda x, y: x | y, keep)), "few")
    each = [pairs_to_compare(few, how, n, near, seed).select(F.lit(how).alias("how"), *pairs.columns) for how in hows]
    return functools.reduce(DataFrame.unionByName, each)


def guess(similarity: Column) -> Column:
    return F.when(similarity > 0.6, "Yes").otherwise("No")


def entity_data(cells: DataFrame, fields: DataFrame, mappings: DataFrame, attributes: DataFrame) -> DataFrame:
    """entity_id, name, value: cells under the name of the mapped attribute, else their own."""
    named = affinities(mappings).join(attributes, "global_id").groupBy("local_id").agg(F.min_by("name", F.struct(-F.col("affinity"), "global_id")).alias("global_name"))
    x = cells.join(fields, "field_id").join(named, F.col("field_id") == F.col("local_id"), "left")
    return x.select("entity_id", F.coalesce("global_name", "local_name").alias("name"), "value")


def compare_entities(data: DataFrame, a: int, b: int) -> DataFrame:
    """name, value_a, value_b, filled: attributes of two entities, those that both have first."""
    side = lambda e, c: data.where(F.col("entity_id") == e).groupBy("name").agg(F.min("value").alias(c))
    x = side(a, "value_a").join(side(b, "value_b"), "name", "full")
    filled = F.when(F.coalesce("value_a", F.lit("")) != "", 1).otherwise(0) + F.when(F.coalesce("value_b", F.lit("")) != "", 1).otherwise(0)
    return x.withColumn("filled", filled).orderBy(F.desc("filled"), "name")


def save_comparison(pairs: DataFrame, a: int, b: int, label: str) -> tuple[DataFrame, DataFrame]:
    """The pairs with the label set, and the match that a Yes (in any case) adds, stored smaller id first."""
    own = (F.least("entity_a", "entity_b") == min(a, b)) & (F.greatest("entity_a", "entity_b") == max(a, b))
    out = pairs.withColumn("human_label", F.when(own, label).otherwise(F.col("human_label")))
    rows = [(min(a, b), max(a, b))] if label.lower() == "yes" else []
    return out, pairs.sparkSession.createDataFrame(rows, "entity_a long, entity_b long")


def create_mappings(pairs: DataFrame) -> DataFrame:
    """Accepted (or rejected) pairs local_id, global_id as mapping (or anti-mapping) rows."""
    return pairs.select("local_id", "global_id", F.lit(1.0).alias("confidence"), F.lit(0.5).alias("authority"), F.lit("WEB").alias("who_created"), F.current_timestamp().alias("when_created"), F.lit("WEB").alias("why_created"))


def suggest_attribute(existing: DataFrame, name: str, reason: str) -> DataFrame:
    return existing.unionByName(existing.sparkSession.createDataFrame([(name, reason)], "name string, reason string"))


def set_config(config: DataFrame, name: str, value: str, module: str = "dedup") -> DataFrame:
    return config.withColumn("value", F.when((F.col("name") == name) & (F.col("module") == module), value).otherwise(F.col("value")))


def config_params(config: DataFrame, module: str = "dedup") -> DataFrame:
    return config.where(F.col("module") == module).select("name", F.coalesce("description", "name").alias("label"), "value")


def field_histogram(cells: DataFrame, field_id: int, most: int = 1000, seed: int = 0) -> DataFrame:
    """Histogram of the numbers among a sample of a field's values."""
    drawn = sample(cells.where(F.col("field_id") == field_id), most, "entity_id", "value", seed=seed)
    return stats.histogram(drawn.select(text.to_num("value").alias("x")), "x")


def top_attributes(composite: DataFrame, field_id: int, n: int = 5) -> DataFrame:
    return composite.where(F.col("field_id") == field_id).orderBy(F.desc("score"), "global_id").limit(n)


def detail(kind: str, cells: DataFrame, mappings: DataFrame, composite: DataFrame, scores: DataFrame, field_id: int, methods: list[str]) -> DataFrame:
    """The parts of the detail screen of a field: summary, examples, shared, distro, scoring."""
    own = F.col("field_id") == field_id
    if kind == "summary":
        return field_histogram(cells, field_id)
    if kind == "scoring":
        return score_breakdown(scores.where(own), methods)
    top = top_attributes(composite, field_id, 5 if kind == "examples" else 4).select("global_id")
    mapped = affinities(mappings).join(F.broadcast(top), "global_id")  # a few rows
    others = cells.join(mapped.select(F.col("local_id").alias("field_id"), "global_id"), "field_id")
    if kind == "examples":
        mine = example_values(cells.where(own), 10).select(F.lit(None).cast("long").alias("global_id"), "value")
        return mine.unionByName(sample_per(others.select("global_id", "value").distinct(), 10, ["global_id"], "value"))
    if kind == "shared":
        return shared_values(cells, mappings).where(own).join(F.broadcast(top), "global_id", "left_semi")
    if kind == "distro":
        parts = [stats.histogram(others.where(F.col("global_id") == r.global_id).select(text.to_num("value").alias("x")), "x").withColumn("global_id", F.lit(r.global_id)) for r in top.collect()]  # at most four
        out = parts[0] if parts else field_histogram(cells.limit(0), field_id).withColumn("global_id", F.lit(None).cast("long"))
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    raise ValueError(f"no part of the detail screen is called {kind}")
