"""Schema matching: four experts score local fields against global attributes; composites and evaluation.

Inputs: fields (field_id, source_id, local_name), cells (field_id, entity_id, value text), attributes (global_id, name),
mappings (local_id, global_id, confidence, authority), dictionary (global_id, value). Scores: source_id, field_id,
global_id, method, score. A scope is a predicate on fields; it is applied to the fields before anything is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.functions import stats, text
from loomery.operators.relational import best

METHODS = ["qgrams", "mdl", "ngrams", "dist"]
TRAINING_THRESHOLD = 0.5


def affinities(mappings: DataFrame) -> DataFrame:
    """local_id, global_id, affinity: authority * confidence summed, within 0 and 1."""
    total = F.sum(F.col("authority") * F.col("confidence"))
    return mappings.groupBy("local_id", "global_id").agg(F.least(F.greatest(F.lit(0.0), total), F.lit(1.0)).alias("affinity"))


def max_affinities(mappings: DataFrame) -> DataFrame:
    return best(affinities(mappings), ["local_id"], "affinity")


def training_mappings(mappings: DataFrame, threshold: float = TRAINING_THRESHOLD) -> DataFrame:
    return affinities(mappings).where(F.col("affinity") >= threshold)


def scoped(fields: DataFrame, scope: Column | None = None, unmapped: DataFrame | None = None) -> DataFrame:
    """Fields of a source, one field, any predicate, or those that the mappings lack."""
    out = fields if scope is None else fields.where(scope)
    return out if unmapped is None else out.join(unmapped.select(F.col("local_id").alias("field_id")).where("field_id IS NOT NULL"), "field_id", "left_anti")


def weighted(rows: DataFrame, idf: DataFrame, missing: Column | None = None) -> DataFrame:
    """id, token, weight: tf times idf over the norm of the document. Tokens without idf take `missing`, or are left out."""
    joined = rows.join(idf, "token", "inner" if missing is None else "left")
    w = F.col("tf") * (F.col("idf") if missing is None else F.coalesce("idf", missing))
    joined = joined.select("id", "token", w.alias("w"))
    norms = joined.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")).where("norm > 0")
    return joined.join(norms, "id").select("id", "token", (F.col("w") / F.col("norm")).alias("weight"))


def cosines(local: DataFrame, known: DataFrame) -> DataFrame:
    """field_id, global_id, score over shared tokens. The global side is the smaller by far; AQE broadcasts it if it is small enough."""
    left = local.select(F.col("id").alias("field_id"), "token", F.col("weight").alias("a"))
    right = known.select(F.col("id").alias("global_id"), "token", F.col("weight").alias("b"))
    return left.join(right, "token").groupBy("field_id", "global_id").agg(F.sum(F.col("a") * F.col("b")).alias("score"))


def _idf(known: DataFrame, n_attributes: DataFrame) -> DataFrame:
    """token, idf = sqrt(ln(D / df)); n_attributes: one row, D."""
    df = known.groupBy("token").agg(F.count_distinct("id").alias("df"))
    return df.join(F.broadcast(n_attributes)).select("token", F.sqrt(F.ln(F.col("d") / F.col("df"))).alias("idf"))


def _result(scores: DataFrame, fields: DataFrame, method: str) -> DataFrame:
    return scores.join(fields.select("field_id", "source_id"), "field_id").select("source_id", "field_id", "global_id", F.lit(method).alias("method"), "score")


# Expert 1: q-grams of names


def name_grams(names: DataFrame, id_: str, name: str) -> DataFrame:
    """id, token, c."""
    return names.select(F.col(id_).alias("id"), F.explode(text.qgrams(name)).alias("token")).groupBy("id", "token").agg(F.count("*").alias("c"))


def qgram_stages(fields: DataFrame, attributes: DataFrame, mappings: DataFrame) -> dict[str, DataFrame]:
    """local and global term frequencies, idf, and D."""
    counted = name_grams(fields, "field_id", "local_name")
    local = counted.select("id", "token", F.ln(F.lit(1.0) + F.col("c")).alias("tf"))
    mapped = counted.join(affinities(mappings), F.col("id") == F.col("local_id")).groupBy("global_id", "token").agg(F.sum(F.col("c") * F.col("affinity")).alias("c")).withColumnRenamed("global_id", "id")
    own = name_grams(attributes, "global_id", "name")
    added = own.join(mapped.select("id", "token"), ["id", "token"], "left_anti")
    known = mapped.unionByName(added.withColumn("c", F.col("c").cast("double"))).select("id", "token", F.ln(F.lit(1.0) + F.col("c")).alias("tf"))
    return {"local": local, "global": known, "idf": _idf(known, attributes.agg(F.count("*").alias("d"))), "size": attributes.agg(F.count("*").alias("d"))}


def qgrams_scores(fields: DataFrame, attributes: DataFrame, mappings: DataFrame, scope: Column | None = None, unmapped: DataFrame | None = None) -> DataFrame:
    own = scoped(fields, scope, unmapped)
    stages = qgram_stages(fields, attributes, mappings)
    everything = stages["local"].select("token").union(stages["global"].select("token")).distinct()
    idf = everything.join(stages["idf"], "token", "left").join(F.broadcast(stages["size"])).select("token", F.coalesce("idf", F.sqrt(F.ln("d"))).alias("idf"))
    local = stages["local"].join(own.select(F.col("field_id").alias("id")), "id", "left_semi")
    return _result(cosines(weighted(local, idf), weighted(stages["global"], idf)), own, "qgrams")


# Expert 2: description length under a dictionary


def mdl_stages(cells: DataFrame, dictionary: DataFrame, fields: DataFrame, mappings: DataFrame) -> dict[str, DataFrame]:
    values = cells.select("field_id", F.substring("value", 1, 1000).alias("value")).groupBy("field_id", "value").agg(F.count("*").alias("c"))
    length = F.length("value")
    stats_ = values.groupBy("field_id").agg(F.sum("c").alias("n"), (F.sum(length * F.col("c")) / F.sum("c")).alias("avglen"), F.max(length).alias("maxlen"))
    trained = training_mappings(mappings)
    mapped = values.join(trained, F.col("field_id") == F.col("local_id")).select("global_id", "value", "affinity")
    every = mapped.unionByName(dictionary.select("global_id", F.substring("value", 1, 1000).alias("value"), F.lit(1.0).alias("affinity")).distinct())
    known = every.groupBy("global_id", "value").agg(F.least(F.lit(1.0), F.sum("affinity")).alias("aff"))
    cards = known.groupBy("global_id", F.length("value").alias("len")).agg(F.sum("aff").alias("card")).withColumn("lg_card", F.log2("card"))
    return {"values": values, "stats": stats_, "dictionary": known, "cards": cards}


def mdl_scores(cells: DataFrame, dictionary: DataFrame, fields: DataFrame, mappings: DataFrame, scope: Column | None = None, unmapped: DataFrame | None = None, by_length: bool = False) -> DataFrame:
    """greatest(0, 1 - description length / (8 * average length)). by_length also equates the lengths of matches and dictionary."""
    own = scoped(fields, scope, unmapped)
    stages = mdl_stages(cells, dictionary, fields, mappings)
    values = stages["values"].join(own.select("field_id"), "field_id", "left_semi")
    matches = values.join(stages["dictionary"], "value").groupBy("field_id", "global_id", F.length("value").alias("len")).agg(F.sum(F.col("c") * F.col("aff")).alias("card"))
    matches = matches.withColumn("lg", F.log2("card"))
    cards = stages["cards"].select("global_id", F.col("len").alias("d_len"), F.col("lg_card"))
    both = matches.join(cards, "global_id")
    both = both.where("len = d_len") if by_length else both
    sums = both.groupBy("field_id", "global_id").agg((F.sum("card") / F.count("*")).alias("mean_card"), F.sum(F.col("lg") + F.col("lg_card")).alias("bits"))
    x = sums.join(stages["stats"], "field_id")
    f = F.col("mean_card") / F.col("n")
    length = f * F.log2("maxlen") + (1 - f) * F.col("avglen") * 8 + f / F.col("n") * F.col("bits")
    score = F.greatest(F.lit(0.0), 1 - F.try_divide(length, 8 * F.col("avglen")))
    return _result(x.select("field_id", "global_id", score.alias("score")), own, "mdl")


# Expert 3: tokens of values


def ngram_stages(cells: DataFrame, dictionary: DataFrame, attributes: DataFrame, mappings: DataFrame, tokens=text.stemmed_tokens) -> dict[str, DataFrame]:
    def counted(rows: DataFrame, key: str) -> DataFrame:
        return rows.select(F.col(key).alias("id"), F.explode(tokens(F.col("value"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("c"))

    def shares(rows: DataFrame) -> DataFrame:
        total = rows.groupBy("id").agg(F.sum("c").alias("total"))
        return rows.join(total, "id").select("id", "token", (F.col("c") / F.col("total")).alias("tf"))

    local = counted(cells, "field_id")
    mapped = local.join(affinities(mappings), F.col("id") == F.col("local_id")).select(F.col("global_id").alias("id"), "token", (F.col("c") * F.col("affinity")).alias("c"))
    known = mapped.unionByName(counted(dictionary, "global_id").select("id", "token", F.col("c").cast("double").alias("c"))).groupBy("id", "token").agg(F.sum("c").alias("c"))
    known = shares(known)
    return {"local": shares(local), "global": known, "idf": _idf(known, attributes.agg(F.count("*").alias("d")))}


def ngrams_scores(cells: DataFrame, dictionary: DataFrame, fields: DataFrame, attributes: DataFrame, mappings: DataFrame, scope: Column | None = None, unmapped: DataFrame | None = None, tokens=text.stemmed_tokens) -> DataFrame:
    own = scoped(fields, scope, unmapped)
    stages = ngram_stages(cells, dictionary, attributes, mappings, tokens)
    local = stages["local"].join(own.select(F.col("field_id").alias("id")), "id", "left_semi")
    return _result(cosines(weighted(local, stages["idf"]), weighted(stages["global"], stages["idf"])), own, "ngrams")


# Expert 4: distributions of numbers


def dist_stats(cells: DataFrame) -> DataFrame:
    """field_id, n, mean, variance of the numeric values; at least two."""
    x = cells.select("field_id", (F.col("value") if dict(cells.dtypes)["value"] == "double" else text.to_num("value")).alias("x")).where("x IS NOT NULL")
    return x.groupBy("field_id").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("variance")).where("n > 1")


def dist_scores(cells: DataFrame, fields: DataFrame, mappings: DataFrame, scope: Column | None = None, unmapped: DataFrame | None = None) -> DataFrame:
    """Per field and attribute the largest p * affinity over the mapped fields, each compared alone; sentinels and p = 0 drop out."""
    own = scoped(fields, scope, unmapped)
    all_stats = dist_stats(cells)
    known = all_stats.join(affinities(mappings), F.col("field_id") == F.col("local_id")).select("global_id", "affinity", F.col("n").alias("gn"), F.col("mean").alias("gm"), F.col("variance").alias("gv"))
    local = all_stats.join(own.select("field_id"), "field_id", "left_semi")
    # A row per field against a row per mapping: schema sizes, not data sizes.
    pairs = local.crossJoin(F.broadcast(known))
    tested = pairs.withColumn("t", stats.welch_test("n", "gn", "mean", "gm", "variance", "gv")).where("t < 1.0")
    return _result(tested.groupBy("field_id", "global_id").agg(F.max((1 - F.col("t")) * F.col("affinity")).alias("score")), own, "dist")


# Composites


def raw_max(scores: DataFrame) -> DataFrame:
    return best(scores, ["field_id", "method"], "score")


def ncomp(scores: DataFrame, methods: DataFrame) -> DataFrame:
    """Sum of (score * weight)^2 over active methods (method, active, weight)."""
    active = methods.where("active").select("method", "weight")
    return scores.join(F.broadcast(active), "method").groupBy("source_id", "field_id", "global_id").agg(F.sum(F.pow(F.col("score") * F.col("weight"), F.lit(2.0))).alias("score"))  # a row per method


def ncomp_max(scores: DataFrame, methods: DataFrame) -> DataFrame:
    return best(ncomp(scores, methods), ["field_id"], "score")


def mcomp(scores: DataFrame, methods: DataFrame, only_active: bool = False) -> DataFrame:
    """A vote: the weights of the methods whose best match it is."""
    voters = (methods.where("active") if only_active else methods).select("method", "weight")
    return raw_max(scores).join(F.broadcast(voters), "method").groupBy("source_id", "field_id", "global_id").agg(F.sum("weight").alias("score"))


def mcomp_max(scores: DataFrame, methods: DataFrame, only_active: bool = False) -> DataFrame:
    return best(mcomp(scores, methods, only_active), ["field_id"], "score")


def default_methods(spark) -> DataFrame:
    return spark.createDataFrame([*[(m, True, 1.0) for m in METHODS], ("val_qgrams", False, 1.0)], "method string, active boolean, weight double")


# Evaluation


def error_rates(chosen: DataFrame, truth: DataFrame, group: list[str]) -> DataFrame:
    """Per group: fields, right, wrong, without truth, success and error rates, and right over wrong."""
    x = chosen.join(truth.select("field_id", F.col("global_id").alias("true_id")), "field_id", "left")
    right, wrong, unknown = F.count_if(F.col("global_id") == F.col("true_id")), F.count_if(F.col("global_id") != F.col("true_id")), F.count_if(F.col("true_id").isNull())
    out = x.groupBy(*group).agg(F.count("*").alias("n"), right.alias("n_right"), wrong.alias("n_wrong"), unknown.alias("n_unknown"))
    return out.withColumns({"success_rate": F.col("n_right") / F.col("n"), "error_rate": F.col("n_wrong") / F.col("n"), "ratio": F.try_divide(F.col("n_right").cast("double"), F.col("n_wrong"))})


def pair_features(scores: DataFrame) -> DataFrame:
    """field_id, global_id and a column for each expert's score, 0 where it has none."""
    return scores.groupBy("field_id", "global_id").pivot("method", METHODS).agg(F.max("score")).fillna(0.0, METHODS)


def labelled_features(scores: DataFrame, mappings: DataFrame) -> DataFrame:
    """pair_features() with label 1 where a mapping exists."""
    known = mappings.select(F.col("local_id").alias("field_id"), "global_id", F.lit(1.0).alias("label")).distinct()
    return pair_features(scores).join(known, ["field_id", "global_id"], "left").fillna(0.0, ["label"])


def decision_tree(training: DataFrame, points: DataFrame, depth: int = 4) -> DataFrame:
    """points with `accepted` (class 1) from a tree fitted on labelled features."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=METHODS, outputCol="features")
    model = DecisionTreeClassifier(maxDepth=depth, seed=1).fit(vectors.transform(training))
    return model.transform(vectors.transform(points)).withColumn("accepted", F.col("prediction") == 1.0).drop("features", "rawPrediction", "probability", "prediction")


def split_points(points: DataFrame, fields: DataFrame, tested: Column) -> tuple[DataFrame, DataFrame]:
    """Labelled features of the sources to train on and of those to test (a predicate on fields)."""
    own = points.join(fields.select("field_id", tested.alias("_tested")), "field_id")
    return own.where("NOT _tested").drop("_tested"), own.where("_tested").drop("_tested")


def tree_test(points: DataFrame, fields: DataFrame, tested: Column, depth: int = 4) -> DataFrame:
    """Precision, recall and F1 of a tree on sources that it wasn't fitted on: one row."""
    training, test = split_points(points, fields, tested)
    return precision_recall(decision_tree(training, test, depth), F.col("accepted"), F.col("label") > 0)


def precision_recall(judged: DataFrame, accepted: Column, truth: Column) -> DataFrame:
    """accepted, rejected, false positives and negatives, precision, recall, F1: one row."""
    x = judged.agg(F.count_if(accepted).alias("n_accepted"), F.count_if(~accepted).alias("n_rejected"), F.count_if(accepted & ~truth).alias("n_fp"), F.count_if(~accepted & truth).alias("n_fn"), F.count_if(truth).alias("n_true"))
    right = (F.col("n_accepted") - F.col("n_fp")).cast("double")
    x = x.withColumns({"precision": F.try_divide(right, F.col("n_accepted")), "recall": F.try_divide(right, F.col("n_true"))})
    return x.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


# Factoring of attribute names


def factor_names(fields: DataFrame, mappings: DataFrame, synonyms: DataFrame, thesaurus: DataFrame) -> dict[str, DataFrame]:
    """Fields whose names hold a synonym of their mapped attribute: the synonyms, what is left of the name, its parts, and those that the thesaurus (token, term) knows."""
    mapped = fields.join(affinities(mappings), F.col("field_id") == F.col("local_id")).select("field_id", "local_name", "global_id")
    knockouts = mapped.join(synonyms, "global_id").where(F.contains(F.lower("local_name"), F.lower("synonym")) & (F.length("synonym") > 0))
    leftovers = knockouts.groupBy("field_id", "global_id", "local_name").agg(F.collect_set("synonym").alias("synonyms"))
    leftovers = leftovers.withColumn("leftover", text.remove_substrs("local_name", F.col("synonyms")))
    parts = leftovers.select("field_id", "global_id", F.explode(text.dsubstrs("leftover")).alias("part"))
    gems = parts.join(thesaurus, F.lower(parts["part"]) == F.lower(thesaurus["token"])).select("field_id", "global_id", "part", "term")
    return {"knockouts": knockouts, "leftovers": leftovers, "parts": parts, "gems": gems}
