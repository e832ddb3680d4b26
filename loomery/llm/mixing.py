"""Soft-membership mixing: rates for documents whose expected token totals by domain match targets. DataFrame functions only.

1. A labelled table names a domain for some documents. Naive Bayes on hashed words: of the occurrences of a bucket in
   labelled text, the share that lies in each domain, drawn towards the domain's share of all words by SHRINK occurrences;
   its log over the domain's share is the weight of each occurrence. Every word of a text counts, and buckets that labelled
   text doesn't hold weigh nothing. It is fitted on at most MAX_LABELLED rows (the smallest by a hash of the id); the model
   has BUCKETS weights a domain. Words of a text depend on each other, so the sum of weights is divided by the one of
   TEMPERATURES that gives the least log loss on the HELD-th part of the labelled rows, which the weights don't see.
2. A document's posterior is the softmax of the log priors and these sums.
3. With n tokens and posterior p of document i, rates r >= 0 minimise f = sum over domains of (T_k - t_k)^2 / t_k with
   T_k = sum_i r_i n_i p_ik, by projected gradient from r = 1: r_i <- max(0, r_i - sum_k p_ik c_k). In the metric that n_i
   gives, any gradient step has this form, with one number c_k per domain. c solves G c = T - t, G being the domains' Gram
   matrix over the documents of positive rate, so that domains which documents share don't slow each other down; where
   that doesn't lower f, c is halved, and at last the plain gradient (T - t) / t is taken with a step of min_k t_k / T_k(1),
   which can't overshoot. Each round is one pass over (n, p) that sends K totals and the Gram matrix to the driver; rates
   follow from the rounds' numbers, so no rate leaves the executors. Targets that no rates >= 0 meet are met as nearly as
   least squares allow.

Cases: a null, empty or blank text has no tokens and the prior as posterior; null ids are kept; repeated rows count as often as they
stand there; labels that are null take no part and of conflicting labels of an id the larger counts; without labels there
is no domain and every rate is 1; domains whose target is null keep their present total, and an empty table gives an empty
result. Other columns are kept by mix() and ignored by rates().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.llm._common import bounded_labels, materialize, release

#: Bounds of the labelled sample and of the hashed words.
MAX_LABELLED, BUCKETS = 10000, 1 << 16
#: Occurrences by which a bucket's shares are drawn to the domains' shares; one in HELD labelled rows chooses the temperature.
SHRINK, HELD = 10.0, 5
TEMPERATURES = [2.0**i for i in range(11)]
ROUNDS, TOLERANCE, HALVINGS = 60, 1e-4, 3
#: A round that lowers f by less than this share of it is the last.
LEAST_GAIN = 1e-6
#: Rounds after which rates are written, so that expressions stay short.
WRITE_EVERY = 20


def domain_of(labels: DataFrame) -> DataFrame:
    """doc_id and the domain that quality and toxic name: 0 clean, 1 junk, 2 toxic."""
    number = F.when(F.col("toxic") > 0, 2).when(F.col("quality") <= 0, 1).when(F.col("quality") > 0, 0)
    return labels.select("doc_id", number.alias("domain"))


DOMAINS = ["clean", "junk", "toxic"]
#: White space of all scripts parts words.
WORD = r"(?U)\S+"


def words(text: Column) -> Column:
    """The runs of all but white space; none of a text without."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


class DomainModel:
    """Log priors, and for each domain but the first the weights of all buckets against the first domain's."""

    def __init__(self, priors: list[float], weights: list[list[float]], temperature: float = 1.0):
        self.priors, self.weights, self.temperature = priors, weights, temperature

    def sums(self, held: Column) -> list[Column]:
        """Of an array of buckets the sum of weights for each domain; 0 for the first."""
        # Literals of BUCKETS numbers, which the optimizer parses once.
        arrays = [F.split(F.lit(",".join(f"{x:.9g}" for x in w)), ",").cast("array<double>") for w in self.weights]
        added = lambda a: lambda total, b: total + F.get(a, b)
        found = [F.aggregate(held, F.lit(0.0), added(a)) for a in arrays]
        return [F.lit(0.0), *found] if found else [F.lit(0.0)] * len(self.priors)


def learn_domains(docs: DataFrame, labelled: DataFrame, k: int = len(DOMAINS)) -> DomainModel | None:
    """labelled: doc_id, domain (0 .. k-1)."""
    chosen = bounded_labels(labelled, MAX_LABELLED, ["domain"])  # at most MAX_LABELLED rows
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    apart = F.pmod(F.xxhash64("doc_id", F.lit(HELD)), F.lit(HELD)) == 0
    held = materialize(texts.select("domain", F.transform(words(F.col("text")), bucket).alias("buckets"), apart.alias("apart")), "labelled")
    sizes = [int(x or 0) for x in held.agg(*[F.count_if(F.col("domain") == j) for j in range(k)]).first()]
    total = sum(sizes)
    if not total:
        return None
    priors = [math.log((s + 1) / (total + k)) for s in sizes]
    in_domains = [F.count_if(F.col("domain") == j).alias(f"c{j}") for j in range(k)]
    counts = held.where("NOT apart").select("domain", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(*in_domains).collect()  # at most BUCKETS rows
    model = DomainModel(priors, weights_of([(r.bucket, [r[f"c{j}"] for j in range(k)]) for r in counts], k))
    del counts
    release()
    scored = held.where("apart").select("domain", *[x.alias(f"s{j}") for j, x in enumerate(model.sums(F.col("buckets")))])
    losses = scored.agg(*[F.sum(_loss(priors, t)) for t in TEMPERATURES]).first()
    if losses[0] is not None:
        model.temperature = min(zip(losses, TEMPERATURES))[1]
    return model


def weights_of(counts: list[tuple[int, list[int]]], k: int) -> list[list[float]]:
    """The weights of all buckets for the domains from 1 on, from each bucket's occurrences by domain."""
    whole = [sum(c[j] for _, c in counts) + 1.0 for j in range(k)]
    share = [x / sum(whole) for x in whole]
    weights = [[0.0] * BUCKETS for _ in range(k - 1)]
    for b, c in counts:
        drawn = [(c[j] + SHRINK * share[j]) / share[j] for j in range(k)]
        for j in range(1, k):
            weights[j - 1][b] = math.log(drawn[j] / drawn[0])
    return weights


def _loss(priors: list[float], temperature: float) -> Column:
    """-log of the posterior of the row's domain, by the sums s0 .. s(k-1)."""
    logits = [F.col(f"s{j}") / temperature + p for j, p in enumerate(priors)]
    top = F.greatest(*logits)
    own = F.element_at(F.array(*logits), F.col("domain") + 1)
    return top - own + F.ln(sum((F.exp(x - top) for x in logits[1:]), F.exp(logits[0] - top)))


def with_posteriors(docs: DataFrame, model: DomainModel) -> DataFrame:
    """Adds n_tokens (words between white space) and p0 .. p(k-1), from each row alone."""
    k = len(model.priors)
    out = docs.withColumn("_held", F.transform(words(F.coalesce("text", F.lit(""))), bucket))
    sums = [(x / model.temperature + p).alias(f"_z{j}") for j, (x, p) in enumerate(zip(model.sums(F.col("_held")), model.priors))]
    # A generator of one row keeps the optimizer from putting these expressions in for each of their later uses.
    out = out.select(*docs.columns, F.explode(F.array(F.struct(F.size("_held").cast("long").alias("n_tokens"), *sums))).alias("_x")).select(*docs.columns, "_x.*")
    top = F.greatest(*[f"_z{j}" for j in range(k)])
    out = out.select("*", *[F.exp(F.col(f"_z{j}") - top).alias(f"_e{j}") for j in range(k)])
    whole = sum((F.col(f"_e{j}") for j in range(1, k)), F.col("_e0"))
    names = [*docs.columns, "n_tokens", *[f"p{j}" for j in range(k)]]
    return out.withColumns({f"p{j}": F.col(f"_e{j}") / whole for j in range(k)}).select(*names)


def _stepped(rate: Column, steps: list[list[float]]) -> Column:
    """The rate after these rounds; a round's step is a number for each domain."""
    for step in steps:
        rate = F.greatest(F.lit(0.0), rate - sum((F.col(f"p{j}") * c for j, c in enumerate(step[1:], 1)), F.col("p0") * step[0]))
    return rate


def _sums(rows: DataFrame, rate: Column, k: int) -> tuple[list[float], list[list[float]]]:
    """The domains' totals, and their Gram matrix over the rows of positive rate."""
    totals = [F.sum(F.col("n_tokens") * rate * F.col(f"p{j}")) for j in range(k)]
    free = F.when(rate > 0, F.col("n_tokens")).otherwise(0.0)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = [float(x or 0.0) for x in rows.agg(*totals, *[F.sum(free * F.col(f"p{i}") * F.col(f"p{j}")) for i, j in pairs]).first()]
    gram = [[0.0] * k for _ in range(k)]
    for (i, j), x in zip(pairs, row[k:]):
        gram[i][j] = gram[j][i] = x
    return row[:k], gram


def _solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gaussian elimination with pivots, over K unknowns; a small ridge keeps it defined."""
    k = len(right)
    ridge = 1e-9 * max(1e-300, sum(matrix[i][i] for i in range(k)))
    rows = [[*(x + ridge * (i == j) for j, x in enumerate(line)), y] for i, (line, y) in enumerate(zip(matrix, right))]
    for i in range(k):
        pivot = max(range(i, k), key=lambda r: abs(rows[r][i]))
        rows[i], rows[pivot] = rows[pivot], rows[i]
        for r in range(k):
            if r != i and rows[r][i]:
                ratio = rows[r][i] / rows[i][i]
                rows[r] = [x - ratio * y for x, y in zip(rows[r], rows[i])]
    return [line[k] / line[i] for i, line in enumerate(rows)]


def fit_rates(rows: DataFrame, targets: list[float | None], k: int) -> tuple[DataFrame, list[list[float]], list[float], list[float]]:
    """rows: n_tokens, p0 .. and any others, already written. Returns rows with `rate`, the rounds' numbers, the totals reached and the targets.

    targets: tokens per domain; null: the domain's present total. A target of 0 is weighed like a target of one token.
    """
    rows = rows.withColumn("rate", F.lit(1.0))
    now, gram = _sums(rows, F.col("rate"), k)
    wanted = [p if t is None else t for p, t in zip(now, targets)]
    scale = [max(1.0, t) for t in wanted]
    loss = lambda totals: sum((x - t) ** 2 / s for x, t, s in zip(totals, wanted, scale))
    safe = min((s / p for s, p in zip(scale, now) if p > 0), default=1.0)
    steps, recent = [], []
    for _ in range(ROUNDS):
        off = [x - t for x, t in zip(now, wanted)]
        if max(abs(x) / s for x, s in zip(off, scale)) < TOLERANCE:
            break
        whole = _solve(gram, off)
        tries = [[x / 2**h for x in whole] for h in range(HALVINGS)] + [[safe * x / s for x, s in zip(off, scale)]]
        for step in tries:
            reached, found = _sums(rows, _stepped(F.col("rate"), [*recent, step]), k)
            if loss(reached) < loss(now):
                break
        else:
            break
        gain = 1 - loss(reached) / loss(now)
        steps.append(step)
        recent.append(step)
        now, gram = reached, found
        if len(recent) == WRITE_EVERY:
            rows, recent = materialize(rows.withColumn("rate", _stepped(F.col("rate"), recent)), "rates"), []
        if gain < LEAST_GAIN:
            break
    return rows.withColumn("rate", _stepped(F.col("rate"), recent)), steps, now, wanted


def rates(docs: DataFrame, labelled: DataFrame, shares: list[float]) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate: rates that keep the total of tokens and give the domains these shares of it."""
    k = len(DOMAINS)
    model = learn_domains(docs, labelled, k) or DomainModel([0.0] * k, [])
    rows = materialize(with_posteriors(docs.select("doc_id", "text"), model).drop("text"), "posteriors")
    total = float(rows.agg(F.sum("n_tokens")).first()[0] or 0)
    fitted = fit_rates(rows, [s * total for s in shares], k)[0]
    return fitted.select("doc_id", "n_tokens", *[F.col(f"p{j}").alias(f"p_{name}") for j, name in enumerate(DOMAINS)], "rate")


def mix(docs: DataFrame, labelled: DataFrame, factors: list[float], least: float = 0.0) -> DataFrame:
    """The documents, all columns, each as often as its rate says; targets are the present totals times `factors`.

    Fitted rates under `least` are raised to it, which may carry a domain over its target.

    A rate's fraction is a chance that a hash of the row decides, so that a repeated run gives the same rows.
    """
    k = len(DOMAINS)
    model = learn_domains(docs, labelled, k)
    if model is None:
        return docs
    # The texts travel with their posteriors, so that each is read and scored once.
    renamed = docs.toDF(*["text" if c == "text" else f"own_{i}" for i, c in enumerate(docs.columns)])
    rows = materialize(with_posteriors(renamed, model), "posteriors")
    numbers = rows.select("n_tokens", *[f"p{j}" for j in range(k)])
    present = _sums(numbers, F.lit(1.0), k)[0]
    steps = fit_rates(numbers, [f * t for f, t in zip(factors, present)], k)[1]
    # The rounds again, as a fold over their steps: an expression of one size for any number of rounds.
    rounds = F.expr(f"array({','.join('array(' + ','.join(f'{x!r}D' for x in s) + ')' for s in steps)})") if steps else F.expr("cast(array() as array<array<double>>)")
    rate = F.aggregate(rounds, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - sum((F.col(f"p{j}") * s[j] for j in range(1, k)), F.col("p0") * s[0])))
    first = next((f"own_{i}" for i, c in enumerate(docs.columns) if c == "doc_id"), "text")
    chance = F.pmod(F.xxhash64(first, "text"), F.lit(1 << 20)) / float(1 << 20)
    copies = F.floor(F.greatest(F.lit(least), rate) + chance).cast("int")
    repeated = rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return repeated.select(*[F.col("text" if c == "text" else f"own_{i}").alias(c) for i, c in enumerate(docs.columns)])
