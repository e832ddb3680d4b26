"""License scans, toxicity, quality and mixing against brute force and held-out accuracy."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from loomery.llm import licenses, mixing, quality, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_scan(text, wanted):
    """Every window of every template, one by one."""
    words = [w.encode() for w in WORD.findall((text or "").translate(A_Z))]
    starts, base, labels, best = [], set(), set(), 0.0
    for t in wanted:
        need = set(t.words)
        for i in range(len(words)):
            block = words[i : i + t.span]
            share = len(need & set(block)) / len(need)
            if share < t.threshold - 1e-9:
                continue
            if t.phrase:
                if tuple(block) == t.words:
                    starts.append(i)
                    base.add(t.label)
                    labels.add(t.label)
                    best = max(best, share)
            else:
                labels.add(t.label)
                best = max(best, share)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best


def test_license_scan_equals_brute_force(spark, small):
    rng = random.Random(3)
    pool = sorted({w for _, p in licenses.TEMPLATES for w in p.split()} | {"lorem", "ipsum", "été", "x1"})
    made = [None, "", "MIT License", "mit-license,MIT LICENSE! mit license", "license mit", "the Apache\nLicense", "gnu general public license license"]
    made += [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    for _, notice in licenses.TEMPLATES:
        words = notice.split()
        for drop in (0, 1, 2, 4):
            kept = [w for i, w in enumerate(words) if i not in rng.sample(range(len(words)), min(drop, len(words)))]
            made.append("lorem ipsum " * rng.randint(0, 9) + " ".join(kept).title() + " ipsum" * 5)
    made += [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(made)], "doc_id long, text string, label int")
    wanted = licenses.templates(licenses.BASE_PHRASES, licenses.TEMPLATES, licenses.THRESHOLD)
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert len(rows) == len(made)
    for i, t in enumerate(made):
        r = rows[i]
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)
        want = brute_scan(t, wanted)
        assert got == want[:6], (t, got, want)
        assert abs(r.score - want[6]) < 1e-12
    assert any(r.n_base > 1 for r in rows.values()) and any("bsd" in r.labels for r in rows.values())
    assert licenses.scan_licenses(docs.limit(0)).collect() == []


SYLLABLES = ["an", "the", "re", "on", "ing", "er", "tion", "st", "or", "he", "ea", "nd", "ou", "wh", "in", "es"]


def prose(rng, n, extra=(), share=0.0):
    return " ".join(rng.choice(extra) if extra and rng.random() < share else "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(7)
    bad = ["grumplesnort", "vexiblat", "quodmuck"]
    rows = [(i, prose(rng, rng.randint(20, 200), bad, 0.06) + f" {rng.choice(bad)}", 1) if i % 4 == 0 else (i, prose(rng, rng.randint(20, 200)), 0) for i in range(1200)]
    docs = spark.createDataFrame(rows + [(9001, None, 0), (9002, "", 0), (None, "x", 0)], "doc_id long, text string, truth int").select("doc_id", "text", F.lit("s").alias("score"))
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows] + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(docs, toxicity.learn_labels(docs, labels)).collect()
    truth = {i: t for i, _, t in rows}
    held = [(r.predicted, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 150 and np.mean([a == b for a, b in held]) > 0.95
    assert {r.predicted for r in out if r.doc_id in (9001, 9002)} == {0} and len(out) == 1203
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    kept = toxicity.drop_toxic(docs, toxicity.learn_labels(docs, labels))
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in out)


def test_toxicity_of_words_that_ordinary_text_holds_too(spark):
    """A language whose toxic words stand in ordinary text as well, 40 times more seldom, beside one whose words don't."""
    rng = random.Random(9)
    bad, common = ["grumplesnort", "vexiblat", "quodmuck"], ["zarboxil", "zarboxum", "zarboxet"]

    def one(i):
        toxic, lang = int(i % 4 == 0), "fr" if i % 5 == 0 else "en"
        share = (0.12 if toxic else 0.003) if lang == "fr" else 0.12 * toxic
        return i, prose(rng, 80, common if lang == "fr" else bad, share), lang, toxic

    rows = [one(i) for i in range(2400)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1, r[3]) for r in rows], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.score_documents(docs, toxicity.learn_labels(docs, labels)).collect()}
    for lang in ("en", "fr"):
        held = [(out[i].predicted, y) for i, _, x, y in rows if x == lang and out[i].held_out]
        assert np.mean([p for p, y in held if y]) > 0.8 and np.mean([p for p, y in held if not y]) < 0.05, lang


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.score_documents(docs, toxicity.learn_labels(docs, none)).collect()] == [0.0, 0.0]


def test_windows_cover_the_whole_text():
    rng = random.Random(1)
    for text in ("", "x" * 1000, prose(rng, 300), "é" * 77 + " a"):
        windows = toxicity.windows_of(text)
        assert b"".join(windows) == text.lower().encode() and max(map(len, windows)) <= toxicity.WINDOW


def test_ordinal_model_orders_three_grades(spark):
    rng = random.Random(5)
    make = {0: lambda: prose(rng, 60).upper() + "!!", 1: lambda: prose(rng, 30) + " " + prose(rng, 30).upper(), 2: lambda: prose(rng, 60)}
    rows = [(i, make[i % 3](), i % 3) for i in range(600)]
    docs = spark.createDataFrame(rows + [(900, None, 0), (None, "x", 0)], "doc_id long, text string, grade int")
    rated = docs.where("doc_id < 400").select("doc_id", F.col("grade").alias("quality"))
    model = quality.learn_ratings(docs, rated)
    assert list(model.thresholds) == sorted(model.thresholds) and model.grades == [0, 1, 2]
    out = {r.doc_id: r for r in quality.rate_documents(docs, model, least=2).collect()}
    assert np.mean([out[i].grade == g for i, _, g in rows[400:]]) > 0.95
    means = [np.mean([out[i].expected_grade for i, _, g in rows[400:] if g == k]) for k in range(3)]
    assert means == sorted(means)
    assert all(out[i].selected == (out[i].tail_probability >= 0.5) for i in out)
    kept = quality.keep_quality(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.selected}


def brute_likelihood(x, place, weights, thresholds):
    """Mean log likelihood of the cumulative-link model with its ridge, row by row."""
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    total = 0.0
    for row, g in zip(x, place):
        below = [0.0, *(sigmoid(t - float(row @ weights)) for t in thresholds), 1.0]
        total += math.log(max(1e-12, below[g + 1] - below[g]))
    return total / len(x) - quality.RIDGE / 2 * float(weights @ weights)


def test_ordinal_fit_tops_the_likelihood_of_three_grades():
    """No small step away from the fitted weights and thresholds has a much better likelihood, and the start's is worse."""
    rng = random.Random(11)
    texts = [prose(rng, 12, ["zub", "kef"], (0.0, 0.15, 0.4)[i % 3]) for i in range(240)]
    grades = [i % 3 for i in range(240)]
    model = quality.fit(texts, grades)
    x = np.stack([quality.features(t) for t in texts]).astype(float)
    w, t = model.weights.astype(float), model.thresholds
    fitted = brute_likelihood(x, grades, w, t)
    assert t[0] < t[1] and fitted > brute_likelihood(x, grades, 0 * w, np.log([1 / 2, 2])) + 0.5
    step = np.random.default_rng(0)
    for _ in range(20):
        dw, dt = step.standard_normal(len(w)) * 1e-3, step.standard_normal(2) * 1e-2
        up, down = brute_likelihood(x, grades, w + dw, t + dt), brute_likelihood(x, grades, w - dw, t - dt)
        assert abs(up - down) / 2 < 0.05 * (np.linalg.norm(dw) + np.linalg.norm(dt)) and max(up, down) < fitted + 2e-3


def test_grades_of_both_labels(spark):
    rows = [(1, 1, 0, 2), (2, 0, 0, 1), (3, 1, 1, 0), (4, 0, 1, 0), (5, None, None, None), (6, 1, None, 2), (7, None, 1, 0)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int, want int")
    assert [r.grade for r in quality.graded(labels).orderBy("doc_id").collect()] == [w for *_, w in rows]


def test_ordinal_gradient_matches_likelihood():
    """With one feature, the fitted curve puts the grades' shares where they are."""
    texts = ["aaaa"] * 50 + ["bbbb"] * 50
    ratings = [0] * 40 + [1] * 10 + [0] * 10 + [1] * 40
    model = quality.fit(texts, ratings)
    assert abs(model.at_least("aaaa")[0] - 0.2) < 0.05 and abs(model.at_least("bbbb")[0] - 0.8) < 0.05


def test_quality_with_one_grade_or_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 1)]):
        model = quality.learn_ratings(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
        out = quality.rate_documents(docs, model).collect()
        assert all(r.selected and r.grade == (1 if rows else 0) for r in out)
        assert quality.keep_quality(docs, model).count() == 2


def brute_loss(n, p, targets, rounds=30_000):
    """The least squares by plain projected gradient, for long."""
    r = np.ones(len(n))
    step = min(t / x for t, x in zip(targets, n @ p))
    for _ in range(rounds):
        r = np.maximum(0, r - p @ (step * ((n * r) @ p - targets) / targets))
    return float((((n * r) @ p - targets) ** 2 / targets).sum())


def test_rates_reach_the_least_squares(spark):
    rng = np.random.default_rng(0)
    n, p = rng.integers(1, 500, 400).astype(float), rng.dirichlet([0.5, 0.3, 0.2], 400)
    rows = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(400)], "doc_id long, n_tokens long, p0 double, p1 double, p2 double")
    for factors, feasible in (([1.3, 0.4, 0.8], True), ([3.0, 0.01, 0.5], False), ([1.0, 1.0, 1.0], True)):
        targets = (n @ p) * np.array(factors)
        fitted, steps, reached, wanted = mixing.fit_rates(rows, list(map(float, targets)), 3)
        got = np.array([r.rate for r in fitted.orderBy("doc_id").collect()])
        assert (got >= 0).all() and np.allclose(reached, (n * got) @ p) and np.allclose(wanted, targets)
        loss = float((((n * got) @ p - targets) ** 2 / targets).sum())
        best = brute_loss(n, p, targets)
        assert loss <= best * 1.02 + 1e-3 * targets.sum() * 1e-3, (factors, loss, best)
        if feasible:
            assert np.abs((n * got) @ p / targets - 1).max() < 1e-3
        folded = np.ones(len(n))
        for c in steps:
            folded = np.maximum(0, folded - p @ np.array(c))
        assert np.allclose(folded, got)


def mixed_docs(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        kind = i % 6
        words = prose(rng, 50, ["zzjunk", "qqspam"], 0.2) if kind == 1 else prose(rng, 50, ["vilex", "hatrix"], 0.2) if kind == 2 else prose(rng, 50)
        rows.append((i, words, "en", "s", len(words)))
    docs = spark.createDataFrame(rows + [(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 0 if i % 6 == 1 else 1, 1 if i % 6 == 2 else 0) for i in range(0, 600)] + [(3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def brute_posteriors(texts, domains, apart, asked, k=3):
    """The naive Bayes of the operator, in plain loops: weights by bucket, then the temperature of least loss."""
    counts, prior = {}, [math.log((domains.count(j) + 1) / (len(domains) + k)) for j in range(k)]
    for buckets, d, out in zip(texts, domains, apart):
        for b in () if out else buckets:
            counts.setdefault(b, [0] * k)[d] += 1
    whole = [1 + sum(c[j] for c in counts.values()) for j in range(k)]
    share = [x / sum(whole) for x in whole]
    weight = lambda b, j: math.log((counts[b][j] + mixing.SHRINK * share[j]) / (sum(counts[b]) + mixing.SHRINK) / share[j]) if b in counts else 0.0

    def posterior(buckets, t):
        z = [prior[j] + sum(weight(b, j) for b in buckets) / t for j in range(k)]
        e = [math.exp(x - max(z)) for x in z]
        return [x / sum(e) for x in e]

    loss = lambda t: sum(-math.log(max(1e-300, posterior(b, t)[d])) for b, d, out in zip(texts, domains, apart) if out)
    t = min(mixing.TEMPERATURES, key=loss)
    return [posterior(b, t) for b in asked], t


def test_posteriors_equal_brute_force(spark):
    docs, labels = mixed_docs(spark)
    rows = docs.select("doc_id", F.transform(mixing.words(F.coalesce("text", F.lit(""))), mixing.bucket).alias("b"), (F.pmod(F.xxhash64("doc_id", F.lit(mixing.HELD)), F.lit(mixing.HELD)) == 0).alias("apart"))
    rows = sorted(rows.where("doc_id IS NOT NULL").collect())
    domain = lambda i: 1 if i % 6 == 1 else 2 if i % 6 == 2 else 0
    want, t = brute_posteriors([r.b for r in rows], [domain(r.doc_id) for r in rows], [r.apart for r in rows], [r.b for r in rows])
    model = mixing.learn_domains(docs, mixing.domain_of(labels))
    assert model.temperature == t
    got = {r.doc_id: (r.p0, r.p1, r.p2) for r in mixing.with_posteriors(docs.select("doc_id", "text"), model).collect()}
    assert all(abs(a - b) < 1e-6 for r, w in zip(rows, want) for a, b in zip(got[r.doc_id], w))
    assert all(abs(a - math.exp(p) / sum(map(math.exp, model.priors))) < 1e-9 for a, p in zip(got[None], model.priors))


def test_posteriors_and_rates(spark):
    docs, labels = mixed_docs(spark)
    out = mixing.rates(docs, mixing.domain_of(labels), [0.8, 0.15, 0.05]).collect()
    right = [max(("clean", "junk", "toxic"), key=lambda d: r[f"p_{d}"]) == ("junk" if r.doc_id % 6 == 1 else "toxic" if r.doc_id % 6 == 2 else "clean") for r in out if r.doc_id is not None]
    assert np.mean(right) > 0.95 and len(out) == 601
    assert all(abs(r.p_clean + r.p_junk + r.p_toxic - 1) < 1e-9 and r.rate >= 0 for r in out)
    # Shares that known rates give can be met.
    total = sum(r.n_tokens for r in out)
    shares = [sum(r.n_tokens * r[f"p_{d}"] * (1.2 if max(r.p_clean, r.p_junk, r.p_toxic) == r.p_clean else 0.6) for r in out) / total for d in ("clean", "junk", "toxic")]
    out = mixing.rates(docs, mixing.domain_of(labels), shares).collect()
    for d, share in zip(("clean", "junk", "toxic"), shares):
        assert abs(sum(r.n_tokens * r.rate * r[f"p_{d}"] for r in out) / total - share) < 0.002


def test_mix_repeats_documents_and_keeps_columns(spark):
    docs, labels = mixed_docs(spark)
    mixed = mixing.mix(docs, mixing.domain_of(labels), [1.5, 1.0, 1.0])
    assert mixed.columns == docs.columns and mixed.dtypes == docs.dtypes
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    clean = [i for i in range(600) if i % 6 not in (1, 2)]
    assert all(copies.get(i, 0) >= 1 for i in clean)
    assert 1.3 < sum(copies[i] for i in clean) / len(clean) < 1.7
    again = {r.doc_id: r["count"] for r in mixing.mix(docs, mixing.domain_of(labels), [1.5, 1.0, 1.0]).groupBy("doc_id").count().collect()}
    assert again == copies


def test_mixing_without_labels_or_rows(spark):
    docs, labels = mixed_docs(spark)
    none = mixing.domain_of(labels.limit(0))
    assert mixing.mix(docs, none, [1.1, 1.0, 1.0]).count() == 601
    assert mixing.rates(docs.limit(0), mixing.domain_of(labels), [0.8, 0.1, 0.1]).count() == 0


def test_mixing_counts_words_between_any_white_space(spark):
    texts = ["a\nb\tc", "  a  b ", "a\r\n\r\nb", "a\u00a0b\u3000c", " \n", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = mixing.with_posteriors(docs, mixing.DomainModel([0.0, 0.0, 0.0], [])).collect()
    assert [r.n_tokens for r in sorted(rows)] == [len((t or "").split()) for t in texts]
    words = docs.select(mixing.words(F.col("text")).alias("w"), "doc_id").where("doc_id < 4").orderBy("doc_id").collect()
    assert [r.w for r in words] == [t.split() for t in texts[:4]]


def test_mixing_stage_thins_nothing_out(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    docs, labels = mixed_docs(spark)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(corpus_pipeline, "MIX_FACTORS", [1.1, 0.4, 0.4])
    mixed = corpus_pipeline.mix_domains(spark, docs, str(tmp_path))
    assert mixed.select("doc_id").distinct().count() == docs.count()


def test_toxic_words_by_one_rule_at_every_size():
    """Words 40 times as common in toxic text: found in a small table, and not lost in a larger one."""
    rng = random.Random(3)
    bad = ["zarboxil", "zarboxum", "zarboxet"]
    toxic, ordinary = [prose(rng, 80, bad, 0.12) for _ in range(600)], [prose(rng, 80, bad, 0.003) for _ in range(1200)]
    for n in (150, 600):
        assert any(b"zarbox" in w for w in toxicity.toxic_words(toxic[:n], ordinary[: 2 * n])), n
