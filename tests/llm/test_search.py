"""Searches against brute force, and near-duplicate classes against all pairs."""

import collections
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from loomery.llm import collision, dartminhash, mtree, neardup


def vectors(n=1500, d=16, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * rng.uniform(0.5, 2, (n, 1))
    x[1::50] = x[1]  # repeated vectors: ties
    return x.astype(np.float32)


def table(spark, x):
    rows = [(i, [float(v) for v in x[i]], i % 3) for i in range(len(x))]
    odd = [(100_000, None, 0), (100_020, [math.nan] * 16, 0), (100_040, [0.0] * 16, 0), (100_060, [math.inf] + [0.0] * 15, 0), (100_080, [None] + [1.0] * 15, 0), (None, [1.0] * 16, 0), (100_100, [1.0, 2.0], 0)]
    return spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int")


def best(scores, k):
    return [j for j, _ in sorted(scores, key=lambda p: (-p[1], p[0]))[:k]]


def test_mtree_is_exact(spark):
    x = vectors()
    out = collections.defaultdict(list)
    rows = table(spark, x)
    for r in mtree.top_products(rows, collision.every(rows, 20)).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.rank, r.vec_id, r.score))
    w = np.floor(64 * x.astype(float)).astype(np.int64)
    ids = [*range(len(x)), 100_040]
    w = np.vstack([w, np.zeros((1, 16), np.int64)])
    for q in [i for i in ids if i % 20 == 0]:
        s = w[ids.index(q)] @ w.T
        want = best([(j, int(s[k])) for k, j in enumerate(ids) if j != q], 20)
        assert [v for _, v, _ in out[q]] == want and [r for r, _, _ in out[q]] == list(range(1, 21))
        assert [c for _, _, c in out[q]] == [int(s[ids.index(j)]) for j in want]
    assert set(out) == {i for i in ids if i % 20 == 0}  # 100100 has no row of its own length


def test_mtree_few_rows_and_none(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in mtree.top_products(rows, collision.every(rows, 20)).collect()]
    assert sorted(got) == [(0, 1, 2, 4096), (0, 2, 1, 2048)]
    assert mtree.top_products(rows.limit(0), rows.limit(0)).collect() == []


def test_collision_counting_recall_and_scores(spark):
    x = vectors(4000, 16, 3)
    rows = table(spark, x)
    out = collections.defaultdict(list)
    for r in collision.nearest(rows, collision.every(rows, 20)).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
    e = x.astype(float)
    hit = total = 0
    for q in range(0, len(x), 20):
        s = e[q] @ e.T
        want = best([(j, s[j]) for j in range(len(x)) if j != q], 20)
        got = [v for v, _ in out[q]]
        hit, total = hit + len(set(got) & set(want)), total + 20
        assert len(got) == 20 and q not in got
        assert all(abs(score - s[v]) < 1e-9 for v, score in out[q])
    assert hit / total >= 0.9
    assert not {100_000, 100_020, 100_040, 100_060, 100_080} & set(out)


def test_collision_finds_all_of_few(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-0.5, 0.5]), (2, [0.0, 0.0]), (3, [0.9, 0.1])], "vec_id long, embedding array<float>")
    got = [(r.rank, r.vec_id) for r in collision.nearest(rows, collision.every(rows, 20)).orderBy("rank").collect()]
    assert got == [(1, 3), (2, 1)]


def clustered(n=4000, d=32, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((100, d))[rng.integers(0, 100, n)] + 0.15 * rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def asked(n):
    at = np.arange(0, n, 20)
    return at, [np.array([i]) for i in at], np.full(len(at), -np.inf)


def test_mtree_prunes_clustered_vectors_over_several_levels():
    """Of rows in clusters few distances are computed; of rows without any structure nearly all."""
    for x, share in ((clustered(), 0.35), (np.random.default_rng(1).uniform(0.9, 1, (2000, 3)), 0.3), (np.random.default_rng(1).standard_normal((2000, 64)), 1.0)):
        w = np.floor(64 * x).astype(np.int64)
        tree, (at, own, least) = mtree.MTree(w), asked(len(w))
        assert tree.root.levels() >= 3
        for i, (rows, scores) in zip(at, tree(w[at], 20, own, least)):
            s = w @ w[i]
            want = best([(j, int(s[j])) for j in range(len(w)) if j != i], 20)
            assert rows.tolist() == want and scores.tolist() == s[want].tolist()
        assert tree.computed <= share * tree.offered
    assert mtree.MTree(np.floor(64 * np.random.default_rng(0).standard_normal((500, 64))).astype(np.int64)).root.levels() >= 2


def test_mtree_bounds_of_earlier_blocks_lose_nothing():
    w = np.floor(64 * clustered(1000)).astype(np.int64)
    tree, (at, own, least) = mtree.MTree(w), asked(len(w))
    whole = tree(w[at], 20, own, least)
    floors = np.array([float(s[9]) for _, s in whole])
    for (rows, scores), (some, theirs), floor in zip(whole, tree(w[at], 20, own, floors), floors):
        assert some[: (scores >= floor).sum()].tolist() == rows[scores >= floor].tolist()


def test_mtree_of_huge_and_empty_and_repeated_vectors(spark):
    big = 2.0**24
    rows = [(0, [big, 1 / 64]), (1, [big, 2 / 64]), (2, [big, 1 / 64]), (20, [1.0, 1.0]), (20, [0.5, 0.5]), (40, []), (41, []), (61, [])]
    out = {}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in mtree.top_products(frame, collision.every(frame, 20)).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    b = int(64 * big)
    assert out[0][:2] == [(1, b * b + 2), (2, b * b + 1)] and out[0][2:] == [(20, 64 * b + 64), (20, 32 * b + 32)]
    assert [v for v, _ in out[20]] == [1, 0, 2] and out[40] == [(41, 0), (61, 0)]
    with np.testing.assert_raises(Exception):
        more = spark.createDataFrame([(0, [2.0**40]), (1, [2.0**40])], "vec_id long, embedding array<double>")
        mtree.top_products(more, more).collect()
    with np.testing.assert_raises(Exception):
        more = spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>")
        mtree.top_products(more, more).collect()


def test_collision_counting_verifies_few_rows_of_clusters():
    """Recall, and the share of rows verified: under a tenth of clustered rows, under a third of rows without structure."""
    for x, share in ((clustered(), 0.1), (np.random.default_rng(1).standard_normal((6000, 32)), 0.34)):
        index, (at, own, least) = collision.CollisionIndex(x), asked(len(x))
        at, own, least = at[:60], own[:60], least[:60]
        hit = 0
        for i, (rows, _) in zip(at, index(x[at], 20, own, least)):
            s = x @ x[i]
            hit += len(set(rows.tolist()) & set(best([(j, s[j]) for j in range(len(x)) if j != i], 20)))
        assert hit >= 0.9 * 20 * len(at) and index.verified <= share * index.offered, (hit, index.verified / index.offered)


def test_collision_of_none_empty_repeated_and_huge(spark):
    kind = "vec_id long, embedding array<double>"
    none = spark.createDataFrame([], kind)
    assert collision.nearest(none, none).collect() == []
    rows = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1e200, 1e199]), (2, [1.0, 1.0]), (2, [2.0, 1.0]), (20, []), (40, [3.0, 4.0]), (40, [3.0, 4.0])], kind)
    out = {}
    for r in collision.nearest(rows, collision.every(rows, 20)).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    assert set(out) == {0, 40} and out[0][0] == 1 and sorted(out[40]) == [0, 1, 2, 2] and len(out[0]) == 5


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def brute_classes(rows):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            union = sum((sets[a] | sets[b]).values())
            if not union or sum((sets[a] & sets[b]).values()) >= 0.8 * union:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def family(rng, n, copies, edits):
    base = [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(n)] = f"v{rng.randint(0, 10**6)}"
        yield " ".join(words)


def test_near_duplicate_classes_equal_all_pairs(spark):
    rng = random.Random(8)
    texts = [None, "", "  !! ", "one two", "One, two", "a b c d e f g a b c d e f g"]
    texts += [" ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for n, copies, edits in ((300, 12, 4), (120, 25, 8), (30, 6, 1), (8, 4, 1), (200, 40, 20)):
        texts += family(rng, n, copies, edits)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    got = {r.doc_id: r for r in neardup.classes(docs).collect()}
    assert {i: r.class_id for i, r in got.items()} == brute_classes(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_exact_copies_and_hubs_in_parts(spark, monkeypatch):
    """The same classes whether no, some or all groups of copies and hubs are dealt out."""
    from loomery.llm import _common

    rng = random.Random(12)
    texts = ["same words in all of these copies"] * 30 + [*family(rng, 80, 40, 3), *family(rng, 60, 9, 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for heavy, chunk in ((1, 256), (3, 4), (10_000, 2)):
        monkeypatch.setattr(_common, "HEAVY", heavy)
        monkeypatch.setattr(neardup, "HEAVY", heavy)
        monkeypatch.setattr(neardup, "CHUNK", chunk)
        got = {r.doc_id: r for r in neardup.classes(docs).collect()}
        assert {i: r.class_id for i, r in got.items()} == brute_classes(list(enumerate(texts)))
        assert got[7].copies == 30


def test_several_texts_of_one_id(spark):
    rows = [(1, "z z z z z z", "a"), (1, "b b b b b b", "b"), (1, "b b b b b b", "a"), (2, "other", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for n in (1, 4):
        kept = neardup.drop_near_duplicates(docs.repartition(n))
        assert sorted(map(tuple, kept.collect())) == [(1, "b b b b b b", "a"), (2, "other", "c")]


def test_drop_near_duplicates_keeps_one_row_of_each(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A b c d e f!", "y"), (None, "a b c d e f", "z"), (3, None, "z"), (4, "", "z"), (5, "other words stand here now", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted([r.doc_id for r in kept.collect()], key=str) == sorted([1, None, 3, 5], key=str)
    assert neardup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    off = []
    for _ in range(30):
        n = int(rng.integers(20, 400))
        ha = np.sort(rng.integers(0, 1 << 48, n).astype(np.uint64))
        cut = int(rng.integers(0, n))
        hb = np.sort(np.concatenate([rng.choice(ha, cut, replace=False), rng.integers(0, 1 << 48, n - cut).astype(np.uint64)]))
        wa, wb = rng.exponential(2, n), rng.exponential(2, n)
        s = dartminhash.signatures(np.repeat([0, 1], n), np.concatenate([ha, hb]), np.concatenate([wa, wb]), 2, 256)
        assert (s != dartminhash.NO_DART).all()
        off.append((s[0] == s[1]).mean() - dartminhash.similarity((ha, wa), (hb, wb)))
    assert abs(np.mean(off)) < 0.02 and np.sqrt(np.mean(np.square(off))) < 0.05


def test_elements_are_weighted_shingles():
    texts = ["a b c d e f g a b c d e", "x", "", "a b c d e f g a b c d e a b c d e", "é ü ñ"]
    owner, _, weights = dartminhash.elements([dartminhash.normal(t) for t in texts])
    for i, t in enumerate(texts):
        assert sorted(weights[owner == i].tolist()) == sorted(shingles(t).values())
