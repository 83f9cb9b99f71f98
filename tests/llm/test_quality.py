"""Held-out labels, the risk's gradient and the prior on made scores."""

import numpy as np
import pyarrow as pa

from attestry.llm.kernels import Kernel
from attestry.llm.quality import BUCKETS, STATS, Features, best_bin, counts, features, histogram, minimise, model_of, quality_filter, ratios, risk, score, space, train, unlabelled_sums


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learn, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    kept = {r[0] for r in quality_filter(docs, learn).select("doc_id").collect()}
    rows = test.collect()
    good = [r.doc_id in kept for r in rows if r.quality == 1 and not r.toxic]
    low = [r.doc_id in kept for r in rows if r.quality == 0]
    toxic = [r.doc_id in kept for r in rows if r.toxic]
    assert np.mean(good) > 0.975 and np.mean(low) < 0.05 and np.mean(toxic) < 0.45


def made(n, words, rng):
    at = np.concatenate([[0], np.cumsum(rng.integers(0, 6, n))])
    parts = [np.sort(rng.choice(words, b - a, replace=False)) for a, b in zip(at[:-1], at[1:])]
    return Features(np.concatenate(parts).astype(np.int32), at, rng.normal(size=(n, STATS)).astype(np.float32))


def test_risk_against_brute_force():
    """The risk by its definition, document by document, its gradient by differences, and a
    bracket below and above 0."""
    rng = np.random.default_rng(5)
    p, u = made(14, np.arange(8), rng), made(30, np.arange(12), rng)
    p.stats[:, 0] = 3.9
    sp = space(ratios(counts(p), 14, counts(u), 30), np.zeros(STATS), np.ones(STATS))
    assert 0 < len(sp.ratio) <= 12 and sp.size == len(sp.ratio) + 3 * STATS + 1
    signs = set()
    for prior in (None, 0.1, 0.9):
        of = risk(sp, p, lambda t: unlabelled_sums(sp, u, t), prior, 2.0)
        for scale in (0.1, 1.0, 0.0):
            theta = rng.normal(size=sp.size) * scale
            if not scale:  # all positives far above all others
                theta[len(sp.ratio)], theta[-1] = 3.0, -9.0
            m = model_of(sp, theta)

            def loss(f, y):
                return np.mean([np.log1p(np.exp(-y * x)) for x in score(m, f)])

            if prior is None:
                want = loss(p, 1) + loss(u, -1)
            else:
                rest = loss(u, -1) - prior * loss(p, -1)
                signs.add(rest > 0)
                want = prior * loss(p, 1) + max(0, rest)
            want += 2.0 / 14 * (theta[:-1] ** 2).sum() / 2
            value, g = of(theta)
            assert abs(value - want) < 1e-4
            for i in range(sp.size):
                step = np.zeros(sp.size)
                step[i] = 1e-5
                assert abs((of(theta + step)[0] - of(theta - step)[0]) / 2e-5 - g[i]) < 1e-5
    assert signs == {True, False}
    of = risk(sp, p, lambda t: unlabelled_sums(sp, u, t), None, 2.0)
    best = minimise(of, np.zeros(sp.size), 200, 1e-6)
    assert np.linalg.norm(of(best)[1]) < 1e-3 and of(best)[0] < of(np.zeros(sp.size))[0]
    assert all(of(best + rng.normal(size=sp.size) * 0.01)[0] >= of(best)[0] for _ in range(50))


def test_sums_over_parts_are_those_of_all():
    rng = np.random.default_rng(7)
    u = made(40, np.arange(20), rng)
    sp = space(np.where(np.arange(BUCKETS) < 20, 0.5, 0.0), u.stats.mean(0), u.stats.std(0))
    theta = rng.normal(size=sp.size)
    cut = [Features(u.words[u.at[a] : u.at[b]], u.at[a : b + 1] - u.at[a], u.stats[a:b]) for a, b in ((0, 13), (13, 13), (13, 40))]
    assert np.allclose(sum(unlabelled_sums(sp, f, theta) for f in cut), unlabelled_sums(sp, u, theta))


def test_ratios_follow_the_evidence():
    """At every size a word that all documents but no positive let expect has weight, and
    one seen once has little."""
    for n in (1, 10, 1000):
        r = ratios(np.array([0, 0, 30 * n, 0]), 150 * n, np.array([30 * n, 1, 200 * n, 0]), 1000 * n)
        assert r[0] < -1 and abs(r[1]) < 0.1 and abs(r[2]) < 0.1 and r[3] == 0


def test_prior():
    rng = np.random.default_rng(3)
    p, u = rng.normal(2, 1, 5000), np.concatenate([rng.normal(2, 1, 6000), rng.normal(-2, 1, 4000)])
    assert abs(best_bin(histogram(p), histogram(u), len(u)) - 0.6) < 0.05


def test_features_do_not_depend_on_neighbours():
    texts = ["Ab ab.\nab ab.\n", "", "é*** 12", "word " * 5000, None]
    k = Kernel()
    whole = features(k, pa.array(texts))
    for i, t in enumerate(texts):
        one = features(k, pa.array([t], pa.string()))
        assert np.array_equal(one.stats[0], whole.stats[i])
        assert np.array_equal(one.words, whole.words[whole.at[i] : whole.at[i + 1]])


def test_cases(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (None, "and the of to", 1.0), (4, "x " * 40000, 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality_score double")
    out = quality_filter(df, labels, score_as="quality_score")
    assert out.columns == ["doc_id", "text", "quality_score", "quality_score_"]
    out.collect()
    none = quality_filter(df, labels.limit(0))
    assert none.count() == 5 and none.columns == df.columns
    assert quality_filter(df.limit(0), labels).count() == 0
    assert train(df.limit(0), labels).model is None
