"""Against brute force over all pairs."""

import itertools
import re

import numpy as np
import pyspark.sql.functions as F

from attestry.llm import jaccard
from attestry.llm.jaccard import Join, bitmaps, blocked, exact_pairs, jaccard_join, near_dedup, possible, remaining

DDL = "doc_id long, text string"


def grams(text, n=3):
    w = re.findall(r"[\u3000-\ud7ff]|[a-z0-9\u0080-\u2fff\ue000-\U0010ffff]+", (text or "").lower())
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def brute(rows, t):
    sets = sorted((d, x, grams(x)) for d, x in set(rows))
    out = set()
    for a, b in itertools.combinations([s for s in sets if s[2]], 2):
        if len(a[2] & b[2]) >= t * len(a[2] | b[2]) - 1e-9:
            out.add((a[0], b[0]))
    return out, {d: s for d, _, s in sets}


def classes(want, docs):
    """The row of each document: the least document that pairs connect it with, and its pairs."""
    parent = {d: d for d in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {(d, root(d), sum(d in p for p in want)) for d in docs}


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    # near copies and a large group of them
    base = rows[3][1].split()
    rows += [(10_000 + i, " ".join(base[:i] + [f"w{i}"] + base[i + 1 :])) for i in range(25)]
    rows += [(20_000 + i, rows[5][1]) for i in range(25)]
    want, sets = brute(rows, 0.6)
    # the second: no order by frequency, so that all is linked, and groups in many blocks
    for sizes in ({"block_entries": 4000, "hot": 8}, {"block_entries": 4000, "hot": 2, "max_order_kb": 1, "bucket_entries": 900}):
        got = jaccard_join(spark.createDataFrame(rows, DDL), **sizes).collect()
        assert len(got) == len(rows) and {tuple(r) for r in got} == classes(want, sets)


def test_links_of_low_thresholds(spark):
    """A threshold below a half lets bitmaps of very different widths meet."""
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(words[i : i + n])) for i, n in enumerate((400, 300, 250, 160, 150, 130, 125, 120))]
    want, sets = brute(rows, 0.3)
    assert {tuple(r) for r in jaccard_join(spark.createDataFrame(rows, DDL), threshold=0.3, hot=2).collect()} == classes(want, sets)


def test_copies_count_in_links_and_rows_do_not_grow_with_pairs(spark):
    """A link of a set is one of each of its copies; texts that differ in signs are copies too."""
    base = [f"u{i}" for i in range(60)]
    near = " ".join(base[:-1] + ["end"])
    rows = [(i, " ".join(base)) for i in range(40)] + [(i, ", ".join(base).upper()) for i in range(40, 60)] + [(i, near) for i in range(60, 100)]
    got = {tuple(r) for r in jaccard_join(spark.createDataFrame([*rows, (100, "alone"), (101, None)], DDL)).collect()}
    assert got == {(i, 0, 99) for i in range(100)} | {(100, 100, 0), (101, 101, 0)}


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " .,! "), (4, "Same Words here today"), (5, "same words, HERE today!"), (5, "same words, HERE today!"), (6, "ab"), (7, "AB."), (None, "ab"), (8, "x " * 30000)]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], DDL + ", bucket int").withColumn("sig", F.lit(1))
    got = sorted(map(tuple, jaccard_join(df).collect()), key=str)
    assert got == sorted([(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (5, 4, 1), (6, 6, 2), (7, 6, 2), (None, 6, 2), (8, 8, 0)], key=str)
    kept = near_dedup(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 8]
    assert jaccard_join(df.limit(0)).count() == 0 and near_dedup(df.limit(0)).count() == 0


def test_one_of_each_group_stays(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, sets = brute([(r.doc_id, r.text) for r in docs.collect()], 0.6)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert {r.doc_id for r in near_dedup(docs).collect()} == {d for d in sets if root(d) == d}


def test_components_by_rounds_and_in_one_task(spark):
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 3), (205, 204), (204, 203)]
    e = spark.createDataFrame(edges, "a long, b long")
    nodes = e.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    from attestry.llm.jaccard import components

    want = {n: 0 if n == 100 else 203 if n > 200 else n // 20 * 20 for n in {x for y in edges for x in y}}
    for local in (4 << 20, 0):
        assert {r.sig: r.label for r in components(e, nodes, local).collect()} == want


def test_bitmaps_let_every_pair_pass():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 46, 700, dtype=np.uint64)
    sets = []
    for i in range(120):
        n = int(rng.integers(1, 700))
        own = rng.integers(0, 1 << 46, int(rng.integers(0, n // 2 + 1)), dtype=np.uint64)
        sets.append(np.unique(np.concatenate([base[int(rng.integers(0, 60)) :][: n - len(own)], own])) if i % 3 else np.unique(rng.integers(0, 1 << 46, n, dtype=np.uint64)))
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    size, sig = np.diff(at), np.arange(len(sets)).astype(np.uint64)
    for side in (np.full(len(sets), -1), np.arange(len(sets)) % 2):
        want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.6 * len(np.union1d(sets[i], sets[j])) - 1e-9 and (side[i] < 0 or side[i] != side[j])}
        a, b = possible(sig, size, bitmaps(np.concatenate(sets), at), np.zeros(len(sets), np.int64), side, 0.6)
        found = {(min(x), max(x)) for x in zip(a.tolist(), b.tolist())}
        assert want <= found and len(found) == len(a) and len(found) < 0.5 * len(sets) ** 2 / 2
        exact = {(min(x), max(x)) for p, q, *_ in exact_pairs(sig, sets, side, 0.6) for x in zip(p.tolist(), q.tolist())}
        assert exact == want and len(want) > 50


def test_pairs_of_dense_and_sparse_columns_in_tiles():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 90, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(90) < 0.85], rng.integers(0, 1 << 60, int(rng.integers(1, 20)), dtype=np.uint64)])) for _ in range(90)]
    sets += [np.unique(rng.choice(rng.integers(0, 1 << 60, 400, dtype=np.uint64), int(rng.integers(1, 30)))) for _ in range(90)]
    group, none = np.arange(180) % 2, np.full(180, -1)
    want = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i, j in itertools.combinations(range(180), 2) if group[i] == group[j] and len(np.intersect1d(sets[i], sets[j])) >= 0.6 * len(np.union1d(sets[i], sets[j])) - 1e-9}
    for rows in (7, 1024):
        found = [(min(x), max(x), c) for a, b, _, _, n in exact_pairs(np.arange(180), sets, none, 0.6, group, rows) for *x, c in zip(a.tolist(), b.tolist(), n.tolist())]
        assert sorted(found) == sorted((*p, c) for p, c in want.items()) and len(found) > 500


def test_ngrams_spread_thin_over_tasks_count_as_frequent(spark):
    """What every task sees once or twice is frequent in the table."""
    rows = [(i, "known to all " + " ".join(f"r{i}x{j}" for j in range(20))) for i in range(200)]
    join = Join(spark.createDataFrame(rows, DDL).repartition(100), "text", "doc_id", 3, 0.6, 1 << 10, 1 << 20, 64, 16, 64, 1 << 19)
    assert join.classes.value.max() >= 6 and join.linked.count() == 0


def test_classes_of_large_groups_without_all_their_pairs(spark, monkeypatch):
    """What near_dedup sends to buckets grows with the rows of a group, not with its pairs,
    and what the blocks side by side leave apart still meets."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words, f"x{i}"])) for i in range(200)]
    rows += [(1000 + i, " ".join([*words[:43], *(f"z{j}" for j in range(17)), f"y{i}"])) for i in range(90)]  # similarity 0.53 to the others, which bitmaps let pass
    rows += [(2000 + i, " ".join(words[: 54 + i % 6]) + f" v{i}") for i in range(60)]  # other sizes
    made, table = {}, jaccard.table

    def count(df, name):
        out = table(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard, "table", count)
    want, sets = brute(rows, 0.6)
    least = {c for _, c, _ in classes(want, sets)}
    assert {r.doc_id for r in near_dedup(spark.createDataFrame(rows, DDL), hot=8, bucket_entries=600).collect()} == least and len(least) > 1
    assert made["buckets"] <= 3 * made["refined"] and made["refined"] == 350 and made["apart"] and made["rest"]


def test_what_is_apart_meets(spark):
    """Pairs of different parts of large labels meet, pairs of the largest part do not."""
    nodes = [(i, 1, 1 + i % 7, i % 5 if i % 3 else 0) for i in range(60)] + [(100 + i, 2, 1, 9) for i in range(60)] + [(200, 3, 1, 1), (201, 3, 1, 2)]
    df = spark.createDataFrame(nodes, "sig long, label long, size long, part long")
    got = {}
    for r in remaining(df, F.lit(1), 10).collect():
        got.setdefault(r.bucket, []).append((r.sig, r.side))
    met = {(min(a, b), max(a, b)) for x in got.values() for (a, s), (b, r) in itertools.combinations(x, 2) if s < 0 or s != r}
    part = {n[0]: n[3] for n in nodes if n[1] == 1}
    assert {(a, b) for a, b in itertools.combinations(part, 2) if part[a] != part[b]} <= met
    assert not any(part.get(a, 0) == part.get(b, 0) == 0 for a, b in met) and max(map(len, got.values())) <= 22
    assert blocked(df, F.lit(1), 10, 10, 122, True).count() < 3 * len(nodes) < blocked(df, F.lit(1), 10, 10, 122).count()


def test_tiles_of_what_is_connected_are_not_counted(monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 60, 40, dtype=np.uint64)
    sets, calls = [np.unique(np.append(base, np.uint64(i))) for i in range(400)], []
    monkeypatch.setattr(jaccard, "overlaps", lambda x, y, f=jaccard.overlaps: calls.append(1) or f(x, y))
    top = np.arange(400)
    for a, b, *_ in exact_pairs(np.arange(400), sets, np.full(400, -1), 0.6, rows=20, known=lambda: top):
        top = jaccard.merged(top, a, b)
    assert not top.any() and len(calls) == 20
