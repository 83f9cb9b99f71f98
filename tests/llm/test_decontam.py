"""Against all diagonals, without seeds."""

import itertools
import random
import re

import duckdb
import pandas as pd
import pyarrow as pa
import pytest

from attestry.llm import decontam
from attestry.llm.decontam import decontaminate, find_contamination
from attestry.llm.kernels import Kernel
from attestry.llm.queries import ORACLE

DDL = "doc_id long, text string"


def words(t):
    return re.findall(r"[\u3000-\ud7ff]|[a-z0-9\u0080-\u2fff\ue000-\U0010ffff]+", (t or "").lower())


def brute(docs, items, window=20, share=0.8, floor=5):
    out = {}
    for d, t in docs:
        w = words(t)
        for i, it in items:
            v = words(it)
            if len(v) < floor:
                continue
            n = min(window, len(v))
            need = share * n
            best = 0
            for diag in range(-len(v) + 1, len(w)):
                same = [0 <= diag + j < len(w) and w[diag + j] == v[j] for j in range(len(v))]
                inside = [0 <= diag + j < len(w) for j in range(len(v))]
                for s in range(len(v) - n + 1):
                    if all(inside[s : s + n]):
                        best = max(best, sum(same[s : s + n]))
            if best >= need - 1e-9:
                out[d, i] = best
    return out


def test_recall_against_brute_force(spark, sf):
    rng = random.Random(5)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:12] + [(90, "Alpha beta gamma delta epsilon."), (91, "too short")]
    fill = [f"w{rng.randrange(3000)}" for _ in range(4000)]
    docs = []
    for k in range(60):
        v = words(items[k % 13][1])
        for j in rng.sample(range(len(v)), int(len(v) * (k % 4) * 0.05)):
            v[j] = f"z{k}"
        a = rng.randrange(3900)
        docs.append((k, " ".join(fill[a : a + 40]) + ". " + ", ".join(v).title() + " " + " ".join(fill[a + 40 : a + 80])))
    docs += [(100 + k, " ".join(fill[k * 50 : k * 50 + 80])) for k in range(20)]
    want = brute(docs, items)
    assert len(want) >= 55
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matches for r in find_contamination(spark.createDataFrame(docs, DDL), bench).collect()}
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(want[k] == m for k, m in got.items())
    kept = {r.doc_id for r in decontaminate(spark.createDataFrame(docs, DDL), bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_parts_of_the_benchmark(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    import attestry.llm.decontam as m

    once = sorted(map(tuple, find_contamination(docs, bench).collect()))
    real = m._slices

    def three(b, i, t, mb):
        from pyspark.sql import functions as F

        for k in range(3):
            yield from real(b.where(F.col(i) % 3 == k), i, t, mb)

    m._slices = three
    try:
        assert sorted(map(tuple, find_contamination(docs, bench).collect())) == once and once
    finally:
        m._slices = real


def test_cases(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, None), (2, ""), (3, item), (3, item), (None, item.upper()), (5, "x " * 40000 + item), (6, "one two three")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], DDL + ", item_id int")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "")], "item_id long, text string")
    assert sorted(((r.doc_id or 0), r.item_id, r.first_word, r.words, r.matches) for r in find_contamination(docs, bench).collect()) == [(0, 7, 0, 10, 10), (3, 7, 0, 10, 10), (5, 7, 40000, 10, 10)]
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 6]
    assert find_contamination(docs.limit(0), bench).count() == 0 and decontaminate(docs, bench.limit(0)).count() == 7


def oracle(docs, items):
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    db.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    return sorted(db.sql(f"select doc_id, item_id, first_word, words, matches from ({ORACLE['op9_decontaminate']})").fetchall())


def test_short_items_with_all_the_substitutions_allowed(spark):
    rng = random.Random(3)
    items = [(n, " ".join(f"i{n}x{j}" for j in range(n))) for n in range(5, 21)]
    docs, want = [], set()
    for n, t in items:
        most = n // 5
        ways = list(itertools.combinations(range(n), most))
        more = list(itertools.combinations(range(n), most + 1))
        for gone in rng.sample(ways, min(60, len(ways))) + rng.sample(more, 5):
            v = [f"z{j}" if j in gone else x for j, x in enumerate(t.split())]
            if len(gone) == most:
                want.add((len(docs), n, 3, n, n - most))
            docs.append((len(docs), "before it stand " + " ".join(v) + " after"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in find_contamination(spark.createDataFrame(docs, DDL), bench).collect()}
    assert got == want
    assert sorted(want) == oracle(docs, items)
    kept = {r.doc_id for r in decontaminate(spark.createDataFrame(docs, DDL), bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, *_ in want}


@pytest.mark.parametrize("hits", [1 << 20, 50])
def test_short_items_of_few_words_against_sql(monkeypatch, hits):
    monkeypatch.setattr(decontam, "HITS", hits)
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choices("abc", k=n))
    docs = [(i, text(rng.randrange(0, 60))) for i in range(80)]
    items = [(i, text(rng.randrange(3, 21))) for i in range(60)]
    want = oracle(docs, items)
    ix = decontam.build_index(*zip(*items), decontam.MASKS, 5)
    got = decontam.find(ix, Kernel(), pa.array([t for _, t in docs]), 20, 0.8)
    assert len(want) > 100 and got == want


def whole_somewhere(masks, window, gone):
    return any(all(s + i not in gone for i, c in enumerate(m) if c == "1") for m in masks for s in range(window - len(m) + 1))


def test_masks_leave_out_no_way_to_differ():
    assert decontam.complete(decontam.MASKS, 20, 0.8) == decontam.MASKS
    assert all(whole_somewhere(decontam.MASKS, 20, set(c)) for c in itertools.combinations(range(20), 4))
    for masks, window, share in (((), 20, 0.8), (("11111111",), 20, 0.8), (decontam.MASKS, 13, 0.7), (decontam.MASKS, 200, 0.9)):
        got = decontam.complete(masks, window, share)
        assert set(masks) < set(got) and len(got[-1]) == window // (window - int(-(-share * window // 1)) + 1)


def test_long_items_with_every_way_to_differ_in_one_window():
    rng = random.Random(8)
    item = [f"i{j}" for j in range(33)]
    docs = []
    for gone in itertools.combinations(range(20), 4):
        at = rng.randrange(14)
        # all but one window differs throughout
        docs.append(" ".join(["x"] + [f"z{j}" if not at <= j < at + 20 or j - at in gone else w for j, w in enumerate(item)] + ["y"]))
    ix = decontam.build_index([1], [" ".join(item)], decontam.MASKS, 5)
    got = [r for lo in range(0, len(docs), 500) for r in decontam.find(ix, Kernel(), pa.array(docs[lo : lo + 500]), 20, 0.8)]
    assert len(got) == len(docs) == 4845 and {m for *_, m in got} == {16}


def test_ties_and_signs_of_their_own(spark):
    item = "alpha beta gamma delta epsilon zeta"
    han = "\u6570\u636e\u96c6\u7684\u8d28\u91cf"
    docs = [(1, f"x {item} y {item}"), (2, f"q{han}"), (3, f"a {han[:3]}x{han[3:]} {han[:5]}z"), (4, f"{item.replace('beta', 'other')} {item.replace('zeta', 'o')}")]
    items = [(1, item), (2, han)]
    got = sorted(map(tuple, find_contamination(spark.createDataFrame(docs, DDL), spark.createDataFrame(items, "item_id long, text string")).collect()))
    assert got == oracle(docs, items)
    assert [(r[0], r[2]) for r in got] == [(1, 1), (2, 1), (3, 8), (4, 0)]
