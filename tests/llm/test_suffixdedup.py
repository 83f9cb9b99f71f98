"""Against a brute-force search for repeated windows of words."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from attestry.llm.suffixdedup import find_repeats, lpf, smaller

DDL = "doc_id long, text string"


def brute(rows, least):
    """(doc_id, start, end, n_words) of the union of windows seen before."""
    seen, out = set(), set()
    for d, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        words = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^ \t\n\r\v\f\x00\x1c-\x1f]+", text or "")]
        covered = [False] * len(words)
        for i in range(len(words) - least + 1):
            key = tuple(w for _, _, w in words[i : i + least])
            if key in seen:
                covered[i : i + least] = [True] * least
            seen.add(key)
        i = 0
        while i < len(words):
            j = i
            while j < len(words) and covered[j]:
                j += 1
            if j > i:
                out.add((d, words[i][0], words[j - 1][1], j - i))
            i = j + 1
    return out


def got(df, least=50, **kw):
    rows = find_repeats(df, min_words=least, **kw).collect()
    assert len(rows) == len({(r.doc_id, r.start, r.end, r.n_words) for r in rows})
    return {(r.doc_id, r.start, r.end, r.n_words) for r in rows}


def test_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    passage = " ".join(rows[7][1].split()[:60])
    rows += [(1000 + i, f"{rows[i][1][:200]} {passage} {rows[i + 1][1][:100]}") for i in range(30)]
    df = spark.createDataFrame(rows, DDL)
    want = brute(rows, 50)
    assert len(want) > 30
    assert got(df) == want
    assert got(df, batch_words=500) == want
    assert got(df, least=12) == brute(rows, 12)


def test_cases(spark):
    long = " ".join(f"w{i % 97}x{i % 89}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, "a b c"), (4, long), (5, long), (5, long), (None, long), (6, "é ü " * 70), (7, "x\n" * 200)]
    df = spark.createDataFrame([(*r, 0) for r in rows], DDL + ", m int")
    assert got(df) == brute(rows, 50)
    assert got(df.limit(0)) == set()


def test_equal_rows_are_one_document(spark):
    alone = " ".join(f"v{i}" for i in range(80))
    other = " ".join(f"u{i}" for i in range(70))
    within = " ".join([*(f"t{i}" for i in range(60))] * 2)
    rows = [(1, alone), (1, alone), (1, alone), (2, other), (3, f"x {other} y"), (3, f"x {other} y"), (4, within), (4, within), (None, alone + " z"), (None, alone + " z")]
    rows += [(None, " ".join(f"s{i}" for i in range(60)))] * 2
    want = brute(rows, 50)
    assert {d for d, *_ in want} == {3, 4, None}
    df = spark.createDataFrame(rows, DDL)
    assert got(df) == want
    assert {r.first_doc_id for r in find_repeats(df).collect() if r.doc_id != 4} == {1, 2}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=30), min_size=1, max_size=6))
def test_lpf(texts):
    words = np.array([w for t in texts for w in t], np.uint64)
    number = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    at = np.arange(len(words))
    length, source = lpf(words, number, at, at)
    ends = np.cumsum([len(t) for t in texts])

    def common(i, j):
        n = 0
        while i + n < ends[number[i]] and j + n < ends[number[j]] and words[i + n] == words[j + n]:
            n += 1
        return n

    for i in range(len(words)):
        assert length[i] == max([common(i, j) for j in range(i)], default=0)
        if length[i]:
            assert source[i] < i and common(i, source[i]) == length[i]


def test_smaller():
    rng = np.random.default_rng(1)
    for order in (np.arange(50), np.arange(50)[::-1], rng.permutation(200)):
        want = [max([j for j in range(i) if order[j] < order[i]], default=-1) for i in range(len(order))]
        assert smaller(order).tolist() == want
