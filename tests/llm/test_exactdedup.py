"""Against a dictionary of texts; the filter misses no repeated hash."""

import numpy as np

from attestry.llm.bloom import contains, repeat_filter
from attestry.llm.exactdedup import exact_dedup


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.unionAll(docs.where("doc_id % 3 = 0").withColumn("doc_id", docs.doc_id + 5000))
    first = {}
    for r in sorted(docs.collect()):
        first.setdefault(r.text, r)
    got = exact_dedup(docs).collect()
    assert sorted(got) == sorted(first.values())
    # a filter that is far too small costs work only
    assert sorted(exact_dedup(docs, bits_per_row=1, max_filter_mb=1).collect()) == sorted(first.values())


def test_filter(spark):
    rng = np.random.default_rng(2)
    h = rng.integers(-(2**62), 2**62, 60_000)
    h = np.concatenate([h, h[:500]])
    df = spark.createDataFrame([(int(x),) for x in h], "h long").repartition(7)
    packed, bits = repeat_filter(df, "h", len(h))
    found = contains(packed, bits, h)
    assert found[:500].all() and found[-500:].all()
    assert found[500:-500].mean() < 0.02


def test_cases(spark):
    long = "y" * 200_000
    rows = [(1, None, 1), (2, None, 1), (3, "", 1), (4, "", 1), (5, "a", 1), (5, "a", 1), (5, "a", 2), (None, "a", 1), (7, "A", 1), (8, long, 1), (9, long, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __hash int")
    out = exact_dedup(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, len(r.text) if r.text is not None else -1) for r in out.collect()) == [(1, -1), (2, -1), (3, 0), (5, 1), (7, 1), (8, 200_000)]
    assert exact_dedup(df.limit(0)).count() == 0
