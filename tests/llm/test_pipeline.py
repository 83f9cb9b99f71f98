"""Each stage on what its predecessor kept, against the brute-force versions."""

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from attestry.llm import shared
from attestry.llm.kernels import Kernel
from attestry.llm.packing import token_counter
from attestry.llm.quality import features, score, train
from test_decontam import brute as leaks
from test_jaccard import brute as near
from test_linededup import brute_whole as lines


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], sf).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    assert all(d.columns == docs.columns for d in seen[:-1])
    rows = [{r.doc_id: r for r in d.collect()} for d in seen[:-1]]

    assert set(rows[1].items()) <= set(rows[0].items()) and len(rows[1]) > 0.6 * len(rows[0])
    # the stage is the classifier's score against its threshold, text by text
    c = train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(rows[1]) == {d for d, r in rows[0].items() if score(c.model, features(Kernel(), pa.array([r.text])))[0] >= c.threshold}

    want = lines([(d, r.text) for d, r in rows[1].items()])
    assert {d: r.text for d, r in rows[2].items()} == want
    assert all(r.n_chars == len(r.text) for r in rows[2].values())

    pairs, sets = near([(d, r.text) for d, r in rows[2].items()], 0.6)
    gone, change = {d: d for d in sets}, True
    while change:
        change = False
        for a, b in pairs:
            low = min(gone[a], gone[b])
            change |= gone[a] != low or gone[b] != low
            gone[a] = gone[b] = low
    assert set(rows[3]) == {d for d, low in gone.items() if d == low}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {d for d, _ in leaks([(d, r.text) for d, r in rows[3].items()], items)}
    assert set(rows[3]) - set(rows[4]) == hit

    count = token_counter(str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    packed = {}
    for r in seen[-1].collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.n_tokens
    assert packed == {d: int(count(pa.array([r.text]))[0]) for d, r in rows[4].items()}


def test_run(spark, sf):
    since = len(shared.MADE)
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "piece", "first_token", "n_tokens", "bin_id", "slot"]
    # the last documents, and the token counts made of them
    assert len(shared.MADE) - since == 2 and out.count() > 100


LONG = "w" * 30_000 + " plain words of a very long text " * 3000
TWO = "the first line of some length that stands in two of them\nand another line that is long enough\n"


def test_cases(spark, sf, tmp_path):
    """Nulls, empty texts, ties, repeated rows, long texts and clashing columns, stage by
    stage and as a whole; then an empty table."""
    good = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:60]
    rows = [(d, t, "h", 1) for d, t in good] + [(9000, None, None, 1), (None, "", "h", None), (9001, LONG, "h", 2), (None, LONG + " x", "h", 2), (9002, TWO + "own", None, 3), (9003, TWO + "others", "h", 3), (9003, TWO + "others", "h", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, label int").withColumn("n_chars", F.length("text").cast("long")).withColumn("__h", F.lit("sig")).withColumn("bucket", F.lit(1))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(tmp_path / "none" / f"{t}.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    at, empty = str(tmp_path), docs.limit(0)
    for name in list(stages)[:-1]:
        out = stages[name](spark, docs, at)
        assert out.columns == docs.columns and stages[name](spark, empty, at).count() == 0
        kept = out.collect()
        texts = [(r.doc_id, r.text) for r in kept]
        if name == "quality_classifier":
            assert texts.count((9003, TWO + "others")) in (0, 2)
        else:
            assert texts.count((9000, None)) == 1 and texts.count((None, "")) == 1
            assert ((9001, LONG) in texts) == (name != "ngram_jaccard_join")  # a null id is the least
        if name == "line_dedup":
            assert texts.count((9003, "others")) == 2 and (9002, TWO + "own") in texts
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept)
        if name == "ngram_jaccard_join":
            assert (None, LONG + " x") in texts and texts.count((9003, TWO + "others")) == 0
    packed = stages["best_fit_packing"](spark, docs, at).collect()
    assert sum(r.doc_id == 9003 for r in packed) == 2 and not any(r.doc_id == 9000 for r in packed) and any(r.doc_id is None for r in packed)
    assert corpus_pipeline.run(spark, at).count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
