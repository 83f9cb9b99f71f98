"""Scores of retrieval and answers, and their summaries."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions.text import answer_correct, bound, c, hit_matches, normalize_text, portions, spread

MARK = "\u0001"


def normalize_all(arr: Column) -> Column:
    """normalize_text of each item, as one text, for lambdas cannot hold Python."""
    joined = F.array_join(F.transform(arr, lambda x: F.coalesce(x, F.lit(""))), MARK)
    return F.when(F.size(arr) > 0, F.split(normalize_text(joined), MARK)).otherwise(F.array().cast("array<string>"))


def retrieval(hits: Column | str, quotes: Column | str, answers: Column | str) -> Column:
    """Struct of measures of one question: first matching rank of each quote among the
    ranked hits; precision counts quotes, so it can exceed 1."""
    hits, quotes, answers = c(hits), c(quotes), c(answers)
    forms = F.struct(normalize_all(hits).alias("h"), normalize_all(quotes).alias("q"), normalize_all(answers).alias("a"))
    some = lambda r: r.isNotNull()
    first = lambda s: lambda quote: F.array_min(F.filter(F.transform(s["h"], lambda hit, i: F.when(hit_matches(hit, quote, s["a"]), i + 1)), some))
    ranks = lambda s: F.filter(F.transform(s["q"], first(s)), some)
    return bound(forms, lambda s: bound(F.struct(ranks(s).alias("r"), F.size(s["q"]).alias("nq"), F.size(s["h"]).alias("nh")), lambda t: measures(F.size(t["r"]), F.array_min(t["r"]), t["nq"], t["nh"])))


def measures(matched: Column, first: Column, quotes: Column, hits: Column) -> Column:
    return F.struct(
        (matched > 0).alias("evidence_hit"),
        F.least(matched / F.greatest(quotes, F.lit(1)), F.lit(1.0)).alias("evidence_recall"),
        F.when(hits > 0, matched / hits).otherwise(0.0).alias("evidence_precision"),
        F.coalesce(1.0 / first, F.lit(0.0)).alias("mrr"),
        first.cast("int").alias("first_evidence_rank"),
        hits.cast("int").alias("retrieved_count"),
    )


#: Of this worker's last task, the patterns of one part of the quotes.
_LAST: dict[str, tuple] = {}


def _patterns(key: str, quotes: list[str]) -> tuple:
    """An automaton of what a hit must hold for a quote, its first 24 characters or all of
    a shorter one; all quotes as one text, and where each begins."""
    if key not in _LAST:
        import ahocorasick

        of: dict[str, list[int]] = {}
        for i, q in enumerate(quotes):
            of.setdefault(q[:24], []).append(i)
        a = ahocorasick.Automaton()
        for p, ids in of.items():
            a.add_word(p, ids)
        if of:
            a.make_automaton()
        starts = list(accumulate((len(q) + 1 for q in quotes), initial=0))
        _LAST.clear()
        _LAST[key] = (a if of else None, MARK.join(quotes), starts, max(map(len, quotes), default=0))
    return _LAST[key]


def _matches(h: str, a, every: str, starts: list[int], longest: int) -> list[int]:
    """Numbers of the quotes that match one hit, as hit_matches says."""
    found = set()
    if a is not None:
        for _, ids in a.iter(h):
            found.update(ids)
    at = every.find(h) if len(h) <= longest else -1
    while at >= 0:
        i = bisect_right(starts, at) - 1
        found.add(i)
        at = every.find(h, starts[i + 1])
    return sorted(found)


#: About so many bytes of pairs are made before they leave the worker.
PAIRS_BYTES = 4 << 20


def match_pairs(hits: DataFrame, quotes: DataFrame, hit_text: str = "text", quote_text: str = "text", max_broadcast_mb: int = 64, keep: Sequence[str] | None = None) -> DataFrame:
    """Columns of both sides, those of quotes first, for pairs where a hit matches a quote;
    all columns, or those to keep, and no others are sent to Python. Quotes are broadcast in
    parts that are measured to be below max_broadcast_mb; hits are read once a part and never
    shuffle. Each hit is read once for all quotes of the part, by an Aho-Corasick automaton,
    instead of once for each. A worker holds a batch, the strings of a portion of it and
    PAIRS_BYTES of pairs."""
    quotes_names, hits_names = ([x for x in d.columns if keep is None or x in keep] for d in (quotes, hits))
    h = spread(hits).withColumn("__h", normalize_text(hit_text)).where("__h <> ''").select(*hits_names, "__h")
    q = quotes.withColumn("__q", normalize_text(quote_text)).where("__q <> ''").select(*quotes_names, "__q")
    size = quotes.agg(F.coalesce(F.sum(F.octet_length(F.col(quote_text))), F.lit(0))).collect()[0][0]
    parts = max(1, -(-int(size) * 2 // (max_broadcast_mb << 20)))
    names = [*quotes_names, *hits_names]
    schema = T.StructType([*(quotes.schema[x] for x in quotes_names), *(hits.schema[x] for x in hits_names)])
    wide_h, wide_q = hit_text in hits_names, quote_text in quotes_names
    out = None
    for i in range(parts):
        part = q if parts == 1 else q.where(F.pmod(F.xxhash64("__q"), F.lit(parts)) == i)
        shared, key = hits.sparkSession.sparkContext.broadcast(part.toArrow()), uuid4().hex

        def find(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            t = shared.value.combine_chunks()
            lengths = pc.binary_length(t["__q"]).to_pylist() if wide_q else None

            def made(batch: pa.RecordBatch, rows: list[int], ids: list[int]) -> pa.RecordBatch:
                left = t.select(quotes_names).take(pa.array(ids, pa.int64())).combine_chunks()
                return pa.record_batch([*(c.chunk(0) for c in left.columns), *(batch.column(c).take(pa.array(rows, pa.int64())) for c in hits_names)], names)

            for batch in batches:
                texts = batch.column("__h")
                for at, n in portions(texts):
                    rows, ids, held = [], [], 0
                    for r, x in enumerate(texts.slice(at, n).to_pylist(), at):
                        for j in _matches(x, *_patterns(key, t["__q"].to_pylist() if key not in _LAST else [])):
                            rows.append(r)
                            ids.append(j)
                            held += 64 + (len(x) if wide_h else 0) + (lengths[j] if wide_q else 0)
                            if held >= PAIRS_BYTES:
                                yield made(batch, rows, ids)
                                rows, ids, held = [], [], 0
                    if rows:
                        yield made(batch, rows, ids)

        pairs = h.mapInArrow(find, schema)
        out = pairs if out is None else out.unionAll(pairs)
    return out


#: How an answer that was not given is marked.
ANSWER_ERROR, QUOTA_ERROR = "answer_error", "api_quota_exhausted"


def summarize(results: DataFrame, *by: str, flat: bool = False, answer_error: str = ANSWER_ERROR) -> DataFrame:
    """Summary of result rows (retrieval struct, answer_correct, answer_judge_method)
    for all of them or by columns. Means are over all rows, a missing measure counts
    as 0; answers count where answer_correct is there, with flat everywhere. No rows
    give one row of zeros unless by columns."""
    n = F.count(F.lit(1))
    r = lambda f: F.coalesce(F.avg(F.coalesce(F.col("retrieval")[f].cast("double"), F.lit(0.0))), F.lit(0.0))
    correct, total = F.count_if(F.coalesce("answer_correct", F.lit(False))), n if flat else F.count("answer_correct")
    method = lambda m: F.count_if(F.col("answer_correct").isNotNull() & F.col("answer_judge_method").eqNullSafe(m))
    out = [
        n.alias("total"), r("evidence_hit").alias("evidence_hit_rate"), r("evidence_recall").alias("evidence_recall"), r("mrr").alias("mrr"),
        F.coalesce(correct / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("qa_accuracy"), correct.alias("qa_correct"), total.alias("qa_total"),
        *([] if flat else [method(answer_error).alias("qa_answer_errors"), method(QUOTA_ERROR).alias("qa_quota_errors")]),
        r("retrieved_count").alias("avg_retrieved_count"),
    ]
    return results.groupBy(*by).agg(*out)


def score_answers(predictions: DataFrame, judgements: DataFrame | None = None, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """predictions (keys, prediction, answers) with answer_correct, answer_judge_method
    and answer_judge: by rule, and where the rule says no by the judgements (keys,
    correct, reason), which only those rows look up; none means rule alone."""
    ruled = predictions.withColumn("__rule", answer_correct("prediction", "answers"))
    kind = "struct<correct:boolean,reason:string>"
    if judgements is None:
        return ruled.withColumn("answer_correct", F.col("__rule")).withColumn("answer_judge_method", F.lit("rule")).withColumn("answer_judge", F.lit(None).cast(kind)).drop("__rule")
    j = judgements.select(*keys, F.lit(False).alias("__rule"), F.struct(F.col("correct"), F.col("reason")).cast(kind).alias("answer_judge"))
    both = ruled.join(j, [*keys, "__rule"], "left")
    judged = F.coalesce(F.col("answer_judge.correct"), F.lit(False))
    return both.withColumn("answer_correct", F.col("__rule") | judged).withColumn("answer_judge_method", F.when(F.col("__rule"), "rule").otherwise("model_judge")).drop("__rule")


def percent(x: Column) -> Column:
    y = F.coalesce(x.cast("double"), F.lit(0.0))
    return F.when(F.isnan(y) | (F.abs(y) == float("inf")), 0.0).otherwise(F.floor(y * 10000 + 0.5) / 100)


def rounded(x: Column, digits: int) -> Column:
    return F.floor(F.coalesce(x.cast("double"), F.lit(0.0)) * 10**digits + 0.5) / 10**digits


def compare(summaries: DataFrame) -> DataFrame:
    """One row a platform, as percentages, from summaries with platform and ord."""
    s = F.col
    return summaries.select(
        "platform", "ord", percent(s("qa_accuracy")).alias("qa_accuracy_percent"), F.coalesce("qa_correct", F.lit(0)).alias("qa_correct"), F.coalesce("qa_total", "total", F.lit(0)).alias("qa_total"),
        percent(s("evidence_hit_rate")).alias("evidence_hit_rate_percent"), percent(s("evidence_recall")).alias("evidence_recall_percent"), rounded(s("mrr"), 4).alias("mrr"), rounded(s("avg_retrieved_count"), 2).alias("avg_retrieved_count"),
    )


def winner(compared: DataFrame) -> DataFrame:
    """The platform of the highest accuracy, the first of equals."""
    return compared.orderBy(F.desc("qa_accuracy_percent"), "ord").limit(1)


def question_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Questions of either platform side by side: id and both answer_correct."""
    return a.select("id", F.col("answer_correct").alias("correct_a")).join(b.select("id", F.col("answer_correct").alias("correct_b")), "id", "full_outer")


def ranked(hits: DataFrame, key: str, *order: Column, rank: str = "rank") -> DataFrame:
    return hits.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def top_k(hits: DataFrame, k: Column | int, rank: str = "rank") -> DataFrame:
    """Ranks up to k, which is kept between 1 and 20."""
    k = F.least(F.lit(20), F.greatest(F.lit(1), F.coalesce(k if isinstance(k, Column) else F.lit(k), F.lit(1))))
    return hits.where(F.col(rank) <= k)
