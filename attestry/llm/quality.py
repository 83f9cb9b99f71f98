"""Quality classifier from positive and unlabelled text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.kernels import Kernel, U, blank_lut, bytes_of, give_back, owners, pieces, word_lut
from attestry.llm.shared import col, fresh, table

BUCKETS = 1 << 18
STATS = 10


class Features(NamedTuple):
    """Distinct hashed words of documents, their offsets, and a row of figures each."""

    words: np.ndarray
    at: np.ndarray
    stats: np.ndarray


def features(k: Kernel, arr: pa.Array) -> Features:
    """Words without case and signs, each once, and shares of kinds of bytes, of
    repeated words and lines, and lengths. An empty text has no words and zeros."""
    text, offs = bytes_of(arr)
    h, _, _, wo = k.words(text, offs, word_lut())
    packed = np.sort((owners(wo).astype(U) << U(32)) | (h >> U(46)))
    packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])] if len(packed) else packed
    at = np.searchsorted(packed >> U(32), np.arange(len(offs)).astype(U))
    raw, _, _, ro = k.words(text, offs, blank_lut())
    lines, _, _, lo = k.lines(text, offs)

    def per(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return c[offs[1:]] - c[offs[:-1]]

    def distinct(x: np.ndarray, o: np.ndarray) -> np.ndarray:
        p = np.sort((owners(o).astype(U) << U(48)) | (x >> U(16)))
        p = p[np.concatenate([[True], p[1:] != p[:-1]])] if len(p) else p
        return np.diff(np.searchsorted(p >> U(48), np.arange(len(o)).astype(U)))

    n = np.maximum(np.diff(offs), 1)
    upper, digit = (text >= 65) & (text <= 90), (text >= 48) & (text <= 57)
    plain = digit | upper | (text >= 97) & (text <= 122) | (text >= 128) | (text <= 32)
    soft = np.isin(text, np.frombuffer(b".,;:'\"-?()", np.uint8))
    w, r, ln = np.diff(wo), np.diff(ro), np.diff(lo)
    one = lambda x: np.maximum(x, 1)
    stats = np.stack(
        [
            np.sqrt(per(~plain & ~soft) / n), per(soft) / n, np.sqrt(per(upper) / n), np.sqrt(per(digit) / n),
            np.where(r > 0, distinct(raw, ro) / one(r), 0) * np.minimum(1, r / 20), np.where(ln > 1, distinct(lines, lo) / one(ln) - 1, 0),
            np.log1p(r) / 10, np.minimum(np.diff(offs) / one(r), 40) / 10, np.where(r > 0, w / one(r), 0), per(text == 124) / n,
        ],
        axis=1,
    ).astype(np.float32)
    return Features((packed & U(0xFFFFFFFF)).astype(np.int32), at.astype(np.int64), stats)


class Model(NamedTuple):
    weights: np.ndarray
    dense: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float


def expand(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((stats - mean) / scale, -4, 4)
    return np.concatenate([z, np.abs(z), z * z / 4], axis=1)


def score(m: Model, f: Features) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(m.weights[f.words], dtype=np.float64)])
    return c[f.at[1:]] - c[f.at[:-1]] + expand(f.stats, m.mean, m.scale) @ m.dense + m.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def ratios(cp: np.ndarray, positives: int, cu: np.ndarray, documents: int) -> np.ndarray:
    """Of each word, the logarithm r of how many positives hold it by how many would if they
    were like the documents, each with one more, shrunk by its standard error: r times
    r^2 / (r^2 + se^2). No word is cut for being rare: one that should have been in many
    positives and is in none counts at any size of the table."""
    expected = positives * cu / max(1, documents)
    r = np.log((cp + 1) / (expected + 1))
    return np.where(cu > 0, r**3 / (r**2 + 1 / (cp + 1) + 1 / (expected + 1)), 0.0)


def only(f: Features, number: np.ndarray) -> Features:
    """The words that have a number, by it."""
    words = number[f.words]
    c = np.concatenate([[0], np.cumsum(words >= 0)])
    return Features(words[words >= 0], c[f.at], f.stats)


class Space(NamedTuple):
    """What a parameter vector means: words with a ratio by number, then figures, then bias."""

    number: np.ndarray
    ratio: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @property
    def size(self) -> int:
        return len(self.ratio) + 3 * STATS + 1


def space(full: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> Space:
    active = np.flatnonzero(np.abs(full) > 0.01)
    number = np.full(BUCKETS, -1, np.int32)
    number[active] = np.arange(len(active), dtype=np.int32)
    return Space(number, full[active], mean, scale)


def side(sp: Space, f: Features):
    """Of documents: their scores under a parameter vector, and the sum of their features
    weighted by a vector of one number each."""
    f, n = only(f, sp.number), len(sp.ratio)
    own, x = owners(f.at), expand(f.stats, sp.mean, sp.scale)

    def scores(theta: np.ndarray) -> np.ndarray:
        return np.bincount(own, (theta[:n] * sp.ratio)[f.words], len(x)) + x @ theta[n:-1] + theta[-1]

    def weighted(d: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(f.words, d[own], n) * sp.ratio, d @ x, [d.sum()]])

    return scores, weighted


def unlabelled_sums(sp: Space, f: Features, theta: np.ndarray) -> np.ndarray:
    """Sum of the loss of taking documents for negative, of its gradient, and their number."""
    scores, weighted = side(sp, f)
    s = scores(theta)
    return np.concatenate([[np.logaddexp(0, s).sum()], weighted(sigmoid(s)), [len(s)]])


def risk(sp: Space, p: Features, u: Callable[[np.ndarray], np.ndarray], prior: float | None, decay: float):
    """The risk of a parameter vector and its gradient; u gives unlabelled_sums. With a
    prior, the non-negative unbiased risk prior * R+(P) + max(0, R-(U) - prior * R-(P)) of
    the logistic loss; without, that of telling positive from unlabelled, for the estimate
    of the prior. decay counts once by the number of positives."""
    scores, weighted = side(sp, p)
    n = max(1, len(p.stats))
    penalty = np.full(sp.size, decay / n)
    penalty[-1] = 0

    def of(theta: np.ndarray) -> tuple[float, np.ndarray]:
        s, sums = scores(theta), u(theta)
        loss, g = sums[0] / max(1, sums[-1]), sums[1:-1] / max(1, sums[-1])
        plus, dp = np.logaddexp(0, -s).sum() / n, -sigmoid(-s) / n
        if prior is None:
            value, grad = plus + loss, weighted(dp) + g
        else:
            rest = loss - prior * np.logaddexp(0, s).sum() / n
            value, grad = prior * plus + max(0.0, rest), weighted(prior * dp)
            if rest > 0:
                grad = grad + g - weighted(prior * sigmoid(s) / n)
        return value + (penalty * theta * theta).sum() / 2, grad + penalty * theta

    return of


def minimise(of, theta: np.ndarray, most: int, tolerance: float = 1e-3, memory: int = 8) -> np.ndarray:
    """L-BFGS with halved steps, of at most so many evaluations."""
    value, g = of(theta)
    most, pairs, first = most - 1, [], max(1.0, float(np.linalg.norm(g)))
    while most > 0 and np.linalg.norm(g) > tolerance * first:
        q, rates = g.copy(), []
        for s, y in reversed(pairs):
            rates.append((s @ q) / (s @ y))
            q -= rates[-1] * y
        q = q * ((pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])) if pairs else q / first
        for (s, y), a in zip(pairs, reversed(rates)):
            q += s * (a - (y @ q) / (s @ y))
        step, moved = 1.0, False
        while most > 0 and not moved:
            new = of(theta - step * q)
            most -= 1
            moved = new[0] <= value - 1e-4 * step * (g @ q)
            step = step if moved else step / 2
        if not moved:
            break
        s, y = -step * q, new[1] - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        theta, value, g = theta + s, *new
    return theta


def model_of(sp: Space, theta: np.ndarray) -> Model:
    n = len(sp.ratio)
    weights = np.zeros(BUCKETS, np.float32)
    weights[np.flatnonzero(sp.number >= 0)] = theta[:n] * sp.ratio
    return Model(weights, theta[n:-1], sp.mean, sp.scale, float(theta[-1]))


def counts(f: Features) -> np.ndarray:
    return np.bincount(f.words, minlength=BUCKETS)


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, total: int, delta: float = 0.1) -> float:
    """Class prior by best-bin estimation: of the score thresholds, the one with the
    least upper bound on share of unlabelled above it by share of positives above it.
    Both are histograms over the same bins, from low to high scores."""
    n = max(1, int(positive.sum()))
    p = np.cumsum(positive[::-1]) / n
    u = np.cumsum(unlabelled[::-1]) / max(1, total)
    slack = np.sqrt(np.log(4 / delta) / (2 * n)) + np.sqrt(np.log(4 / delta) / (2 * max(1, total)))
    ok = p > 0.2
    if not ok.any():
        return 0.5
    at = int(np.argmin(np.where(ok, (u + slack) / np.maximum(p, 1e-9), np.inf)))
    return float(np.clip(u[at] / p[at], 0.05, 0.99))


def pick(f: Features, rows: np.ndarray) -> Features:
    n = np.diff(f.at)[rows]
    at = np.concatenate([[0], np.cumsum(n)])
    index = np.repeat((f.at[rows] - at[:-1]).astype(np.int32), n)
    index += np.arange(len(index), dtype=np.int32)
    return Features(f.words[index], at.astype(np.int64), f.stats[rows])


EDGES = np.linspace(-12, 12, 481)


def histogram(s: np.ndarray) -> np.ndarray:
    return np.histogram(np.clip(s, -11.999, 11.999), EDGES)[0]


class Classifier(NamedTuple):
    model: Model | None
    prior: float
    threshold: float


def packed(words: pa.Array, stats: pa.Array) -> Features:
    """Features back from two columns of bytes."""
    data, offs = bytes_of(words)
    return Features(data.view(np.int32), offs // 4, bytes_of(stats)[0].view(np.float32).reshape(-1, STATS))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in slices of so many rows, so that a worker needs the memory of one."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
        give_back()


GRAIN = float(1 << 20)  # sums travel as whole numbers of this fineness, so that their order does not matter


def train(
    df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", max_positive: int = 16_000, first_unlabelled: int = 8_000, evaluations: int = 10, decay: float = 3.0, keep: float = 0.995,
) -> Classifier:
    """A classifier from trusted positives, those labels with quality 1 that are not
    toxic, and unlabelled documents of df, which are all of df.

    max_positive bounds the labelled documents that it is fitted on, taken by the hash of
    the id. Word counts, the class prior and the risk are those of all documents of df: the
    prior is estimated from the scores that two models, each fitted without one half of the
    positives, give to all documents of the halves they have not seen; the risk of
    unlabelled documents and its gradient are sums over all of them, taken by tasks at each
    of at most so many evaluations. About first_unlabelled documents only serve to find
    where these begin, and to fit the two models for the prior. The threshold is the score
    that the share keep of held-out positives reaches. No negative label is read. Without a
    trusted positive or a document there is no model.
    """
    trusted = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    some, total = trusted.count(), df.count()
    if not some or not total:
        return Classifier(None, 0.0, 0.0)
    share = lambda c, n, most, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(1 << 20)) < min(1 << 20, most * (1 << 20) // n)
    ids = trusted.where(share(F.col("doc_id"), some, max_positive, 1)).select(F.col("doc_id").alias("pid"))
    d = df.select(col(doc_id).alias("d"), col(text).alias("t"))
    marked = d.join(F.broadcast(ids), d.d == ids.pid, "left").select("t", F.pmod(F.xxhash64("d", F.lit(3)), F.lit(10)).cast("int").alias("f"), F.col("pid").isNotNull().alias("p"), F.coalesce(share(F.col("d"), total, first_unlabelled, 2), F.lit(False)).alias("u"))  # ids: at most max_positive, about

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The features of each document, and in how many of the task's each word is."""
        k, sums, figures = Kernel(), np.zeros(BUCKETS, np.int64), np.zeros(2 * STATS)
        names = ["f", "p", "u", "words", "stats", "word", "n"]
        for batch in batches:
            for part in pieces(batch, "t"):
                f = features(k, part.column(0))
                sums += counts(f)
                x = f.stats.astype(np.float64)
                figures += np.concatenate([x.sum(0), (x * x).sum(0)])
                data, n = f.words.tobytes(), part.num_rows
                words = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((f.at * 4).astype(np.int32).tobytes()), pa.py_buffer(data)])
                stats = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 4 * STATS).astype(np.int32).tobytes()), pa.py_buffer(f.stats.tobytes())])
                yield pa.record_batch([*part.columns[1:], words, stats, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names)
        sums = np.concatenate([sums, np.rint(figures * GRAIN).astype(np.int64)])
        at = np.flatnonzero(sums)
        none = lambda kind: pa.nulls(len(at), kind)
        yield pa.record_batch([none(pa.int32()), none(pa.bool_()), none(pa.bool_()), none(pa.binary()), none(pa.binary()), pa.array(at.astype(np.int32)), pa.array(sums[at])], names)

    kinds = "f int, p boolean, u boolean, words binary, stats binary, word int, n long"
    found = table(marked.mapInArrow(extract, kinds), "features")
    every = found.where("words is not null")
    # a task sends a number for each parameter: fewer and longer tasks send less
    every = every.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, every.rdd.getNumPartitions() // 4))
    cu = np.zeros(BUCKETS + 2 * STATS, np.int64)
    got = found.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).toArrow()  # no more than BUCKETS rows
    cu[got["word"].to_numpy()] = got["n"].to_numpy()
    cu, figures = cu[:BUCKETS], cu[BUCKETS:].reshape(2, STATS) / GRAIN / total
    mean, scale = figures[0], np.sqrt(np.maximum(figures[1] - figures[0] ** 2, 0)) + 1e-3
    got = every.where("p or u").select("f", "p", "u", "words", "stats").toArrow()
    if not got.num_rows:
        return Classifier(None, 0.0, 0.0)
    sample = packed(got["words"], got["stats"])
    fold, p, u = (got[c].to_numpy() for c in ("f", "p", "u"))
    del got
    # rows come in the order in which tasks end; sums need a fixed one
    c = np.concatenate([[0], np.cumsum(sample.words, dtype=np.int64)])
    by = np.lexsort((c[sample.at[1:]] - c[sample.at[:-1]], sample.stats[:, 7], sample.stats[:, 6], fold))
    sample, fold, p, u = pick(sample, by), fold[by], p[by], u[by]
    if not p.any() or not u.any():
        return Classifier(None, 0.0, 0.0)
    rows = lambda mask: pick(sample, np.flatnonzero(mask))
    local = lambda sp, f: lambda theta: unlabelled_sums(sp, f, theta)

    def fitted(mask: np.ndarray, others: np.ndarray, prior: float | None) -> tuple[Space, np.ndarray, Features]:
        mine = rows(p & mask) if (p & mask).any() else rows(p)
        sp = space(ratios(counts(mine), len(mine.stats), cu, total), mean, scale)
        unlabelled = rows(u & others) if (u & others).any() else rows(u)
        return sp, minimise(risk(sp, mine, local(sp, unlabelled), prior, decay), np.zeros(sp.size), 40), mine

    half = fold % 2
    halves = [model_of(*fitted(half != i, half != i, None)[:2]) for i in (0, 1)]
    seen = sum(histogram(score(halves[i], rows(p & (half == i)))) for i in (0, 1))
    shared = df.sparkSession.sparkContext.broadcast(halves)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(EDGES) - 1, np.int64)
        for batch in slices(batches):
            f, odd = packed(batch.column(1), batch.column(2)), batch.column(0).to_numpy() % 2
            sums += histogram(np.where(odd == 0, score(shared.value[0], f), score(shared.value[1], f)))
        bins = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(bins), pa.array(sums[bins])], ["bin", "n"])

    corpus = np.zeros(len(EDGES) - 1, np.int64)
    for b, n in every.select("f", "words", "stats").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n")).collect():
        corpus[b] = n
    prior = best_bin(seen, corpus, total)
    held = fold >= 8
    sp, theta, mine = fitted(~held, np.ones(len(fold), bool), prior)
    meaning = df.sparkSession.sparkContext.broadcast(sp)

    def everywhere(theta: np.ndarray) -> np.ndarray:
        now = df.sparkSession.sparkContext.broadcast(theta)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(meaning.value.size + 2)
            for batch in slices(batches):
                sums += unlabelled_sums(meaning.value, packed(batch.column(0), batch.column(1)), now.value)
            v = np.rint(sums * GRAIN).astype(np.int64)
            at = np.flatnonzero(v)
            yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(v[at])], ["i", "v"])

        got = every.select("words", "stats").mapInArrow(add, "i int, v long").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # a row a parameter
        out = np.zeros(len(theta) + 2)
        out[got["i"].to_numpy()] = got["v"].to_numpy() / GRAIN
        now.unpersist()
        return out

    model = model_of(sp, minimise(risk(sp, mine, everywhere, prior, decay), theta, evaluations, 0.01))
    out = score(model, rows(p & held) if (p & held).any() else rows(p))
    return Classifier(model, prior, float(np.quantile(out, 1 - keep)))


def quality_filter(
    df: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", max_positive: int = 16_000, keep: float = 0.995, score_as: str | None = None,
) -> DataFrame:
    """The rows of df that the classifier trained by train keeps, in all columns, and
    their score if score_as names a column for it (another name if df has it).

    Whole texts are scored, each row by itself: nothing shuffles. Null texts count as
    empty, and an empty text is scored by its bias and zeros like any other text.
    Repeated rows stay or go together. Without a model (no trusted positive or no
    document) every row stays, with a null score.
    """
    c = train(df, labels, text, doc_id, max_positive, keep=keep)
    give_back()  # the driver goes on without the sample
    name = fresh(df, score_as or "__score")
    names = [col(x) for x in df.columns]
    if c.model is None:
        return df.select(*names, *([F.lit(None).cast("double").alias(name)] if score_as else []))
    shared = df.sparkSession.sparkContext.broadcast(c.model)

    @F.arrow_udf("double")
    def rate(arr: pa.Array) -> pa.Array:
        k = Kernel()
        out = [score(shared.value, features(k, part.column(0))) for part in pieces(pa.record_batch([arr], ["t"]), "t")]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    kept = df.withColumn(name, rate(F.coalesce(col(text), F.lit("")))).where(F.col(name) >= c.threshold)
    return kept if score_as else kept.select(*names)
