"""URL filter by gradient-boosted trees on lexical features."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.kernels import bytes_of
from attestry.llm.shared import col, fresh, table

BINS = 64
#: Words of hosts and what each says of a URL for which no label is given; two are enough.
WORDS = {
    2: "casino bets poker slots jackpot pills pharma viagra cialis spam porn xxx adult escort sex warez crack keygen torrent payday malware phish",
    1: "bet win winner free cheap prize bonus lottery lucky deal discount replica ads ad adserver track tracker click clicks popup banner loan loans meds drugs dating hot farm toolbar download",
}
WEIGHTS = {word: weight for weight, words in WORDS.items() for word in words.split()}
NAMES = (
    "length", "host_length", "path_length", "depth", "labels", "digit_share", "host_digit_share", "hyphens_in_host", "hyphens_in_path", "entropy", "host_entropy",
    "parameters", "query_length", "fragment", "https", "upper_share", "escapes", "suffix_length", "suffix_frequency", "suffix_bad_share", "longest_label", "vowel_share", "rare_pairs",
)


def parts(url: Column) -> dict[str, Column]:
    """Scheme, host, path, query and fragment; missing ones are empty."""
    u = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^[^@]*@|:\d+$", ""))
    return {
        "scheme": F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1)), "host": host, "path": F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1),
        "query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), "fragment": F.regexp_extract(rest, r"#(.*)$", 1), "suffix": F.regexp_extract(host, r"([^.]*)$", 1),
    }


def shares(text: np.ndarray, offs: np.ndarray, mask: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(mask)])
    return c[offs[1:]] - c[offs[:-1]]


def entropy(text: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Of the bytes of each text, in bits."""
    n = np.diff(offs)
    own = np.repeat(np.arange(len(n)), n)
    v = np.sort(own * 256 + text)
    if not len(v):
        return np.zeros(len(n))
    new = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    c = np.diff(np.concatenate([new, [len(v)]]))
    p = c / n[v[new] >> 8]
    return np.bincount(v[new] >> 8, -p * np.log2(p), len(n))


def features(url: pa.Array, host: pa.Array, path: pa.Array, query: pa.Array, fragment: pa.Array, scheme: pa.Array, suffix: pa.Array, suffixes: dict[str, tuple[float, float]], pairs: np.ndarray, unnamed: np.ndarray | None = None) -> np.ndarray:
    (u, uo), (h, ho), (p, po), (q, qo) = map(bytes_of, (url, host, path, query))
    one = lambda x: np.maximum(x, 1)
    digit = lambda b: (b >= 48) & (b <= 57)
    n, nh, np_ = np.diff(uo), np.diff(ho), np.diff(po)
    dots = np.flatnonzero(h == 46)
    longest = np.array([max(map(len, x.split(".")), default=0) if x else 0 for x in host.to_pylist()])
    code = np.zeros(len(h), np.int64)
    code[1:] = h[:-1].astype(np.int64) * 256 + h[1:]
    inside = np.ones(len(h), bool)
    inside[ho[:-1][nh > 0]] = False
    rare = np.where(inside, pairs[code], 0.0)
    c = np.concatenate([[0], np.cumsum(rare)])
    # unnamed: the log share of suffixes that are not among suffixes; none of them has a label
    stat = [suffixes.get(s) or (0.0 if unnamed is None else float(unnamed[i]), 0.5) for i, s in enumerate(suffix.to_pylist())]
    del dots
    return np.stack(
        [
            n, nh, np_, shares(p, po, p == 47), shares(h, ho, h == 46) + 1, shares(u, uo, digit(u)) / one(n), shares(h, ho, digit(h)) / one(nh), shares(h, ho, h == 45), shares(p, po, p == 45),
            entropy(u, uo), entropy(h, ho), np.where(np.diff(qo) > 0, shares(q, qo, q == 38) + 1, 0), np.diff(qo), np.diff(bytes_of(fragment)[1]), np.array([s == "https" for s in scheme.to_pylist()]),
            shares(u, uo, (u >= 65) & (u <= 90)) / one(n), shares(u, uo, u == 37), np.diff(bytes_of(suffix)[1]), np.array([a for a, _ in stat]), np.array([b for _, b in stat]), longest,
            shares(h, ho, np.isin(h, np.frombuffer(b"aeiou", np.uint8))) / one(nh), (c[ho[1:]] - c[ho[:-1]]) / one(nh - 1),
        ],
        axis=1,
    ).astype(np.float32)


class Trees(NamedTuple):
    """Boosted trees of one depth as complete binary trees: feature and bin of each
    inner node (feature -1: all go left), value of each leaf."""

    edges: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    start: float


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(x.shape[1])], axis=1).astype(np.uint8)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Logistic loss, second-order gains over histograms of BINS quantile bins."""
    edges = np.stack([np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]) for j in range(x.shape[1])])
    b = binned(x, edges)
    n, f = b.shape
    mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    start = float(np.log(mean / (1 - mean)))
    s = np.full(n, start)
    feature, cut, value = np.full((trees, (1 << depth) - 1), -1), np.zeros((trees, (1 << depth) - 1), np.int64), np.zeros((trees, 1 << depth))
    flat = b.astype(np.int64) + np.arange(f) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-s))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 1 << level
            at = (node[:, None] * (f * BINS) + flat).ravel()
            sg = np.bincount(at, np.repeat(g, f), width * f * BINS).reshape(width, f, BINS)
            sh = np.bincount(at, np.repeat(h, f), width * f * BINS).reshape(width, f, BINS)
            lg, lh = sg.cumsum(2), sh.cumsum(2)
            tg, th = lg[:, :, -1:], lh[:, :, -1:]
            gain = lg**2 / (lh + l2) + (tg - lg) ** 2 / (th - lh + l2) - tg**2 / (th + l2)
            gain = np.where((lh >= least) & (th - lh >= least), gain, 0).reshape(width, -1)
            best = gain.argmax(1)
            for k in range(width):
                if gain[k, best[k]] > 1e-9:
                    feature[t, width - 1 + k], cut[t, width - 1 + k] = divmod(int(best[k]), BINS)
            fe, cu = feature[t, width - 1 + node], cut[t, width - 1 + node]
            node = node * 2 + ((fe >= 0) & (b[np.arange(n), np.maximum(fe, 0)] > cu))
        value[t] = -rate * np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + l2)
        s += value[t][node]
    return Trees(edges, feature, cut, value, start)


def predict(m: Trees, x: np.ndarray) -> np.ndarray:
    """Probability of a bad URL."""
    b = binned(x, m.edges)
    s = np.full(len(b), m.start)
    depth = m.value.shape[1].bit_length() - 1
    for t in range(len(m.value)):
        node = np.zeros(len(b), np.int64)
        for level in range(depth):
            fe, cu = m.feature[t, (1 << level) - 1 + node], m.cut[t, (1 << level) - 1 + node]
            node = node * 2 + ((fe >= 0) & (b[np.arange(len(b)), np.maximum(fe, 0)] > cu))
        s += m.value[t][node]
    return 1 / (1 + np.exp(-s))


class Model(NamedTuple):
    trees: Trees
    suffixes: dict[str, tuple[float, float]]
    pairs: np.ndarray
    total: int
    counts: DataFrame | None


COLUMNS = ("url", "host", "path", "query", "fragment", "scheme", "suffix")


def spread(df: DataFrame, url: str) -> list[Column]:
    p = parts(col(url))
    return [F.coalesce(col(url), F.lit("")).alias("url"), *(p[c].alias(c) for c in COLUMNS[1:])]


def seed_labels(df: DataFrame, url: str = "url") -> DataFrame:
    """(url, bad, family): labels from weak signals that vote: words of the host, an IP
    address, a user's name before it, a host in punycode, four hyphens in a host, as many
    digits as letters. Two votes make a URL bad, none makes it good, one leaves it without
    a label. family is the host without its first label if that is a common one, so that
    a model can be tested on families that it has not seen."""
    p = parts(col(url))
    host = p["host"]
    words = F.array_distinct(F.split(host, r"[.\-_]+"))
    named = F.map_from_arrays(F.array(*map(F.lit, WEIGHTS)), F.array(*map(F.lit, WEIGHTS.values())))
    digits, letters = F.regexp_count(host, F.lit("[0-9]")), F.regexp_count(host, F.lit("[a-z]"))
    rest = F.regexp_replace(F.coalesce(col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    others = [(host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), 2), (F.regexp_extract(rest, r"^([^/?#]*)", 1).contains("@"), 1), (host.contains("xn--"), 1), (F.regexp_count(host, F.lit("-")) >= 4, 1), ((digits >= letters) & (letters > 0), 1)]
    votes = F.aggregate(words, F.lit(0), lambda s, w: s + F.coalesce(F.try_element_at(named, w), F.lit(0)))
    for hit, weight in others:
        votes = votes + F.when(hit, weight).otherwise(0)
    bad = F.when(votes >= 2, 1).when(votes == 0, 0)
    return df.where(col(url).isNotNull()).select(col(url).alias("url"), bad.alias("bad"), F.regexp_replace(host, r"^(www|m|blog|en|mail)\d*\.", "").alias("family"))


def train(df: DataFrame, labels: DataFrame, url: str = "url", max_labels: int = 20_000, max_suffixes: int = 4096) -> Model | None:
    """A model from labelled URLs (url, bad 0 or 1), at most about max_labels of either
    class, taken by the hash of the URL. How often a suffix of hosts and a pair of
    letters occur in df is counted over all its URLs; the model holds
    the max_suffixes most frequent suffixes and those with labels, and a table of all
    counts if there are more. None without URLs of both classes."""
    known = labels.where(F.col("url").isNotNull() & F.col("bad").isNotNull()).select("url", (F.col("bad") != 0).cast("int").alias("bad")).distinct()
    sizes = {r["bad"]: r["n"] for r in known.groupBy("bad").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return None
    share = lambda n: min(1 << 20, max_labels * (1 << 20) // n)
    limit = F.when(F.col("bad") == 1, share(sizes[1])).otherwise(share(sizes[0]))
    sample = known.where(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < limit).select(*spread(known, "url"), "bad").toArrow()
    sample = sample.take(pa.array(np.argsort(np.array(sample["url"].to_pylist(), dtype=object), kind="stable")))
    p = parts(col(url))
    every = df.where(col(url).isNotNull())
    counts = table(every.groupBy(p["suffix"].alias("s")).agg(F.count(F.lit(1)).alias("count")), "suffixes")
    distinct, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))).collect()[0]
    often = counts.orderBy(F.desc("count"), "s").limit(max_suffixes).collect()
    if distinct > max_suffixes:
        named = df.sparkSession.createDataFrame([(s,) for s in sorted(set(sample["suffix"].to_pylist()))], "s string")
        often = list({r["s"]: r for r in [*often, *counts.join(named, "s", "left_semi").collect()]}.values())
    total = max(1, total)
    letters = every.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(p["host"]) - 1, F.lit(1))), lambda i: F.substring(p["host"], i, F.lit(2)))).alias("x"))
    pairs = np.full(65536, 12.0)
    found = letters.where("octet_length(x) = 2").groupBy("x").count().collect()
    n = max(1, sum(r["count"] for r in found))
    for r in found:
        a, b = r["x"].encode()
        pairs[a * 256 + b] = min(12.0, -np.log2(r["count"] / n))
    y = sample["bad"].to_numpy().astype(float)
    bad: dict[str, list[float]] = {}
    for s, v in zip(sample["suffix"].to_pylist(), y.tolist()):
        bad.setdefault(s, []).append(v)
    suffixes = {r["s"]: (float(np.log(r["count"] / total)), (sum(bad.get(r["s"], [])) + 1) / (len(bad.get(r["s"], [])) + 2)) for r in often}
    x = features(*(sample[c] for c in COLUMNS), suffixes, pairs)
    # of the labels of its suffix, a URL to learn from must not see its own
    of = [(sum(bad[s]), len(bad[s])) for s in sample["suffix"].to_pylist()]
    x[:, NAMES.index("suffix_bad_share")] = [(a - v + 1) / (n + 1) for (a, n), v in zip(of, y.tolist())]
    return Model(boost(x, y), suffixes, pairs, total, counts if distinct > len(suffixes) else None)


def url_filter(df: DataFrame, labels: DataFrame | None = None, url: str = "url", max_labels: int = 20_000, threshold: float = 0.5, score_as: str = "bad_url", max_suffixes: int = 4096) -> DataFrame:
    """df with the probability that each URL is bad, and keep_url, which is false from
    threshold on; new names if df has such columns.

    Gradient-boosted trees on lexical features only: lengths, depth, digit shares,
    entropies, counts of parameters, and statistics of suffixes and letter pairs over
    all of df. They are fitted on labelled URLs, by default those that seed_labels
    derives from weak signals. Every URL is scored; nothing shuffles but statistics,
    unless there are more suffixes than the model holds: then their counts are joined.

    A null URL has a null score and is kept; an empty one is scored like any other.
    Repeated rows are scored alike. Without labels of both classes, scores are null and
    all rows are kept. An empty table gives no rows.
    """
    model = train(df, seed_labels(df, url) if labels is None else labels, url, max_labels, max_suffixes)
    name = fresh(df, score_as)
    if model is None:
        out = df.withColumn(name, F.lit(None).cast("double"))
    else:
        shared = df.sparkSession.sparkContext.broadcast(model._replace(counts=None))

        @F.arrow_udf("double")
        def rate(*arrays: pa.Array) -> pa.Array:
            m, (*arrays, count) = shared.value, arrays
            rare = np.log(np.maximum(count.to_numpy(zero_copy_only=False), 1) / m.total)
            return pa.array(predict(m.trees, features(*arrays, m.suffixes, m.pairs, rare)))

        p = parts(col(url))
        count, suffix, joined = F.lit(1).cast("long"), fresh(df, "__suffix"), df
        if model.counts is not None:
            n = fresh(df, "__count")
            joined = df.join(model.counts.select(F.col("s").alias(suffix), F.col("count").alias(n)), p["suffix"] == F.col(suffix), "left")
            count = F.coalesce(F.col(n), F.lit(1))
        score = F.when(col(url).isNotNull(), rate(F.coalesce(col(url), F.lit("")), *(p[c] for c in COLUMNS[1:]), count))
        out = joined.select(*[col(c) for c in df.columns], score.alias(name))
    return out.withColumn(fresh(out, "keep_url"), F.coalesce(F.col(name) < threshold, F.lit(True)))
