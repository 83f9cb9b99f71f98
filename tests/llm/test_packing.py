"""Against a plain best-fit loop; every token once; every capacity kept."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestry.llm.packing import Capacity, best_fit, pack, token_counter

PATH = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def plain(lengths, cap, rule, w):
    bins, out = [], []
    for n in lengths:
        d = (n, 1, n * n)
        fits = [i for i, r in enumerate(bins) if all(x >= y for x, y in zip(r, d))]
        if not fits:
            bins.append(list(cap))
            fits = [len(bins) - 1]
            best = fits[0]
        elif rule == "dot":
            best = max(fits, key=lambda i: (sum(a * x * y / c / c for a, x, y, c in zip(w, bins[i], d, cap)), -i))
        else:
            best = min(fits, key=lambda i: (sum(a * ((x - y) / c) ** 2 for a, x, y, c in zip(w, bins[i], d, cap)), i))
        bins[best] = [x - y for x, y in zip(bins[best], d)]
        out.append(best)
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 11), max_size=60), st.sampled_from(["dot", "norm"]), st.integers(1, 5), st.sampled_from([128, 160, 256]))
def test_matches_plain_loop(lengths, rule, docs, attention):
    cap, w = Capacity(16, docs, attention), (1.0, 0.5, 0.25)
    lengths = sorted(lengths, reverse=True)
    assert best_fit(np.array(lengths, np.int64), cap, rule, w).tolist() == plain(lengths, cap, rule, w)


def test_count_is_the_encoder_s():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello world", "", " lead", "tail  ", "a\n\n b\t\tc 's it's 12,5 x", "é  ñ　日本 語", "x" * 5000, "w " * 20000, None, "\n\n\n"]
    assert token_counter(PATH, public_tokenizers.PATTERN)(pa.array(texts)).tolist() == [len(e.encode_ordinary(t or "")) for t in texts]


def test_every_token_once_within_capacity(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cap = Capacity(512, 6, 512 * 512 // 2)
    rows = pack(docs, capacity=cap, shard_pieces=300).collect()
    count = token_counter(PATH, public_tokenizers.PATTERN)
    want = {r.doc_id: int(count(pa.array([r.text]))[0]) for r in docs.collect()}
    seen, bins = {}, {}
    for r in rows:
        seen.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
        bins.setdefault(r.bin_id, []).append((r.slot, r.n_tokens))
    for d, n in want.items():
        at = 0
        for first, size in sorted(seen.get(d, [])):
            assert first == at
            at += size
        assert at == n
    for b in bins.values():
        sizes = [n for _, n in b]
        assert sorted(s for s, _ in b) == list(range(len(b)))
        assert sum(sizes) <= 512 and len(b) <= 6 and sum(n * n for n in sizes) <= cap.attention
    assert len({b >> 32 for b in bins}) > 1


def test_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a b", 0), (3, "a b", 0), (None, "c", 0), (5, "w " * 30000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = pack(df).collect()
    assert sorted((r.doc_id or 0) for r in got if r.doc_id != 5) == [0, 3, 3]
    assert sum(r.n_tokens for r in got if r.doc_id == 5) == 30001 and max(r.n_tokens for r in got) == 2560
    assert max(r.n_tokens for r in pack(df, capacity=Capacity(4096, 32, 1_000_000)).collect()) == 1000
    assert pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack(df, capacity=Capacity(0, 1, 1))


def test_each_capacity_binds_at_the_default(spark):
    rows = [(i, "w " * n) for i, n in enumerate([2500] * 20 + [1500] * 30 + [400] * 60 + [3] * 400)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    cap, bins = Capacity(), {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r.n_tokens)
    assert all(sum(b) <= cap.tokens and len(b) <= cap.documents and sum(n * n for n in b) <= cap.attention for b in bins.values())
    assert any(len(b) == cap.documents for b in bins.values())
    assert any(sum(b) + 401 > cap.tokens and len(b) < cap.documents and sum(n * n for n in b) + 401**2 <= cap.attention for b in bins.values())
    # without the attention cost another document would have gone in
    assert any(sum(n * n for n in b) + 1500**2 > cap.attention and sum(b) + 1500 <= cap.tokens for b in bins.values())
