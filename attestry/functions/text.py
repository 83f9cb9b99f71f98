"""Text functions as Column expressions; Python only where NFKC can change a text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as ECMAScript has it; Java's \\s is ASCII only.
WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
BLANKS = "\t\n\x0b\f\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
SIGNS = r"，。；;：:、！!？?（）()\[\]【】《》“”\"'`·\-—/\\"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text(x: Column | str) -> Column:
    return F.coalesce(c(x).cast("string"), F.lit(""))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its files give it fewer parts than there are, as one file of
    one row group does; tables that are larger, or tiny, stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1 << 20:
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def trim(x: Column | str) -> Column:
    """Both ends, of all white space; Spark's trim takes blanks only."""
    return F.regexp_replace(c(x), rf"^{WS}+|{WS}+$", "")


def portions(texts: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Offset and length of slices of about so many bytes, of one text at least: Spark's
    batches have up to 64 MB, and whatever is made of them is made for one slice at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to - at
        at = to


@F.arrow_udf(T.StringType())
def _nfkc(arr: pa.Array) -> pa.Array:
    out = [pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in arr.slice(*p).to_pylist()], pa.string()) for p in portions(arr)]
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def nfkc(x: Column | str) -> Column:
    """NFKC. ASCII and Latin-1 letters are stable under it, so only texts with other
    signs are sent to Python; the rest send a null."""
    x = c(x)
    return F.coalesce(_nfkc(F.when(x.rlike(r"[^\x00-\x7F\u00C0-\u00FF]"), x)), x)


def normalize_text(x: Column | str) -> Column:
    """Null as empty, NFKC, without white space, in lower case."""
    return F.lower(F.regexp_replace(nfkc(text(x)), f"{WS}+", ""))


def strip_thinking(x: Column | str) -> Column:
    return trim(F.regexp_replace(text(x), r"(?is)<think>.*?</think>", ""))


def normalize_answer(x: Column | str) -> Column:
    """Without citations and zero decimals, then as normalize_text."""
    cited = F.regexp_replace(text(x), r"【\d+】|\[\d+\]|\(\d+\)", "")
    return normalize_text(F.regexp_replace(cited, r"(\d+)\.0+(?=%|[^\d]|\z)", "$1"))


def compact_answer(x: Column | str) -> Column:
    """As normalize_answer, then without signs; ASCII commas and full stops stay."""
    return F.regexp_replace(normalize_answer(x), f"[{WS[1:-1]}{SIGNS}]+", "")


def item_correct(prediction_norm: Column, answer: Column) -> Column:
    """Whether a normalised prediction covers an answer: by containment, or for more
    than six characters by 0.72 of its Han, Latin and digit characters. Both sides are
    normalised once more, as citations can arise by the first time."""
    return covered(compact_answer(prediction_norm), compact_answer(normalize_answer(answer)))


def covered(p: Column, a: Column) -> Column:
    chars = F.filter(F.split(a, ""), lambda ch: ch.rlike(r"^[\p{IsHan}A-Za-z0-9]$"))
    n = F.size(chars)
    share = F.size(F.filter(chars, lambda ch: F.contains(p, ch))) / n
    return F.when(a == "", F.lit(False)).when(F.contains(p, a), F.lit(True)).when(F.length(a) <= 6, F.lit(False)).otherwise(F.coalesce((n > 0) & (share >= 0.72), F.lit(False)))


def answer_correct(prediction: Column | str, answers: Column | str) -> Column:
    """Whether every one of at least one answer is covered. All answers pass through the
    normal forms as one text, with separators that these never touch."""
    p = compact_answer(normalize_answer(prediction))
    mark = "\u0001"
    joined = F.array_join(F.transform(c(answers), lambda a: F.coalesce(a, F.lit(""))), mark)
    items = F.split(compact_answer(normalize_answer(joined)), mark)
    good = bound(F.struct(p.alias("p"), items.alias("items")), lambda s: F.forall(s["items"], lambda a: covered(s["p"], a)))
    return F.coalesce((F.size(c(answers)) > 0) & good, F.lit(False))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, outside of any lambda in it; Python steps
    may be in the value, not in the body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compact_whitespace(x: Column | str) -> Column:
    y = F.regexp_replace(F.regexp_replace(text(x), "\r\n", "\n"), "[ \t]+", " ")
    return trim(F.regexp_replace(y, "\n{3,}", "\n\n"))


def html_to_text(x: Column | str) -> Column:
    """Without style, script and tags; six entities decoded one after another, so that
    what the first decodes the next decodes again."""
    y = text(x)
    for pattern in (r"(?is)<style[\s\S]*?</style>", r"(?is)<script[\s\S]*?</script>", r"<[^>]+>"):
        y = F.regexp_replace(y, pattern, " ")
    for entity, to in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        y = F.replace(y, F.lit(entity), F.lit(to))
    return compact_whitespace(y)


def hit_matches(hit_norm: Column, quote_norm: Column, answers_norm: Column | None = None) -> Column:
    """Of normalised texts: containment either way, the quote's first 24 characters in
    the hit, or all answers in it. A hit that contains a quote of 24 characters holds
    its prefix too, so that is one search."""
    prefix = F.substring(quote_norm, 1, 24)
    found = F.contains(hit_norm, F.when(F.length(quote_norm) >= 24, prefix).otherwise(quote_norm))
    within = (F.length(hit_norm) <= F.length(quote_norm)) & F.contains(quote_norm, hit_norm)
    match = found | within
    if answers_norm is not None:
        match = match | (F.size(answers_norm) > 0) & F.forall(answers_norm, lambda a: F.contains(hit_norm, a))
    return F.coalesce((hit_norm != "") & (quote_norm != "") & match, F.lit(False))


def sanitize_filename(x: Column | str, fallback: str = "file") -> Column:
    y = F.regexp_replace(F.regexp_replace(text(x), r"[\\/]+", "_"), r'[\x00-\x1F<>:"|?*]+', "_")
    y = trim(F.regexp_replace(y, f"{WS}+", " "))
    return F.when(y == "", F.lit(fallback)).otherwise(y)


def sanitize_dataset_name(x: Column | str, fallback: str = "dataset") -> Column:
    y = F.regexp_replace(trim(text(x)), r"[^A-Za-z0-9_.\-]+", "_")
    return F.when(y.isin("", ".", ".."), F.lit(fallback)).otherwise(y)


def json_bool(x: Column | str) -> Column:
    """Of a string form of a JSON value."""
    y = F.lower(trim(text(x)))
    return y.isin("1", "true", "yes", "y", "correct", "对", "正确") | F.coalesce(F.try_to_number(y, F.lit("S999999999D999")) != 0, F.lit(False))


#: What services say when a quota is used up; the one list for columns and connectors.
QUOTA = tuple("account balance|billing|exceeded your current quota|insufficient balance|insufficient_quota|out of credits|payment required|quota exceeded|quota exhausted|quota_exceeded|request limit|resource exhausted|余额不足|欠费|账户余额|资源耗尽|配额不足|额度不足".split("|"))


def quota_error(status: Column, body: Column | str, parser: bool = False) -> Column:
    low = F.lower(text(body))
    hit = status == 402
    if parser:
        hit = hit | (status == 429)
    for p in QUOTA:
        hit = hit | F.contains(low, F.lit(p))
    return F.coalesce(hit, F.lit(False))


def mask_key(x: Column | str) -> Column:
    y = text(x)
    return F.when(y == "", "").when(F.length(y) > 8, F.concat(F.left(y, F.lit(4)), F.lit("..."), F.right(y, F.lit(4)))).otherwise("***")


def parse_ids(x: Column | str) -> Column:
    """Comma-separated integers, read up to the first sign that is none; null for junk."""
    parts = F.filter(F.transform(F.split(text(x), ","), lambda p: trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: F.try_to_number(F.nullif(F.regexp_extract(p, r"^([+-]?\d+)", 1), F.lit("")), F.lit("S999999999999999999")).cast("long"))


def split_list(x: Column | str, pattern: str = rf"(?:,|{WS})+") -> Column:
    return F.filter(F.split(text(x), pattern), lambda p: p != "")


def split_paragraphs(x: Column | str) -> Column:
    return F.filter(F.transform(F.split(text(x), rf"\n{WS}*\n"), lambda p: trim(p)), lambda p: p != "")


def split_lines(x: Column | str) -> Column:
    return F.filter(F.transform(F.split(text(x), r"\n+"), lambda p: trim(p)), lambda p: p != "")


def split_sentences(x: Column | str) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text(x), F.lit(r"[^。！？?!\n]+[。！？?!\n]*"), F.lit(0)), lambda p: trim(p)), lambda p: p != "")


def split_words(x: Column | str) -> Column:
    return F.filter(F.split(text(x), f"{WS}+"), lambda p: p != "")


def _kinds() -> np.ndarray:
    """Of each byte: 1 letter, 2 digit, 4 ASCII white space, 8 other ASCII, 0 not ASCII."""
    out = np.zeros(256, np.uint8)
    out[:128] = 8
    out[[9, 10, 11, 12, 13, 32]] = 4
    out[48:58] = 2
    out[65:91] = out[97:123] = 1
    return out


KINDS = _kinds()
JOINTS = np.isin(np.arange(256), np.frombuffer(b".,:/_-", np.uint8))


def token_weights(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text, hundredths of tokens by words and by kind of character; a null has none.

    By character: CJK 150, ASCII letters and digits 45, other ASCII 80, others 100, white
    space none. By word: CJK 150, words of letters 130 (one apostrophe may join two),
    numbers 100 (single signs may join digits). All bytes of a portion are counted at once,
    with about forty bytes of arrays for each."""
    each = [_weights(arr.slice(*p)) for p in portions(arr)]
    if not each:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([words for words, _ in each]), np.concatenate([dense for _, dense in each])


def _weights(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """token_weights of one portion."""
    arr = arr.fill_null("") if arr.null_count else arr
    n = len(arr)
    wide = pa.types.is_large_string(arr.type)
    offs = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64)
    data = arr.buffers()[2]
    b = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offs[0] : offs[-1]]
    offs = offs - offs[0]
    after = lambda k: np.concatenate([b[k:], np.zeros(min(k, len(b)), np.uint8)])
    kind, b1, b2 = KINDS[b], after(1), after(2)
    first = np.zeros(len(b), bool)
    first[offs[:-1][np.diff(offs) > 0]] = True

    def per(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return c[offs[1:]] - c[offs[:-1]]

    cjk = (b >= 0xE5) & (b <= 0xE9) | (b == 0xE4) & (b1 >= 0xB8)
    blank = (b == 0xC2) & (b1 == 0xA0) | (b == 0xE1) & (b1 == 0x9A) & (b2 == 0x80) | (b == 0xE3) & (b1 == 0x80) & (b2 == 0x80) | (b == 0xEF) & (b1 == 0xBB) & (b2 == 0xBF)
    blank |= (b == 0xE2) & ((b1 == 0x80) & ((b2 <= 0x8A) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF)) | (b1 == 0x81) & (b2 == 0x9F))
    han = per(cjk)
    dense = 150 * han + 45 * per((kind & 3) > 0) + 80 * per(kind == 8) + 100 * (per(b >= 0xC0) - han - per(blank))

    def runs(bit: int, joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs begin, and whether one joint and no more stands between a run and the
        one before it in the same text."""
        mine = kind == bit
        start = mine.copy()
        start[1:] &= ~mine[:-1] | first[1:]
        at = np.flatnonzero(start)
        linked = np.zeros(len(at), bool)
        far = at >= 2
        x = at[far]
        linked[far] = joint[b[x - 1]] & mine[x - 2] & ~first[x] & ~first[x - 1]
        return at, linked

    apostrophe = np.arange(256) == 39
    at, linked = runs(1, apostrophe)
    chain = np.arange(len(at)) - np.maximum.accumulate(np.where(linked, 0, np.arange(len(at)))) if len(at) else at
    word, number = np.zeros(len(b), bool), np.zeros(len(b), bool)
    word[at[chain % 2 == 0]] = True
    at, linked = runs(2, JOINTS)
    number[at[~linked]] = True
    return 150 * han + 130 * per(word) + 100 * per(number), dense


def _whole(hundredths: np.ndarray) -> np.ndarray:
    return -(-hundredths // 100)


@F.arrow_udf(T.IntegerType())
def _dense(arr: pa.Array) -> pa.Array:
    return pa.array(_whole(token_weights(arr)[1]).astype(np.int32))


@F.arrow_udf(T.IntegerType())
def _tokens(arr: pa.Array) -> pa.Array:
    words, dense = token_weights(arr)
    return pa.array(_whole(np.maximum(words, dense)).astype(np.int32))


@F.arrow_udf(T.StructType([T.StructField("dense_tokens", T.IntegerType()), T.StructField("tokens", T.IntegerType())]))
def _both(arr: pa.Array) -> pa.Array:
    words, dense = token_weights(arr)
    return pa.StructArray.from_arrays([pa.array(_whole(x).astype(np.int32)) for x in (dense, np.maximum(words, dense))], ["dense_tokens", "tokens"])


def estimate_dense_tokens(x: Column | str) -> Column:
    """By kind of character, in hundredths so that sums are exact."""
    return _dense(text(x))


def estimate_tokens(x: Column | str) -> Column:
    """The greater of the estimate by words and by characters."""
    return _tokens(text(x))


def estimate_both(x: Column | str) -> Column:
    """Struct of both estimates, dense_tokens and tokens, for one count."""
    return _both(text(x))
