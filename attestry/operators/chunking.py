"""Chunks of documents: character windows, Markdown by headings, token budgets and atomic
spans, each as one pass of Python over each document."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import BLANKS, WS, portions, text

EMBEDDING_LIMIT = 24_000
BUDGET, LEAST = 1000, 55
SPACE = WS[1:-1]
STRIP = BLANKS
HEADING = re.compile(rf"^#{{1,6}}{WS}+[^\n\r\u2028\u2029]+$", re.M)
SECTION = re.compile(rf"^#{{1,6}}{WS}+[^{SPACE}][^\n\r\u2028\u2029]*$", re.M)
BLANK_LINE = re.compile(rf"\n{WS}*\n")
IMAGE = r"(?:!\[[^\]\r\n]*\]\([^)]+\)|<img\b[\s\S]*?>)"
IMAGE_BEFORE = re.compile(rf"(?:^|\r?\n)[ \t]*{IMAGE}[ \t]*(?:\r?\n[ \t]*)*\Z", re.I)
IMAGE_AFTER = re.compile(rf"(?:\r?\n[ \t]*)+{IMAGE}[ \t]*(?:\r?\n[ \t]*)*\Z", re.I)
CJK, WORD, NUMBER = re.compile("[\u4e00-\u9fff]"), re.compile(r"[A-Za-z]+(?:'[A-Za-z]+)?"), re.compile(r"[0-9]+(?:[.,:/_-][0-9]+)*")
OTHER = re.compile(rf"[^{SPACE}\x00-\x7f\u4e00-\u9fff]")


def filled(s: str, max_chars: int, overlap: int) -> list[str]:
    flat = re.sub("[ \t]+", " ", s.replace("\r\n", "\n"))
    out, now = [], ""
    for p in kept(BLANK_LINE.split(re.sub("\n{3,}", "\n\n", flat).strip(STRIP))):
        if not now:
            now = p
        elif len(now) + len(p) + 2 <= max_chars:
            now = f"{now}\n\n{p}"
        else:
            out.append(now)
            now = f"{now[max(0, len(now) - overlap):]}\n\n{p}"
    return [*out, now] if now else out


def split_corpus(x: Column | str, max_chars: int = 1800, overlap: int = 180) -> Column:
    """Paragraphs filled into chunks of up to max_chars; the next chunk begins with the
    last overlap characters of the one before. A paragraph is never cut. One pass over each
    text: a fold of Columns would copy the chunks made so far for each paragraph."""

    @F.arrow_udf("array<string>")
    def split(arr: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        out = [pa.array([filled(t, max_chars, overlap) for t in arr.slice(*p).to_pylist()], kind) for p in portions(arr)]
        return pa.concat_arrays(out) if out else pa.array([], kind)

    return split(text(x))


NOT_ALNUM = bytes(i for i in range(128) if not chr(i).isalnum())
NOT_PLAIN = bytes(i for i in range(128) if chr(i).isalnum() or i in (9, 10, 11, 12, 13, 32))


@lru_cache(256)
def weights(s: str) -> tuple[int, int]:
    """The two sums of token_weights for one text. Both add up over texts that white space
    parts, and white space has none."""
    ascii_ = s.encode("ascii", "ignore")
    cjk = other = 0
    if len(ascii_) < len(s):
        cjk, other = len(CJK.findall(s)), len(OTHER.findall(s))
    return 150 * cjk + 130 * len(WORD.findall(s)) + 100 * len(NUMBER.findall(s)), 150 * cjk + 45 * len(ascii_.translate(None, NOT_ALNUM)) + 80 * len(ascii_.translate(None, NOT_PLAIN)) + 100 * other


def whole(words: int, dense: int) -> int:
    return max(-(-words // 100), -(-dense // 100))


def tokens(s: str) -> int:
    """Same estimate as the Column estimate_tokens."""
    return whole(*weights(s))


def kept(parts: Iterable[str]) -> list[str]:
    return [p for p in (x.strip(STRIP) for x in parts) if p]


def is_table(text: str) -> bool:
    """A whole HTML table, or a GFM one: a separator from the second line on, and a bar
    in every line."""
    t = text.strip(STRIP)
    if re.match(r"<table\b[\s\S]*</table>\s*\Z", t, re.I):
        return True
    lines = kept(re.split(r"\r?\n", t))

    def separator(line: str) -> bool:
        cells = [x.strip(STRIP) for x in re.sub(r"^\||\|$", "", line).split("|")]
        return "|" in line and len(cells) > 1 and all(re.fullmatch(r":?-{3,}:?", x) for x in cells)

    first = next((i for i, x in enumerate(lines) if separator(x)), -1)
    return len(lines) > 1 and first >= 1 and all("|" in x for x in lines)


#: From coarse to fine: how to cut a text that is too long, and how to join what is cut.
LADDER: list[tuple[Callable[[str], list[str]], str]] = [
    (lambda t: kept(BLANK_LINE.split(t)), "\n\n"),
    (lambda t: kept(re.split(r"\n+", t)), "\n"),
    (lambda t: kept(re.findall(r"[^。！？?!\n]+[。！？?!\n]*", t)), "\n"),
    (lambda t: kept(re.split(f"{WS}+", t)), " "),
    (list, ""),
]


def windows(text: str, budget: int) -> Iterator[str]:
    at, step = 0, max(200, budget * 2)
    while at < len(text):
        end = min(len(text), at + step)
        piece = text[at:end].strip(STRIP)
        while piece and tokens(piece) > budget and end > at + 1:
            end -= max(1, (end - at) // 4)
            piece = text[at:end].strip(STRIP)
        if piece:
            yield piece
        at = end if piece else at + 1


def fit(text: str, budget: int, level: int = 0, whole_tables: bool = True) -> list[str]:
    """Pieces of at most budget tokens; a table stays whole unless told otherwise."""
    text = text.strip(STRIP)
    if not text:
        return []
    if tokens(text) <= budget or whole_tables and is_table(text):
        return [text]
    segments: list[str] = []
    while level < len(LADDER) and len(segments := LADDER[level][0](text)) <= 1:
        level += 1
    if level == len(LADDER):
        return list(windows(text, budget))
    glue, out, now, sums = LADDER[level][1], [], [], (0, 0)
    for s in kept(segments):
        own = weights(s)
        # with white space between, sums are exact; single characters join into words
        both = (sums[0] + own[0], sums[1] + own[1]) if glue else weights("".join(now) + s)
        if whole(*own) > budget:
            out += kept([glue.join(now)]) + fit(s, budget, level + 1, whole_tables)
            now, sums = [], (0, 0)
        elif now and whole(*both) > budget:
            out += kept([glue.join(now)])
            now, sums = [s], own
        else:
            now.append(s)
            sums = both
    return out + kept([glue.join(now)])


def gather(parts: Iterable[str], budget: int, glue: str) -> Iterator[tuple[str, int]]:
    """Neighbours joined while the sum of their estimates stays within the budget."""
    now: list[str] = []
    total = 0
    for p in parts:
        n = tokens(p)
        if now and total + n > budget:
            yield glue.join(now), total
            now, total = [], 0
        now.append(p)
        total += n
    if now:
        yield glue.join(now), total


def finished(chunks: list[str], text: str, budget: int) -> list[str]:
    out = kept(p for c in chunks for p in fit(c, budget))
    return out or fit(text, budget)


def by_paragraph(text: str, budget: int, least: int) -> list[str]:
    """Paragraphs joined up to the budget, longer ones by sentence. A rest below least
    is left out where there are chunks already."""
    if is_table(text):
        return [text.strip(STRIP)]
    out: list[str] = []
    run: list[str] = []

    def flush(last: bool) -> None:
        groups = list(gather(run, budget, "\n\n"))
        for i, (chunk, n) in enumerate(groups):
            if not last or i + 1 < len(groups) or n >= least or not out:
                out.append(chunk)
        run.clear()

    for p in filter(None, BLANK_LINE.split(text)):
        if tokens(p) > budget:
            flush(False)
            out += [s for s, _ in gather(filter(None, re.split(r"(?<=[。！？?!])", p)), budget, "")]
        else:
            run.append(p)
    flush(True)
    return finished(out, text, budget)


def by_heading(text: str, budget: int, least: int) -> list[str]:
    """Sections of ATX headings; longer ones by paragraph. A section below least is left
    out where there are chunks already."""
    starts = [m.start() for m in HEADING.finditer(text)]
    if not starts:
        return by_paragraph(text, budget, least)
    out: list[str] = []
    prefix = text[: starts[0]].strip(STRIP)
    if prefix:
        out += by_paragraph(prefix, budget, least) if tokens(prefix) > budget else [prefix]
    for a, b in zip(starts, [*starts[1:], len(text)]):
        section = text[a:b].strip(STRIP)
        n = tokens(section)
        if n > budget:
            out += [s for s, _ in gather(BLANK_LINE.split(section), budget, "\n\n")]
        elif n >= least or not out:
            out.append(section)
    return finished(out, text, budget)


def locate(text: str, chunks: list[str]) -> list[tuple[str, int, int]]:
    """Each chunk with its place: found as it is one after another, else all of them with
    runs of white space as one blank; (-1, -1) where that fails too."""
    out, at = [], 0
    for c in chunks:
        i = text.find(c, at)
        if i < 0:
            break
        out.append((c, i, i + len(c)))
        at = i + len(c)
    else:
        return out
    place, flat = [], []
    for m in re.finditer(rf"{WS}+|[^{SPACE}]+", text):
        if m.group()[0] in STRIP:
            flat.append(" ")
            place.append(m.start())
        else:
            flat.append(m.group())
            place.extend(range(m.start(), m.end()))
    source, out, at = "".join(flat), [], 0
    for c in chunks:
        key = re.sub(f"{WS}+", " ", c).strip(" ")
        i = source.find(key, at) if key else -1
        if i < 0:
            out.append((c, -1, -1))
            continue
        out.append((c, place[i], place[i + len(key) - 1] + 1))
        at = i + len(key)
    return out


def split_located(text: str, markdown: bool = True) -> list[tuple[str, int, int]]:
    if not markdown:
        return locate(text, by_paragraph(text, 275, LEAST))
    n = tokens(text)
    least = LEAST if n >= LEAST else int(min(10, max(1, n / 2)))
    return locate(text, by_heading(text, BUDGET, least))


def trimmed(text: str, start: int, end: int) -> tuple[str, int, int] | None:
    a = max(0, min(len(text), start))
    b = max(a, min(len(text), end))
    s = text[a:b]
    a += len(s) - len(s.lstrip(STRIP))
    s = s.strip(STRIP)
    return (s, a, a + len(s)) if s else None


def heading_only(s: str) -> bool:
    lines = kept(re.split(r"\r?\n", s))
    return len(lines) == 1 and re.match(rf"#{{1,6}}{WS}+[^{SPACE}]", lines[0]) is not None


def chunked(text: str) -> list[tuple[str, int, int]]:
    """Located chunks of the trimmed text; one that is a heading only takes its
    successor in, which is not looked at again."""
    t = trimmed(text, 0, len(text))
    if not t:
        return []
    parts = [(c, t[1] + max(0, a), t[1] + max(0, b)) for c, a, b in split_located(t[0])]
    out, i = [], 0
    while i < len(parts):
        c, a, b = parts[i]
        if i + 1 < len(parts) and heading_only(c):
            n, _, e = parts[i + 1]
            out.append((f"{c.strip(STRIP)}\n\n{n.strip(STRIP)}", a, e))
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return out


def atomic(text: str, spans: list[dict]) -> list[tuple[str, int, int]]:
    """Table and image spans: an image with its markup before it, a table without an
    image after it, each within the section of its start; by start."""
    heads = [m.start() for m in SECTION.finditer(text)]
    out = []
    for s in spans:
        kind, a, b = (s.get("type") or "").lower(), s["start"], s["end"]
        if kind not in ("table", "image") or b <= a:
            continue
        a = max(0, min(len(text), a))
        b = max(a, min(len(text), b))
        if kind == "image":
            lo = max(0, a - 2000)
            m = IMAGE_BEFORE.search(text[lo:a])
            a = lo + m.start() if m else a
        else:
            m = IMAGE_AFTER.search(text[a:b])
            if m and m.start() and re.search(r"<table\b", text[a : a + m.start()], re.I):
                b = a + m.start()
        t = trimmed(text, a, b)
        if t:
            lo = max((h for h in heads if h <= t[1]), default=0)
            hi = min((h for h in heads if h > t[1]), default=len(text))
            t = trimmed(text, max(lo, t[1]), min(hi, t[2]))
        if t:
            out.append(t)
    return sorted(out, key=lambda x: x[1])


def around(text: str, chunks: list[tuple[str, int, int]], spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Chunks that a span touches become one with it; a span that touches none goes in
    where it stands."""
    out = sorted(chunks, key=lambda x: x[1])
    for s in spans:
        first = next((i for i, c in enumerate(out) if c[2] > s[1] and c[1] < s[2]), None)
        if first is None:
            out.insert(next((i for i, c in enumerate(out) if c[1] > s[1]), len(out)), s)
            continue
        last = first
        while last + 1 < len(out) and out[last + 1][1] < s[2]:
            last += 1
        merged = trimmed(text, min(out[first][1], s[1]), max(out[last][2], s[2]))
        if merged:
            out[first : last + 1] = [merged]
    return out


def pages_of(spans: list[dict], start: int, end: int) -> str:
    pages = [s["page"] for s in spans if s["end"] > start and s["start"] < end and s.get("page") is not None] if 0 <= start < end else []
    return "" if not pages else str(min(pages)) if min(pages) == max(pages) else f"{min(pages)}-{max(pages)}"


CHUNK = "doc string, id string, doc_index2 decimal(20,4), title string, content string, page string, fragmentRole string, embeddingContent string, sourceStart int, sourceEnd int, sourceDocIndex2 int, tablePart int, tablePartTotal int"
FIELDS = [f.split()[0] for f in CHUNK.replace("decimal(20,4)", "decimal").split(", ")]
TYPES = [pa.string(), pa.string(), pa.decimal128(20, 4), *[pa.string()] * 5, *[pa.int32()] * 5]


def chunk_rows(doc: str, text: str | None, label: str, page_spans: list[dict] | None, semantic_spans: list[dict] | None) -> Iterator[tuple]:
    """Chunks of one document, and parts of tables above the embedding limit."""
    text = text or ""
    sha = lambda *p: hashlib.sha1("::".join(map(str, p)).encode()).hexdigest()
    chunks = chunked(text)
    spans = atomic(text, semantic_spans or [])
    if spans:
        chunks = around(text, chunks, spans)
    number = 0
    for content, start, end in chunks:
        if not content.strip(STRIP):
            continue
        number += 1
        page = pages_of(page_spans or [], start, end) or None
        parts = fit(content, EMBEDDING_LIMIT, 0, False) if is_table(content) else [content]
        large = len(parts) > 1
        own = (start, end) if large else (None, None)
        yield (doc, sha(label, doc, number), Decimal(number), doc, content, page, "display" if large else None, parts[0] if large else None, *own, None, None, None)
        for i, part in enumerate(parts[1:], 2):
            yield (doc, sha(label, doc, number, "embedding", i), Decimal(number) + Decimal(i) / 10000, doc, part, page, "embedding_part", None, start, end, number, i, len(parts))


def markdown_chunks(docs: DataFrame, label: str, skip: bool = False) -> DataFrame:
    """docs (doc, text, page_spans, semantic_spans) as rows of CHUNK. One document in,
    its chunks out: nothing shuffles, and a batch holds a portion of documents. With skip, a
    document that fails gives one row with its number 0 and the error as content, in the
    role "error", and the others go on."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in portions(batch.column("text")):
                rows: list[tuple] = []
                for row in batch.slice(at, n).to_pylist():
                    try:
                        rows += list(chunk_rows(row["doc"], row["text"], label, row["page_spans"], row["semantic_spans"]))
                    except Exception as e:
                        if not skip:
                            raise
                        rows.append((row["doc"], "", Decimal(0), row["doc"], str(e), None, "error", None, None, None, None, None, None))
                if rows:
                    yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*rows), TYPES)], FIELDS)

    return docs.select("doc", "text", "page_spans", "semantic_spans").mapInArrow(split, CHUNK)


def sidecar(chunks: DataFrame) -> DataFrame:
    """The ten published fields with their defaults, without ids and embedding texts."""
    empty = lambda x: F.coalesce(x, F.lit("")).alias(x)
    return chunks.select("doc", "doc_index2", "title", "content", empty("page"), empty("fragmentRole"), "sourceStart", "sourceEnd", "sourceDocIndex2", "tablePart", "tablePartTotal")


