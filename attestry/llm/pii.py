"""Personal identifiers behind disguises, reported where they stand in the source."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.kernels import Kernel, bytes_of, pieces, word_lut
from attestry.llm.shared import col

_LOOKS = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲᴄ", "d": "ԁ", "e": "еҽ", "g": "ɡ", "h": "һ", "i": "іιı", "j": "јϳ", "k": "κк", "l": "ӏⅼ", "m": "м", "n": "ո", "o": "оοօσ", "p": "рρ", "q": "ԛ", "r": "г",
    "s": "ѕ", "t": "т", "u": "υս", "v": "νѵ", "w": "ѡԝ", "x": "хχ", "y": "уγү", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
    "-": "‐‑‒–—−﹣", ".": "․。｡", "@": "﹫", " ": "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000",
}


def _homoglyphs() -> dict[int, str]:
    """One character to one: look-alikes, full-width and mathematical forms, digits of
    other scripts."""
    out = {ord(x): to for to, looks in _LOOKS.items() for x in looks}
    for i in (*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), *range(0x2460, 0x2469), *range(0x2070, 0x208A)):
        c = unicodedata.normalize("NFKC", chr(i))
        if len(c) == 1 and c.isascii():
            out.setdefault(i, c)
    for i in range(0x80, 0x1FBFA):
        if unicodedata.category(chr(i)) == "Nd":
            out.setdefault(i, str(unicodedata.digit(chr(i))))
    return out


HOMOGLYPHS = _homoglyphs()
ODD = re.compile("[" + "".join(re.escape(chr(i)) for i in HOMOGLYPHS) + "]")
HIDDEN = "\u00ad\u180e\u200b\u200c\u200d\u2060\ufeff"
DIGITS = {w: str(i) for i, ws in enumerate(("zero oh", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")) for w in ws.split()}
_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_OPEN, _CLOSE = r"[\(\[\{<]", r"[\)\]\}>]"
_AT = rf"(?:\s*{_OPEN}\s*(?:at|@)\s*{_CLOSE}\s*|\s+at\s+|\s*@\s*)"
_DOT = rf"(?:\s*{_OPEN}\s*(?:dot|\.)\s*{_CLOSE}\s*|\s+dot\s+|\.)"
_NAME = r"[a-z0-9_%+\-]"
#: local part, at, labels, each joined by a dot in some disguise; a plain address matches too.
#: Each side has at most 64 labels, as no host name has more.
ADDRESS = re.compile(rf"(?<!{_NAME}){_NAME}++(?:{_DOT}{_NAME}++){{0,63}}+{_AT}[a-z0-9\-]++(?:{_DOT}[a-z0-9\-]++){{1,64}}+", re.I)
#: before a bare at these are prose: meet me at example dot com
PROSE = frozenset("me us him her it them you i we they he she here there now be is was are were meet look see stay live work arrive this that home day time".split())
HINT = re.compile(rf"\sdot\s|{_OPEN}\s*(?:at|dot|\.|@)\s*{_CLOSE}|\s@|@\s", re.I)
AT, DOT, PART = re.compile(_AT, re.I), re.compile(_DOT, re.I), re.compile(rf"{_DOT}|{_AT}", re.I)
#: at least three spelled digits in a row, mixed with figures: fewer are prose
SPELLED = re.compile(rf"(?<![\w])(?:\d+[\s\-.,]{{1,3}})*{_WORD}(?:[\s\-.,]{{1,3}}(?:{_WORD}|\d+)){{2,}}(?![\w])", re.I)
SPELL_HINT = re.compile(rf"\b{_WORD}[\s\-.,]{{1,3}}(?:{_WORD}|\d)", re.I)
TOKEN = re.compile(rf"\b{_WORD}\b", re.I)

EMAIL = re.compile(r"[A-Za-z0-9_%+\-]+(?:\.[A-Za-z0-9_%+\-]+)*@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z][A-Za-z0-9\-]*[A-Za-z0-9]")
RUN = re.compile(r"(?<![\w.])[+(]{0,2}\d(?:[ \-.()/]{0,3}\d){3,22}(?!\w)")
IP = re.compile(r"(?:\d{1,3}\.){3}\d{1,3}\Z")
SSN = re.compile(r"\d{3}[- ]\d{2}[- ]\d{4}\Z")
DATE = re.compile(r"\d{4}[-./]\d{1,2}[-./]\d{1,2}\Z|\d{1,2}[-./]\d{1,2}[-./]\d{4}\Z")
SECRET = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_\- ]?key|access[_\- ]?key)\b[\"']?\s*[=:]\s*[\"']?([^\s\"']{8,})")
SECRET_HINT = re.compile(r"(?i)token|secret|passw|key")
MAC = re.compile(r"(?<![\w:-])[0-9A-Fa-f]{2}([:-])(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}(?![\w:-])")
IPV6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{2,39}(?:\d{1,3}(?:\.\d{1,3}){3})?(?![\w:])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?!\w)")
BOOK = re.compile(r"(?i)\b(?:isbn|issn|ean|gtin|doi)\b[\s:#\-]*(?:1[03][\s:\-]+)?$")
#: without a plus or a bracket: groups as the numbering plans of North America or, from 0 on, of Europe have them
PLAN = re.compile(r"(?:1[ .\-]?)?[2-9]\d{2}[ .\-]?[2-9]\d{2}[ .\-]?\d{4}\Z|0\d(?:[ .\-/()]{0,3}\d){7,13}\Z|\d{3}[ .\-]\d{4}\Z|\d{1,4}[ .\-]\d{3}[ .\-]\d{3,4}[ .\-]\d{3,4}\Z|\d{2,5}[\-/]\d{5,9}\Z")


class Found(NamedTuple):
    kind: str
    start: int
    end: int
    source: str
    value: str


class Transducer:
    """A text in normal form, and for each place in it the place in the source.

    Pieces that stand for themselves or map one to one are kept as (place in the
    normal form, place in the source, length in the source, one to one)."""

    def __init__(self, text: str) -> None:
        self.source, self.maps = text, []
        flat = text
        if not text.isascii():
            if ODD.search(flat):
                flat = flat.translate(HOMOGLYPHS)
            if any(h in flat for h in HIDDEN):
                flat = self._rewrite(flat, [(m.start(), m.end(), "") for m in re.finditer(f"[{HIDDEN}]+", flat)])
        if SPELL_HINT.search(flat):
            edits = []
            for m in SPELLED.finditer(flat):
                if sum(1 for _ in TOKEN.finditer(m.group())) >= 3:
                    edits += [(m.start() + t.start(), m.start() + t.end(), DIGITS[t.group().lower()]) for t in TOKEN.finditer(m.group())]
                    # blanks between single spelled digits join them
            flat = self._rewrite(flat, edits)
        if HINT.search(flat):
            edits = []
            for m in ADDRESS.finditer(flat):
                edits += self._address(m)
            flat = self._rewrite(flat, edits)
        self.text = flat

    @staticmethod
    def _address(m: re.Match) -> list[tuple[int, int, str]]:
        """Rewrites of one address; none if only a bare word at or a plain dot speaks
        for it, as in prose."""
        s, base = m.group(), m.start()
        ats = list(AT.finditer(s))
        if len(ats) != 1:
            return []
        a = ats[0]
        bare = a.group().strip().lower() == "at"
        if bare and s[: a.start()].lower() in PROSE:
            return []
        dots = [d for d in DOT.finditer(s)]
        after = [d for d in dots if d.start() >= a.end()]
        if not after or (bare and not any(d.group().strip() != "." for d in after)):
            return []
        edits = [(base + a.start(), base + a.end(), "@")]
        edits += [(base + d.start(), base + d.end(), ".") for d in dots if d.group() != "." and (d.end() <= a.start() or d.start() >= a.end())]
        return sorted(e for e in edits if s[e[0] - base : e[1] - base] != e[2])

    def _rewrite(self, text: str, edits: list[tuple[int, int, str]]) -> str:
        if not edits:
            return text
        out, points, at, length = [], [(0, 0)], 0, 0
        for start, end, new in edits:
            out += [text[at:start], new]
            length += start - at
            points.append((length, start))  # what is new stands for start to end
            length += len(new)
            points.append((length, end))
            at = end
        out.append(text[at:])
        self.maps.append(points)
        return "".join(out)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """Where a stretch of the normal form stands in the source."""
        for points in reversed(self.maps):
            start, end = self._step(points, start, False), self._step(points, end, True)
        return start, end

    @staticmethod
    def _step(points: list[tuple[int, int]], at: int, right: bool) -> int:
        # points alternate: from even ones on text is itself, from odd ones on it is new
        i = bisect_right(points, (at, -1) if right else (at, 1 << 60)) - 1
        if right and i >= 0 and i % 2 == 0 and points[i][0] == at and i > 0:
            return points[i][1]
        n, s = points[max(i, 0)]
        if max(i, 0) % 2 == 0:
            return s + at - n
        return (points[i + 1][1] if at > n else s) if right else s


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def ean(digits: str) -> bool:
    return sum(int(c) * (1 + 2 * (i % 2)) for i, c in enumerate(digits)) % 10 == 0


def iban(s: str) -> bool:
    """The check digits of an account number."""
    x = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def number(s: str, before: str = "", spelled: bool = False) -> str | None:
    """Kind of a run of digits with separators, or None; before: what stands before it;
    spelled: some of its digits are words, as nobody writes counts."""
    digits = re.sub(r"\D", "", s)
    n = len(digits)
    if IP.match(s):
        return "ip" if all(int(x) < 256 for x in s.split(".")) else None
    if DATE.match(s) or BOOK.search(before) or n == 13 and digits[:3] in ("978", "979") and ean(digits):
        return None
    if SSN.match(s):
        return "ssn"
    plain = s.isdigit()
    if 13 <= n <= 19 and (luhn(digits) or plain):
        return "card" if luhn(digits) else "account"
    if s[0] in "+(" and 7 <= n <= 15:
        return "phone"
    if 7 <= n <= 15 and PLAN.match(s) or spelled and 9 <= n <= 15:
        return "phone"
    return None


def version6(s: str) -> bool:
    """Whether this is an IPv6 address of three groups at least, so that times and double
    colons in prose are none."""
    try:
        return len(s) >= 6 and len(re.findall(r"[0-9A-Fa-f]+", s)) >= 3 and ipaddress.IPv6Address(s) is not None
    except ValueError:
        return False


def detect(text: str) -> list[Found]:
    """Identifiers of one text by place; of overlapping ones the first kind wins:
    secrets, e-mail, IBAN, MAC and IPv6 addresses, numbers."""
    t = Transducer(text)
    s, spans = t.text, []
    if ("=" in s or ":" in s) and SECRET_HINT.search(s):
        spans += [("secret", m.start(1), m.end(1)) for m in SECRET.finditer(s)]
    at = s.find("@")
    while at >= 0:
        lo = at
        while lo > 0 and (s[lo - 1].isalnum() and s[lo - 1].isascii() or s[lo - 1] in "_%+-."):
            lo -= 1
        lo = max(lo, s.rfind("..", lo, at) + 2 if ".." in s[lo:at] else lo)
        m = EMAIL.match(s, lo + (s[lo] == "."))
        if m:
            spans.append(("email", m.start(), m.end()))
        at = s.find("@", max(m.end() if m else 0, at + 1))
    if s.count(":") > 1 or s.count("-") > 4:
        spans += [("mac", *m.span()) for m in MAC.finditer(s)]
        spans += [("ip", *m.span()) for m in IPV6.finditer(s) if version6(m.group())]
    spans += [("iban", *m.span()) for m in IBAN.finditer(s) if iban(m.group())]
    for m in RUN.finditer(s):
        lo, hi = m.span()
        piece = m.group()
        spelled = bool(t.maps) and any(c.isalpha() and c.isascii() for c in text[slice(*t.back(lo, hi))])
        kind = number(piece, s[max(0, lo - 24) : lo], spelled)
        if kind:
            spans.append((kind, lo, hi))
            continue
        # several numbers with blanks between: each by itself
        for x in re.finditer(r"\S+", piece):
            kind = number(x.group())
            if kind:
                spans.append((kind, lo + x.start(), lo + x.end()))
    out, taken = [], []
    for kind, lo, hi in spans:
        if any(a < hi and lo < b for a, b in taken):
            continue
        taken.append((lo, hi))
        start, end = t.back(lo, hi)
        out.append(Found(kind, start, end, text[start:end], s[lo:hi]))
    return sorted(out, key=lambda f: (f.start, f.end))


def word_hashes(k: Kernel, words: list[str]) -> np.ndarray:
    return k.words(*bytes_of(pa.array(words)), word_lut())[0]


def suspects(k: Kernel, arr: pa.Array) -> np.ndarray:
    """The texts in which detect can find anything at all. None of the others has four
    digits, an @, a sign that a transducer rewrites, three spelled digits, dot as a
    word, a bracket with at, five colons or dashes, two colons in a row, or a secret's
    name with = or a colon."""
    text, offs = bytes_of(arr)
    h, _, _, wo = k.words(text, offs, word_lut())

    def per(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return c[at[1:]] - c[at[:-1]]

    table = np.zeros(256, np.uint8)
    for bit, signs in ((1, b"0123456789"), (2, b"@"), (4, b"([{<"), (8, b"=:"), (16, b":-")):
        table[np.frombuffer(signs, np.uint8)] |= bit
    table[0xC4:] |= 2  # other scripts and signs than Latin-1 letters
    table[0xC2] |= 2
    kind = table[text]
    has = lambda bit: per((kind & bit) > 0, offs)
    two = np.zeros(len(text), bool)
    two[1:] = (text[1:] == 58) & (text[:-1] == 58)
    twice = per(two, offs)
    word = lambda *w: per(np.isin(h, word_hashes(k, list(w))), wo)
    return np.flatnonzero(
        (has(1) >= 4) | (has(16) >= 5) | (twice > 0) | (has(2) > 0) | (word("dot") > 0) | (has(4) > 0) & (word("at", "dot") > 0) | (word(*DIGITS) >= 3)
        | (has(8) > 0) & (word("token", "secret", "password", "passwd", "key", "apikey", "accesskey") > 0)
    )


def find_identifiers(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, kind, start, end, source, value): every identifier of every text, as
    characters start to end of the source, what stands there, and its normal form.

    Transducers turn look-alike letters and digits of other scripts into ASCII, drop
    characters that show nothing, and read three or more spelled digits in a row and at
    and dot in disguise (in brackets, or as words where both are). Each keeps the
    places it changed, so that a span found in the normal form maps back to the source
    exactly. Kinds: secret, email, ip (4 and 6), mac, iban (by its check digits), ssn, card
    (13 to 19 digits with a Luhn check digit), account (as many without one), phone (with
    a plus or bracket, or as numbering plans group it). Dates, version-like numbers, book
    numbers, counts and runs of more than 23 digits are none. A bare "at" is a disguise only
    where a dot of the host is one too and no pronoun or the like (PROSE) stands before it.
    An address has at most 64 labels on a side.

    Each row by itself: nothing shuffles. Null and empty texts give no rows; repeated
    rows repeat theirs; a null id is kept. An empty table gives no rows. Other columns
    are not read. Texts are read as a whole, whatever their length.
    """
    kind = df.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("value", T.StringType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel()
        for batch in (part for whole in batches for part in pieces(whole, "t")):
            rows, found = [], []
            some = suspects(kernel, batch.column(1))
            for i, t in zip(some.tolist(), batch.column(1).take(pa.array(some)).to_pylist()):
                for f in detect(t):
                    rows.append(i)
                    found.append(f)
            if found:
                k, a, b, s, v = zip(*found)
                yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array(k), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(s), pa.array(v)], ["doc_id", "kind", "start", "end", "source", "value"])

    return df.select(col(doc_id).alias("d"), col(text).alias("t")).where(F.octet_length("t") > 5).mapInArrow(search, schema)
