"""Exact round trips, damage of every kind, and gaps that cover what is lost."""

import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestry.llm.warc import CHUNK, File, harm, member, read_warc, record, salvage_pages, write_warc

BODIES = [b"", b"one", b"WARC/1.0\r\nWARC-Type: x\r\n\r\n", b"x" * 300_000, "é\r\n\r\n".encode() * 9, b"\x1f\x8b\x08\x00" * 40]
JUNK = b"\x1f\x8b\x08junk\nWARC/1.0\r\njunk"


def read(data, packed=False):
    out = list(File(lambda pos, n: data[pos : pos + n], len(data)).read(packed))
    at = 0
    for _, start, end, *_ in out:
        assert start == at and end > start
        at = end
    assert at == len(data)
    return out


def records(packed):
    one = [record(f"http://h/{i}", b, str(i)) for i, b in enumerate(BODIES)]
    return [member(x) for x in one] if packed else one


@pytest.mark.parametrize("packed", [True, False])
def test_whole(packed):
    got = read(b"".join(records(packed)), packed)
    assert [b for *_, b, _ in got] == BODIES and all(k == "record" for k, *_ in got)
    assert read(b"") == []


@pytest.mark.parametrize("packed", [True, False])
@settings(max_examples=60, deadline=None)
@given(st.integers(0, 5), st.sampled_from(["flip", "cut", "before", "drop"]), st.floats(0, 0.999))
def test_one_damaged(packed, which, how, share):
    parts = records(packed)
    at = int(share * len(parts[which]))
    x = parts[which]
    hurt = {"flip": x[:at] + bytes([x[at] ^ 0x40]) + x[at + 1 :], "cut": x[:at], "before": JUNK + x, "drop": x[:at] + x[at + 1 :]}[how]
    got = read(b"".join(parts[:which] + [hurt] + parts[which + 1 :]), packed)
    bodies = [b for k, *_, b, _ in got if k == "record"]
    for i, b in enumerate(BODIES):
        if i != which:
            assert b in bodies
    if how == "before":
        assert bodies == BODIES
        assert [(s, e) for k, s, e, *_ in got if k == "gap"] == [(sum(map(len, parts[:which])), sum(map(len, parts[:which])) + len(JUNK))]


def test_gap_longer_than_the_window():
    a, b = record("u", b"a", "1"), record("u", b"b", "2")
    junk = b"j" * (CHUNK * 2 + 5)
    assert [(k, s, e) for k, s, e, *_ in read(a + junk + b"\n" + b)] == [("record", 0, len(a)), ("gap", len(a), len(a) + len(junk) + 1), ("record", len(a) + len(junk) + 1, len(a + junk + b) + 1)]
    assert [k for k, *_ in read(junk)] == ["gap"]


@pytest.mark.parametrize("packed", [True, False])
def test_round_trip(spark, sf, packed, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    paths = write_warc(pages.repartition(3), f"file://{tmp_path}/w", packed=packed)
    got = {(r.uri, bytes(r.payload).decode()) for r in read_warc(spark, paths).collect()}
    assert got == {(r.url, r.html) for r in pages.collect()}
    assert not [x.path for x in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(f"{tmp_path}/w")) if not x.path.endswith((".warc", ".gz"))]


def test_salvage(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").coalesce(1)
    rows = salvage_pages(pages).collect()
    want = {r.page_id: (r.url, r.html) for i, r in enumerate(pages.collect()) if i % 50 not in (7, 23)}
    assert {r.page_id: (r.url, r.html) for r in rows if r.kind == "record"} == want
    assert sum(r.kind == "gap" for r in rows) == 3 and harm(0, b"x") == b"x"


def test_cases(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", ""), (2, "", ""), (None, "http://x\r\ny", "z")], "page_id long, url string, html string").selectExpr("*", "1 AS kind", "2 AS start", "3 AS offset")
    assert sorted((r.page_id or 0, r.url, r.html) for r in salvage_pages(df).collect()) == [(0, "http://x y", "z"), (1, "", ""), (2, "", ""), (2, "", "")]
    long = spark.createDataFrame([(9, "u", "é" * 700_000)], "page_id long, url string, html string")
    assert [r.html for r in salvage_pages(long).collect()] == ["é" * 700_000]
    assert salvage_pages(df.limit(0)).count() == 0
    assert read_warc(spark, []).count() == 0


def test_many_records_in_a_member():
    one = [record(f"u{i}", b, str(i)) for i, b in enumerate(BODIES)]
    data = member(b"".join(one[:4])) + member(b"".join(one[4:]))
    got = list(File(lambda pos, n: data[pos : pos + n], len(data)).read(True))
    assert [b for *_, b, _ in got] == BODIES
    assert {(s, e) for _, s, e, *_ in got} == {(0, len(member(b"".join(one[:4])))), (len(member(b"".join(one[:4]))), len(data))}
    assert [o for _, _, _, o, *_ in got] == [sum(map(len, one[lo:i])) for i, lo in enumerate([0] * 4 + [4] * 2)]
    # one of them damaged before it was packed: the others stay, its bytes are a gap
    hurt = one[1][:-6] + b"?" + one[1][-5:]
    got = list(File(lambda pos, n, d=member(one[0] + hurt + one[2]): d[pos : pos + n], len(member(one[0] + hurt + one[2]))).read(True))
    assert [(k, b) for k, *_, b, _ in got] == [("record", BODIES[0]), ("gap", None), ("record", BODIES[2])]


def test_a_large_member_is_read_in_pieces():
    bodies = [bytes([i]) * 3_000_000 for i in range(5)]
    data = member(b"".join(record("u", b, str(i)) for i, b in enumerate(bodies)))
    got = list(File(lambda pos, n: data[pos : pos + n], len(data)).read(True))
    assert [b for *_, b, _ in got] == bodies
    # what says that it holds more than a row can is a gap, and is never held as a whole
    bomb = member(b"WARC/1.0\r\nWARC-Type: x\r\nWARC-Record-ID: <a>\r\nContent-Length: 9000000\r\n\r\n" + bytes(9_000_000) + b"\r\n\r\n")
    got = list(File(lambda pos, n, d=bomb + data: d[pos : pos + n], len(bomb + data), most=4_000_000).read(True))
    assert [k for k, *_ in got] == ["gap"] + ["record"] * 5 and got[0][-1] == "record is larger than a row can be"


@pytest.mark.parametrize("packed", [True, False])
def test_spellings_that_hold(packed):
    import base64
    import hashlib

    digest = lambda kind, b: base64.b32encode(hashlib.new(kind, b).digest()).decode()
    head = b"%s\r\nWARC-Type: resource\r\nWARC-Record-ID: <%d>\r\nX-Long: a\r\n b\r\n\tc\r\n%sContent-Length: 3\r\n\r\nabc\r\n\r\n"
    made = [
        head % (b"WARC/0.18", 0, b""), head % (b"WARC/1.1", 1, b"WARC-Block-Digest: sha1:" + digest("sha1", b"abc").lower().encode() + b"\r\n"),
        head % (b"WARC/1.0", 2, b"WARC-Block-Digest: SHA-256:" + hashlib.sha256(b"abc").hexdigest().upper().encode() + b"\r\n"), head % (b"WARC/1.0", 3, b"X-Huge: " + b"h" * (1 << 21) + b"\r\n"),
        head % (b"WARC/1.0", 4, b"WARC-Block-Digest: md5:" + digest("md5", b"abc").encode().rstrip(b"=") + b"\r\n"), head % (b"WARC/1.0", 5, b"WARC-Block-Digest: other:1\r\n"),
    ]
    got = read(b"".join(member(x) if packed else x for x in made), packed)
    assert [k for k, *_ in got] == ["record"] * 6 and {h["x-long"] for *_, h, _, _ in got} == {"a b c"}
    bad = head % (b"WARC/1.0", 6, b"WARC-Block-Digest: sha1:" + digest("sha1", b"abd").encode() + b"\r\n")
    assert [k for k, *_ in read(member(bad) if packed else bad, packed)] == ["gap"]
