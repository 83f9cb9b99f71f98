"""Against a plain loop over chunks; shifts; first copies stay."""

import random

import numpy as np
import pyarrow as pa

from attestry.llm.kernels import STEP, Kernel, U, mix
from attestry.llm.linededup import chunks, line_dedup
from attestry.llm.queries import op7_line_dedup

DDL = "doc_id long, text string"


def plain_chunks(t):
    """(start, end) in characters of all chunks of one text."""
    lines = [x + "\n" for x in t.split("\n")[:-1]] + ([t.split("\n")[-1]] if t.split("\n")[-1] else [])
    k = Kernel()
    h = np.array([k.ranges(k.prefix(np.frombuffer(x.rstrip("\n").encode() if x.endswith("\n") else x.encode(), np.uint8)), np.array([0]), np.array([len((x[:-1] if x.endswith("\n") else x).encode())]))[0] for x in lines], U)
    r = [mix(np.array([(h[i - 1] if i else U(0)) * U(STEP) + h[i]], U))[0] for i in range(len(h))]
    at, start, out = 0, 0, []
    for i, x in enumerate(lines):
        at += len(x)
        if i == len(lines) - 1 or i and r[i] < r[i - 1] and r[i] <= r[i + 1]:
            out.append((start, at))
            start = at
    return out


def brute(rows, least=48):
    occ = {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for s, e in plain_chunks(t or "") if t else []:
            c = t[s:e]
            c = c[:-1] if c.endswith("\n") else c
            if "\n" in c and len(c.encode()) >= least and c.strip():
                occ.setdefault(c, []).append((d, s, e))
    cut = {}
    for v in occ.values():
        for d, s, e in v[1:]:
            cut.setdefault(d, []).append((s, e))
    out = {}
    for d, t in rows:
        spans, at, new = sorted(cut.get(d, [])), 0, ""
        for s, e in spans:
            new, at = new + t[at:s], e
        new = t if not spans else new + t[at:]
        if not spans or new.strip():
            out[d] = new
    return out


def corpus(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    lines = rows[1][1].split("\n")
    while len(lines) < 14:
        lines += [x for x in rows[len(lines)][1].split("\n")]
    passage = "\n".join(x[:120] for x in lines[:14])
    return rows + [(1000 + i, "\n".join(f"own {i} {j}" for j in range(i % 5)) + "\n" + passage + f"\nend é {i}") for i in range(20)]


def test_matches_brute_force(spark, sf):
    rows = corpus(spark, sf)
    df = spark.createDataFrame(rows, DDL)
    want = brute(rows)
    assert sum(want.get(d) != t for d, t in rows) > 15
    assert {r.doc_id: r.text for r in line_dedup(df).collect()} == want
    assert {r.doc_id: r.text for r in line_dedup(df, max_broadcast_mb=-1).collect()} == want


def test_shift_resistant():
    passage = "\n".join(f"line {i * i} of the passage" for i in range(40))
    k, seen = Kernel(), []
    for before in ("", "a\n", "a\nb\nc\n", "zz\n" * 9):
        _, h, *_ = chunks(k, pa.array([before + passage + "\n"]), 1)
        seen.append(set(h.tolist()))
    assert len(set.intersection(*seen)) >= 0.7 * len(seen[0])


def test_cases(spark):
    two = "a line of some length, the first of two\nand another line that is long enough\n"
    rows = [(1, None), (2, ""), (3, "x"), (4, two), (5, two), (5, two), (None, two), (6, "\n\n\n" * 50), (7, "\n\n\n" * 50), (8, "b\n" * 40000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], DDL + ", cuts int")
    out = line_dedup(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 3, 4, 6, 7, 8]
    kept = {r.doc_id: r.text for r in line_dedup(df, drop_emptied=False).collect()}
    assert kept[5] == "" and kept[None] == "" and kept[4] == two and kept[8] == "b\n" * 40000
    assert line_dedup(df.limit(0)).count() == 0


def brute_whole(rows, least=48):
    """Every line of a run of two or more lines and least bytes that stands earlier."""
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (t or "").split("\n")
        feeds = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        lines, gone, new = lines[: len(feeds)], set(), []
        for i in range(len(lines)):
            for j in range(i + 1, len(lines)):
                run = "\n".join(lines[i : j + 1])
                if len(run.encode()) >= least and run.strip():
                    # an earlier start in the same text comes first as well
                    if run in seen:
                        gone |= set(range(i, j + 1))
                    seen.add(run)
        out[d] = "".join(x for i, x in enumerate(feeds) if i not in gone) if gone else t
        if gone and not out[d].strip():
            del out[d]
    return out


def test_short_passages_between_other_lines(spark, tmp_path):
    rows = []
    for n in range(2, 7):
        passage = "\n".join(f"line {j} of the passage é of {n} lines, which goes on" for j in range(n))
        rows += [(100 * n + i, f"before {n} {i}\n{passage}\nafter {n} {i}\n") for i in range(12)]
    df = spark.createDataFrame(rows, DDL)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {d: t if d % 100 == 0 else f"before {d // 100} {d % 100}\nafter {d // 100} {d % 100}\n" for d, t in rows}
    assert got == brute_whole(rows)


def test_whole_against_brute_force(spark):
    rng = random.Random(4)
    lines = ["a", "", "é" * 11, "b" * 20, "c" * 24, "d" * 60, "  ", "e" * 7, "f" * 47]
    rows = [(d, "\n".join(rng.choices(lines, k=rng.randrange(0, 12))) + rng.choice(["", "\n"])) for d in range(60)]
    rows += [(None, rows[3][1]), (70, None), (5, rows[5][1])]
    df = spark.createDataFrame(rows, DDL)
    want = brute_whole(rows)
    assert sum(want.get(d) != t for d, t in rows) > 20
    for mb in (16, -1):
        got = [tuple(r) for r in line_dedup(df, whole=True, max_broadcast_mb=mb).collect()]
        assert dict(got) == want and len(got) == len(want) + (5 in want)
