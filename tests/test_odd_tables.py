"""Queries against their SQL on tables of odd rows."""

import tracemalloc

import duckdb
import pyarrow as pa

from attestry.functions import text
from attestry.operators import chunking, scoring
from attestry.plans.queries import ORACLE, QUERIES
from attestry.streaming import jobs


def both(spark, folder, name, **tables):
    """Rows of the query and of its SQL over tables given as DuckDB SELECTs."""
    db = duckdb.connect()
    for t, sql in tables.items():
        db.execute(f"copy ({sql}) to '{folder}/{t}.parquet' (format parquet)")
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = QUERIES[name](spark, str(folder))
    cols = ", ".join(got.columns)
    return sorted(map(tuple, got.collect()), key=repr), sorted(db.sql(f"select {cols} from ({ORACLE[name]})").fetchall(), key=repr)


def test_sections_of_empty_and_repeated_documents(spark, tmp_path):
    rows = "(1, 0), (2, 1), (3, -5), (4, NULL), (5, 500), (6, 450), (7, 149), (NULL, 900), (9, 90), (9, 3000), (11, NULL), (11, 460), (12, 100000)"
    got, want = both(spark, tmp_path, "section_asof", documents=f"SELECT i::BIGINT AS doc_id, n::BIGINT AS n_chars FROM (VALUES {rows}) t(i, n)")
    assert got == want


def test_job_states_are_not_numbered_in_one_task(spark, tmp_path):
    kinds = "CASE WHEN i % 97 = 0 THEN NULL WHEN i % 11 < 2 THEN 'purchase' ELSE 'view' END"
    users = "CASE WHEN i % 5 < 2 THEN 1 WHEN i % 101 = 0 THEN NULL ELSE i % 60 + 2 END"
    rows = f"SELECT i::BIGINT AS event_id, CASE WHEN i % 13 > 0 THEN TIMESTAMP '2024-01-01' + to_seconds((i * 7919 % 3000)::BIGINT) END AS ts, ({users})::BIGINT AS user_id, CASE WHEN i % 5 < 2 AND i < 2990 THEN 'view' ELSE {kinds} END AS event_type, '' AS props FROM range(3000) t(i)"
    got, want = both(spark, tmp_path, "latest_job_state", events=rows)
    assert got == want
    plan = QUERIES["latest_job_state"](spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_last_lines_of_a_job_in_order(spark):
    rows = [("j", "build", i, "log", str(i)) for i in range(950)] + [("j", "build", 950, "completed", "end"), ("j", "build", 951, "log", "late"), (None, "a", 3, "failed", "x"), (None, "a", 2, "log", "y")]
    events = spark.createDataFrame(rows, "job_id string, kind string, seq long, event string, line string").repartition(5)
    got = {r.job_id: tuple(r)[1:] for r in jobs.latest_states(events).collect()}
    assert got == {"j": ("completed", 950, 100, [str(i) for i in range(550, 950)]), None: ("failed", 1, 8, ["y"])}


def test_documents_meet_items_once_and_without_their_text(spark, sf):
    df = QUERIES["platform_compare"](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    makers = [x for x in plan.splitlines() if "MapInArrow" in x]
    assert len(makers) == 1 and "text" not in makers[0] and "quote" not in makers[0]


def test_pairs_leave_the_worker_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(scoring, "PAIRS_BYTES", 500)
    h = spark.createDataFrame([(i, f"{'x' * 300} and word{i % 7}") for i in range(40)], "hit long, text string").coalesce(1)
    q = spark.createDataFrame([(i, f"word{i % 7}") for i in range(50)], "item long, quote string")
    want = sorted((j, i) for i in range(40) for j in range(50) if i % 7 == j % 7)
    wide = scoring.match_pairs(h, q, "text", "quote")
    assert wide.columns == ["item", "quote", "hit", "text"] and sorted((r.item, r.hit) for r in wide.collect()) == want
    narrow = scoring.match_pairs(h, q, "text", "quote", keep=("hit", "item"))
    assert narrow.columns == ["item", "hit"] and sorted(map(tuple, narrow.collect())) == want


def test_portions_cover_all_texts():
    arr = pa.array(["a" * 10, None, "", "b" * 50, "c", "d" * 9, None])
    for part in (arr, arr.slice(1, 5), arr.slice(0, 0)):
        for most in (1, 10, 20, 1000):
            got = list(text.portions(part, most))
            assert [i for at, n in got for i in range(at, at + n)] == list(range(len(part)))
            assert all(n == 1 or sum(len(x or "") for x in part.slice(at, n).to_pylist()) <= most for at, n in got)


def test_tokens_are_counted_in_bounded_memory():
    some = ["it's 3.14 and 文字 2024-01-02, x\u3000y ", None, "", "don't'stop 1.2.3 "]
    arr = pa.array([x if x is None else x * 2000 for x in some] * 60)
    want = [text.token_weights(arr.slice(i, 1)) for i in range(4)]
    tracemalloc.start()
    words, dense = text.token_weights(arr)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert arr.nbytes > 6 << 20 and peak < 32 << 20
    assert words.tolist() == [int(w[0]) for w, _ in want] * 60 and dense.tolist() == [int(d[0]) for _, d in want] * 60


def test_documents_are_cut_into_sections_once(spark, tmp_path):
    texts = ["repeat('word and 12.5 ', 300)", "repeat('a#b\\n', 150) || repeat(' ', 900) || 'end'", "repeat('文字🙂é', 150)", "repeat('x', 400)", "repeat('y ', 200) || 'z'", "'short'", "''", "NULL", "repeat(chr(10), 500)", "chr(10) || '# head' || repeat('q', 800)"]
    rows = " UNION ALL ".join(f"SELECT {i}::BIGINT AS doc_id, ({x.replace(chr(92) + 'n', chr(10))})::VARCHAR AS text" for i, x in enumerate(texts))
    got, want = both(spark, tmp_path, "markdown_sections", documents=rows)
    assert got == want and len({r[0] for r in got}) == 7
    plan = QUERIES["markdown_sections"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1


def test_chunks_of_many_documents_leave_together(spark):
    kinds = "doc string, text string, page_spans array<struct<page:int,start:int,end:int>>, semantic_spans array<struct<type:string,start:int,end:int,page:int,title:string>>"
    docs = [(f"d{i}", "" if i % 10 == 0 else f"## Head {i}\n\n" + "some words " * (i % 50), None, None) for i in range(3000)]
    rows = chunking.markdown_chunks(spark.createDataFrame(docs, kinds).coalesce(1), "l").collect()
    assert [(r.doc, r.content) for r in rows] == [(d, c[0]) for d, t, *_ in docs for c in chunking.chunked(t)]
