"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestry.functions.text import spread
from attestry.llm.decontam import find_contamination
from attestry.llm.exactdedup import exact_dedup
from attestry.llm.jaccard import jaccard_join
from attestry.llm.linededup import line_dedup
from attestry.llm.packing import pack
from attestry.llm.pii import find_identifiers
from attestry.llm.quality import quality_filter
from attestry.llm.suffixdedup import find_repeats
from attestry.llm.urlfilter import url_filter
from attestry.llm.warc import salvage_pages


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_filter(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), score_as="quality_score")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages").select("page_id", "url"))


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return salvage_pages(read(spark, sf_dir, "pages"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read(spark, sf_dir, "documents"), whole=True)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op10_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_identifiers(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_url_filter": op4_url_filter,
    "op5_warc_salvage": op5_warc_salvage,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_line_dedup": op7_line_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_pii_deobfuscation": op10_pii_deobfuscation,
}

ORACLE: dict[str, str] = {
    "op6_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\x{3000}-\x{D7FF}]|[a-z0-9\x{80}-\x{2FFF}\x{E000}-\x{10FFFF}]+') AS ws FROM documents WHERE text IS NOT NULL),
        g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END)) AS gs FROM w WHERE len(ws) > 0),
        s AS (SELECT doc_id, gs, len(gs)::INT AS n, min(doc_id) OVER (PARTITION BY gs) AS rep FROM g),
        r AS (SELECT rep, unnest(gs) AS x, n FROM s WHERE doc_id = rep),
        p AS (SELECT a.rep AS doc_a, b.rep AS doc_b, count(*) AS overlap, any_value(a.n) AS size_a, any_value(b.n) AS size_b FROM r a JOIN r b ON a.x = b.x AND a.rep < b.rep GROUP BY 1, 2),
        q AS (SELECT doc_a, doc_b FROM p WHERE overlap >= 0.6 * (size_a + size_b - overlap) - 1e-9),
        e AS (SELECT doc_a AS x, doc_b AS y FROM q UNION ALL SELECT doc_b, doc_a FROM q),
        m AS (SELECT rep, count(*) AS members FROM s GROUP BY rep),
        c AS (SELECT rep AS x, rep AS y FROM m UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x),
        k AS (SELECT x AS rep, min(y) AS class_id FROM c GROUP BY x),
        l AS (SELECT e.x AS rep, sum(m.members) AS links FROM e JOIN m ON e.y = m.rep GROUP BY e.x)
        SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, (coalesce(l.links, 0) + coalesce(m.members - 1, 0))::BIGINT AS links
        FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN k ON s.rep = k.rep LEFT JOIN m ON s.rep = m.rep LEFT JOIN l ON s.rep = l.rep""",
    "op8_exact_dedup": """
        SELECT * FROM documents
        WHERE text IS NULL OR doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)""",
    "op9_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\x{3000}-\x{D7FF}]|[a-z0-9\x{80}-\x{2FFF}\x{E000}-\x{10FFFF}]+') AS ws FROM documents),
        b AS (SELECT item_id, regexp_extract_all(lower(text), '[\x{3000}-\x{D7FF}]|[a-z0-9\x{80}-\x{2FFF}\x{E000}-\x{10FFFF}]+') AS ws FROM benchmark),
        dw AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS p FROM d),
        bw AS (SELECT item_id, len(ws) AS m, least(20, len(ws)) AS k, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS q FROM b WHERE len(ws) >= 5),
        c AS (SELECT doc_id, item_id, p - q AS diag, n, m, k, list(q) AS qs FROM dw JOIN bw USING (w) GROUP BY ALL HAVING count(*) >= 0.8 * k),
        s AS (SELECT *, unnest(range(greatest(0, -diag), least(m, n - diag) - k + 1)) AS s FROM c),
        x AS (SELECT doc_id, item_id, k, diag + s AS first_word, len(list_filter(qs, lambda q: q >= s AND q < s + k)) AS matches FROM s)
        SELECT doc_id, item_id, arg_max(first_word, matches * 1000000000 - first_word)::INT AS first_word, any_value(k)::INT AS words, max(matches)::INT AS matches
        FROM x WHERE matches >= 0.8 * k GROUP BY doc_id, item_id""",
}
