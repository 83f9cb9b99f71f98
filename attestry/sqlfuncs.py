"""Views of the text functions for SQL: SELECT attestry_normalize_text(x) ..."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions.llmjson import _balanced
from attestry.operators.chunking import tokens

WS = "[\\\\t\\\\n\\\\x0B\\\\f\\\\r \\\\u00A0\\\\u1680\\\\u2000-\\\\u200A\\\\u2028\\\\u2029\\\\u202F\\\\u205F\\\\u3000\\\\uFEFF]"
NATIVE = {
    "attestry_trim(x STRING) RETURNS STRING": f"regexp_replace(x, '^{WS}+|{WS}+$', '')",
    "attestry_compact_whitespace(x STRING) RETURNS STRING": f"regexp_replace(regexp_replace(regexp_replace(replace(coalesce(x, ''), '\\r\\n', '\\n'), '[ \\\\t]+', ' '), '\\\\n{{3,}}', '\\n\\n'), '^{WS}+|{WS}+$', '')",
    "attestry_strip_thinking(x STRING) RETURNS STRING": f"regexp_replace(regexp_replace(coalesce(x, ''), '(?is)<think>.*?</think>', ''), '^{WS}+|{WS}+$', '')",
    "attestry_percent(x DOUBLE) RETURNS DOUBLE": "CASE WHEN x IS NULL OR isnan(x) OR abs(x) = double('Infinity') THEN 0.0D ELSE floor(x * 10000 + 0.5) / 100 END",
    "attestry_digest(x STRING) RETURNS STRING": "sha2(x, 256)",
}


def register(spark: SparkSession) -> list[str]:
    """Registers temporary functions and returns their names."""
    names = []
    for head, body in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
        names.append(head.split("(")[0])

    def normalize(arr: pa.Array) -> pa.Array:
        import unicodedata

        return pa.array(["" if x is None else "".join(unicodedata.normalize("NFKC", x).replace("﻿", " ").split()).lower() for x in arr.to_pylist()], pa.string())

    def count(arr: pa.Array) -> pa.Array:
        return pa.array([tokens(x or "") for x in arr.to_pylist()], pa.int32())

    def balanced(arr: pa.Array) -> pa.Array:
        return pa.array([None if x is None else _balanced(x) for x in arr.to_pylist()], pa.list_(pa.string()))

    for name, f, kind in (("attestry_normalize_text", normalize, T.StringType()), ("attestry_estimate_tokens", count, T.IntegerType()), ("attestry_json_objects", balanced, T.ArrayType(T.StringType()))):
        spark.udf.register(name, F.arrow_udf(f, kind))
        names.append(name)
    return names
