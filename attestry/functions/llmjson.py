"""JSON out of what language models write: fences, prose around it, small defects."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.functions.text import BLANKS, WS, c, strip_thinking, text, trim


def strip_fences(x: Column | str) -> Column:
    y = F.regexp_replace(trim(text(x)), rf"^(?i:```(?:json)?){WS}*", "")
    return trim(F.regexp_replace(y, rf"{WS}*```\z", ""))


def repair(x: Column | str) -> Column:
    """Without commas before a closing bracket; backslashes that escape nothing doubled."""
    y = F.regexp_replace(c(x), rf",{WS}*([}}\]])", "$1")
    return F.regexp_replace(y, r'\\(?!["\\/bfnrtu])', r"\\\\")


BRACES = re.compile(r'["{}\\]')


def _balanced(s: str) -> list[str]:
    """Top-level {...}, with regard to strings and escapes."""
    out, start, depth, quoted, skip = [], -1, 0, False, -1
    for m in BRACES.finditer(s):
        i, ch = m.start(), m.group()
        if quoted:
            if i == skip:
                continue
            if ch == "\\":
                skip = i + 1
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = True
        elif ch == "{":
            start = i if depth == 0 else start
            depth += 1
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(s[start : i + 1])
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def balanced_objects(arr: pa.Array) -> pa.Array:
    return pa.array([None if s is None else _balanced(s) for s in arr.to_pylist()], pa.list_(pa.string()))


COMMA, LONE = re.compile(rf",{WS}*([}}\]])"), re.compile(r'\\(?!["\\/bfnrtu])')
OPEN, CLOSE = re.compile(rf"^(?i:```(?:json)?){WS}*"), re.compile(rf"{WS}*```\Z")


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _is_object(s: str) -> bool:
    try:
        return isinstance(json.loads(s, parse_constant=_no_constant), dict)
    except (ValueError, RecursionError):
        return False


def _object(s: str) -> str | None:
    """The first candidate that is a JSON object; each is tried once."""
    y = CLOSE.sub("", OPEN.sub("", s.strip(BLANKS))).strip(BLANKS)
    if y.startswith("{") and _is_object(y):
        return y
    a, b = y.find("{"), y.rfind("}")
    if a < 0:
        return None
    for c in dict.fromkeys([y, *_balanced(y), *([y[a : b + 1]] if b > a else [])]):
        for t in dict.fromkeys((c, LONE.sub(r"\\\\", COMMA.sub(r"\1", c)))):
            if _is_object(t):
                return t
    return None


@F.arrow_udf(T.StringType())
def _objects(arr: pa.Array) -> pa.Array:
    return pa.array([None if s is None else _object(s) for s in arr.to_pylist()], pa.string())


def outer(x: Column, left: str, right: str) -> Column:
    """From the first left to the last right, or null."""
    a = F.instr(x, left)
    b = F.length(x) - F.instr(F.reverse(x), right) + 1
    return F.when((a > 0) & (F.instr(x, right) > 0) & (b > a), F.substring(x, a, b - a + 1))


def extract_object(x: Column | str) -> Column:
    """The first candidate that is a JSON object, as its text, or null: the whole, each
    balanced object, the span from first to last brace; each as it is, then repaired. One
    pass over each text, which ends with the first that holds."""
    return _objects(text(x))


def is_object(s: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(s)).startswith("OBJECT"), F.lit(False))


def is_array(s: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(s)).startswith("ARRAY"), F.lit(False))


def field(x: Column, *names: str) -> Column:
    """The first of the named members that is an array, as text."""
    v = F.try_parse_json(x)
    return F.coalesce(*(F.when(is_array(F.to_json(F.try_variant_get(v, f"$.{n}", "variant"))), F.to_json(F.try_variant_get(v, f"$.{n}", "variant"))) for n in names))


def extract_array(x: Column | str) -> Column:
    """A JSON array as text, or null: the text itself, its items or questions; those or
    qa of an object in it; the span from first to last bracket, repaired."""
    y = strip_fences(strip_thinking(x))
    inner = extract_object(y)
    span = F.regexp_replace(outer(y, "[", "]"), rf",{WS}*([}}\]])", "$1")
    return F.coalesce(F.when(is_array(y), y), field(y, "items", "questions"), field(inner, "items", "questions", "qa"), F.when(is_array(span), span))


def message_text(x: Column | str) -> Column:
    """Content, or reasoning, of the first choice of a chat response."""
    v = F.try_parse_json(c(x))
    get = lambda p: F.try_variant_get(v, p, "string")
    return trim(F.coalesce(get("$.choices[0].message.content"), get("$.choices[0].message.reasoning_content"), F.lit("")))


def judge_verdict(raw: Column | str) -> Column:
    """Struct correct, reason of a judge's raw answer; null where no object is in it."""
    from attestry.functions.text import json_bool

    o = extract_object(strip_thinking(raw))
    v = F.try_parse_json(o)
    return F.when(o.isNotNull(), F.struct(json_bool(F.try_variant_get(v, "$.correct", "string")).alias("correct"), trim(F.coalesce(F.try_variant_get(v, "$.reason", "string"), F.lit(""))).alias("reason")))


def qa_items(raw: Column | str) -> Column:
    """Array of (query, answer, quote) of a generator's raw answer, aliases merged, only
    those with a query, an answer and a quote, in order."""
    v = F.from_json(extract_array(raw), "array<string>")

    def item(s: Column) -> Column:
        o = F.try_parse_json(s)
        get = lambda *names: trim(F.coalesce(*(F.nullif(F.try_variant_get(o, f"$.{n}", "string"), F.lit("")) for n in names), F.lit("")))
        raw_answer = F.coalesce(F.try_variant_get(o, "$.answer", "variant"), F.try_variant_get(o, "$.answers", "variant"))
        answers = F.coalesce(F.from_json(F.to_json(raw_answer), "array<string>"), F.array(raw_answer.try_cast("string")))
        answers = F.filter(F.transform(answers, lambda a: trim(F.coalesce(a, F.lit("")))), lambda a: a != "")
        return F.struct(get("query", "question").alias("query"), answers.alias("answer"), get("evidence_quote", "quote", "evidence").alias("quote"))

    return F.filter(F.transform(v, item), lambda i: (i["query"] != "") & (F.size(i["answer"]) > 0) & (i["quote"] != ""))
