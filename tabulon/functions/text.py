"""Prompt-text mining (T1-T9) as column expressions and table operators.

The reference parsed one uploaded question file with Python ``re``; here a
table of prompts ``(id, text)`` is mined with Spark's regex functions, so
millions of prompts split over tasks and never leave the JVM.  The patterns
behave the same in Java and Python regex on the reference's prompt files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The extraction patterns and trigger phrases.
URL_PATTERN = r"https?://[^\s\n]+"
QUESTION_PATTERN = r"\d+\.\s*([^?\n]+\??)"
QUESTION_LINE_PATTERN = r"(?m)^\s*\d+\.\s+(.+)$"
JSON_KEY_PATTERN = r"-\s*`([^`]+)`\s*:"
JSON_OBJECT_PHRASES = ["return a json object", "json object with keys", "return json",
                       "output json", "respond with json"]
TRAILING_PUNCT = r"[).,]+$"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def urls(text: str | Column, strip_trailing: bool = False) -> Column:
    """Distinct URLs of a text as ``array<string>`` (order of first use)."""
    found = F.regexp_extract_all(_c(text), F.lit(URL_PATTERN), 0)
    cleaned = F.transform(found, lambda u: F.trim(
        F.regexp_replace(u, TRAILING_PUNCT, "") if strip_trailing else u))
    return F.array_distinct(F.filter(cleaned, lambda u: u != ""))


def extract_urls(df: DataFrame, id_col: str, text_col: str,
                 strip_trailing: bool = False) -> DataFrame:
    """``(id, url)`` -- one row per distinct URL of each text."""
    return df.select(F.col(id_col).alias("id"),
                     F.explode(urls(text_col, strip_trailing)).alias("url"))


def questions(text: str | Column, line_anchored: bool = False) -> Column:
    """Numbered questions of a text; none found -> the whole trimmed text."""
    pat = QUESTION_LINE_PATTERN if line_anchored else QUESTION_PATTERN
    found = F.filter(F.transform(F.regexp_extract_all(_c(text), F.lit(pat), 1),
                                 lambda q: F.trim(q)), lambda q: q != "")
    whole = F.trim(_c(text))
    return F.when(F.size(found) > 0, found).otherwise(
        F.when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>")))


def extract_questions(df: DataFrame, id_col: str, text_col: str,
                      line_anchored: bool = False) -> DataFrame:
    """``(id, pos, question)``."""
    return df.select(F.col(id_col).alias("id"),
                     F.posexplode(questions(text_col, line_anchored)).alias("pos", "question"))


def format_requirement(text: str | Column) -> Column:
    """T3: 'standard' or 'JSON array', plus ' with base64 images'."""
    low = F.lower(_c(text))
    base = F.when(low.contains("json array"), F.lit("JSON array")).otherwise(F.lit("standard"))
    return F.when(low.contains("base64"), F.concat(base, F.lit(" with base64 images"))) \
        .otherwise(base)


def wants_json_object(text: str | Column) -> Column:
    """T5: the text asks for a JSON object (one of five phrases)."""
    low = F.lower(_c(text))
    cond = F.lit(False)
    for p in JSON_OBJECT_PHRASES:
        cond = cond | low.contains(p)
    return cond


def json_keys(text: str | Column) -> Column:
    """T5: key names from ``- `key`:`` bullets, in order."""
    return F.regexp_extract_all(_c(text), F.lit(JSON_KEY_PATTERN), 1)


def answer_shape(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """T3 + T5: ``(id, format, json_object, keys)`` -- ``json_object`` only
    when a phrase asks for it and at least one key is named."""
    keys = json_keys(text_col)
    return df.select(F.col(id_col).alias("id"),
                     format_requirement(text_col).alias("format"),
                     (wants_json_object(text_col) & (F.size(keys) > 0)).alias("json_object"),
                     keys.alias("keys"))


def answers_object(keys: str | Column, answers: str | Column) -> Column:
    """JSON object mapping the i-th key to the i-th answer, missing -> null."""
    a = _c(answers)
    return F.to_json(F.map_from_arrays(
        _c(keys), F.transform(_c(keys), lambda k, i: F.get(a, i))))


def strip_text(c: str | Column) -> Column:
    """Python ``str.strip()`` (Unicode whitespace)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def split_first(c: str | Column, sep: str = ":") -> Column:
    """Split on the first ``sep`` only -> array of at most two parts."""
    return F.split(_c(c), F.lit(sep.replace("\\", "\\\\").replace(".", "\\.")), 2)
