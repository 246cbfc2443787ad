"""Cleaning of generated texts and parsing of ratings."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import strip, word_count


def clean_generation(df: DataFrame, text: str, into: str = "clean") -> DataFrame:
    """Strips known prefixes (each from the already shortened text), outer quotes, and all after the first separator.

    Done in stages of one column, so that the expression doesn't grow with every step.
    """
    out = df.withColumn(into, strip(F.col(text)))
    c = F.col(into)
    for p in L.CLEAN_PREFIXES:
        out = out.withColumn(into, F.when(F.startswith(F.lower(c), F.lit(p.lower())), strip(F.substring(c, len(p) + 1, 1 << 30))).otherwise(c))
    quoted = F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"'))
    out = out.withColumn(into, F.when(quoted, F.when(F.length(c) < 2, F.lit("")).otherwise(F.substring(c, F.lit(2), F.length(c) - 2))).otherwise(c))
    for s in L.CLEAN_SEPARATORS:
        out = out.withColumn(into, F.when(F.contains(c, F.lit(s)), strip(F.substring_index(c, s, 1))).otherwise(c))
    return out


def clean_caption(t: Column) -> Column:
    return F.replace(t, F.lit("“"), F.lit(""))


def after_last(t: Column, marker: str = L.ASSISTANT_MARKERS[0]) -> Column:
    """What follows the last marker, stripped; the whole stripped text without one."""
    return strip(F.substring_index(t, marker, -1))


def between_first(t: Column, marker: str = L.ASSISTANT_MARKERS[1]) -> Column:
    """Text between the first and the second marker; null without a marker."""
    rest = F.substring(t, F.locate(marker, t) + len(marker), F.length(t))
    return F.when(F.contains(t, F.lit(marker)), F.substring_index(rest, marker, 1))


def drop_prefix(response: Column, prompt: Column) -> Column:
    """The response after as many characters as the prompt has, stripped."""
    return strip(F.substring(response, F.length(prompt) + 1, F.length(response)))


def shorten(t: Column, limit: int = 100) -> Column:
    return F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit("..."))).otherwise(t)


def title_and_body(df: DataFrame, title: str = "title", body: str = "body", score: str = "score", least: int = 5, most: int = 24) -> DataFrame:
    """(joke, score): title and body joined, of 5 to 24 words and a positive score, scaled so that the best kept one has 1000."""
    kept = df.select(F.concat(F.col(title), F.lit(" "), F.col(body)).alias("joke"), F.col(score).alias("raw")).where(word_count(F.col("joke")).between(least, most) & (F.col("raw").cast("int") > 0))
    return scale_to_max(kept, "raw", "score").drop("raw")


def scale_to_max(df: DataFrame, value: str, into: str, top: float = 1000.0) -> DataFrame:
    """value / max(value) * top; the one-row maximum is joined, so no window gathers all rows."""
    best = df.agg(F.max(value).alias("_best"))
    return df.crossJoin(F.broadcast(best)).withColumn(into, F.try_divide(F.col(value), F.col("_best")) * top).drop("_best")


def name_and_path(spec: Column) -> tuple[Column, Column]:
    """name:path, split at the first colon."""
    parts = F.split(spec, ":", 2)
    return parts[0], F.get(parts, F.lit(1))


def rating(t: Column) -> Column:
    """The first "rating": number of one or two digits, within 0..10; 0 without one."""
    found = F.nullif(F.regexp_extract(t, L.RATING_PATTERN, 1), F.lit(""))
    return F.coalesce(F.least(F.lit(10.0), F.greatest(F.lit(0.0), found.cast("double"))), F.lit(0.0))


# a literal dictionary of a rating without leading zeros and a reason in either kind of quotes
_PLAIN = r"""\A\{(?:'rating'|"rating"): (0|[1-9][0-9]{0,8}), (?:'reason'|"reason"): (?:'([^'"\\\r\n\x00]*)'|"([^'"\\\r\n\x00]*)")\}?\z"""


def rating_and_reason(df: DataFrame, text: str) -> DataFrame:
    """Adds rating and reason read from a literal dictionary, its closing brace perhaps missing; 0 and '' where unreadable.

    The plain shape, a whole rating and then a reason without quotes, escapes or line breaks, is read by a pattern; only other
    texts reach Python, in batches.
    """

    def read(t: object) -> tuple[int, str]:
        if t is None:
            return 0, ""
        try:
            value = ast.literal_eval(t if t.endswith("}") else t + "}")
            if isinstance(value, dict):
                return int(value.get("rating", 0)), str(value.get("reason", ""))
        except Exception:
            pass
        return 0, ""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            yield pd.DataFrame([read(t) for t in s], columns=["rating", "reason"]).astype({"rating": "int64"})

    both = F.pandas_udf(run, "rating bigint, reason string")
    plain = F.col(text).rlike(_PLAIN)
    rest = df.withColumn("_r", both(F.when(~plain, F.col(text))))
    group = lambda k: F.regexp_extract(text, _PLAIN, k)
    return rest.withColumn("rating", F.when(plain, group(1).cast("bigint")).otherwise(F.col("_r.rating"))).withColumn("reason", F.when(plain, F.concat(group(2), group(3))).otherwise(F.col("_r.reason"))).drop("_r")


def average_label(a: Column, b: Column) -> Column:
    """Floor of the mean of two labels; -1 counts as 0."""
    mean = F.floor((a + b) / 2).cast("int")
    return F.when(mean == -1, 0).otherwise(mean)
