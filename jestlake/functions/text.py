"""Text primitives with Python's notion of white space, as Column expressions inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import NON_WS, WS

_STRIP = rf"^{WS}+|{WS}+\z"


def strip(t: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(t, _STRIP, "")


def words(t: Column) -> Column:
    """White-space separated words; no empty ones."""
    return F.regexp_extract_all(t, F.lit(f"({NON_WS}+)"), F.lit(1))


def word_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit(f"{NON_WS}+"))


def visible_length(t: Column) -> Column:
    """Characters that are no white space."""
    return F.length(F.regexp_replace(t, WS, ""))


def count_of(t: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("int")


def line_count(t: Column) -> Column:
    """Lines of the stripped text."""
    return count_of(strip(t), "\n") + 1


def has_any(t: Column, parts: tuple[str, ...]) -> Column:
    """Whether the text contains one of the literals."""
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(t, F.lit(p))
    return out


def by_language(lang: Column | str, make: Callable[[str], Column], default: str | None = "en") -> Column:
    """make(language) for a fixed language, or chosen per row; other languages take the default's (None: null)."""
    if isinstance(lang, str):
        if lang in ("en", "zh", "es"):
            return make(lang)
        if default is None:
            raise ValueError(f"unknown language: {lang}")
        return make(default)
    out = make(default) if default else F.lit(None)
    return F.when(lang == "zh", make("zh")).when(lang == "es", make("es")).when(lang == "en", make("en")).otherwise(out)
