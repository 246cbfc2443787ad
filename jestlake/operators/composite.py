"""Weighted rewards over scorer columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from .scorers import REGISTRY, formatting, is_valid, structure, text_size
from ..functions.text import word_count


def weighted(scores: dict[str, Column], weights: dict[str, float], exclude: tuple[str, ...] = ()) -> Column:
    """Sum of weight times score; a null score counts 0; excluded names are left out."""
    terms = [F.lit(w) * F.coalesce(scores[name], F.lit(0.0)) for name, w in weights.items() if name not in exclude and name in scores]
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def score_rows(df: DataFrame, text: str, prompt: str, lang: Column | str) -> DataFrame:
    """Adds is_valid, and word_pair, headline, formatting, length and coherence by the registry; validity is judged once."""
    judged = df.withColumn("is_valid", is_valid(F.col(text), lang))
    own = {"formatting": formatting(F.col(text), lang, F.col("is_valid"))}
    return judged.withColumns({name: own.get(name, s.fn(F.col(text), F.col(prompt), lang)) for name, s in REGISTRY.items()})


def composite(df: DataFrame, rater: Column, text: str, lang: Column | str) -> DataFrame:
    """Adds composite: the rater where valid, plus word pair, formatting, length and coherence (columns of score_rows)."""
    gated = F.when(F.col("is_valid") if "is_valid" in df.columns else is_valid(F.col(text), lang), rater).otherwise(0.0)
    scores = {"rater": gated, **{n: F.col(n) for n in ("word_pair", "formatting", "length", "coherence")}}
    return df.withColumn("composite", weighted(scores, L.COMPOSITE_WEIGHTS))


def training_reward(scores: dict[str, Column], exclude: tuple[str, ...] = ()) -> Column:
    """The seven-term reward: each score and the sum rounded to 3 places (half to even)."""
    half_even = lambda c: F.bround(F.round(c, 9), 3)  # noqa: E731  # the first rounding takes away the noise of binary sums
    rounded = {name: half_even(F.coalesce(c, F.lit(0.0))) for name, c in scores.items()}
    return half_even(weighted(rounded, L.TRAINING_WEIGHTS, exclude))


def detail_rows(df: DataFrame, rater: Column, text: str = "joke", prompt: str = "prompt", lang: Column | str = "en") -> DataFrame:
    """The evaluation detail row per generation."""
    t = F.col(text)
    scored = score_rows(df.withColumn("rater_score", rater), text, prompt, lang)
    return scored.select(
        "model",
        "prompt_idx",
        "generation_idx",
        prompt,
        text,
        "rater_score",
        F.col("word_pair").alias("word_pair_score"),
        F.col("formatting").alias("formatting_score"),
        F.col("length").alias("length_score"),
        F.col("coherence").alias("coherence_score"),
        "is_valid",
        word_count(t).alias("word_count"),
        structure(t, lang).alias("structure"),
    )


def flatten_generations(df: DataFrame, generations: str = "jokes") -> DataFrame:
    """One row per generation of each prompt; generation_idx is its place."""
    return df.select(*[c for c in df.columns if c != generations], F.posexplode(generations).alias("generation_idx", "joke"))


__all__ = ["weighted", "score_rows", "composite", "training_reward", "detail_rows", "flatten_generations", "text_size"]
