"""Row-wise scorers of short texts. A scorer is a function of Columns that gives one Column; null means not applicable.

Every scorer takes a language per row (a Column) or for all rows (a string); languages other than en, zh and es are scored
as en unless stated. All scorers stay inside codegen; a model enters as a score column or a pandas UDF (see gated_rater).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import by_language, count_of, has_any, line_count, strip, visible_length, word_count

Lang = Column | str


def is_valid(t: Column, lang: Lang = "en") -> Column:
    """Whether a text is one single joke: few questions, no dialogue marks, few lines."""

    def one(code: str) -> Column:
        low = t if code == "zh" else F.lower(t)
        if code == "es":
            questions = count_of(t, "?") + count_of(t, "¿") > 2
        else:
            questions = count_of(t, "？" if code == "zh" else "?") > 1
        return ~(questions | (count_of(low, L.QUESTION_WORD[code]) > 1) | has_any(low, L.DIALOGUE_MARKS[code]) | (line_count(t) > L.MAX_LINES))

    return by_language(lang, one)


def structure(t: Column, lang: Lang = "en") -> Column:
    """Structure tag; the first pattern that matches wins."""

    def one(code: str) -> Column:
        low = t if code == "zh" else F.lower(t)
        if code == "zh":
            punchline = F.contains(t, F.lit("？")) & has_any(t, ("！", "。"))
        elif code == "es":
            punchline = has_any(t, ("?", "¿")) & has_any(t, ("!", "¡", "."))
        else:
            punchline = (count_of(t, "?") == 1) & has_any(t, ("!", "."))
        out = None
        for tag, pattern in L.STRUCTURE_PATTERNS[code].items():
            out = F.when(low.rlike(pattern), tag) if out is None else out.when(low.rlike(pattern), tag)
        return out.when(punchline, "qa-punchline").when(has_any(low, L.OBSERVATIONS[code]), "observation").otherwise("one-liner")

    return by_language(lang, one)


def pair_words(prompt: Column) -> tuple[Column, Column]:
    """The two words a word-pair prompt asks for; nulls for other prompts."""
    pick = lambda g: F.coalesce(*(F.nullif(F.regexp_extract(prompt, p, g), F.lit("")) for p in L.PAIR_PATTERNS))
    return pick(1), pick(2)


def word_pair(t: Column, prompt: Column) -> Column:
    """2 with both words of the prompt, -1 with one, -2 with none; null for prompts without a word pair."""
    a, b = pair_words(prompt)
    low = F.lower(t)
    hits = F.contains(low, strip(F.lower(a))).cast("int") + F.contains(low, strip(F.lower(b))).cast("int")
    return F.when(hits == 2, 2.0).when(hits == 1, -1.0).when(hits == 0, -2.0)  # null words give null hits


def text_size(t: Column, lang: Lang = "en") -> Column:
    """Words, or visible characters for zh."""
    return by_language(lang, lambda code: visible_length(t) if code == "zh" else word_count(t))


def headline(t: Column, prompt: Column, lang: Lang = "en") -> Column:
    """1 for an answer to a headline that is short and doesn't talk about the task, else -1; null for word-pair prompts."""

    def one(code: str) -> Column:
        size = visible_length(t) if code == "zh" else word_count(t)
        return (
            F.when(has_any(F.lower(prompt), L.HEADLINE_SKIP[code]), None)
            .when(size > L.HEADLINE_MAX[code], -1.0)
            .when(has_any(F.lower(t), L.HEADLINE_BAD[code]), -1.0)
            .otherwise(1.0)
        )

    return by_language(lang, one, default=None)


def has_emoji(t: Column) -> Column:
    return t.rlike(L.EMOJI_COARSE) & t.rlike(L.EMOJI_CLASS)


def has_forbidden(t: Column) -> Column:
    return F.contains(t, F.lit("#")) | F.contains(t, F.lit("@")) | has_emoji(t)


def formatting(t: Column, lang: Lang = "en", valid: Column | None = None) -> Column:
    """-5 with forbidden signs, -1 with chatter, wide gaps or an invalid form, else 1. valid: is_valid, if it is a column already."""
    valid = is_valid(t, lang) if valid is None else valid
    chatter = by_language(lang, lambda code: has_any(t, L.CHATTER[code]))
    return F.when(has_forbidden(t), -5.0).when(chatter | F.contains(t, F.lit("   ")), -1.0).when(~valid, -1.0).otherwise(1.0)


def length_penalty(t: Column, lang: Lang = "en") -> Column:
    """-2 outside the bounds, else -0.2 for each word (zh: character) beyond the best length."""

    def one(code: str) -> Column:
        low, high, best = L.LENGTHS[code]
        size = visible_length(t) if code == "zh" else word_count(t)
        return F.when((size < low) | (size > high), -2.0).otherwise(F.lit(-0.2) * F.greatest(F.lit(0), size - best) + F.lit(0.0))

    return by_language(lang, one)


def coherence(t: Column, lang: Lang = "en", weight: float = L.COHERENCE_WEIGHT) -> Column:
    """Penalty for many capitalised words, or for zh many marks."""

    def one(code: str) -> Column:
        if code == "zh":
            size, hits, limit = visible_length(t), F.regexp_count(t, F.lit(L.ZH_PUNCTUATION)), L.PUNCTUATION_LIMIT
        else:
            capitals = rf"(?<!{L.WORD})[A-Z][a-z]*(?!{L.WORD})"
            size, hits, limit = word_count(t), F.regexp_count(t, F.lit(capitals)), L.CAPITALS_LIMIT
        # greatest skips the null ratio of an empty text
        return F.lit(-weight) * F.greatest(F.try_divide(hits, size) - limit, F.lit(0.0)) + F.lit(0.0)

    return by_language(lang, one)


def gated_rater(score: Column, t: Column, lang: Lang = "en", valid: Column | None = None) -> Column:
    """A rater's score where the text is valid, else 0. For a rater UDF pass nulled(t): it then sees no invalid text."""
    return F.when(is_valid(t, lang) if valid is None else valid, F.coalesce(score, F.lit(0.0))).otherwise(0.0)


def nulled(t: Column, lang: Lang = "en") -> Column:
    """The text where it is valid, else null: input for an expensive rater."""
    return F.when(is_valid(t, lang), t)


# Earlier variants, English only.


def is_valid_v0(t: Column) -> Column:
    """As is_valid, without the dialogue check."""
    return ~((count_of(t, "?") > 1) | (count_of(F.lower(t), "why ") > 1) | (line_count(t) > L.MAX_LINES))


def structure_v0(t: Column) -> Column:
    low, p = F.lower(t), L.STRUCTURE_PATTERNS["en"]
    punchline = (count_of(t, "?") == 1) & has_any(t, ("!", "."))
    return (
        F.when(low.rlike(p["why-did"]), "why-did")
        .when(low.rlike(L.EARLY_WHERE_PATTERN), "where-did")
        .when(low.rlike(p["what-do-you-call"]), "what-do-you-call")
        .when(low.rlike(p["knock-knock"]), "knock-knock")
        .when(punchline, "qa-punchline")
        .when(has_any(low, L.OBSERVATIONS["en"]), "observation")
        .otherwise("one-liner")
    )


def word_pair_v0(t: Column, prompt: Column) -> Column:
    """Only prompts that contain two words; a word is looked for inside single words."""
    pick = lambda g: F.lower(F.nullif(F.regexp_extract(prompt, L.EARLY_PAIR_PATTERN, g), F.lit("")))
    a, b = pick(1), pick(2)
    # a word inside one of the text's words: the text contains it and it has no white space itself
    found = lambda w: (F.contains(F.lower(t), w) & ~w.rlike(L.WS)).cast("int")
    hits = found(a) + found(b)
    return F.when(~F.contains(prompt, F.lit("two words")) | a.isNull() | b.isNull(), None).otherwise(F.when(hits == 2, 2.0).when(hits == 1, -1.0).otherwise(-2.0))


def headline_v0(t: Column, prompt: Column) -> Column:
    return F.when(F.contains(prompt, F.lit("two words")), None).when((word_count(t) <= L.HEADLINE_MAX["en"]) & ~F.contains(t, F.lit("headline")), 1.0).otherwise(-1.0)


def formatting_v0(t: Column) -> Column:
    bad = F.contains(t, F.lit("#")) | has_any(t, L.EARLY_CHATTER) | F.contains(t, F.lit("   ")) | has_emoji(t) | ~is_valid_v0(t)
    return F.when(bad, -1.0).otherwise(1.0)


def rater_v0(label: Column, t: Column) -> Column:
    """Score from a label's last character (so '10' counts 0), gated by the early validity."""
    return F.when(is_valid_v0(t), F.right(label, F.lit(1)).try_cast("double")).otherwise(0.0)


@dataclass(frozen=True)
class Scorer:
    """A registered scorer: fn(text, prompt, lang) gives its Column; weight is its default in the composite."""

    fn: Callable[[Column, Column, Lang], Column]
    weight: float
    needs_prompt: bool = False


REGISTRY: dict[str, Scorer] = {
    "word_pair": Scorer(lambda t, p, lang: word_pair(t, p), L.TRAINING_WEIGHTS["word_pair"], True),
    "headline": Scorer(lambda t, p, lang: headline(t, p, lang), L.TRAINING_WEIGHTS["headline"], True),
    "formatting": Scorer(lambda t, p, lang: formatting(t, lang), L.TRAINING_WEIGHTS["formatting"]),
    "length": Scorer(lambda t, p, lang: length_penalty(t, lang), L.TRAINING_WEIGHTS["length"]),
    "coherence": Scorer(lambda t, p, lang: coherence(t, lang), L.TRAINING_WEIGHTS["coherence"]),
}
