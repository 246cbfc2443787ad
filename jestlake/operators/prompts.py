"""Prompt building, task routing and prompt sampling."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.text import by_language


def fill(template: str, **columns: Column) -> Column:
    """A template with its {name} places filled; null when a filled column is null. Percent signs and braces in values are safe."""
    parts: list[Column] = []
    rest = template
    while rest:
        hits = [(rest.find("{" + name + "}"), name) for name in columns if "{" + name + "}" in rest]
        if not hits:
            parts.append(F.lit(rest))
            break
        at, name = min(hits)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(columns[name].cast("string"))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def pair_prompt(a: Column, b: Column, lang: Column | str = "en") -> Column:
    return by_language(lang, lambda code: fill(L.PAIR_PROMPTS[code], a=a, b=b), default=None)


def headline_prompt(h: Column, lang: Column | str = "en") -> Column:
    return by_language(lang, lambda code: fill(L.HEADLINE_PROMPTS[code], h=h), default=None)


def prompt_functions(language: str):
    """(pair, headline) builders of one language; ValueError for others."""
    if language not in L.LANGUAGES:
        raise ValueError(f"unknown language: {language}")
    return (lambda a, b: pair_prompt(a, b, language)), (lambda h: headline_prompt(h, language))


def rating_prompt(template: str, joke: Column) -> Column:
    """A rating prompt: the joke in place of the template's {}."""
    before, _, after = template.partition("{}")
    return F.concat(F.lit(before), joke, F.lit(after))


def few_shot_prompt(template: str, a: Column, b: Column) -> Column:
    """A template with two {} places."""
    x, _, rest = template.partition("{}")
    y, _, z = rest.partition("{}")
    return F.concat(F.lit(x), a, F.lit(y), b, F.lit(z))


def chat_message(content: Column, role: str = "user") -> Column:
    return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))


def _task(df: DataFrame) -> tuple[Column, Column, Column]:
    have = set(df.columns)
    return tuple(F.col(c) if c in have else F.lit(L.MISSING) for c in ("word1", "word2", "headline"))


def route_for_training(df: DataFrame, lang: Column | str) -> DataFrame:
    """Adds prompt and drops rows without a task. Nulls are ordinary values that print as 'nan', as in the tables this mirrors."""
    a, b, h = (F.coalesce(c, F.lit("nan")) for c in _task(df))
    prompt = F.when((a != L.MISSING) & (b != L.MISSING), pair_prompt(a, b, lang)).when(h != L.MISSING, headline_prompt(h, lang))
    return df.withColumn("prompt", prompt).where("prompt is not null")


def route_for_submission(df: DataFrame, lang: Column | str) -> DataFrame:
    """Adds prompt to every row; nulls count as missing; rows without a task get the fallback."""
    a, b, h = (F.coalesce(c, F.lit(L.MISSING)) for c in _task(df))
    prompt = F.when((a != L.MISSING) & (b != L.MISSING), pair_prompt(a, b, lang)).when(h != L.MISSING, headline_prompt(h, lang))
    return df.withColumn("prompt", F.coalesce(prompt, F.lit(L.FALLBACK_PROMPT)))


def route_early(df: DataFrame) -> DataFrame:
    """(kind, prompt): all pairs, then all headlines; a row with both gives two prompts."""
    a, b, h = (F.coalesce(c, F.lit("nan")) for c in _task(df))
    pairs = df.where(~((a == L.MISSING) & (b == L.MISSING))).select(F.lit(0).alias("kind"), fill(L.EARLY_PAIR_PROMPT, a=a, b=b).alias("prompt"))
    heads = df.where(h != L.MISSING).select(F.lit(1).alias("kind"), fill(L.EARLY_HEADLINE_PROMPT, h=h).alias("prompt"))
    return pairs.unionByName(heads)


def random_pairs(spark: SparkSession, nouns: list[str], verbs: list[str], n: int = 500, seed: int | None = 42) -> DataFrame:
    """(pos, verb, noun): n pairs drawn with replacement, verb first; lists are parameters and duplicates weigh twice."""
    rng = random.Random(seed)
    rows = [(i, rng.choice(verbs), rng.choice(nouns)) for i in range(n)]
    return spark.createDataFrame(rows, "pos bigint, verb string, noun string")


def hashed_pairs(df: DataFrame, key: Column, nouns: list[str], verbs: list[str], seed: int = 42) -> DataFrame:
    """Adds verb and noun to any number of rows by hashing a key (md5 of key:seed:place): the distributed counterpart of random_pairs."""
    number = lambda salt: F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(str(salt)))), 1, 8), 16, 10).cast("bigint")
    pick = lambda xs, salt: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(number(salt), F.lit(len(xs))) + 1).cast("int"))
    return df.withColumn("verb", pick(verbs, 1)).withColumn("noun", pick(nouns, 2))


def training_prompts(spark: SparkSession, nouns: list[str], verbs: list[str], headlines: list[str], language: str, n_pairs: int = 500, seed: int = 42) -> DataFrame:
    """(pos, prompt): pair prompts and headline prompts, shuffled by the generator that drew the pairs."""
    if language not in L.LANGUAGES:
        raise ValueError(f"unknown language: {language}")
    rng = random.Random(seed)
    pairs = [(rng.choice(verbs), rng.choice(nouns)) for _ in range(n_pairs)]
    prompts = [L.PAIR_PROMPTS[language].format(a=a, b=b) for a, b in pairs] + [L.HEADLINE_PROMPTS[language].format(h=h) for h in headlines]
    rng.shuffle(prompts)
    return spark.createDataFrame(list(enumerate(prompts)), "pos bigint, prompt string")
