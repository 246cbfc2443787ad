"""The end-to-end flows as lazy plans: evaluation, prompt preparation, comparison, submission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.arrays import expected_value
from ..operators.composite import composite, detail_rows, score_rows
from ..operators.metrics import comparison_summary, delta_to_base, model_summary
from ..operators.parsing import clean_generation
from ..operators.prompts import route_for_submission, route_for_training
from ..operators.prompts import headline_prompt, pair_prompt
from ..operators.splits import shuffled, three_way_split
from ..sources import readers, sinks


def evaluate_models(generations: DataFrame, rater: Column, lang: Column | str = "en") -> tuple[DataFrame, DataFrame]:
    """(detail, summary) of rows model, prompt_idx, generation_idx, prompt, joke; rater is a score column or a pandas UDF call."""
    detail = detail_rows(generations, rater, lang=lang)
    return detail, model_summary(detail)


def rated_by_logits(generations: DataFrame, logits: str = "logits") -> DataFrame:
    """Adds ev, the expected rating of stored logits."""
    return generations.withColumn("ev", expected_value(F.col(logits)))


def compare(generations: DataFrame, lang: Column | str = "en", base: str = "base", trained: str = "trained") -> tuple[DataFrame, DataFrame]:
    """(summary, deltas) per language of rows language, model, prompt, joke, ev."""
    scored = composite(score_rows(generations, "joke", "prompt", lang), F.col("ev"), "joke", lang)
    summary = comparison_summary(scored.select("language", "model", "ev", "is_valid", "composite"), ["language", "model"])
    metrics = ["mean_ev_reward", "mean_composite_reward", "validity_rate"]
    return summary, delta_to_base(summary, ["language"], metrics, base=base, trained=trained)


def prepare_prompts(tasks: DataFrame, lang: Column | str) -> DataFrame:
    """Prompts of a task table's rows that hold a task."""
    return route_for_training(tasks, lang).select("prompt")


def load_split(spark: SparkSession, paths: dict[str, str], language: str = "all", seed: int = 42) -> DataFrame:
    """(joke, labels, split_name): the rated jokes of one language or all, split 80 : 10 : 10 and stratified by label.

    Rows are ordered by a hash of their content, so equal rows are interchangeable and the split is the same for any files.
    """
    rows = readers.rated(spark, paths, language)
    return three_way_split(rows, "labels", F.concat_ws("|", "joke", "labels"), seed)


def prepare_data(spark: SparkSession, language: str, tasks_path: str, folder: str, pairs: DataFrame, headlines: DataFrame, seed: int = 42) -> dict[str, str]:
    """Training and test prompts of a language, as parquet files; returns their paths. ValueError for an unknown language.

    pairs: (key, verb, noun); headlines: (key, headline). Training prompts are both together in a seeded order; test prompts
    are those of a task file's rows that hold a task.
    """
    if language not in L.LANGUAGES:
        raise ValueError(f"unknown language: {language}")
    both = pairs.select(F.concat_ws(":", F.lit("pair"), "key").alias("key"), pair_prompt(F.col("verb"), F.col("noun"), language).alias("prompt"))
    both = both.unionByName(headlines.select(F.concat_ws(":", F.lit("headline"), "key").alias("key"), headline_prompt(F.col("headline"), language).alias("prompt")))
    train = shuffled(both, F.col("key"), seed).orderBy("pos").select("prompt")
    test = prepare_prompts(readers.task_tsv(spark, tasks_path), language)
    return {split: sinks.write_prompts(df, folder, split, language) for split, df in (("train", train), ("test", test))}


def submission(tasks: DataFrame, generated: DataFrame, lang: Column | str) -> DataFrame:
    """(id, text): cleaned generations for every task row; rows without one get ''. generated: (id, raw)."""
    asked = route_for_submission(tasks, lang).select("id", "prompt")
    clean = clean_generation(generated, "raw", "text").select("id", "text")
    return asked.join(clean, "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"))
