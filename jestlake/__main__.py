"""Command line: python -m jestlake COMMAND ...

    prepare   training and test prompts of a language from a task file, word lists and headlines
    evaluate  detail rows and the summary per model of stored generations
    compare   base against trained per language
    submit    the submission file of cleaned generations for a task file
    split     rated jokes of one language or all, loaded and split

Generations are parquet files: model, prompt_idx, prompt, joke and ev (the rater's score of the joke); for compare also language;
for submit id and raw. The session is the one spark-submit brings, or a local one.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.prompts import hashed_pairs
from .operators.splits import head
from .plans import pipelines
from .session import ship
from .sources import readers, sinks


def _words(path: str) -> list[str]:
    """A word list, one word a line; words listed twice weigh twice."""
    with open(path, encoding="utf-8") as lines:
        return [w for line in lines if (w := line.strip())]


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    pairs = hashed_pairs(spark.range(a.word_pairs).select(F.col("id").alias("key")), F.col("key"), _words(a.nouns), _words(a.verbs), a.seed)
    heads = spark.read.text(a.headlines).select(F.xxhash64("value").alias("key"), F.col("value").alias("headline")).where("headline <> ''")
    for split, path in pipelines.prepare_data(spark, a.language, a.tasks, a.output, pairs, head(heads, a.max_headlines, "key"), a.seed).items():
        print(f"{split}: {spark.read.parquet(path).count()} prompts -> {path}")


def _generations(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = spark.read.parquet(*a.generations)
    return rows if a.num_samples is None else rows.where(F.col("prompt_idx") < a.num_samples)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _generations(spark, a)
    if "generation_idx" not in rows.columns:
        rows = rows.withColumn("generation_idx", F.lit(0))
    detail, summary = pipelines.evaluate_models(rows, F.col("ev"), a.language)
    sinks.write_csv(detail, f"{a.output}/detail", single=False)
    sinks.write_csv(summary, f"{a.output}/summary")
    print(sinks.markdown_table(summary.select("model", "rater_mean", "rater_std", "validity_rate", "word_pair_mean", "distinct_2", "avg_word_count"), "model"))


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    summary, deltas = pipelines.compare(_generations(spark, a), F.col("language"), a.base, a.trained)
    sinks.write_csv(summary, f"{a.output}/summary")
    sinks.write_csv(deltas, f"{a.output}/deltas")
    print(sinks.markdown_table(deltas, "language"))


def submit(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = pipelines.submission(readers.task_tsv(spark, a.tasks), spark.read.parquet(*a.generations), a.language)
    for r in sinks.write_submissions(rows, a.output).collect():  # the first three
        print(r["id"], r["text"])


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    paths = {code: path for code, path in (("en", a.en), ("zh", a.zh), ("es", a.es)) if path}
    rows = pipelines.load_split(spark, paths, a.language, a.seed)
    rows.write.mode("overwrite").partitionBy("split_name").parquet(a.output)
    print(sinks.markdown_table(spark.read.parquet(a.output).groupBy("split_name").count(), "split_name"))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="jestlake", description=__doc__.split("\n")[0])
    commands = top.add_subparsers(dest="command", required=True)

    def command(run, *options: tuple) -> None:
        own = commands.add_parser(run.__name__)
        own.set_defaults(run=run)
        for name, settings in options:
            own.add_argument(name, **settings)

    language = ("--language", {"choices": ["en", "zh", "es"], "default": "en"})
    seed = ("--seed", {"type": int, "default": 42})
    output = ("--output", {"required": True})
    tasks = ("--tasks", {"required": True, "help": "tab-separated id, word1, word2, headline"})
    generations = ("--generations", {"required": True, "nargs": "+", "help": "parquet files"})
    samples = ("--num-samples", {"type": int, "default": None, "help": "prompts per model, the first ones; all by default"})
    command(prepare, language, tasks, output, ("--nouns", {"required": True}), ("--verbs", {"required": True}), ("--headlines", {"required": True, "help": "text, one a line"}), ("--word-pairs", {"type": int, "default": 500}), ("--max-headlines", {"type": int, "default": 500}), seed)
    command(evaluate, language, generations, output, samples)
    command(compare, generations, output, samples, ("--base", {"default": "base"}), ("--trained", {"default": "trained"}))
    command(submit, language, tasks, generations, output)
    command(split, ("--language", {"choices": ["en", "zh", "es", "all"], "default": "all"}), *((f"--{code}", {"help": "rated jokes"}) for code in ("en", "zh", "es")), output, seed)
    return top


def main(argv: list[str] | None = None) -> None:
    arguments = parser().parse_args(argv)
    spark = SparkSession.builder.appName("jestlake").getOrCreate()
    ship(spark)
    arguments.run(spark, arguments)


if __name__ == "__main__":
    main()
