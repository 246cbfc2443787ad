"""Readers with declared schemas. Delimited text follows pandas' quoting: quotes double, line breaks may stand inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import schemas as S

# A record may hold line breaks, so a delimited file is one task; files of one record a line can be read by lines instead.
_CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def task_tsv(spark: SparkSession, path: str) -> DataFrame:
    """id, word1, word2, headline of a task file; '-' is the missing marker. One record a line, so files split."""
    return spark.read.schema(S.TASK).csv(path, sep="\t", header=True, quote='"', escape='"')


def _rated(spark: SparkSession, path: str, sep: str, text: str, label: str, by_line: bool = False) -> DataFrame:
    raw = spark.read.options(**_CSV).option("multiLine", not by_line).option("sep", sep).csv(path)
    # labels truncate towards zero; unreadable ones are dropped like missing ones
    return raw.select(F.col(text).alias("joke"), F.col(label).try_cast("double").try_cast("int").alias("labels")).dropna()


def rated_en(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    return _rated(spark, path, ",", "joke", "labels", by_line)


def rated_zh(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    return _rated(spark, path, "\t", "joke", "average_weighted", by_line)


def rated_es(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    return _rated(spark, path, ",", "joke", "score", by_line)


def rated(spark: SparkSession, paths: dict[str, str], language: str = "all") -> DataFrame:
    """Rated jokes of one language or all of them (bag union)."""
    readers = {"en": rated_en, "zh": rated_zh, "es": rated_es}
    wanted = list(readers) if language == "all" else [language]
    if any(w not in readers for w in wanted):
        raise ValueError(f"unknown language: {language}")
    out = None
    for w in wanted:
        part = readers[w](spark, paths[w])
        out = part if out is None else out.unionByName(part)
    return out


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """(prompt_idx, prompt) of a parquet file or folder of prompts, numbered from 0 without gaps: files by name, rows as stored."""
    df = spark.read.parquet(path)
    if "prompt_idx" in df.columns:
        return df.select("prompt_idx", "prompt")
    rows = df.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"), "prompt")
    sizes = rows.groupBy("_file").agg(F.count("*").alias("_n"))  # one row a file
    before = F.coalesce(F.sum("_n").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_file", before.alias("_before"))
    return rows.join(starts, "_file").select((F.col("_before") + F.col("_row")).alias("prompt_idx"), "prompt")


def text_lines(spark: SparkSession, path: str, label: int = 10) -> DataFrame:
    """One-liners, one a line, under a constant label. Serialised Python objects are not read: they could run code."""
    return spark.read.text(path).select(F.col("value").alias("joke"), F.lit(label).alias("labels"))


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """title, body, score of a JSON array file."""
    return spark.read.schema(S.TITLED).json(path, multiLine=True)


def text_column(spark: SparkSession, path: str, column: str, sep: str = ",") -> DataFrame:
    """One text column of a delimited file."""
    return spark.read.options(**_CSV).option("sep", sep).csv(path).select(F.col(column))


def text_union(spark: SparkSession, first: str, second: str, column: str = "text") -> DataFrame:
    """Texts of a delimited file, then of a parquet file (bag union)."""
    return text_column(spark, first, column).union(spark.read.parquet(second).select(column))


def complete_rows(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file without the rows that miss any column."""
    return spark.read.options(**_CSV).csv(path).dropna(how="any")


def base_model(spark: SparkSession, path: str) -> DataFrame:
    """(base_model): the model that an adapter's configuration names; null where it names none."""
    held = spark.read.text(path, wholetext=True)
    return held.select(F.get_json_object("value", "$.base_model_name_or_path").alias("base_model"))


def without_index(df: DataFrame) -> DataFrame:
    """Drops the leftover index column of a pandas file, if there."""
    return df.drop("__index_level_0__")
