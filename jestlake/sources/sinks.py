"""Writers. Small results may ask for one file; large ones keep their partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SUFFIX = {"en": "", "zh": "_zh", "es": "_es"}


def write_prompts(df: DataFrame, folder: str, split: str, language: str, single: bool = True) -> str:
    """Parquet rl_df_<split><suffix>; returns the path."""
    path = f"{folder}/rl_df_{split}{SUFFIX[language]}.parquet"
    (df.coalesce(1) if single else df).select("prompt").write.mode("overwrite").parquet(path)
    return path


def write_csv(df: DataFrame, path: str, single: bool = True, sep: str = ",") -> None:
    """Delimited text with a header; quotes double."""
    out = df.coalesce(1) if single else df
    out.write.mode("overwrite").csv(path, header=True, sep=sep, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_submissions(df: DataFrame, path: str) -> DataFrame:
    """Tab-separated id and text; returns the first three rows, text cut at 100 characters, for a look."""
    rows = df.select("id", "text")
    write_csv(rows, path, sep="\t")
    return rows.orderBy("id").limit(3).select("id", F.substring("text", 1, 100).alias("text"))


def markdown_rows(df: DataFrame, order: str) -> DataFrame:
    """(pos, line): a table in Markdown, one line a row after the two of the header, in the order of a column; nulls are empty.

    Meant for summaries; the lines stay a DataFrame, so that a table of any size can be written as text.
    """
    cells = F.concat(*(F.concat(F.lit("| "), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit(" ")) for c in df.columns), F.lit("|"))
    spark = df.sparkSession
    head = spark.range(2).select((F.col("id") - 2).alias("pos"), F.when(F.col("id") == 0, "".join(f"| {c} " for c in df.columns) + "|").otherwise("|" + " --- |" * len(df.columns)).alias("line"))
    body = df.select(F.struct(order).alias("_o"), cells.alias("line"))
    numbered = body.withColumn("pos", F.row_number().over(W.orderBy("_o")) - 1)  # a summary: few rows
    return head.unionByName(numbered.select(F.col("pos").cast("bigint").alias("pos"), "line"))


def markdown_table(df: DataFrame, order: str) -> str:
    """A summary as Markdown text, for a console or a report."""
    return "\n".join(r["line"] for r in markdown_rows(df, order).orderBy("pos").collect())


def sample_table(scored: DataFrame, scores: list[str], n: int, order: str) -> DataFrame:
    """The first n scored generations by an order column: prompt, generation, each score and their total, rounded to 3 places."""
    first = scored.orderBy(order).limit(n)
    parts = [F.round(F.coalesce(F.col(c), F.lit(0.0)), 3) for c in scores]
    total = F.aggregate(F.array(*parts), F.lit(0.0), lambda a, x: a + x)
    return first.select(order, "prompt", "generation", *(p.alias(c) for p, c in zip(parts, scores)), F.round(total, 3).alias("total"))
