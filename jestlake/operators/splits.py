"""Splits, unions and sampling of labelled rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGE = 1_000_000  # rows of a hash range that is ranked by itself


def ranked(df: DataFrame, by: list[str], order: Column, into: str) -> DataFrame:
    """Adds the row's rank from 1 and its group's size, in the order of a uniformly spread hex string.

    Ranks come from counts of hash ranges plus ranks inside a range; ranges are so many that one holds about RANGE rows of
    all, so that a class of any size spreads over tasks.
    """
    digits = max(2, math.ceil(math.log(max(1, df.count()) / RANGE, 16)))
    keyed = df.withColumn("_o", order).withColumn("_s", F.substring("_o", 1, digits))
    sizes = keyed.groupBy(*by, "_s").agg(F.count("*").alias("_n"))
    w = W.partitionBy(*by).orderBy("_s") if by else W.orderBy("_s")  # one row a range
    bases = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    total = sizes.groupBy(*by).agg(F.sum("_n").alias(f"{into}_of"))
    inside = F.row_number().over(W.partitionBy(*by, "_s").orderBy("_o"))
    joined = keyed.join(bases.drop("_n"), [*by, "_s"])
    joined = joined.join(total, by) if by else joined.crossJoin(F.broadcast(total))
    return joined.withColumn(into, F.col("_base") + inside).drop("_o", "_s", "_base")


def three_way_split(df: DataFrame, label: str, key: Column, seed: int = 42, test_size: float = 0.2, stratify_second: bool = False) -> DataFrame:
    """Adds split_name: a test_size share of each label is set aside, then halved into test and val.

    Membership follows the hash md5(key:seed), not a random generator; the halves are stratified only if asked for.
    """
    order = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))
    first = ranked(df, [label], order, "_r")
    quota = F.floor(F.col("_r_of") * test_size + 0.5)
    held = first.withColumn("_held", F.col("_r") <= quota).drop("_r", "_r_of")
    again = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed + 1))))
    out = ranked(held, ["_held", label] if stratify_second else ["_held"], again, "_q")
    name = F.when(~F.col("_held"), "train").when(F.col("_q") <= F.floor(F.col("_q_of") / 2), "test").otherwise("val")
    return out.withColumn("split_name", name).drop("_held", "_q", "_q_of")


def union_all(*parts: DataFrame) -> DataFrame:
    """Bag union by column names."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def labelled(df: DataFrame, text: str, label: int) -> DataFrame:
    """(joke, labels) with a constant label."""
    return df.select(F.col(text).alias("joke"), F.lit(label).alias("labels"))


def head(df: DataFrame, n: int | None, order: str) -> DataFrame:
    """The first n rows by an order column; all of them for no or zero n."""
    return df.orderBy(order).limit(n) if n else df


def head_then_filter(df: DataFrame, n: int, order: str, text: str) -> DataFrame:
    """The first n rows, of which those with an empty text go: may give fewer than n."""
    return df.orderBy(order).limit(n).where(F.coalesce(F.col(text), F.lit("")) != "")


def tiled(spark, values: list[str], n: int) -> DataFrame:
    """(pos, value): a short list repeated to n rows."""
    return spark.range(n).select(F.col("id").alias("pos"), F.element_at(F.array(*map(F.lit, values)), (F.col("id") % len(values) + 1).cast("int")).alias("value"))


def distinct_sorted(df: DataFrame, label: str) -> DataFrame:
    """The distinct labels in order, as one array."""
    return df.select(label).distinct().agg(F.array_sort(F.collect_list(label)).alias("labels"))


def shuffled(df: DataFrame, key: Column, seed: int = 42) -> DataFrame:
    """Adds pos: the rows' places from 0 in a seeded random order, that of md5(key:seed); the same for any partitioning."""
    order = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))
    return ranked(df, [], order, "pos").drop("pos_of").withColumn("pos", F.col("pos") - 1)


def sample_matching(df: DataFrame, condition: Column, key: Column, n: int = 1, seed: int = 42) -> DataFrame:
    """n random rows of those that meet a condition: the first by md5(key:seed), kept per task before any shuffle."""
    order = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))
    return df.where(condition).orderBy(order).limit(n)
