"""Problem 6: records of evaluation splits that occur, exactly or nearly, in the training split.

Method: minwise hash shingles with banded buckets; only candidates across the splits are kept, their exact Jaccard
similarity is verified, and confirmed pairs are aggregated by split and source. Records of equal normalised text form one
class that knows on which sides of the split it occurs, so a text repeated over a third of the table is compared once.

Defined results: a null split belongs to no side and is in no pair; null and blank texts are in no pair; a null source
counts as its own source; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, release
from .blocks import expand_links
from .neardup import candidate_links, signatures, text_classes, verified

TRAIN = "train"


def _members(df: DataFrame, key: str, text: str, split: str) -> DataFrame:
    sides = df.select(F.col(key).alias("_k"), (F.col(split) == TRAIN).alias("train")).where("train is not null")
    every = text_classes(df, key, text)
    members = cut(every.join(sides, "_k"))
    release(every._made_of)
    return members


def cross_split_pairs(df: DataFrame, key: str, text: str, split: str) -> DataFrame:
    """(train_k, eval_k): every confirmed pair with its training record and its evaluation record."""
    texts = _members(df, key, text, split)
    side = F.bit_or(F.when(F.col("train"), 1).otherwise(2)).alias("side")
    signed = cut(signatures(texts, side, bands=False))
    members = cut(texts.select("_k", "cls", "train"))
    release(texts)
    sides = cut(signed.select("_id", "side"))
    links = candidate_links(signed)
    near = cut(verified(links, signed).select("a", "b"))
    release(signed, links)
    same = sides.where("side = 3").select(F.col("_id").alias("a"), F.col("_id").alias("b"))
    links = cut(near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).union(same))
    release(sides, near)
    train, other = (members.where(F.col("train") == side).select("cls", F.col("_k").alias("k")) for side in (True, False))
    return expand_links(links, train, other).select(F.col("ka").alias("train_k"), F.col("kb").alias("eval_k"))


def found(df: DataFrame) -> DataFrame:
    """Pairs with exactly one record in train, as (joke_id_a, joke_id_b), a < b."""
    pairs = cross_split_pairs(df, "joke_id", "joke", "split_name")
    return pairs.select(F.least("train_k", "eval_k").alias("joke_id_a"), F.greatest("train_k", "eval_k").alias("joke_id_b"))


def report(df: DataFrame) -> DataFrame:
    """Per split and source of the evaluation record and source of the training record: pairs, records, differing labels."""
    pairs = cross_split_pairs(df, "joke_id", "joke", "split_name")
    fields = df.select("joke_id", "split_name", "source", "labels")
    ev = fields.select(F.col("joke_id").alias("eval_k"), F.col("split_name").alias("split_name"), F.col("source").alias("eval_source"), F.col("labels").alias("el"))
    tr = fields.select(F.col("joke_id").alias("train_k"), F.col("source").alias("train_source"), F.col("labels").alias("tl"))
    return (
        pairs.join(ev, "eval_k")
        .join(tr, "train_k")
        .groupBy("split_name", "eval_source", "train_source")
        .agg(F.count("*").alias("pairs"), F.countDistinct("eval_k").alias("eval_records"), F.sum(F.when(F.col("el") != F.col("tl"), 1).otherwise(0)).alias("label_conflicts"))
    )
