"""Structure-diversity reward in batch: each item is scored against the tags of the last items before its batch.

The rule is serial (a history of at most HISTORY tags, read once per batch of items), but a batch only depends on a fixed
number of positions before it. So every row contributes its tag to the few batches that can see it, and everything is an
equi-join or an aggregation on batch numbers: no task sees more than a batch and its history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HISTORY = 30
BUCKET = 4096


def with_position(df: DataFrame, key: str, into: str = "pos") -> DataFrame:
    """Adds the row's rank by an integer key, from 0, by two levels: counts of key ranges are summed up, then ranked inside."""
    ranged = df.withColumn("_bucket", F.floor(F.col(key) / BUCKET))
    # one row per range of keys; summed in groups of ranges so that this too stays small in any task
    sizes = ranged.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_group", F.floor(F.col("_bucket") / BUCKET))
    groups = sizes.groupBy("_group").agg(F.sum("_n").alias("_gn"))
    ahead = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    groups = groups.withColumn("_gbase", F.coalesce(F.sum("_gn").over(ahead(W.orderBy("_group"))), F.lit(0))).drop("_gn")
    bases = sizes.join(groups, "_group").withColumn("_base", F.col("_gbase") + F.coalesce(F.sum("_n").over(ahead(W.partitionBy("_group").orderBy("_bucket"))), F.lit(0)))
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy(key))
    return ranged.join(bases.select("_bucket", "_base"), "_bucket").withColumn(into, F.col("_base") + inside - 1).drop("_bucket", "_base")


def diversity_reward(df: DataFrame, pos: str = "pos", tag: str = "structure", batch: int = 8, run: str | None = None, history: int = HISTORY) -> DataFrame:
    """Adds diversity: 1 / kinds in the history, minus the item's own share of history and batch so far.

    pos numbers the items from 0 without gaps (within each run, if a run column is given); batch items are scored per call.
    """
    keys = [run] if run else []
    rows = df.withColumn("_b", F.floor(F.col(pos) / batch))
    reach = -(-history // batch)
    seen = (
        rows.select(*keys, F.col(pos).alias("_p"), F.col(tag).alias("_tag"), F.explode(F.sequence(F.col("_b") + 1, F.col("_b") + reach)).alias("_b"))
        .where(F.col("_p") >= F.col("_b") * batch - history)
        .groupBy(*keys, "_b", "_tag")
        .agg(F.count("*").alias("_h"))
    )
    whole = seen.groupBy(*keys, "_b").agg(F.sum("_h").alias("_len"), F.count("*").alias("_kinds"))
    own = F.row_number().over(W.partitionBy(*keys, "_b", tag).orderBy(pos)) - 1
    joined = rows.withColumn("_own", own).join(seen.withColumnRenamed("_tag", tag), [*keys, "_b", tag], "left").join(whole, [*keys, "_b"], "left")
    reward = F.lit(1.0) / F.greatest(F.coalesce("_kinds", F.lit(0)), F.lit(1)) - (F.coalesce("_h", F.lit(0)) + F.col("_own")) / (F.greatest(F.coalesce("_len", F.lit(0)), F.lit(1)) + (F.col(pos) - F.col("_b") * batch))
    return joined.withColumn("diversity", reward).drop("_b", "_own", "_h", "_len", "_kinds")
