"""Problem 9: mixing sources to target weights, sizes in tokens of a public tokenizer.

Method: low-discrepancy source schedule. Every source's documents are shuffled by hash and cut into blocks of equal token
counts, pass after pass up to the allowed repeats; slot i of the mix takes the golden-ratio point frac((i + 1) * phi),
which the cumulative weights map to a source, and the slot's rank among the slots of its source names the block to join.

The size of the mix is the largest at which every source still reaches its share within its repeats, unless a size is
given; with a larger size a source that runs out gives all it may, the rest keep their exact token quotas.

Defined results: documents with a null source or text take no part, nor do sources without a target; a target whose source
has no tokens is reported with share 0 and doesn't bound the size; null or negative shares count as 0, null repeats as 1;
empty texts have no tokens and are never chosen; equal documents under different ids count separately; an empty table or
an all-zero target gives no chosen rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .bpe import VOCAB, count_tokens

BLOCK_TOKENS = 2000
PHI = 0.6180339887498949
CHUNK = 4096  # slots or shuffle buckets ranked in one task
BUCKET_TOKENS = 2_000_000  # tokens of a source per shuffle bucket, about


def _targets(targets: DataFrame) -> DataFrame:
    share = F.greatest(F.coalesce(F.col("target_share"), F.lit(0.0)), F.lit(0.0))
    return targets.where("source is not null").groupBy("source").agg(F.max(share).alias("target_share"), F.max(F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(0))).alias("max_repeats"))


def _offsets(docs: DataFrame, buckets: int) -> DataFrame:
    """Adds start: tokens of the source before the document in hash order.

    Two levels, so that no task sees a whole source: totals of hash buckets are summed up first, then each bucket inside.
    """
    hashed = docs.withColumn("h", F.xxhash64("doc_id", F.lit(97))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    totals = hashed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("sum"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("source", "bucket", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("base"))
    inside = W.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    return hashed.join(bases, ["source", "bucket"]).select("doc_id", "source", "n_tokens", (F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"))


def schedule(spark, weights: list[tuple[str, float]], slots: int) -> DataFrame:
    """(slot, source, rank): source of each slot by the golden-ratio sequence, and the slot's rank among that source's."""
    total = sum(w for _, w in weights) or 1.0
    point = (F.col("id") + 1) * F.lit(PHI)
    point = point - F.floor(point)
    bounds, upto = [], 0.0
    for name, weight in sorted(weights):
        upto += weight / total
        bounds.append((name, upto))
    pick = F.lit(bounds[-1][0])
    for name, bound in reversed(bounds[:-1]):
        pick = F.when(point < F.lit(bound), F.lit(name)).otherwise(pick)
    picked = spark.range(slots).select(F.col("id").alias("slot"), pick.alias("source"), F.floor(F.col("id") / CHUNK).alias("chunk"))
    per = picked.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    bases = per.select("source", "chunk", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.row_number().over(W.partitionBy("source", "chunk").orderBy("slot"))
    return picked.join(bases, ["source", "chunk"]).select("slot", "source", (F.col("base") + inside - 1).alias("rank"))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, vocab_path: str = VOCAB) -> DataFrame:
    """(slot, source, pass, doc_id, n_tokens): every chosen use of a document and the slot of the mix it falls into."""
    spark = documents.sparkSession
    wanted = _targets(targets)
    part = documents.where("source is not null and text is not null").select("doc_id", "source", "text")
    part = part.join(wanted.where("target_share > 0 and max_repeats > 0").select("source"), "source", "left_semi")
    sized = cut(count_tokens(part, "text", vocab_path).where("n_tokens > 0"))
    # one row per source of the target table, whose number doesn't grow with the data
    facts = wanted.join(sized.groupBy("source").agg(F.sum("n_tokens").alias("have")), "source").collect()
    facts = [r for r in facts if r["target_share"] > 0 and r["max_repeats"] > 0 and r["have"]]
    if not facts:
        return sized.select(F.lit(None).cast("bigint").alias("slot"), "source", F.lit(0).alias("pass"), "doc_id", "n_tokens").where("false")
    total_share = sum(r["target_share"] for r in facts)
    size = total_tokens or int(min(r["have"] * r["max_repeats"] * total_share / r["target_share"] for r in facts))
    quota = {r["source"]: min(r["have"] * r["max_repeats"], size * r["target_share"] / total_share) for r in facts}
    slots = max(1, -(-size // block_tokens))
    buckets = max(1, -(-max(r["have"] for r in facts) // BUCKET_TOKENS))
    limits = spark.createDataFrame([(r["source"], float(quota[r["source"]]), int(r["have"]), int(r["max_repeats"])) for r in facts], "source string, quota double, have bigint, max_repeats int")
    # a use starts at its token offset within the endless repetition of its source and is taken while its middle lies in the quota
    uses = (
        _offsets(sized, buckets)
        .join(F.broadcast(limits), "source")
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("max_repeats") - 1)))
        .withColumn("at", F.col("start") + F.col("pass") * F.col("have"))
        .where(F.col("at") + F.col("n_tokens") / 2 <= F.col("quota"))
        .withColumn("rank", F.floor(F.col("at") / block_tokens))
    )
    plan = schedule(spark, [(r["source"], quota[r["source"]]) for r in facts], slots)
    # the sequence gives a source its slots within a rounding; blocks past the last slot follow at the end of the mix
    return uses.join(plan, ["source", "rank"], "left").select(F.coalesce("slot", F.lit(slots) + F.col("rank")).alias("slot"), "source", "pass", "doc_id", "n_tokens")


def chosen(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """(doc_id, source, n_tokens, repeats, first_slot): each chosen document with how often it is used."""
    used = mix(documents, targets, **options)
    return used.groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens"), F.count("*").alias("repeats"), F.min("slot").alias("first_slot"))


def shares(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """(source, target_share, actual_share, tokens, uses): what each source of the targets got."""
    used = mix(documents, targets, **options).groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"))
    whole = used.agg(F.sum("tokens").alias("all_tokens"))
    return (
        _targets(targets)
        .join(used, "source", "left")
        .join(F.broadcast(whole))  # one row
        .select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("all_tokens")).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("uses", F.lit(0)).alias("uses"))
    )
