"""Aggregates over scored rows: summaries, diversity metrics, classification metrics, class weights, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.arrays import expected_value, hierarchical, log_softmax, ngrams
from ..functions.text import words
from ..session import cut


def distinct_shares(df: DataFrame, text: str, orders: list[int], by: list[str]) -> DataFrame:
    """(by, distinct_<n>, ...): distinct share of the n-grams of each group's pooled texts, for all orders in one pass; 0 where there are none.

    n-grams never cross texts. Counts per n-gram are combined before the shuffle on (group, n-gram); no group is gathered
    anywhere.
    """
    # tokens become a column first: inside the lambda of ngrams they would be cut anew for every place
    tokens = df.select(*by, words(F.lower(F.col(text))).alias("_w"))
    tagged = lambda n: F.transform(ngrams(F.col("_w"), n), lambda g: F.struct(F.lit(n).alias("n"), F.concat_ws("\u0001", g).alias("g")))
    runs = F.flatten(F.array(*map(tagged, orders)))
    # a group without any n-gram keeps a row
    grams = tokens.select(*by, F.explode_outer(runs).alias("_g")).groupBy(*by, F.col("_g.n").alias("_n"), F.col("_g.g").alias("_g")).agg(F.count("*").alias("_c"))
    share = lambda n: F.coalesce(F.try_divide(F.count_if(F.col("_n") == n), F.sum(F.when(F.col("_n") == n, F.col("_c")))), F.lit(0.0))
    return grams.groupBy(*by).agg(*(share(n).alias(f"distinct_{n}") for n in orders))


def distinct_n(df: DataFrame, text: str, n: int, by: list[str], into: str | None = None) -> DataFrame:
    """Distinct share of the n-grams of each group's pooled texts; 0 where there are none."""
    return distinct_shares(df, text, [n], by).withColumnRenamed(f"distinct_{n}", into or f"distinct_{n}")


def exact_median(df: DataFrame, by: list[str], value: str, into: str) -> DataFrame:
    """(by, into): the exact median of the values that are not null, whatever their number and kind.

    A bounded sketch finds values on both sides of the middle; only what lies between them, about 2 % of the rows, is counted
    value by value and ranked, after what lies below has been counted.
    """
    held = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    ends = held.groupBy(*by).agg(F.percentile_approx("_v", F.array(F.lit(0.49), F.lit(0.51)), 10000).alias("_e"), F.count("*").alias("_all"))
    placed = held.join(F.broadcast(ends), by)  # one row a group
    low, high = F.col("_e")[0], F.col("_e")[1]
    below = placed.groupBy(*by).agg(F.count_if(F.col("_v") < low).alias("_below"))
    counts = placed.where(F.col("_v").between(low, high)).groupBy(*by, "_v").agg(F.count("*").alias("_c"), F.max("_all").alias("_all"))
    upto = F.sum("_c").over(W.partitionBy(*by).orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = counts.join(below, by).withColumn("_to", F.col("_below") + upto)
    first = lambda rank: F.min(F.when(F.col("_to") >= rank, F.col("_v")))
    return ranked.groupBy(*by).agg(((first(F.floor((F.col("_all") + 1) / 2)) + first(F.floor(F.col("_all") / 2) + 1)) / 2).alias(into))


def structure_shares(df: DataFrame, by: list[str], tag: str = "structure") -> DataFrame:
    """(by, tag, n, share): share of each tag in its group."""
    counts = df.groupBy(*by, tag).agg(F.count("*").alias("n"))
    whole = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
    return counts.join(whole, by).select(*by, tag, "n", (F.col("n") / F.col("_all")).alias("share"))


def structure_pivot(df: DataFrame, by: list[str], tag: str = "structure", drop_absent: bool = False) -> DataFrame:
    """One column structure_<tag> per tag with its share; null where a group lacks the tag."""
    shares = structure_shares(df, by, tag)
    out = shares.groupBy(*by).pivot(tag, list(L.STRUCTURES)).agg(F.first("share"))
    out = out.select(*by, *(F.col(f"`{t}`").alias(f"structure_{t.replace('-', '_')}") for t in L.STRUCTURES))
    if drop_absent:  # one row of counts
        held = out.agg(*(F.count(c).alias(c) for c in out.columns if c not in by)).first().asDict()
        out = out.drop(*(c for c, n in held.items() if n == 0))
    return out


def structure_entropy(df: DataFrame, by: list[str], tag: str = "structure") -> DataFrame:
    """Entropy in bits of each group's tags."""
    return structure_shares(df, by, tag).groupBy(*by).agg((-F.sum(F.col("share") * F.log2("share")) + F.lit(0.0)).alias("structure_entropy"))


def model_summary(df: DataFrame, by: str = "model", text: str = "joke") -> DataFrame:
    """Per model: prompts, rows, rater mean, sample deviation and exact median, validity, scorer means, diversity, structure shares.

    The scored rows are written once; tags are counted with the sums, n-grams of both orders in one pass.
    """
    scores = {"word_pair_mean": "word_pair_score", "formatting_mean": "formatting_score", "length_mean": "length_score", "coherence_mean": "coherence_score", "avg_word_count": "word_count"}
    rows = cut(df.select(by, "prompt_idx", text, "rater_score", "is_valid", "structure", *scores.values()))
    tagged = {tag: F.count_if(F.col("structure") == tag) for tag in L.STRUCTURES}
    base = rows.groupBy(by).agg(
        F.countDistinct("prompt_idx").alias("n_prompts"),
        F.count("*").alias("n_jokes"),
        F.avg("rater_score").alias("rater_mean"),
        F.stddev_samp("rater_score").alias("rater_std"),
        F.avg(F.col("is_valid").cast("int")).alias("validity_rate"),
        *(F.avg(c).alias(name) for name, c in scores.items()),
        sum(((n > 0).cast("bigint") for n in tagged.values()), F.lit(0).cast("bigint")).alias("n_unique_structures"),
        *(F.when(n > 0, n / F.count("*")).alias(f"structure_{tag.replace('-', '_')}") for tag, n in tagged.items()),
    )
    shares = [c for c in base.columns if c.startswith("structure_")]
    out = base.join(exact_median(rows, [by], "rater_score", "rater_median"), by, "left").join(distinct_shares(rows, text, [1, 2], [by]), by)
    return out.select(by, "n_prompts", "n_jokes", "rater_mean", "rater_std", "rater_median", "validity_rate", *scores, "n_unique_structures", "distinct_1", "distinct_2", *shares)


def comparison_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Per group: mean score, mean of the valid ones (0 if none), mean and population deviation of the composite, validity, rows."""
    return df.groupBy(*by).agg(
        F.avg("ev").alias("mean_ev_reward"),
        F.coalesce(F.avg(F.when(F.col("is_valid"), F.col("ev"))), F.lit(0.0)).alias("mean_ev_reward_valid_only"),
        F.avg("composite").alias("mean_composite_reward"),
        F.stddev_pop("composite").alias("std_composite_reward"),
        F.avg(F.col("is_valid").cast("int")).alias("validity_rate"),
        F.count("*").alias("num_samples"),
    )


def gated_label_summary(df: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Mean, exact median and sample deviation of gated ratings."""
    rows = cut(df.select(*by, score))
    sums = rows.groupBy(*by).agg(F.avg(score).alias("mean_reward"), F.stddev_samp(score).alias("std_reward"), F.count("*").alias("num_samples"))
    return sums.join(exact_median(rows, by, score, "median_reward"), by, "left").select(*by, "mean_reward", "median_reward", "std_reward", "num_samples")


def ablation_summary(df: DataFrame, by: str = "model", text: str = "joke") -> DataFrame:
    """Per model: prompts, rows, mean and sample deviation of ev, validity, distinct bigrams, entropy of the structures."""
    df = cut(df.select(by, "prompt_idx", "ev", "is_valid", "structure", text))
    base = df.groupBy(by).agg(
        F.countDistinct("prompt_idx").alias("n_prompts"),
        F.count("*").alias("n_jokes"),
        F.avg("ev").alias("ev_mean"),
        F.stddev_samp("ev").alias("ev_std"),
        F.avg(F.col("is_valid").cast("int")).alias("validity_rate"),
    )
    return base.join(distinct_n(df, text, 2, [by]), by).join(structure_entropy(df, [by]), by)


def eval_metrics(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """rmse, mae and accuracy of predicted labels (one row)."""
    off = predicted - truth
    return df.agg(F.sqrt(F.avg(F.pow(off, F.lit(2.0)))).alias("rmse"), F.avg(F.abs(off)).alias("mae"), F.avg((off == 0).cast("int")).alias("accuracy"), F.avg(F.pow(off, F.lit(2.0))).alias("mse"))


def class_weights(df: DataFrame, label: str = "labels", clamp: bool = True) -> DataFrame:
    """(head, class, count, weight): the zero-or-not head by total / (2 count), the classes 1..10 by total / (10 count).

    Counts of the classes are taken as at least 1 (clamp); a zero-or-not count of 0 has no weight.
    """
    spark = df.sparkSession
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("int").alias("class")).agg(F.count("*").alias("n"))
    binary = counts.groupBy((F.col("class") != 0).cast("int").alias("class")).agg(F.sum("n").alias("n"))
    heads = spark.range(2).select(F.col("id").cast("int").alias("class")).join(binary, "class", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = heads.agg(F.sum("n").alias("_t"))
    heads = heads.crossJoin(F.broadcast(total)).select(F.lit("binary").alias("head"), "class", F.col("n").alias("count"), F.try_divide(F.col("_t"), 2 * F.col("n")).alias("weight"))
    child = spark.range(1, L.CLASSES).select(F.col("id").cast("int").alias("class")).join(counts, "class", "left")
    child = child.withColumn("n", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1 if clamp else 0)))
    ctotal = child.agg(F.sum("n").alias("_t"))
    child = child.crossJoin(F.broadcast(ctotal)).select(F.lit("child").alias("head"), "class", F.col("n").alias("count"), F.try_divide(F.col("_t"), 10 * F.col("n")).alias("weight"))
    return heads.unionByName(child)


def missing_labels(df: DataFrame, label: str = "labels") -> DataFrame:
    """Labels 0..10 that never occur."""
    every = df.sparkSession.range(L.CLASSES).select(F.col("id").cast("int").alias("label"))
    return every.join(df.select(F.col(label).cast("int").alias("label")).distinct(), "label", "left_anti")


def weighted_cross_entropy(df: DataFrame, log_probs: Column, label: Column, weight: Column) -> DataFrame:
    """Weighted negative log likelihood over the rows: sum of w nll / sum of w."""
    nll = -F.element_at(log_probs, (label + 1).cast("int"))
    return df.agg(F.try_divide(F.sum(weight * nll), F.sum(weight)).alias("cross_entropy"))


def training_loss(df: DataFrame, head: str, child: str, label: str, head_weights: list[float], child_weights: list[float], share: float = 0.1) -> DataFrame:
    """(loss, head_loss, child_loss, squared_error) of a zero-or-not head and a head over the classes 1..10, one row.

    Weighted cross-entropy of the first over all rows, of the second over the rows of other labels than 0 (0 without any), plus
    a share of the mean squared error of the expected label. Rows without a label count nowhere.
    """
    # names of their own: a column of the same name inside a lambda would be taken for the new one
    held = df.where(F.col(label).isNotNull()).select(F.col(label).cast("int").alias("_y"), F.col(head).alias("_head"), F.col(child).alias("_child"))
    rows = held.select("_y", log_softmax(F.col("_head")).alias("_h"), log_softmax(F.col("_child")).alias("_c"), hierarchical(F.col("_head"), F.col("_child")).alias("_z"))
    other = F.col("_y") != 0
    place = F.when(other, 2).otherwise(1)
    weight = lambda weights, at: F.element_at(F.array(*map(F.lit, weights)), at)
    named = rows.select("_y", weight(head_weights, place).alias("_hw"), F.element_at("_h", place).alias("_hl"), F.when(other, weight(child_weights, F.col("_y"))).alias("_cw"), F.when(other, F.element_at("_c", F.col("_y"))).alias("_cl"), expected_value(F.col("_z")).alias("_e"))
    mean = lambda w, x: F.try_divide(F.sum(F.col(w) * -F.col(x)), F.sum(w))
    out = named.agg(mean("_hw", "_hl").alias("head_loss"), F.coalesce(mean("_cw", "_cl"), F.lit(0.0)).alias("child_loss"), F.avg(F.pow(F.col("_e") - F.col("_y"), F.lit(2.0))).alias("squared_error"))
    return out.select((F.col("head_loss") + F.col("child_loss") + share * F.col("squared_error")).alias("loss"), "head_loss", "child_loss", "squared_error")


def parameter_ratio(df: DataFrame, size: str, trained: Column) -> DataFrame:
    """(trained, total, ratio): parameters that are trained, of all."""
    out = df.agg(F.coalesce(F.sum(F.when(trained, F.col(size))), F.lit(0)).alias("trained"), F.sum(size).alias("total"))
    return out.withColumn("ratio", F.try_divide(F.col("trained"), F.col("total")))


def delta_to_base(summary: DataFrame, keys: list[str], metrics: list[str], model: str = "model", base: str = "base", trained: str = "trained") -> DataFrame:
    """Per key: trained minus base for each metric."""
    a = summary.where(F.col(model) == base).select(*keys, *(F.col(m).alias(f"_b_{m}") for m in metrics))
    b = summary.where(F.col(model) == trained).select(*keys, *metrics)
    return b.join(a, keys).select(*keys, *((F.col(m) - F.col(f"_b_{m}")).alias(f"delta_{m}") for m in metrics))


def delta_to_full(summary: DataFrame, metrics: list[str], model: str = "model", full: str = "full") -> DataFrame:
    """Every other model minus the one full row, by a broadcast of that row; empty without one."""
    one = summary.where(F.col(model) == full).select(*(F.col(m).alias(f"_f_{m}") for m in metrics)).limit(1)
    return summary.where(F.col(model) != full).crossJoin(F.broadcast(one)).select(model, *((F.col(m) - F.col(f"_f_{m}")).alias(f"delta_{m}") for m in metrics))


def histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """(bin, n): counts of floor((x - min) / width)."""
    low = df.agg(F.min(value).alias("_low"))
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(low)).groupBy(F.floor((F.col(value) - F.col("_low")) / width).alias("bin")).agg(F.count("*").alias("n"))


def seen_order(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Distinct values in order of first appearance."""
    return df.groupBy(value).agg(F.min(pos).alias("first_pos")).orderBy("first_pos")
