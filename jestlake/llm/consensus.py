"""Problem 1: consensus from several annotators' labels.

Method: feature-assisted consensus. A regularised classifier over item features and one confusion matrix per annotator are
fitted jointly by expectation-maximisation; the classifier's output is the prior of an item's label. The two models' scores
are annotators like the labelers. Rows of a confusion matrix are smoothed towards the annotator's own ordinal profile (a
discretised bell around a bias that may depend on the label), so that annotators with few labels stay usable.

Every iteration is one pass over the items that returns, per partition, sums whose number depends only on the numbers of
annotators, classes and features; Spark adds them up, and the driver sees one row per parameter.

Defined results: a row delivered twice counts once (the latest loaded_at, ties by the larger label), and so does an annotator
who labelled an item more than once (the latest label; of a model's scores the greatest valid one); labels and scores
outside the scale and nulls are no votes; null annotators are no annotators; items without any vote get their label from
the classifier; a posterior tie goes to the smaller label; agreement is null for fewer than two votes; an empty table gives
empty results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, release

CLASSES = 11
ITERATIONS = 1000  # it settles long before
TOLERANCE = 1e-4  # mean change of log likelihood per vote that ends the iterations
WORDS = 32  # hashed word features
FEATURES = WORDS + 8
RIDGE = 2.0
PRIOR_WEIGHT = 8.0  # pseudo-votes of the ordinal profile per confusion row
STEP = 0.5
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")


def item_features(text: str | None) -> np.ndarray:
    """Features of one item's text: bias, length, marks, script and hashed words."""
    out = np.zeros(FEATURES, np.float32)
    out[0] = 1.0
    if not text:
        out[1] = 1.0
        return out
    n = len(text)
    out[2] = np.log1p(n) / 5
    out[3] = "?" in text or "？" in text
    out[4] = "!" in text or "！" in text
    out[5] = len(_CJK.findall(text)) / n
    out[6] = ("\n" in text) + 0.0
    out[7] = any(ch.isdigit() for ch in text)
    words = _WORD.findall(text.lower())
    for w in words:
        out[8 + zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS] += 1
    if words:
        out[8:] /= np.sqrt(len(words))
    return out


def votes(df: DataFrame, item: str = "item_id", low: int = 0, high: int = CLASSES - 1) -> DataFrame:
    """(item, annotator, label): one vote per item and annotator, within the scale: the last one delivered."""
    when = F.coalesce("loaded_at", F.to_timestamp(F.lit("1970-01-01")))
    latest = df.groupBy("eval_id").agg(F.max(F.struct(when.alias("t"), "labels", F.col(item).alias("i"), F.trim("labeler").alias("w"), "llama_score", "gpt_score")).alias("r"))
    rows = latest.select(F.col("r.i").alias("item"), F.col("r.t").alias("t"), "eval_id", "r.labels", "r.w", "r.llama_score", "r.gpt_score").where("item is not null")
    cast = F.array(
        F.struct(F.concat(F.lit("labeler:"), "w").alias("annotator"), F.col("labels").cast("int").alias("label")),
        *(F.struct(F.lit(f"model:{c}").alias("annotator"), F.col(c).cast("int").alias("label")) for c in ("llama_score", "gpt_score")),
    )
    every = rows.select("item", "t", "eval_id", F.explode(cast).alias("v")).select("item", "t", "eval_id", "v.*").where(F.col("annotator").isNotNull() & F.col("label").between(low, high))
    # a model's score is repeated on the item's rows: it is one vote, the greatest of the valid ones
    order = F.when(F.startswith("annotator", F.lit("model:")), F.struct(F.to_timestamp(F.lit("1970-01-01")).alias("t"), F.lit(0).cast("bigint").alias("e"), "label")).otherwise(F.struct("t", F.col("eval_id").cast("bigint").alias("e"), "label"))
    return every.groupBy("item", "annotator").agg(F.max(order).alias("o")).select("item", "annotator", F.col("o.label").alias("label"))


class Model:
    """Classifier weights and annotators' confusion matrices."""

    def __init__(self, annotators: list[str]):
        self.names = annotators
        n = len(annotators)
        step = np.abs(np.arange(CLASSES)[:, None] - np.arange(CLASSES)[None, :])
        start = np.exp(-step / 1.0)
        self.log_confusion = np.log(np.tile(start / start.sum(axis=1, keepdims=True), (n, 1, 1)))
        self.weights = np.zeros((CLASSES, FEATURES))

    def posterior(self, features: np.ndarray, who: np.ndarray, label: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(posterior, prior, log likelihood) of items; who, label, owner list the votes."""
        z = features @ self.weights.T
        z -= z.max(axis=1, keepdims=True)
        prior = np.exp(z)
        prior = (prior / prior.sum(axis=1, keepdims=True) + 1e-6) / (1 + CLASSES * 1e-6)
        logs = np.log(prior)
        for c in range(CLASSES):
            logs[:, c] += np.bincount(owner, self.log_confusion[who, c, label], len(logs))
        top = logs.max(axis=1, keepdims=True)
        post = np.exp(logs - top)
        total = post.sum(axis=1, keepdims=True)
        return post / total, prior, float((np.log(total) + top).sum())

    def sums(self, batches: Iterator[tuple]) -> np.ndarray:
        """Sufficient statistics of an iteration over the items, as one flat vector."""
        counts = np.zeros((len(self.names), CLASSES, CLASSES))
        gradient = np.zeros((CLASSES, FEATURES))
        curvature = np.zeros((CLASSES, FEATURES))
        items, loglik, cast = 0, 0.0, 0
        for features, who, label, owner in batches:
            post, prior, ll = self.posterior(features, who, label, owner)
            for c in range(CLASSES):
                counts[:, c, :] += np.bincount(who * CLASSES + label, post[owner, c], len(self.names) * CLASSES).reshape(-1, CLASSES)
            gradient += (post - prior).T @ features
            size = np.abs(features)
            curvature += (prior * (1 - prior)).T @ (size * size.sum(axis=1, keepdims=True))  # bounds the Hessian by its diagonal
            items += len(features)
            cast += len(who)
            loglik += ll
        return np.concatenate([counts.ravel(), gradient.ravel(), curvature.ravel(), [items, cast, loglik]])

    def update(self, flat: np.ndarray) -> float:
        """M-step; returns the log likelihood per vote."""
        n = len(self.names)
        a, b = n * CLASSES * CLASSES, CLASSES * FEATURES
        counts = flat[:a].reshape(n, CLASSES, CLASSES)
        gradient, curvature = flat[a : a + b].reshape(CLASSES, FEATURES), flat[a + b : a + 2 * b].reshape(CLASSES, FEATURES)
        items, cast, loglik = flat[a + 2 * b :]
        for k in range(n):
            profile = _profile(counts[k])
            table = counts[k] + PRIOR_WEIGHT * profile
            self.log_confusion[k] = np.log(table / table.sum(axis=1, keepdims=True))
        # one step of the ridge-regularised likelihood along the bounded curvature, which can't overshoot far
        self.weights += STEP * (gradient - RIDGE * self.weights) / (curvature + RIDGE)
        return loglik / max(1.0, cast)


def _profile(counts: np.ndarray) -> np.ndarray:
    """Ordinal profile of an annotator: a bell around a straight line through its mean answers, mixed with its base rates."""
    total = counts.sum()
    levels = np.arange(CLASSES)
    if total < 1:
        return np.full((CLASSES, CLASSES), 1.0 / CLASSES)
    weight = counts.sum(axis=1)
    true_mean = (weight * levels).sum() / total
    answer = counts.sum(axis=0)
    answer_mean = (answer * levels).sum() / total
    var = (weight * (levels - true_mean) ** 2).sum() + 5.0
    cov = ((levels - true_mean)[:, None] * (levels - answer_mean)[None, :] * counts).sum() + 5.0
    centre = answer_mean + cov / var * (levels - true_mean)
    spread = ((levels[None, :] - centre[:, None]) ** 2 * counts).sum() / total + 0.15
    bell = np.exp(-((levels[None, :] - np.clip(centre, 0, CLASSES - 1)[:, None]) ** 2) / (2 * spread))
    bell /= bell.sum(axis=1, keepdims=True)
    base = (answer + 1) / (total + CLASSES)
    return 0.93 * bell + 0.07 * base[None, :]


def _blocks(batch: pa.RecordBatch) -> tuple:
    """(features, who, label, owner) of a batch (item, features, who, labels)."""
    features = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, FEATURES)
    who, labels = batch.column(2), batch.column(3)
    sizes = np.diff(who.offsets.to_numpy())
    return features, who.flatten().to_numpy().astype(np.int64), labels.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(batch.num_rows), sizes)


def _featured(batches: Iterator[pa.RecordBatch], at: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """(item, text, annotators, labels) to (item, features, who, labels): texts and names are read once, not once a round."""
    for batch in batches:
        if not batch.num_rows:
            continue
        features = np.stack([item_features(t) for t in batch.column(1).to_pylist()])
        names = batch.column(2)
        who = pa.array([at[a] for a in names.flatten().to_pylist()], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays((np.arange(batch.num_rows + 1) * FEATURES).astype(np.int32), pa.array(features.ravel())), pa.ListArray.from_arrays(pa.array(names.offsets.to_numpy() - names.offsets[0].as_py()), who), batch.column(3)],
            names=["item", "features", "who", "labels"],
        )


def gathered(df: DataFrame, item: str, text: str) -> tuple[DataFrame, list[str]]:
    """(items, annotators): (item, features, who, labels), an item's votes side by side, one an annotator; who numbers the annotators.

    The annotators' names come to the driver, as their confusion matrices do later: 121 numbers each.
    """
    every = cut(votes(df, item))
    names = [r[0] for r in every.select("annotator").distinct().orderBy("annotator").collect()]
    cast = every.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("annotator", "label"))).alias("v"))
    texts = df.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.max(F.trim(text)).alias("text"))
    empty = F.expr("cast(array() as array<string>)"), F.expr("cast(array() as array<int>)")
    rows = texts.join(cast, "item", "left").select("item", "text", F.coalesce(F.col("v.annotator"), empty[0]).alias("annotators"), F.coalesce(F.col("v.label"), empty[1]).alias("labels"))
    kind = rows.schema["item"].dataType.simpleString()
    at = {a: i for i, a in enumerate(names)}
    items = cut(rows.mapInArrow(lambda it: _featured(it, at), f"item {kind}, features array<float>, who array<int>, labels array<int>"))
    release(every)
    return items, names


def fit(items: DataFrame, names: list[str], iterations: int = ITERATIONS) -> Model:
    """Runs expectation-maximisation over the gathered items. RuntimeError if it doesn't settle."""
    model = Model(names)
    if not names:
        return model
    size = len(names) * CLASSES * CLASSES + 2 * CLASSES * FEATURES + 3
    before = -np.inf
    for _ in range(iterations):

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            flat = model.sums(_blocks(b) for b in batches if b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "v"])

        flat = np.zeros(size)
        for row in items.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # as many rows as parameters
            flat[row["i"]] = row["v"]
        now = model.update(flat)
        if abs(now - before) < TOLERANCE:
            return model
        before = now
    raise RuntimeError(f"consensus: not settled after {iterations} iterations")


def label_items(df: DataFrame, item: str = "item_id", text: str = "joke") -> DataFrame:
    """(item, label, confidence, votes, agreement): consensus per item.

    agreement is the share of pairs of votes whose labels differ by at most one, over all pairs of the item.
    """
    items, names = gathered(df, item, text)
    model = fit(items, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            features, who, label, owner = _blocks(batch)
            post, _, _ = model.posterior(features, who, label, owner)
            best = post.argmax(axis=1)
            tallies = np.bincount(owner * CLASSES + label, minlength=batch.num_rows * CLASSES).reshape(-1, CLASSES)
            n = tallies.sum(axis=1)
            close = (tallies * (tallies - 1) / 2).sum(axis=1) + (tallies[:, 1:] * tallies[:, :-1]).sum(axis=1)
            pairs = n * (n - 1) / 2
            agreement = pa.array(np.where(pairs > 0, close / np.maximum(pairs, 1), 0.0), mask=pairs == 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(best.astype(np.int32)), pa.array(post[np.arange(len(best)), best]), pa.array(n.astype(np.int32)), agreement],
                names=["item", "label", "confidence", "votes", "agreement"],
            )

    kind = items.schema["item"].dataType.simpleString()
    return items.mapInArrow(run, f"item {kind}, label int, confidence double, votes int, agreement double").withColumnRenamed("item", item)


def reliability(df: DataFrame, item: str = "item_id", text: str = "joke") -> DataFrame:
    """(annotator, votes, exact, near, mean_error, bias, correlation) of each annotator against the posterior labels."""
    items, names = gathered(df, item, text)
    model = fit(items, names)
    spark = df.sparkSession
    schema = "annotator string, votes double, exact double, near double, mean_error double, bias double, correlation double"
    if not model.names:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = model.sums(_blocks(b) for b in batches if b.num_rows)[: len(model.names) * CLASSES * CLASSES]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "n"])

    cells = items.mapInArrow(run, "i int, n double").groupBy("i").agg(F.sum("n").alias("n"))
    k = CLASSES * CLASSES
    numbered = spark.createDataFrame(list(enumerate(names)), "who int, annotator string")
    cells = cells.withColumn("who", F.floor(F.col("i") / k).cast("int")).join(numbered, "who")
    cells = cells.select("annotator", (F.floor(F.col("i") / CLASSES) % CLASSES).alias("truth"), (F.col("i") % CLASSES).alias("said"), "n")
    off = F.col("said") - F.col("truth")
    w = F.sum("n")
    mean_t, mean_s = F.sum(F.col("n") * F.col("truth")) / w, F.sum(F.col("n") * F.col("said")) / w
    cov = F.sum(F.col("n") * F.col("truth") * F.col("said")) / w - mean_t * mean_s
    var_t = F.sum(F.col("n") * F.col("truth") ** 2) / w - mean_t**2
    var_s = F.sum(F.col("n") * F.col("said") ** 2) / w - mean_s**2
    return cells.groupBy("annotator").agg(
        w.alias("votes"),
        (F.sum(F.when(off == 0, F.col("n")).otherwise(0)) / w).alias("exact"),
        (F.sum(F.when(F.abs(off) <= 1, F.col("n")).otherwise(0)) / w).alias("near"),
        (F.sum(F.abs(off) * F.col("n")) / w).alias("mean_error"),
        (F.sum(off * F.col("n")) / w).alias("bias"),
        F.try_divide(cov, F.sqrt(F.greatest(var_t * var_s, F.lit(0.0)))).alias("correlation"),
    )
