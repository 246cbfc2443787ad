"""Problem 5: text cut off by a field limit or broken off in transfer.

Method: discrete length hazards by window functions. For every source and measure of length (code points, bytes, code points
without what trails the break) the hazard of a length is the share of the texts reaching it that end there; each is tested
against the pooled hazard of the lengths around it (ends over texts at risk, its own length left out) by the exact binomial
tail, with the false-discovery rate controlled over all tests (Benjamini-Hochberg). Texts that end at a significant length
with an incomplete last sentence are truncated: rule `limit`. A transfer may break at any length, so a second rule, named
`transfer` in every row it gives, flags incomplete endings elsewhere; how sure they must be depends on the share of breaks
in their own group (source and what trails the text), estimated by expectation-maximisation.

Completeness is judged by a regularised logistic model over hashed features (the last words, the first words, what lies
between, open quotations), fitted without labels on a bounded sample of texts (SAMPLE, least key hash): sentences followed
by another one are complete, the same sentences cut at random places are not. Whether a last word is a known one is looked up
in the words of the complete sentences of all texts, those that only end the same text aside.

Defined results: null, blank and mark-only texts are no truncated texts, nor are those that only announce a joke; a text of
one word is read like any other; dots, marks and damage after the break are ignored; ties at a significant length are all
read; repeated rows get equal results; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut
from .sentences import _EMOJI, CJK, _shape, _spans, _TOKEN

SAMPLE = 6000
SAMPLE_CHARS = 100_000  # longer texts are not fitted on, so that the sample is bounded whatever a text's size
NEIGHBOURS = 10  # lengths on either side
FDR = 0.01
EXCESS = 2.0  # a limit's hazard and count are at least this many times the pooled hazard around it and the mean count before it
BITS = 20
EPOCHS = 4
ROUNDS = 20  # of a group's share; it moves by less than a thousandth long before
CUTS = 2  # artificial cuts per complete sentence
_TRAIL = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000.…。．｡!?！？�\u200b\u200c\u200d\u200e\u200f\u2060\ufeff~;)]}[({|\\_*-"
_DAMAGE = re.compile(r"[�\x00-\x08\x0b\x0c\x0e-\x1f]")
_LAUGH = r"(?<!\w)a?(?:(?:ha){2,}h?|(?:ja){2,}j?|(?:he){2,}|(?:je){2,}j?|(?:rs){2,}|k{3,}|w{3,})(?!\w)|[哈呵嘿笑]{2,}"
_REMARK = re.compile(rf"(?:(?:[{_EMOJI}]+|#\w+|(?:[;:]-?[)D(])|~+|{_LAUGH})[!！.。~]*)+$", re.IGNORECASE)
# Words that only announce or accept, in the languages of the tables.
ANNOUNCE = set(
    """sure okay ok yes certainly absolutely of course here here's heres s is are a an one the your this you go it joke jokes funny short and now my for comes coming with pleasure
    claro vale sí si por supuesto desde luego aquí ahí tienes va viene está te dejo un una el la tu este chiste broma chistes con gusto ahora
    bien sûr voici voilà une blague votre ta la claro aqui está vai uma piada sua hier ist kommt ein der witz gerne natürlich dein
    好 的 当 然 可 以 没 问 题 给 你 这 是 一 个 请 看 下 面 笑 话 来 了 如 就 有 段 子 ジ ョ ー ク 冗 談 で す は い こ ち ら""".split()
)
_PLAIN = re.compile(rf"[{CJK}]|[^\W\d_{CJK}]+|\d+")
_UNIT_END = re.compile(rf"[.!?…。！？｡．]+[\"'”’»）)\]」』]*(?:\s+|(?=[{CJK}“「《])|$)")


def bare(text: str) -> str:
    """The text without remarks in signs (emoji, tags, laughter) and without what may trail a break."""
    if _DAMAGE.search(text):
        text = _DAMAGE.sub("�", text)
    while True:
        less = _remarkless(text.rstrip(_TRAIL))
        if less == text:
            return text
        text = less


def _remarkless(text: str) -> str:
    """The text without the remarks at its end; a remark holds no white space, so only last words are looked at."""
    while True:
        text = text.rstrip()
        last = text.rsplit(None, 1)[-1:]
        found = _REMARK.search(text, len(text) - len(last[0])) if last else None
        if found is None:
            return text
        text = text[: found.start()]


def announces(text: str) -> bool:
    """Whether a text says nothing but that a joke follows (or nothing at all), at whatever length."""
    return all(m[0] in ANNOUNCE for m in _PLAIN.finditer(_DAMAGE.sub(" ", text.lower())))


def units(text: str) -> list[str]:
    """Sentences of a text in a plain reading; the last may be incomplete. Nothing is cut inside a closed quotation."""
    out = []
    for line in re.split(r"[\r\n]+", text):
        if not line.strip():
            continue
        spans, s, at = _spans(line), 0, 0
        for m in _UNIT_END.finditer(line):
            while s < len(spans) and spans[s][1] <= m.start():
                s += 1
            if s < len(spans) and spans[s][0] < m.start() < spans[s][1]:
                continue
            out.append(line[at : m.end()])
            at = m.end()
        if line[at:].strip():
            out.append(line[at:])
    return out


def _key(*parts: str) -> int:
    return zlib.crc32("\x1f".join(parts).encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


class _Memo(dict):
    """Results of a function of a word; forgets all when it grows too large."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, word: str):
        if len(self) > 200_000:
            self.clear()
        value = self[word] = self.of(word)
        return value


_shapes = _Memo(_shape)
_IDEOGRAPH = re.compile(rf"[{CJK}]")
_is_spelt = _Memo(lambda word: word[0].isalpha() and not _IDEOGRAPH.match(word))


def _words(unit: str) -> list[str]:
    """Tokens of a sentence without its end mark."""
    toks = [_shapes[t] for t in _TOKEN.findall(unit)]
    if toks and len(toks[-1]) > 1 and toks[-1][-1] == ".":
        toks[-1] = toks[-1][:-1]
    return toks


def _spelt(word: str) -> bool:
    """Whether a token is a word of letters that a break could cut."""
    return _is_spelt[word]


def complete(text: str) -> tuple[list[str], list[str]]:
    """Complete sentences of a text without their marks: those before the last one, and the last one if it has one plain end mark."""
    parts = units(text)
    last = parts[-1:] if parts and re.search(r"[^.][.!?。！？][\"”»」』]?\s*$", parts[-1]) else []
    inner, last = ([b for p in some if (b := bare(p).strip())] for some in (parts[:-1], last))
    return inner, last


def known_words(text: str) -> tuple[set[str], str | None]:
    """Words of the complete sentences of a text; apart from them the one that stands only at its very end."""
    inner, last = complete(text)
    known = {w for s in inner for w in set(_words(s)) if _is_spelt[w]}
    toks = _words(last[0]) if last else []
    known.update(w for w in toks[:-1] if _is_spelt[w])
    final = toks[-1] if toks and _spelt(toks[-1]) and toks[-1] not in known else None
    return known, final


def features(unit: str, vocabulary: set[int] | None) -> list[int]:
    """Hashed features of a sentence without its end mark; without a vocabulary none of an unknown last word."""
    toks = _words(unit)
    if not toks:
        return [_key("none")]
    script = "c" if _IDEOGRAPH.match(toks[-1]) else "l"
    start = " ".join(toks[: 3 if script == "c" else 2])
    n = len(toks)
    out = [_key("bias"), _key("1", toks[-1]), _key("s", start), _key("s1", start, toks[-1]), _key("n", script, str(min(n, 40) // 2)), _key("sn", start, str(min(n, 60) // 3))]
    for k in (2, 3, 4, 5):
        if n >= k:
            out.append(_key(str(k), *toks[-k:]))
    if n >= 2:
        out.append(_key("s2", start, *toks[-2:]))
    if vocabulary is not None and _spelt(toks[-1]) and zlib.crc32(toks[-1].encode("utf-8", "surrogatepass")) not in vocabulary:
        out.append(_key("unknown"))
    out.append(_key("open", str((unit.count("“") > unit.count("”")) + 2 * (unit.count('"') % 2) + 4 * (unit.count("«") > unit.count("»")) + 8 * (unit.count("(") > unit.count(")")))))
    inner = {f"{a}{b}" for a, b in zip(toks, toks[1:])} if script == "c" else set(toks[2:])
    out += [_key("in", start, w) for w in inner]
    return out


class EndModel:
    """log odds that the last sentence of a text is incomplete."""

    def __init__(self, texts: list[str]):
        whole = []
        for text in texts:
            inner, last = complete(text)
            whole += inner + last
        self.vocabulary = {zlib.crc32(t.encode("utf-8", "surrogatepass")) for w in whole for t in (_shape(x) for x in _TOKEN.findall(w))}
        rows: list[np.ndarray] = []
        labels: list[int] = []
        for w in whole:
            rows.append(np.array(features(w, self.vocabulary), np.int32))
            labels.append(0)
            seed = zlib.crc32(w.encode("utf-8", "surrogatepass"))
            for k in range(CUTS):
                if len(w) < 3:
                    continue
                at = 1 + (seed * (2 * k + 1) * 2654435761 >> 7) % (len(w) - 1)
                piece = bare(w[:at]).strip()
                if piece and piece != w:
                    rows.append(np.array(features(piece, self.vocabulary), np.int32))
                    labels.append(1)
        self.weights = _logistic(rows, np.array(labels, np.float32))

    def score(self, text: str) -> float:
        """log odds of an incomplete last sentence, by the words of the model's own texts."""
        odds, word = self.reading(text)
        unknown = word is not None and zlib.crc32(word.encode("utf-8", "surrogatepass")) not in self.vocabulary
        return odds + (self.unknown if unknown else 0.0)

    def reading(self, text: str) -> tuple[float, str | None]:
        """log odds of an incomplete last sentence if its last word is known, and that word (none in other scripts)."""
        parts = units(bare(text))
        last = bare(parts[-1]).strip() if parts else ""
        if not last:
            return -20.0, None
        toks = _words(last)
        return float(self.weights[np.array(features(last, None))].sum()), toks[-1] if toks and _spelt(toks[-1]) else None

    @property
    def unknown(self) -> float:
        """Weight of an unknown last word."""
        return float(self.weights[_key("unknown")])


def _logistic(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Weights by Adagrad over mini-batches, with weight decay through the step sizes."""
    weights = np.zeros(1 << BITS, np.float32)
    if not rows:
        weights[_key("bias")] = -4
        return weights
    grad2 = np.full(1 << BITS, 1e-6, np.float32)
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    first = np.cumsum(lengths) - lengths
    order_rng = np.random.default_rng(5)
    size = 64
    for _ in range(EPOCHS):
        order = order_rng.permutation(len(rows))
        for at in range(0, len(order), size):
            chosen = order[at : at + size]
            take = np.concatenate([np.arange(first[i], first[i] + lengths[i]) for i in chosen])
            where = np.repeat(np.arange(len(chosen)), lengths[chosen])
            idx = flat[take]
            z = np.bincount(where, weights=weights[idx], minlength=len(chosen))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[chosen])[where].astype(np.float32)
            uniq, inverse = np.unique(idx, return_inverse=True)
            g = np.bincount(inverse, weights=err, minlength=len(uniq)).astype(np.float32) + 1e-3 * weights[uniq]
            grad2[uniq] += g * g
            weights[uniq] -= 0.3 * g / np.sqrt(grad2[uniq] + 0.1)
    return weights


def binomial_tail(n: int, trials: int, p: float) -> float:
    """P(N >= n) of a binomial: the exact sum of its terms, from n up where that is the smaller side, else as a complement."""
    if n <= 0 or p >= 1:
        return 1.0
    if n > trials or p <= 0:
        return 0.0
    odds = math.log(p) - math.log1p(-p)
    term = math.lgamma(trials + 1) - math.lgamma(n + 1) - math.lgamma(trials - n + 1) + n * odds + trials * math.log1p(-p)
    upper = n >= trials * p
    total, k, ratio = 0.0, n if upper else n - 1, 1.0
    if not upper:
        term += math.log(n / (trials - n + 1)) - odds  # of n - 1
    while 0 <= k <= trials and ratio > 1e-17 * total:
        total += ratio
        ratio *= (trials - k) / (k + 1) * math.exp(odds) if upper else k / (trials - k + 1) / math.exp(odds)
        k += 1 if upper else -1
    tail = math.exp(min(0.0, term + math.log(total)))
    return tail if upper else 1.0 - tail


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, unit, length, n, risk, near, ...) with p added."""
    for batch in batches:
        n, risk, near = (batch.column(i).to_pylist() for i in (3, 4, 5))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([binomial_tail(a, b, c) for a, b, c in zip(n, risk, near)], pa.float64())], names=[*batch.schema.names, "p"])


def length_hazards(sizes: DataFrame) -> DataFrame:
    """(source, unit, length, n, risk, hazard, near, p, significant) from rows (source, unit, length).

    A limit gathers the texts that would have been longer: besides a hazard out of line it takes more texts than end at the
    lengths before it (where a distribution simply ends, hazards rise and counts don't).
    near is the hazard of the lengths around: their ends over their texts at risk, summed over every length there, whether
    a text ends at it or not. Counts per length are combined before any shuffle; the windows run over distinct lengths.
    """
    counts = sizes.groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    by = W.partitionBy("source", "unit").orderBy("length")
    near = by.rangeBetween(-NEIGHBOURS, NEIGHBOURS)
    beyond = W.partitionBy("source", "unit").orderBy(F.col("length").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    low, high = F.greatest(F.col("length") - NEIGHBOURS, F.lit(1)), F.col("length") + NEIGHBOURS
    known = counts.select(
        "*",
        F.sum("n").over(beyond).alias("risk"),
        F.sum("n").over(near).alias("ends"),
        F.sum(F.col("n") * F.col("length")).over(near).alias("ends_length"),
        F.sum("n").over(by.rangeBetween(0, NEIGHBOURS)).alias("ahead"),
        (F.coalesce(F.sum("n").over(by.rangeBetween(-NEIGHBOURS, -1)), F.lit(0)) / NEIGHBOURS).alias("before"),
    )
    # texts at risk summed over all lengths around: those that outlast them all, and those that end inside
    at_risk = (F.col("risk") - F.col("ahead")) * (high - low + 1) + F.col("ends_length") - (low - 1) * F.col("ends") - F.col("risk")
    pooled = (F.col("ends") - F.col("n") + 0.5) / (F.greatest(at_risk, F.lit(0)) + 1.0)
    tested = known.select("source", "unit", F.col("length").cast("int").alias("length"), "n", "risk", F.least(pooled, F.lit(1.0)).alias("near"), "before")
    tested = cut(tested.mapInArrow(_tails, "source string, unit string, length int, n bigint, risk bigint, near double, before double, p double"))
    hazard = F.col("n") / F.col("risk")
    stands_out = (F.col("p") <= fdr_limit(tested)) & (hazard >= EXCESS * F.col("near")) & (F.col("n") >= EXCESS * F.col("before"))
    return tested.select("source", "unit", "length", "n", "risk", hazard.alias("hazard"), "near", "p", stands_out.alias("significant"))


def fdr_limit(tested: DataFrame, rate: float = FDR) -> float:
    """The largest p value that Benjamini-Hochberg accepts: from above, the limit that the number of p values below a limit allows.

    Each step is a count; no p values are sorted anywhere. Steps only ever lower the limit, so they end at its fixed point.
    """
    tests = tested.count()
    limit = rate
    while tests:
        held = tested.where(F.col("p") <= limit).count()
        lower = rate * held / tests
        if lower >= limit:
            return limit
        limit = lower
    return 0.0


_READ = "_k {kind}, source string, odds double, tail string, chars int, bytes int, bare int, word string, own bigint, listed boolean"


def _read(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """(_k, source, text) to the measures of each text and, in rows of their own (listed), the words its complete sentences hold.

    A listed word's own is null, or a hash of the text if the word only ends it.
    """
    fields = ["odds", "tail", "chars", "bytes", "bare", "word", "own"]
    kinds = [pa.float64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
    for batch in batches:
        at, rows, words = [], [], set()
        for i, text in enumerate(batch.column(2).to_pylist()):
            if text is None:
                continue
            known, final = known_words(text)
            words.update((w, None) for w in known)
            b = bare(text)
            own = _text_hash(b)
            if final is not None:
                words.add((final, own))
            if announces(text):
                continue
            rest = text[len(b) :] if text.startswith(b) else text[-3:]
            plain = _remarkless(rest)
            kind = "damage" if "�" in rest else "dots" if re.search(r"\.\.|…", rest) else "mark" if re.search(r"[.!?。！？]", plain) else "remark" if rest.strip() else "none"
            odds, word = model.reading(b)
            at.append(i)
            rows.append((odds, kind, len(text), len(text.encode("utf-8", "surrogatepass")), len(b), word, own))
        take = pa.array(at, pa.int64())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((),) * 7, kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *columns, pa.array([False] * len(at), pa.bool_())], names=["_k", "source", *fields, "listed"])
        listed = {"word": pa.array([w for w, _ in words], pa.string()), "own": pa.array([h for _, h in words], pa.int64())}
        nulls = [listed.get(f, pa.nulls(len(words), k)) for f, k in zip(fields, kinds)]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(words), batch.column(0).type), pa.nulls(len(words), pa.string()), *nulls, pa.array([True] * len(words), pa.bool_())], names=["_k", "source", *fields, "listed"])


def _text_hash(bared: str) -> int:
    """Of what stands before the break, so that marks put after it change nothing."""
    return int.from_bytes(hashlib.blake2b(bared.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def sample_texts(df: DataFrame, key: str, text: str, size: int = SAMPLE) -> list[str]:
    """The bounded sample the model of endings is fitted on."""
    rows = df.where(F.length(text) <= SAMPLE_CHARS).select(F.col(text).alias("_t"), F.xxhash64(key).alias("_h"), F.col(key).alias("_k"))
    return sorted(r["_t"] for r in rows.orderBy("_h", "_k").limit(size).select("_t").collect())


def read_endings(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(_k, source, odds, tail, at_limit): log odds of an incomplete ending, what trails it, and whether it ends at a significant length."""
    fitted = EndModel(sample_texts(df, key, text))
    model = df.sparkSession.sparkContext.broadcast(fitted)  # a fixed number of weights
    rows = df.select(F.col(key).alias("_k"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("_t"))
    kind = rows.schema["_k"].dataType.simpleString()
    every = cut(rows.mapInArrow(lambda it: _read(it, model.value), _READ.format(kind=kind)))
    read = every.where("not listed")
    units_of = F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes", "bare"))))
    hazards = length_hazards(read.select("source", units_of.alias("l")).select("source", "l.*"))
    # a source's limits in one row; a cut of bytes may leave out the rest of a code point
    limits = hazards.where("significant").groupBy("source").agg(F.collect_set(F.struct("unit", "length")).alias("_limits"))
    near = F.exists("_limits", lambda x: ((x.unit == "chars") & (x.length == F.col("chars"))) | ((x.unit == "bare") & (x.length == F.col("bare"))) | ((x.unit == "bytes") & F.col("bytes").between(x.length, x.length + 2)))
    # every word of a complete sentence: whether any text has it before its end, else the hashes of the texts it ends
    known = every.where("listed").groupBy(F.col("word").alias("_w")).agg(F.max(F.col("own").isNull()).alias("inner"), F.min("own").alias("low"), F.max("own").alias("high"))
    # texts without such a word are spread over keys of their own
    looked = read.withColumn("_w", F.coalesce("word", F.concat(F.lit(" "), F.pmod(F.xxhash64("_k"), F.lit(1024)).cast("string")))).join(known, "_w", "left")
    unknown = F.col("word").isNotNull() & ~F.coalesce(F.col("inner") | (F.col("low") != F.col("own")) | (F.col("high") != F.col("own")), F.lit(False))
    odds = F.col("odds") + F.when(unknown, F.lit(fitted.unknown)).otherwise(0.0)
    return looked.join(limits, "source", "left").select("_k", "source", odds.alias("odds"), "tail", F.coalesce(near, F.lit(False)).alias("at_limit"))


def _settled(group: pa.Table) -> pa.Table:
    """(source, tail, at_limit, prior): the share of breaks in a group, from its histogram (o, n) of log odds."""
    at_limit, tail = group.column("at_limit")[0].as_py(), group.column("tail")[0].as_py()
    odds, n = np.clip(group.column("o").to_numpy(), -12, 12) - BALANCE, group.column("n").to_numpy()
    prior = 0.5 if at_limit else 0.02 if tail == "mark" else 0.2
    for _ in range(ROUNDS):
        post = 1 / (1 + np.exp(-(odds + np.log(prior / (1 - prior)))))
        prior = ((post * n).sum() + 0.2) / (n.sum() + 2)
    return pa.table({**{c: group.column(c).slice(0, 1) for c in ("source", "tail", "at_limit")}, "prior": pa.array([prior], pa.float64())})


def judged(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(_k, source, odds, tail, at_limit, truncated, rule).

    The share of breaks in each group (source, trailing kind, at a limit or not) is estimated from its histogram of odds; a
    text is truncated when its posterior is above one half. rule: limit or transfer, null where the text is whole.
    """
    read = cut(read_endings(df, key, text, source))
    group = ["source", "tail", "at_limit"]
    bins = read.groupBy(*group, F.round("odds", 1).alias("o")).agg(F.count("*").alias("n"))  # some hundred rows a group
    shares = bins.groupBy(*group).applyInArrow(_settled, "source string, tail string, at_limit boolean, prior double")
    truncated = F.col("odds") + F.log(F.col("prior") / (1 - F.col("prior"))) - F.lit(BALANCE) > 0
    rule = F.when(F.col("truncated"), F.when(F.col("at_limit"), "limit").otherwise("transfer"))
    return read.join(shares, group).withColumn("truncated", truncated).withColumn("rule", rule).drop("prior")


BALANCE = float(np.log(CUTS))  # the fit sees CUTS incomplete sentences for each complete one


def found(df: DataFrame, key: str = "submission_id", text: str = "text", source: str = "model") -> DataFrame:
    """(key): truncated texts."""
    return judged(df, key, text, source).where("truncated").select(F.col("_k").alias(key))


def report(df: DataFrame, key: str = "submission_id", text: str = "text", source: str = "model") -> DataFrame:
    """(source, texts, truncated, at_limit, in_transfer, share): how often each source truncates, of all its answers, null and empty ones included."""
    every = df.groupBy(F.coalesce(F.col(source), F.lit("")).alias("source")).agg(F.count("*").alias("texts"))
    broken = judged(df, key, text, source).where("truncated").groupBy("source").agg(F.count("*").alias("truncated"), F.count_if(F.col("rule") == "limit").alias("at_limit"), F.count_if(F.col("rule") == "transfer").alias("in_transfer"))
    return every.join(broken, "source", "left").na.fill(0, ["truncated", "at_limit", "in_transfer"]).withColumn("share", F.col("truncated") / F.col("texts"))
