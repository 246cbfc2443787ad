"""Problem 4: missing or wrong language labels, and texts that mix two languages.

Method: one interpolated Kneser-Ney character model per language, kept in sorted hash arrays (an array of n-gram hashes per
order beside the log probabilities of all languages); a part of a text gets the language of the lowest length-normalised
cross-entropy, unless that is higher than the calibrated limit of the language (then it is undetermined). A part of a text
leaves the text's language only on evidence, a gain in likelihood that has to be the greater the shorter it is; limits widen with the spread that a mean over so few
letters has. Limits, spreads and the confidence (a logistic curve over the margin to
the next language) are calibrated on parts that models of the other half of the sample read.

The models are fitted on a bounded sample: SAMPLE records per declared language, those of the least key hash, over all
tables together. Declared labels are partly wrong and some texts are mixed,
so a sentence takes part in the last fit only if models of the other half of the sample agree with its label. Everything else covers every record and whole texts.

Defined results: null, blank and mark-only texts have no parts; ties go to the language code that sorts first; an empty table gives no rows; with no labelled sample at all every text is
undetermined and gives no row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .unify import LOOKALIKES, _fold_table

LANGS = ("de", "en", "es", "fr", "ja", "pt", "zh")
SAMPLE = 2000  # records per declared language
SAMPLE_CHARS = 100_000  # longer texts are not fitted on, so that the sample is bounded whatever a text's size
ORDER = 5
DISCOUNT = 0.75
MIN_COUNT = {5: 2, 4: 1, 3: 1, 2: 1, 1: 1}  # rarer n-grams of the highest order go by their suffix
NAMES = 24.0  # letters at which twice that gain is wanted: the fewer they are, the likelier they are a name, which fits no language
WIDE = 4  # letters that an ideograph or kana counts as
SPREAD = 4.0  # deviations of a mean over a part's letters within which it is not rejected
MIN_GAIN = 24.0  # nats by which a part must prefer another language than its text's
MIN_GAIN_LETTER = 0.7  # and nats a letter
CHUNK = 300_000  # code points scored at once
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 1


def _code_table() -> np.ndarray:
    """Code of every code point: lowered and folded letters, 1 for anything between words, 0 for what doesn't count."""
    table = np.full(0x110000, _SPACE, np.uint32)
    fold = _fold_table()
    for cp in [*range(0x41, 0x250), *range(0x1E00, 0x1F00), *range(0x370, 0x590), *range(0x3041, 0x3100), *range(0xFF10, 0xFFDD), *range(0x2E80, 0x2FE0), *range(0xF900, 0xFB00)]:
        ch = fold.get(cp, chr(cp))
        ch = LOOKALIKES.get(ch, ch)
        if ch and len(ch) == 1 and ch.isalpha():
            table[cp] = ord(low) if len(low := ch.lower()) == 1 else ord(ch)
    for lo, hi in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0x590, 0x2000)):
        table[lo:hi] = np.arange(lo, hi)
    for cp, to in fold.items():
        if to is None or cp in (0x30FB,):
            table[cp] = 0
    for cp in range(0x300, 0x370):
        table[cp] = 0
    table[0x3005] = 0x3005
    return table


_table: np.ndarray | None = None
_END = np.zeros(0x110000, np.uint8)  # 1: always ends a part, 2: only before white space
for _ch in "\n\r。！？!?…｡":
    _END[ord(_ch)] = 1
_END[ord(".")] = 2


def prepare(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, part, owner, at) of a batch: the codes of all texts in a row with the number of the part each lies in, the
    text each part belongs to, and the offset in its text at which each part starts. Every part begins with a space code."""
    global _table
    if _table is None:
        _table = _code_table()
    joined = "\n".join(texts) + "\n"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.cumsum(lengths) - lengths
    kind = _END[raw]
    following = np.empty(len(raw), bool)
    following[:-1] = (raw[1:] == 32) | (raw[1:] == 10) | (raw[1:] == 13)
    following[-1] = True
    ends = (kind == 1) | ((kind == 2) & following)
    starts = np.zeros(len(raw), bool)
    starts[1:] = ends[:-1]
    starts[first] = True
    part = np.cumsum(starts) - 1
    begin = np.flatnonzero(starts)
    owner = np.searchsorted(first, begin, "right") - 1
    at = begin - first[owner]
    codes = _table[raw]
    codes[begin[codes[begin] == 0]] = _SPACE
    keep = codes != 0
    codes, part = codes[keep], part[keep]
    space = codes == _SPACE
    again = np.zeros(len(codes), bool)
    again[1:] = space[1:] & space[:-1] & (part[1:] == part[:-1])
    return codes[~again], part[~again], owner, at


def _single(codes: np.ndarray) -> np.ndarray:
    """Hash of each code by itself."""
    value = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    return value


def _longer(gram: np.ndarray, value: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams that end at each place, from those of the (n - 1)-grams; none reaches over its part."""
    out = value.copy()
    out[1:] += np.where(part[1:] == part[:-1], gram[:-1] * _STEP, np.uint64(0))
    return out


def _grams(codes: np.ndarray, part: np.ndarray, order: int) -> list[np.ndarray]:
    """Hash of the n-gram that ends at each place, for n = 1..order; grams do not reach over parts (they shorten)."""
    value = _single(codes)
    out = [value]
    for _ in range(2, order + 1):
        out.append(_longer(out[-1], value, part))
    return out


class SortedHash:
    """Sorted 64-bit hashes with an index on their leading bits."""

    BITS = 18

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, ~np.uint64(0))
        self.start = np.searchsorted(keys, (np.arange(1 << self.BITS, dtype=np.uint64) << np.uint64(64 - self.BITS))).astype(np.int32)
        self.longest = int(np.max(np.diff(np.append(self.start, len(keys))), initial=0))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted hash, -1 where it is missing."""
        at = self.start[(wanted >> np.uint64(64 - self.BITS)).astype(np.int64)]
        low, size = at.astype(np.int64), self.longest
        end = len(self.keys) - 1
        while size > 1:  # binary search inside the bucket, all at once
            half = size // 2
            mid = np.minimum(low + half, end)
            low = np.where(self.keys[mid] <= wanted, mid, low)
            size -= half
        return np.where(self.keys[np.minimum(low, end)] == wanted, low, -1)


class Models:
    """Kneser-Ney models of all languages over common arrays."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        """parts: per language the codes and part numbers of its training text."""
        self.order, count = order, len(parts)
        singles = [_single(codes) for codes, _ in parts]
        grams, shorter_grams = singles, singles
        self.index: list[SortedHash] = []
        self.logp: list[np.ndarray] = []
        self.loglam: list[np.ndarray] = []
        for n in range(1, order + 1):  # only two orders' hashes are held at a time
            if n > 1:
                shorter_grams = grams
                grams = [_longer(g, v, part) for g, v, (_, part) in zip(grams, singles, parts)]
            low_count = MIN_COUNT.get(n, 1)
            kinds_of = []
            for g, (_, part) in zip(grams, parts):
                keys, c = np.unique(g[_depth(part) >= n - 1], return_counts=True)
                kinds_of.append(keys[c >= low_count])
            kept = np.unique(np.concatenate(kinds_of))
            index = SortedHash(kept)
            logp = np.zeros((len(kept), count), np.float32)
            context_of = np.zeros(len(kept), np.uint64)
            suffix_of = np.zeros(len(kept), np.uint64)
            counts = np.zeros((len(kept), count))
            for lang, (g, short, single, (_, part)) in enumerate(zip(grams, shorter_grams, singles, parts)):
                depth = _depth(part)
                at = np.flatnonzero(depth >= n - 1)
                place = index.find(g[at])
                at, place = at[place >= 0], place[place >= 0]
                if n > 1:  # the gram without its last code, and without its first
                    context_of[place] = short[at - 1]
                    suffix_of[place] = short[at]
                if n == order:
                    counts[:, lang] = np.bincount(place, minlength=len(kept))
                else:  # distinct codes before the gram; one more for a gram at the start of a part
                    before = depth[at] >= n
                    _, one = np.unique(_longer(g, single, part)[at[before]], return_index=True)  # the longer gram determines the shorter
                    counts[:, lang] = np.bincount(place[before][one], minlength=len(kept))
                    begun = np.zeros(len(kept), bool)
                    begun[place[~before]] = True
                    counts[:, lang] += begun
            if n == 1:
                total = counts.sum(axis=0)
                vocabulary = len(kept) + 1
                lam = np.where(total > 0, DISCOUNT * (counts > 0).sum(axis=0) / np.maximum(total, 1), 1.0)
                prob = np.maximum(counts - DISCOUNT, 0) / np.maximum(total, 1) + lam / vocabulary
                prob = np.where(total > 0, prob, 0.0)  # a language without any text is nobody's
                self.floor = np.log(np.maximum(np.where(total > 0, lam / vocabulary, 0.0), 1e-6)).astype(np.float32)
                logp = np.log(np.maximum(prob, 1e-6)).astype(np.float32)
            else:
                contexts = self.index[-1].find(context_of)
                size = len(self.index[-1].keys) - 1
                total = np.zeros((size + 1, count))
                kinds = np.zeros((size + 1, count))
                np.add.at(total, contexts, counts)
                np.add.at(kinds, contexts, counts > 0)
                total, kinds = total[:-1], kinds[:-1]
                lam = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
                self.loglam.append(np.log(np.maximum(lam, 1e-6)).astype(np.float32))
                shorter = self.index[-1].find(suffix_of)
                lower = np.where(shorter[:, None] >= 0, np.exp(self.logp[-1][np.maximum(shorter, 0)]), np.exp(self.floor))
                safe = np.maximum(contexts, 0)
                known = (contexts >= 0)[:, None] & (total[safe] > 0)
                prob = np.where(known, np.maximum(counts - DISCOUNT, 0) / np.maximum(total[safe], 1) + lam[safe] * lower, lower)
                logp = np.log(np.maximum(prob, 1e-12)).astype(np.float32)
            self.index.append(index)
            self.logp.append(logp)

    def log_probs(self, codes: np.ndarray, part: np.ndarray) -> np.ndarray:
        """[places, languages] log probability of each code after the codes before it in its part."""
        grams = _grams(codes, part, self.order)
        depth = _depth(part)
        out = np.zeros((len(codes), len(self.floor)), np.float32)
        left = np.arange(len(codes))
        for n in range(self.order, 0, -1):
            able = depth[left] >= n - 1
            place = np.full(len(left), -1)
            place[able] = self.index[n - 1].find(grams[n - 1][left[able]])
            hit = place >= 0
            out[left[hit]] += self.logp[n - 1][place[hit]]
            miss = left[~hit]
            if not len(miss):
                return out
            if n == 1:
                out[miss] += self.floor
            else:  # back off: weight of the context that the missing gram had
                deep = miss[depth[miss] >= n - 1]
                context = self.index[n - 2].find(grams[n - 2][deep - 1])
                ok = context >= 0
                out[deep[ok]] += self.loglam[n - 2][context[ok]]
            left = miss
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(sums, letters, sizes, owner, at): per part the log likelihood by language, its letters plain and weighted, its text and offset."""
        codes, part, owner, at = prepare(texts)
        logs = self.log_probs(codes, part)
        counted = codes != _SPACE
        logs[~counted] = 0  # spaces say little and long runs of marks nothing
        begin = np.flatnonzero(np.diff(part, prepend=-1))
        letters = np.add.reduceat(counted, begin, dtype=np.int64)
        sizes = letters + (WIDE - 1) * np.add.reduceat(codes >= 0x3000, begin, dtype=np.int64)
        return np.add.reduceat(logs, begin, axis=0), letters, sizes, owner, at


def _depth(part: np.ndarray) -> np.ndarray:
    """Places before each place within its part."""
    place = np.arange(len(part))
    first = np.flatnonzero(np.diff(part, prepend=-1))
    return place - np.repeat(first, np.diff(np.append(first, len(part))))


class Identifier:
    """Models with the calibrated limits of cross-entropy."""

    def __init__(self, labelled: list[tuple[str, str]]):
        """labelled: (declared language, text); declared languages may be wrong for a minority."""
        texts = [t for _, t in labelled]
        declared = np.array([LANGS.index(lang) for lang, _ in labelled])
        codes, part, owner = _prepared(texts)
        wanted = declared[owner]
        letters = np.bincount(part, weights=codes != _SPACE, minlength=len(owner))
        fold = np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) & 1 for t in texts), np.int64, len(texts))[owner]
        sums = np.zeros((len(owner), len(LANGS)), np.float32)
        vouched = np.zeros((2, len(LANGS)), bool)
        for _ in range(2):
            # each half is judged by models of the other half: a model can't vouch for foreign sentences it was fitted on
            for half in (0, 1):
                models = Models([_of(codes, part, (wanted == k) & (fold != half)) for k in range(len(LANGS))])
                vouched[half] = [((wanted == k) & (fold != half)).any() for k in range(len(LANGS))]
                own_codes, own_part = _of(codes, part, fold == half)
                at, own = _part_sums(models, own_codes, own_part)
                sums[at] = own
            # where the other half has nothing of the declared language, there is nobody to contradict it
            agreed = (sums.argmax(axis=1) == declared[owner]) | ~vouched[fold, declared[owner]]
            wanted = np.where(agreed, declared[owner], -1)
        self.trained = np.array([(wanted == k).any() for k in range(len(LANGS))])
        self.models = Models([_of(codes, part, wanted == k) for k in range(len(LANGS))])
        # a part is rejected when its cross-entropy is nearer to what other languages' parts have under the model, and that is no chance of few letters
        self.limit, self.mean, self.spread = np.full(len(LANGS), np.inf), np.zeros(len(LANGS)), np.zeros(len(LANGS))
        some = letters > 0
        for k in range(len(LANGS)):
            own, other = some & (wanted == k), some & (wanted >= 0) & (wanted != k)
            if own.any() and other.any():
                entropy = -sums[:, k] / np.maximum(letters, 1)
                mean = lambda of: np.average(entropy[of], weights=letters[of])  # noqa: B023, E731
                self.mean[k] = mean(own)
                self.spread[k] = np.sqrt(np.mean(letters[own] * (entropy[own] - self.mean[k]) ** 2))  # of one letter
                self.limit[k] = 0.2 * self.mean[k] + 0.8 * min(mean(other & (wanted == m)) for m in range(len(LANGS)) if m != k and (other & (wanted == m)).any())
        # parts of texts whose whole agrees with the declared language: how often is a part of such a margin read like its text?
        whole = np.zeros((len(texts), len(LANGS)))
        np.add.at(whole, owner, sums)
        main = whole.argmax(axis=1)[owner]
        row = np.arange(len(owner))
        rival = sums.copy()
        rival[row, main] = -np.inf
        margin = sums[row, main] - rival.max(axis=1) if len(LANGS) > 1 else np.zeros(len(owner))
        clean = some & (main == declared[owner]) & (margin > -MIN_GAIN)  # the rest are parts in another language
        self.curve = _logistic_curve(np.abs(margin[clean]) / np.sqrt(letters[clean]), margin[clean] > 0)

    def parts(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(owner, at, lang, confidence, letters) of the parts of a batch of texts; lang -1: undetermined."""
        owner, at, sums, letters, sizes = self._scored(texts)
        total = np.zeros((len(texts), len(LANGS)))
        np.add.at(total, owner, sums)
        main = total.argmax(axis=1)[owner]
        row = np.arange(len(owner))
        best = sums.argmax(axis=1)
        gain = sums[row, best] - sums[row, main]
        own = (gain > MIN_GAIN * (1 + (NAMES / np.maximum(sizes, 1)) ** 2)) & (gain > MIN_GAIN_LETTER * letters)
        lang = np.where(own, best, main)
        safe = np.maximum(letters, 1)
        # cross-entropy of the main language over all its parts of the text, of another language over its own part
        grouped = np.where(own, len(texts) + row, owner)
        weight = np.bincount(grouped, weights=letters, minlength=len(texts) + len(owner))[grouped]
        entropy = -np.bincount(grouped, weights=sums[row, lang], minlength=len(texts) + len(owner))[grouped] / np.maximum(weight, 1)
        chance = self.mean[lang] + SPREAD * self.spread[lang] / np.sqrt(np.maximum(weight, 1))
        lang = np.where((entropy > np.maximum(self.limit[lang], chance)) | ~self.trained[lang], -1, lang)
        rival = sums.copy()
        rival[row, np.maximum(lang, 0)] = -np.inf
        margin = (sums[row, np.maximum(lang, 0)] - rival.max(axis=1)) / np.sqrt(safe)
        slope, level = self.curve
        confidence = np.where(lang < 0, 0.0, 1 / (1 + np.exp(-np.clip(slope * margin + level, -30, 30))))
        return owner, at, lang, confidence, letters

    def _scored(self, texts: list[str]):
        sums, letters, sizes, owners, ats = [], [], [], [], []
        start = 0
        for block in _text_blocks(texts):
            s, n, m, owner, at = self.models.score(block)
            sums.append(s), letters.append(n), sizes.append(m), owners.append(owner + start), ats.append(at)
            start += len(block)
        return np.concatenate(owners), np.concatenate(ats), np.concatenate(sums), np.concatenate(letters), np.concatenate(sizes)


def _logistic_curve(x: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """(slope, level) of P(right) = 1 / (1 + exp(-slope x - level)), by Newton steps with a weak prior towards (1, 0)."""
    at, pull = np.array([1.0, 0.0]), 1.0
    data = np.stack([x, np.ones(len(x))], axis=1).astype(np.float64) if len(x) else np.zeros((0, 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ at, -30, 30)))
        gradient = data.T @ (right - p) - pull * (at - [1.0, 0.0])
        step = np.linalg.solve((data * (p * (1 - p))[:, None]).T @ data + pull * np.eye(2), gradient)
        at = at + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(at[0], 0.0)), float(at[1])


def _prepared(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, part, owner) of many texts, prepared in blocks so that little more than the result is held."""
    codes, parts, owners, start, count = [], [], [], 0, 0
    for block in _text_blocks(texts):
        c, p, o, _ = prepare(block)
        codes.append(c), parts.append((p + count).astype(np.int32)), owners.append(o + start)
        start += len(block)
        count += len(o)
    return np.concatenate(codes), np.concatenate(parts), np.concatenate(owners)


def _text_blocks(texts: list[str]) -> Iterator[list[str]]:
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (size == 0 or size + len(texts[stop]) < CHUNK):
            size += len(texts[stop]) + 1
            stop += 1
        yield texts[start:stop]
        start = stop


def _part_sums(models: Models, codes: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parts, log likelihoods by language), block by block of whole parts."""
    first = np.flatnonzero(np.diff(part, prepend=-1))
    numbers, sums, a = [], [], 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(first, first[a] + CHUNK)))
        lo, hi = first[a], first[b] if b < len(first) else len(codes)
        logs = models.log_probs(codes[lo:hi], part[lo:hi])
        logs[codes[lo:hi] == _SPACE] = 0
        numbers.append(part[first[a:b]])
        sums.append(np.add.reduceat(logs, first[a:b] - lo, axis=0))
        a = b
    return (np.concatenate(numbers), np.concatenate(sums)) if numbers else (np.empty(0, np.int64), np.empty((0, len(LANGS)), np.float32))


def _of(codes: np.ndarray, part: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = chosen[part]
    return codes[keep], part[keep]


def least_hashes(rows: DataFrame, group: str, per_group: int) -> DataFrame:
    """Rows that may be among the per_group least hashes (_h) of their group: about twice as many pass, whatever the group's size.

    Group sizes are counted first; the share of the hash range let through follows from them, so that only a bounded
    number of texts is shuffled. (The chance that fewer than per_group pass is nil for the sizes in use.)
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size"))
    share = F.least(F.lit(1.0), F.lit(2.0 * per_group + 200) / F.col("_size"))
    limits = sizes.select(group, (share * 2.0**64 - 2.0**63).alias("_limit"))  # one row per group
    return rows.join(F.broadcast(limits), group).where(F.col("_h") <= F.col("_limit")).drop("_limit")


def sample_labelled(tables: DataFrame, per_language: int = SAMPLE) -> list[tuple[str, str]]:
    """The bounded sample the models are fitted on: (lang, text)."""
    good = tables.where(F.col("lang").isin(*LANGS) & (F.length("text") <= SAMPLE_CHARS)).withColumn("_h", F.xxhash64("src_table", "rec_id"))
    good = least_hashes(good, "lang", per_language)
    first = F.row_number().over(W.partitionBy("lang").orderBy("_h", "rec_id"))
    rows = good.withColumn("_n", first).where(F.col("_n") <= per_language).select("lang", "text").collect()
    return sorted((r["lang"], r["text"]) for r in rows if re.search(r"\w", r["text"]))


def gather(parts: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(src_table, rec_id, lang, text) of several tables given as (name, table, key, text column)."""
    out: DataFrame | None = None
    for name, df, key, text in parts:
        one = df.select(F.lit(name).alias("src_table"), F.col(key).cast("bigint").alias("rec_id"), F.col("lang").alias("lang"), F.col(text).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


def _identify(spark: SparkSession, tables: DataFrame):
    labelled = sample_labelled(tables)
    return spark.sparkContext.broadcast(Identifier(labelled) if labelled else None)  # bounded by the sample


def languages(tables: DataFrame) -> DataFrame:
    """(src_table, rec_id, declared, lang, confidence, share): the languages each text holds; share of its letters."""
    model = _identify(tables.sparkSession, tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = model.value
        for batch in batches:
            names, ids, declared, texts = (batch.column(i) for i in range(4))
            texts = texts.to_pylist()
            at = np.array([i for i, t in enumerate(texts) if t], np.int64)
            if found is None or not len(at):
                continue
            owner, _, lang, confidence, letters = found.parts([texts[i] for i in at])
            ok = (lang >= 0) & (letters > 0)
            flat = pd.DataFrame({"i": at[owner[ok]], "lang": lang[ok], "w": letters[ok], "c": confidence[ok] * letters[ok]}).groupby(["i", "lang"], sort=True).sum().reset_index()
            share = flat["w"] / flat.groupby("i")["w"].transform("sum")
            rows = pa.array(flat["i"].to_numpy())
            yield pa.RecordBatch.from_arrays(
                [names.take(rows), ids.take(rows), declared.take(rows), pa.array([LANGS[k] for k in flat["lang"]], pa.string()), pa.array((flat["c"] / flat["w"]).to_numpy()), pa.array(share.to_numpy())],
                names=["src_table", "rec_id", "declared", "lang", "confidence", "share"],
            )

    return tables.select("src_table", "rec_id", "lang", "text").mapInArrow(run, "src_table string, rec_id bigint, declared string, lang string, confidence double, share double")


def found(tables: DataFrame) -> DataFrame:
    """(src_table, rec_id, lang) of records whose label is missing or wrong or whose text mixes languages."""
    model = _identify(tables.sparkSession, tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = model.value
        for batch in batches:
            texts = batch.column(3).to_pylist()
            at = np.array([i for i, t in enumerate(texts) if t], np.int64)
            if identifier is None or not len(at):
                continue
            owner, _, lang, _, letters = identifier.parts([texts[i] for i in at])
            ok = (lang >= 0) & (letters > 0)
            pairs = np.unique(at[owner[ok]] * len(LANGS) + lang[ok])
            row, lang = pairs // len(LANGS), pairs % len(LANGS)
            declared = np.array([LANGS.index(d) if d in LANGS else -1 for d in batch.column(2).to_pylist()])
            mixed = np.zeros(batch.num_rows, bool)
            mixed[row[1:][row[1:] == row[:-1]]] = True
            case = mixed[row] | (declared[row] != lang)
            rows = pa.array(row[case])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.array(LANGS, object)[lang[case]], pa.string())], names=["src_table", "rec_id", "lang"])

    return tables.select("src_table", "rec_id", "lang", "text").mapInArrow(run, "src_table string, rec_id bigint, lang string")


def segments(tables: DataFrame) -> DataFrame:
    """(src_table, rec_id, seg_no, start_char, end_char, lang, confidence): neighbouring parts of one language joined."""
    model = _identify(tables.sparkSession, tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).to_pylist()
            at = np.array([i for i, t in enumerate(texts) if t], np.int64)
            if model.value is None or not len(at):
                continue
            owner, start, lang, confidence, letters = model.value.parts([texts[i] for i in at])
            flat = pd.DataFrame({"i": at[owner], "start": start, "lang": lang, "w": letters, "c": confidence * letters})
            flat = flat[flat["w"] > 0]
            new = (flat["i"] != flat["i"].shift()) | (flat["lang"] != flat["lang"].shift())
            joined = flat.assign(g=new.cumsum()).groupby("g").agg(i=("i", "first"), start=("start", "first"), lang=("lang", "first"), w=("w", "sum"), c=("c", "sum"))
            joined["no"] = joined.groupby("i").cumcount()
            joined.loc[joined["no"] == 0, "start"] = 0
            after = joined["start"].shift(-1).where(joined["i"] == joined["i"].shift(-1))
            end = [int(e) if e == e else len(texts[i]) for e, i in zip(after, joined["i"])]
            rows = pa.array(joined["i"].to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(joined["no"].to_numpy(), pa.int32()), pa.array(joined["start"].to_numpy(), pa.int32()), pa.array(end, pa.int32()), pa.array([LANGS[k] if k >= 0 else "und" for k in joined["lang"]], pa.string()), pa.array((joined["c"] / joined["w"]).to_numpy())],
                names=["src_table", "rec_id", "seg_no", "start_char", "end_char", "lang", "confidence"],
            )

    return tables.select("src_table", "rec_id", "lang", "text").mapInArrow(run, "src_table string, rec_id bigint, seg_no int, start_char int, end_char int, lang string, confidence double")
