"""Problem 3: records that share most of their content, differing by small edits, insertions or reordering.

Method: many universal hash minima with banding, signature verification, and connected components by alternating
large-star and small-star. Texts are first brought to their consistent form (unify), lowered and cut into tokens (a word,
or one character of a script without word spaces); shingles are pairs of neighbouring tokens, so that an inserted remark
or a moved sentence changes few of them. Equal token sequences form one class; one class costs one row however often it
is repeated.

Defined results: null texts and texts without a letter or digit belong to no class and are in no pair; one-token texts
have that token as their only shingle; repeated rows share a class; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, release
from .blocks import key_filter, pairs_within, passing
from .unify import unify

WIDTH = 2  # tokens in a shingle
BANDS, ROWS = 64, 4  # finds a pair of similarity 0.5 with probability 0.984, one of 0.6 with 0.9999
SKETCH_BITS = 128  # one bit of each of as many further minima
SKETCH_AGREE = 82  # of 128; a pair of similarity 0.5 agrees in 96 +- 4.9
SIMILARITY = 0.5  # exact Jaccard similarity of the shingle sets
BLOCK = 1024  # classes in a block of a bucket; larger buckets are several blocks
MAX_ROUNDS = 200  # of components; more than any graph of fewer than 2 ** 64 nodes takes
SLICE = 500  # texts signed at once
PASS, PASS_BANDS = 128_000_000, 8  # bytes of bucket entries on disk at once; bands at least, an eighth of all
PART = 16_000_000  # bytes of bucket entries sorted at once
SENT = 1_000_000  # entries packed at once
_PRIME = (1 << 31) - 1
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]|[^\W_぀-ヿ㐀-鿿豈-﫿]+")


def tokens(text: str) -> list[str]:
    """Lowered words; in scripts without word spaces each character by itself."""
    return _TOKEN.findall(text.lower())


class _Memo(dict):
    """Hashes of tokens, those of the first ones met kept."""

    def __missing__(self, token: str) -> int:
        value = 0
        for byte in token.encode("utf-8", "surrogatepass"):
            value = (value * 257 + byte + 1) % _PRIME
        if len(self) < 50_000:
            self[token] = value
        return value


_token_hash = _Memo().__getitem__


def shingle_sets(texts: list[list[str]], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """shingle_hashes of many non-empty token lists, one after the other, and the size of each."""
    counts = np.array([len(toks) for toks in texts])
    ids = np.fromiter((_token_hash(t) for toks in texts for t in toks), np.int64, counts.sum())
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.arange(len(ids))
    acc = ids.copy()
    for k in range(1, width):
        more = np.flatnonzero(at + k < ends)
        acc[more] = (acc[more] * 1_000_003 + ids[more + k]) % _PRIME
    owner = np.repeat(np.arange(len(texts)), counts)
    # a shingle begins wherever `width` tokens are left; a shorter text is one shingle
    begins = at + np.minimum(width, counts)[owner] <= ends
    both = np.sort(owner[begins] << 31 | acc[begins])
    both = both[np.r_[True, both[1:] != both[:-1]]]
    return both & _PRIME, np.bincount(both >> 31, minlength=len(texts))


def shingle_hashes(toks: list[str], width: int = WIDTH) -> np.ndarray:
    """Distinct 31-bit hashes of the shingles of a token list, sorted."""
    return shingle_sets([toks], width)[0] if toks else np.empty(0, np.int64)


def _universal(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)


def minima(flat: np.ndarray, sizes: np.ndarray, n: int, seed: int = 7, first: int = 0, last: int | None = None) -> np.ndarray:
    """[len(sizes), last - first] minima over each (non-empty) set of the high 32 bits of a x + b mod 2 ** 64, which is strongly universal for 31-bit x.

    flat, sizes: the sets one after the other and the size of each; first, last: only these of the n hash functions.
    """
    a, b = (x[first:last] for x in _universal(n, seed))
    flat = flat.astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(a), len(sizes)), np.uint64)
    hashed = np.empty_like(flat)
    for k in range(len(a)):
        np.multiply(flat, a[k], out=hashed)
        np.add(hashed, b[k], out=hashed)
        np.minimum.reduceat(hashed, starts, out=out[k])
    return np.ascontiguousarray((out >> np.uint64(32)).astype(np.int64).T)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, form, ...) to (_id, shingles, s0, s1, ...)."""
    for batch in _slices(batches):
        flat, sizes = shingle_sets([form.split(" ") for form in batch.column(1).to_pylist()])
        bits = (minima(flat, sizes, BANDS * ROWS + SKETCH_BITS, first=BANDS * ROWS) & 1).astype(np.uint8)
        words = np.packbits(bits, axis=1).view(np.int64)
        shingles = pa.ListArray.from_arrays(np.cumsum([0, *sizes]).astype(np.int32), pa.array(flat.astype(np.int32)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), shingles, pa.array(words[:, 0]), pa.array(words[:, 1]), *batch.columns[2:]],
            names=["_id", "shingles", "s0", "s1", *batch.schema.names[2:]],
        )


def _bucket_keys(shingles: pa.ListArray, first: int = 0, last: int = BANDS) -> np.ndarray:
    """[len(shingles), last - first] keys of the buckets of these bands."""
    mix = np.random.default_rng(11).integers(1, 1 << 62, ROWS, dtype=np.int64) | 1
    sizes = np.diff(shingles.offsets.to_numpy())
    low = minima(shingles.flatten().to_numpy(), sizes, BANDS * ROWS + SKETCH_BITS, first=first * ROWS, last=last * ROWS)
    with np.errstate(over="ignore"):
        keys = (low.reshape(-1, last - first, ROWS) * mix).sum(axis=2)
        return (keys ^ (keys >> 29)) * np.int64(0x2545F4914F6CDD1D) + np.arange(first, last, dtype=np.int64) * np.int64(0x632BE59BD9B4E019)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, shingles, s0, s1) to (_id, shingles, bands, s0, s1)."""
    for batch in _slices(batches):
        bands = pa.ListArray.from_arrays((np.arange(batch.num_rows + 1) * BANDS).astype(np.int32), pa.array(_bucket_keys(batch.column(1)).ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], bands, *batch.columns[2:]], names=["_id", "shingles", "bands", "s0", "s1"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [" ".join(toks) if (toks := tokens(t)) else None for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string())], names=["_k", "norm"])


def text_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(_k, cls, norm): each record with the class of its normalised token sequence (a 64-bit hash); no class, no row.

    _made_of of the result: the cut to release once the result is cut.
    """
    unified = unify(df, key, text)
    forms = unified.select(F.col(key).alias("_k"), "form").where("form is not null")
    kind = forms.schema["_k"].dataType.simpleString()
    out = forms.mapInArrow(_keyed, f"_k {kind}, norm string").where("norm is not null").select("_k", F.xxhash64("norm").alias("cls"), "norm")
    out._made_of = unified._made_of
    return out


def signatures(classes: DataFrame, *also: Column, bands: bool = True) -> DataFrame:
    """One signed row per class: (_id, shingles, bands, s0, s1).

    bands: False leaves the bucket keys out, which weigh more than a short text (candidate_links makes them as it goes).
    also: further aggregates of a class, as columns after these; only without bands.
    """
    one = classes.groupBy("cls").agg(F.min("norm").alias("norm"), *also).withColumnRenamed("cls", "_id")
    more = "".join(f", {c.name} {c.dataType.simpleString()}" for c in one.schema.fields[2:])
    signed = one.mapInArrow(_sketched, f"_id bigint, shingles array<int>, s0 bigint, s1 bigint{more}")
    return signed.mapInArrow(_banded, "_id bigint, shingles array<int>, bands array<bigint>, s0 bigint, s1 bigint") if bands else signed


def _agree(a: str, b: str) -> Column:
    apart = F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))) + F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1")))
    return apart <= SKETCH_BITS - SKETCH_AGREE


#: A row on its way to its bucket, as it is shuffled.
_ENTRY = np.dtype([("bucket", "<i8"), ("id", "<i8"), ("s0", "<u8"), ("s1", "<u8"), ("side", "i1")])


def _sent(first: int, last: int, parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(_id, shingles, s0, s1, side) to (part, data): the rows' entries of these bands, packed by part."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        entries = np.concatenate(held)
        part = ((entries["bucket"].view(np.uint64) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        entries, ends = entries[order], np.cumsum(np.bincount(part, minlength=parts))
        full = [p for p in range(parts) if ends[p] > (ends[p - 1] if p else 0)]
        data = [entries[ends[p - 1] if p else 0 : ends[p]].tobytes() for p in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in _slices(batches):
            entries = np.empty((batch.num_rows, last - first), _ENTRY)
            entries["bucket"] = _bucket_keys(batch.column(1), first, last)
            for field, column in (("id", 0), ("s0", 2), ("s1", 3), ("side", 4)):
                entries[field] = batch.column(column).to_numpy().view(_ENTRY[field])[:, None]
            held.append(entries.ravel())
            if sum(map(len, held)) >= SENT:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    return run


def _met(block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(part, data) to agreeing pairs (a, b) of one bucket, n null; of buckets of more than `block` rows the rows: a, bucket, n, s0, s1, side."""
    kinds = {"a": "id", "b": "id", "n": "id", "bucket": "bucket", "s0": "s0", "s1": "s1", "side": "side"}

    def out(**columns: np.ndarray) -> pa.RecordBatch:
        n = len(columns["a"])
        made = [pa.array(columns[k].astype(_ENTRY[v].str.replace("u", "i"))) if k in columns else pa.nulls(n, pa.int8() if k == "side" else pa.int64()) for k, v in kinds.items()]
        return pa.RecordBatch.from_arrays(made, names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = b"".join(value.as_buffer() for batch in batches for value in batch.column(1))
        if not data:
            return
        entries = np.frombuffer(data, _ENTRY)
        order = np.argsort(entries["bucket"])
        bucket = entries["bucket"][order]
        same = np.r_[False, bucket[1:] == bucket[:-1], False]
        shared = same[1:] | same[:-1]  # nearly all buckets hold one class and end here
        entries, bucket = entries[order[shared]], bucket[shared]
        del data, order, same, shared
        if not len(bucket):
            return
        begins = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[begins, len(bucket)])
        n = np.repeat(sizes, sizes)
        large = n > block
        for start in range(0, len(big := np.flatnonzero(large)), SENT):
            rows = entries[big[start : start + SENT]]
            yield out(a=rows["id"], n=n[big[start : start + SENT]], **{k: rows[k] for k in ("bucket", "s0", "s1", "side")})
        entries, bucket = entries[~large], bucket[~large]
        ids, s0, s1, side = (np.ascontiguousarray(entries[k]) for k in ("id", "s0", "s1", "side"))
        at, far = np.arange(len(bucket)), 0
        while len(at):  # every two rows of a bucket, by how far they lie apart
            far += 1
            at = at[at + far < len(bucket)]
            at = at[bucket[at] == bucket[at + far]]
            to = at + far
            apart = np.bitwise_count(s0[at] ^ s0[to]) + np.bitwise_count(s1[at] ^ s1[to])
            met = (apart <= SKETCH_BITS - SKETCH_AGREE) & ((side[at] | side[to]) == 3) & (ids[at] != ids[to])
            if met.any():
                a, b = ids[at[met]], ids[to[met]]
                yield out(a=np.minimum(a, b), b=np.maximum(a, b))

    return run


def candidate_links(signed: DataFrame) -> DataFrame:
    """(a, b) with a < b: classes that share a bucket and whose sketches agree; cut, so that `signed` may go.

    signed: may have a column `side` (1, 2 or 3 for both): then only pairs that have both sides between them.

    The bands are taken some at a time, as many as weigh PASS bytes but PASS_BANDS at least: their bucket keys are made, sent to
    their bucket, and gone from disk before the next ones. Every two classes of a bucket are held against each other, whatever
    its size; buckets of more than BLOCK classes in blocks of about that many.
    """
    rows = signed.select("_id", "shingles", "s0", "s1", (F.col("side") if "side" in signed.columns else F.lit(3)).cast("tinyint").alias("side"))
    count, cores = signed.count(), signed.sparkSession.sparkContext.defaultParallelism
    step = min(BANDS, max(PASS_BANDS, PASS // (max(1, count) * _ENTRY.itemsize)))
    parts = max(cores, count * step * _ENTRY.itemsize // PART)
    links = []
    for first in range(0, BANDS, step):
        sent = rows.mapInArrow(_sent(first, min(BANDS, first + step), parts), "part int, data binary")
        kinds = "a bigint, b bigint, n bigint, bucket bigint, s0 bigint, s1 bigint, side tinyint"
        met = cut(sent.repartitionById(parts, "part").mapInArrow(_met(BLOCK), kinds))
        some, large = met.where("n is null").select("a", "b"), met.where("n is not null")
        if not large.isEmpty():
            wide = large.select(F.col("a").alias("_id"), "bucket", "n", "s0", "s1", "side")
            across = _agree("a", "b") & (F.col("a.side").bitwiseOR(F.col("b.side")) == 3)
            more = pairs_within(wide, "bucket", "_id", "n", BLOCK, across)
            some = cut(some.union(more.select(F.least("a._id", "b._id").alias("a"), F.greatest("a._id", "b._id").alias("b"))).distinct())
            release(met)
            met = some
        links.append((some, met))
    whole = links[0][0]
    for some, _ in links[1:]:
        whole = whole.union(some)
    found = cut(whole.distinct())
    release(*(met for _, met in links))
    return found


def verified(links: DataFrame, signed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, jaccard): the links whose Jaccard similarity of all shingles reaches the threshold.

    Shingles are compared by 31-bit hashes: two texts of 100 shingles each share a false one once in 200000 pairs.
    """
    ends = key_filter(links.select(F.explode(F.array("a", "b"))))
    sets = passing(signed.select("_id", "shingles"), "_id", ends)
    both = links.join(sets.select(F.col("_id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("_id").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    jaccard = shared / (F.size("sa") + F.size("sb") - shared)
    return both.select("a", "b", jaccard.alias("jaccard")).where(F.col("jaccard") >= similarity)


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, comp): the least node of each connected component, by alternating large-star and small-star.

    Every round is a pair of aggregations over the edges, written to the shared folder; it ends when a round changes nothing
    (edge count and checksum are all the driver sees). RuntimeError if max_rounds don't suffice.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = cut(large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        release(edges, large)
        edges = small
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = now
    raise RuntimeError(f"components: not done after {max_rounds} rounds")


def same_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cls, group_id): each record that has a class, with its group; group_id is a class id, alone if nothing is near."""
    every = text_classes(df, key, text)
    classes = cut(every)
    release(every._made_of)
    signed = cut(signatures(classes, bands=False))
    members = cut(classes.select("_k", "cls"))
    release(classes)  # texts are read no more
    links = candidate_links(signed)
    edges = cut(verified(links, signed))
    release(signed, links)
    comp = components(edges)
    release(edges)
    grouped = members.join(comp, F.col("cls") == F.col("node"), "left")
    return grouped.select(F.col("_k").alias(key), "cls", F.coalesce("comp", "cls").alias("group_id"))


def same_pairs(df: DataFrame, key: str, text: str, a_name: str, b_name: str) -> DataFrame:
    """All pairs of records of one group, a < b: groups of any size are paired in blocks."""
    groups = cut(same_groups(df, key, text).select(F.col(key).alias("k"), "group_id"))
    several = groups.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1")
    met = pairs_within(groups.join(several, "group_id"), "group_id", "k", "n", BLOCK)
    return met.select(F.least("a.k", "b.k").alias(a_name), F.greatest("a.k", "b.k").alias(b_name))
