"""Pairs inside groups and between groups of any size, in tasks of bounded size."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024  # rows of a block; two blocks meet in one task
BITS = 26  # of a key filter: 8 MB whatever the number of keys
PARTS = 16  # a key filter is put together in


def _places(keys: np.ndarray) -> np.ndarray:
    mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def _packed(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts.values()], pa.binary())], names=["part", "data"])


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(1 << BITS, bool)
    for batch in batches:
        held[_places(batch.column(0).to_numpy())] = True
    yield _packed({k: p for k, p in enumerate(np.packbits(held).reshape(PARTS, -1)) if p.any()})


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(*(c.to_pylist() for c in batch.columns)):
            part = np.frombuffer(zlib.decompress(data), np.uint8)
            parts[k] = parts[k] | part if k in parts else part
    yield _packed(parts)


def key_filter(keys: DataFrame) -> Broadcast:
    """A bit set of the bigint keys of the one column: it lets every one of them pass and few others, as long as it is sparse.

    Its size is fixed; tasks' sets are united in Spark, and PARTS packed rows reach the driver.
    """
    bits = np.zeros((PARTS, (1 << BITS) // 8 // PARTS), np.uint8)
    for r in keys.mapInArrow(_marked, "part int, data binary").repartition("part").mapInArrow(_united, "part int, data binary").collect():
        bits[r["part"]] = np.frombuffer(zlib.decompress(r["data"]), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(zlib.compress(bits.tobytes(), 1))


def passing(rows: DataFrame, column: str, held: Broadcast) -> DataFrame:
    """The rows whose key may be one of the filter's, before any shuffle."""
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(held.value), np.uint8)).view(bool)
        for batch in batches:
            yield batch.filter(pa.array(bits[_places(batch.column(at).to_numpy())]))

    return rows.mapInArrow(run, rows.schema)


def pairs_within(rows: DataFrame, group: str, key: str, size: str, block: int = BLOCK, wanted: Column | None = None) -> DataFrame:
    """Every two rows of a group, as columns of aliases a and b with a.key < b.key; size is the column of the group's size.

    The rows of a group are spread over blocks of about `block` rows by a hash of their key, and every two blocks of a group
    meet by an equi-join of their own: a group of n rows takes (n / block) ** 2 / 2 tasks' worth, never one. Groups below
    that size are one block. wanted: a condition on a.* and b.* that pairs must meet.
    """
    spread = rows.withColumn("_of", F.ceil(F.col(size) / block).cast("int")).withColumn("_own", F.pmod(F.xxhash64(key, group), F.col("_of")).cast("int"))
    # block i meets block j >= i: a row of block k is a first one of (k, k..) and a second one of (..k, k)
    a = spread.withColumn("_i", F.col("_own")).withColumn("_j", F.explode(F.sequence("_own", F.col("_of") - 1))).alias("a")
    b = spread.withColumn("_j", F.col("_own")).withColumn("_i", F.explode(F.sequence(F.lit(0), "_own"))).alias("b")
    same = (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a._i") == F.col("b._i")) & (F.col("a._j") == F.col("b._j"))
    # inside one block each pair is met once; between two blocks the smaller key may lie on either side
    met = a.join(b, same & ((F.col("a._i") < F.col("a._j")) | (F.col(f"a.{key}") < F.col(f"b.{key}"))))
    return met if wanted is None else met.where(wanted)


def expand_links(links: DataFrame, left: DataFrame, right: DataFrame, block: int = 4096) -> DataFrame:
    """(ka, kb): the members of both classes of every link; links (a, b), left and right (cls, k).

    A class is expanded over salts in proportion to its size, so that its copies spread over many tasks.
    """

    def salted(members: DataFrame, end: str) -> tuple[DataFrame, DataFrame]:
        sizes = members.groupBy("cls").agg(F.count("*").alias("n")).select("cls", F.ceil(F.col("n") / block).cast("int").alias("of"))
        sizes = sizes.join(links.select(F.col(end).alias("cls")).distinct(), "cls")
        own = members.join(sizes, "cls").select(F.col("cls").alias(end), F.pmod(F.xxhash64("k"), F.col("of")).cast("int").alias(f"s{end}"), F.col("k").alias(f"k{end}"))
        return sizes.select(F.col("cls").alias(end), F.col("of").alias(f"n{end}")), own

    (na, ka), (nb, kb) = salted(left, "a"), salted(right, "b")
    spread = links.join(na, "a").join(nb, "b").withColumn("sa", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("sb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return spread.join(ka, ["a", "sa"]).join(kb, ["b", "sb"]).select("ka", "kb")
