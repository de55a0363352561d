"""Near copies by word shingles: SimHash within a wide radius, then exact similarity.

Two sets whose similarity (shared over all shingles) is 0.8 or more share one of their first fifth
of shingles, in any order common to all; the order puts frequent shingles of a sample last. Sets
that meet there and whose SimHash differs by no more than the radius are joined to clusters, and
every cluster is taken apart by exact similarity, without the filter (set_links). At similarity 0.8
fingerprints are 9.7 bits apart on average with a deviation of 2.9, so 22 bits are four deviations more.
Sets that follow a leader of a large group are linked to it at once and stay out of the buckets, and
buckets of shingles that the sample finds too often for one task are cut into pairs of blocks.

Words are lower-cased (A-Z) runs without white space; a text of fewer than five words has one
shingle of all its words; null texts, empty ones and those without words are copies of one another.
Of rows with equal key and text any stays; null keys give way to others; other columns are left alone,
whatever their names. An empty table stays empty.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, durable, own_name, whole_text
from .components import components
from .set_links import SAMPLE, clusters, exact_links, find_leaders, key_counts, met, named_rows, new_sets, packed, pairs

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 22
#: In how many texts of the sample a shingle is frequent; entries of one bucket, and of one shingle in a block.
_FREQUENT, _BUCKET, _BLOCK = 3, 1 << 20, 1 << 17


def mark(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.col(text))


def simhash(x: np.ndarray) -> int:
    """64 bits of a set, as a signed long."""
    bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(x), bitorder="little").view("<i8")[0])


def _prefix(x: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
        often = frequent[at] == x
        x = np.concatenate([x[~often], x[often]])
    return x[: len(x) - math.ceil(similarity * len(x) - 1e-9) + 1]


def _meet(similarity: float):
    """A spanning forest of the sets that share a shingle of one bucket and can be similar by size and fingerprint."""

    def run(group: pa.Table) -> pa.Table:
        rows, at, end = met(group, 4)
        found = []
        for s, e in zip(at.tolist(), end.tolist()):
            prints, sizes = rows[s:e, 2].view(np.uint64), rows[s:e, 3]

            def near(i, others):
                least, most = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])  # noqa: B023
                return (least >= similarity * most - 1e-9) & (np.bitwise_count(prints[others] ^ prints[i]) <= RADIUS)  # noqa: B023

            of = clusters(e - s, near)
            links = np.flatnonzero(of != np.arange(e - s))
            found.append(np.stack([rows[s + of[links], 1], rows[s + links, 1]], axis=1))
        return pairs(found)

    return run


def candidates(texts: DataFrame, leaders, n: int, size: int, shingle: int, similarity: float) -> DataFrame:
    """(a, b): short names that join the sets of the ``n`` texts (t, th) that share a rare shingle and can be similar.
    ``size`` is the number of shingles of all."""
    step = max(1, n // SAMPLE)
    some = texts.where(F.pmod("th", F.lit(step)) == 0)

    def shingles(batches):
        for _, found in new_sets(batches, leaders.value, shingle):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    often = arrow_map(some, shingles, "h long").groupBy("h").count().where(F.col("count") >= _FREQUENT).select("h")
    frequent = np.sort(np.array([r.h for r in often.toLocalIterator()], dtype=np.int64).view(np.uint64))
    share = texts.sparkSession.sparkContext.broadcast
    shared = share(frequent)

    def sampled(batches):
        for _, found in new_sets(batches, leaders.value, shingle):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_prefix(x, shared.value, similarity) for x in found]).view(np.int64))], names=["key"])

    blocks = share(key_counts(arrow_map(some, sampled, "key long"), step, _BLOCK))
    buckets = max(1, int(size * (1 - similarity)) // _BUCKET)

    def entries(batches):
        for names, found in new_sets(batches, leaders.value, shingle):
            firsts = [_prefix(x, shared.value, similarity) for x in found]
            n = [len(p) for p in firsts]
            columns = (np.concatenate(firsts).view(np.int64), np.repeat(names, n), np.repeat([simhash(x) for x in found], n), np.repeat([len(x) for x in found], n))
            yield packed(np.stack(columns, axis=1), blocks.value, buckets)

    return arrow_map(texts.select("t"), entries, "bucket int, rows binary").groupBy("bucket").applyInArrow(_meet(similarity), "a long, b long").distinct()


def first_rows(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(k, mark, n) of the row that stays of each component of near copies: its key, the hash of its
    key and text, how many rows have both. The smallest key stays, a null one only without others."""
    texts = df.select(F.col(key).alias("k"), mark(key, text).alias("mark"), whole_text(text).alias("t")).withColumn("th", F.xxhash64("t"))
    leaders = find_leaders(texts, shingle, similarity)
    shared = df.sparkSession.sparkContext.broadcast(leaders)
    rows = durable(named_rows(texts, ["k", "mark", "th"], shared, shingle))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    roots = components(candidates(texts, shared, n, size, shingle, similarity))
    places = durable(roots.union(roots.select("root", "root")).distinct().select(F.col("node").alias("short"), F.col("root").cast("string").alias("grp")))
    links = components(exact_links(texts, rows, places, leaders, shingle, similarity))
    order = F.struct(F.col("k").isNull().alias("last"), "k", "mark", "n")
    least = rows.groupBy("name", "k", "mark").agg(F.count("*").alias("n")).groupBy("name").agg(F.min(order).alias("first"))
    placed = least.join(links, least.name == links.node, "left").groupBy(F.coalesce("root", "name").alias("root")).agg(F.min("first").alias("first"))
    return durable(placed.select("first.k", "first.mark", "first.n"))


def first_only(df: DataFrame, first: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that ``first`` (k, mark, n) names; of those with the same key and text any one."""

    def stay(which: DataFrame) -> DataFrame:
        k, own = own_name(df, "__k"), own_name(df, "__mark")
        named = which.select(F.col("k").alias(k), F.col("mark").alias(own))
        return df.join(named, F.col(key).eqNullSafe(F.col(k)) & (mark(key, text) == F.col(own)), "left_semi")

    repeated = first.where("n > 1")
    if repeated.isEmpty():
        return stay(first)
    return stay(first.where("n = 1")).union(stay(repeated).dropDuplicates([key, text]))


def without_copies(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows, all columns, that stay, exactly one of each component; of rows with the same key and text any."""
    return first_only(df, first_rows(df, key, text, shingle, similarity), key, text)
