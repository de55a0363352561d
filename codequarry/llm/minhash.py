"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A signature has 96 places, each the least of one hash of all shingles; two sets of similarity 0.8 differ
in 19 places on average with a deviation of 3.9. The join finds all pairs that differ in 37 or fewer: 19
chunks of five places (one of six) leave, by the pigeonhole principle, some chunk with at most one error,
so every set sends each chunk out once for each place that the error may be in, without that place, and
such pairs meet. Two bits of every place travel along and tell pairs beyond the limit off (the distance by
two bits is never more than by all), and each bucket returns a spanning forest of what is left. Of sets
just at similarity 0.8 about one pair in 100,000 lies beyond 37 places.

What a forest joins is compared exactly, on full sets, in blocks (set_links); sets that follow a leader
of a large group of near copies are linked to it at once and stay out of the join, so that no bucket grows
with the group. Buckets of keys that a sample finds too often for one task are cut into pairs of blocks.

Words are lower-cased (A-Z) runs without white space. Null texts and texts without words have an empty
set, which links with nothing. Shingles are told apart by 64 bits and sets by 128. Null keys are members
but name a component only if it has no other; rows that repeat a text belong together, each on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, durable, frequent_keys, mix, salted, whole_text
from .components import components
from .set_links import SAMPLE, clusters, exact_links, find_leaders, key_counts, met, named_rows, new_sets, packed, pairs

SHINGLE, SIMILARITY = 2, 0.8
HASHES, RADIUS, CHUNKS = 96, 37, 19
#: Entries of one bucket, and of one key in a block.
BUCKET, KEY_BLOCK = 1 << 20, 1 << 17
_WORDS = HASHES // 32
_LOW = np.uint64(0x5555555555555555)
#: Odd multipliers and additions of the hashes, and what tells places and keys apart.
_MULTIPLY, _ADD, _PLACE, _KEY = (mix(np.arange(HASHES, dtype=np.uint64) + np.uint64(1 + i * 1000)) for i in range(4))
_MULTIPLY |= np.uint64(1)
_CHUNK_OF = np.arange(HASHES) * CHUNKS // HASHES
assert RADIUS // CHUNKS == 1


def signatures(found: list[np.ndarray]) -> np.ndarray:
    """A row of HASHES 64-bit values for each of the non-empty sets."""
    every = np.concatenate(found)
    size = np.array([len(x) for x in found])
    begins = np.cumsum(size) - size
    out = np.empty((HASHES, len(found)), np.uint64)
    for i in range(HASHES):
        out[i] = np.minimum.reduceat(every * _MULTIPLY[i] + _ADD[i], begins)
    return mix(np.ascontiguousarray(out.T))


def two_bits(signs: np.ndarray) -> np.ndarray:
    """The lowest two bits of each place, 32 places in a word."""
    parts = (signs & np.uint64(3)).reshape(-1, _WORDS, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))
    return np.bitwise_or.reduce(parts, axis=2)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places the two bits differ."""
    x = a ^ b
    return np.bitwise_count((x | (x >> np.uint64(1))) & _LOW).sum(axis=-1, dtype=np.int64)


def keys(signs: np.ndarray) -> np.ndarray:
    """For each place the key of its chunk without it."""
    h = mix(signs ^ _PLACE)
    begins = np.flatnonzero(np.diff(_CHUNK_OF, prepend=-1))
    return mix(np.add.reduceat(h, begins, axis=1)[:, _CHUNK_OF] - h + _KEY)


def _meet(group: pa.Table) -> pa.Table:
    """A spanning forest of the entries of each key of a bucket that are within the radius."""
    rows, at, end = met(group, 2 + _WORDS)
    name, bits = rows[:, 1], rows[:, 2:].view(np.uint64)
    two = at[end - at == 2]
    two = two[distance(bits[two], bits[two + 1]) <= RADIUS]
    found = [np.stack([name[two], name[two + 1]], axis=1)]
    for s, e in zip(at[end - at > 2].tolist(), end[end - at > 2].tolist()):
        own = bits[s:e]
        of = clusters(e - s, lambda i, others: distance(own[others], own[i]) <= RADIUS)  # noqa: B023
        links = np.flatnonzero(of != np.arange(e - s))
        found.append(np.stack([name[s + of[links]], name[s + links]], axis=1))
    return pairs(found)


def candidates(texts: DataFrame, leaders, n: int, shingle: int = SHINGLE) -> DataFrame:
    """(a, b): short names that join all sets of the ``n`` texts (t, th) whose signatures are within the radius."""
    step = max(1, n // SAMPLE)

    def sampled(batches):
        for _, found in new_sets(batches, leaders.value, shingle):
            yield pa.RecordBatch.from_arrays([pa.array(keys(signatures(found)).ravel().view(np.int64))], names=["key"])

    often = texts.sparkSession.sparkContext.broadcast(key_counts(arrow_map(texts.where(F.pmod("th", F.lit(step)) == 0), sampled, "key long"), step, KEY_BLOCK))
    buckets = max(1, n * HASHES // BUCKET)

    def entries(batches):
        for names, found in new_sets(batches, leaders.value, shingle):
            signs = signatures(found)
            rows = np.empty((len(names) * HASHES, 2 + _WORDS), np.int64)
            rows[:, 0], rows[:, 1] = keys(signs).ravel().view(np.int64), np.repeat(names, HASHES)
            rows[:, 2:] = np.repeat(two_bits(signs).view(np.int64), HASHES, axis=0)
            yield packed(rows, often.value, buckets)

    return arrow_map(texts.select("t"), entries, "bucket int, rows binary").groupBy("bucket").applyInArrow(_meet, "a long, b long").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """key, n_shingles (its set's size), component_id (the smallest key that links of ``similarity`` or more reach, itself
    included) and kept (whether they are the same). The radius holds for similarities from 0.8."""
    texts = df.select(F.col(key).alias("k"), whole_text(text).alias("t")).withColumn("th", F.xxhash64("t"))
    leaders = find_leaders(texts, shingle, similarity)
    shared = df.sparkSession.sparkContext.broadcast(leaders)
    rows = durable(named_rows(texts, ["k", "th"], shared, shingle))
    roots = components(candidates(texts, shared, rows.count(), shingle))
    places = durable(roots.union(roots.select("root", "root")).distinct().select(F.col("node").alias("short"), F.col("root").cast("string").alias("grp")))
    links = components(exact_links(texts, rows, places, leaders, shingle, similarity))
    # rows without shingles stand alone: their name is their own key, hence no group of them
    least = rows.where("size > 0").groupBy("name").agg(F.min("k").alias("first"))
    placed = least.join(links, least.name == links.node, "left").select("name", "first", F.coalesce("root", "name").alias("root"))
    roots, found, on = salted(placed, placed.groupBy("root").agg(F.min("first").alias("component_id")), "root", [])
    by_name = roots.join(found, on).select("name", "component_id")
    full, found, on = salted(rows.where("size > 0").select("k", "size", "name"), by_name, "name", frequent_keys(rows.where("size > 0").select("name"), "name"))
    out = full.join(found, on).select("k", "size", "component_id").union(rows.where("size = 0").select("k", "size", F.col("k").alias("component_id")))
    return out.select(F.col("k").alias(key), F.col("size").alias("n_shingles"), "component_id", F.col("k").eqNullSafe(F.col("component_id")).alias("kept"))
