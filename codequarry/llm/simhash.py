"""SimHash near-duplicates by keys of halves, and by ball hashing where many share a key.

Of two fingerprints at three bits or fewer one half differs in one bit at most. Every distinct fingerprint
sends out both halves, and where a half has an even number of set bits its 32 neighbours at one bit: 34
entries on average. Those of a key are compared with one another. A key may have any number of senders,
since many fingerprints can share a half; all senders of a key with more than 4,096 are linked by ball hashing.

Ball hashing: every fingerprint sends out itself, its 64 neighbours at one bit and, where its number of
set bits is even, those at two bits of the same half. Two fingerprints at three bits differ in
parity, and two of any three bits lie in the same half, so that their variants meet; at one or two
bits the near variants meet. Variants travel packed, and a variant has at most 2,081 senders since
fingerprints are distinct, so that no bucket runs hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, durable, frequent_keys, mix, salted, whole_text
from .components import components
from .near_copies import first_only, mark

SEED, SHINGLE, RADIUS = 42, 3, 3
_PART = 1 << 16
_ONE = [1 << i for i in range(64)]
_MASKS = np.array([0, *_ONE, *((1 << i) ^ (1 << j) for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32))], dtype=np.uint64)
#: Variants of an average fingerprint, fingerprints in one block, variants in one bucket.
_MEAN, _BLOCK, _BUCKET = 561, 2048, 1 << 20
#: The halves and their neighbours at one bit; entries of an average fingerprint; senders of a key that are compared
#: pair by pair, and up to how many that is done for all keys at once.
_HALVES = np.array([0, *_ONE[:32], 0, *_ONE[32:]], dtype=np.uint64)
_HALF_MEAN, _SHARED, _FEW = 34, 4096, 8


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of lower-cased words in shingles of three; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(words, words[1:], words[2:])))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(shingles), _PART):
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles[i : i + _PART]], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(shingles), bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and fp, the fingerprint as a signed long."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["k", "fp"])

    return arrow_map(df.select(F.col(key).alias("k"), whole_text(text).alias("t")), run, f"k {kind}, fp long").withColumnRenamed("k", key)


def _variants(fps: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for b in batches:
            every = b.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(every), _BLOCK):
                x = every[i : i + _BLOCK]
                even = x[np.bitwise_count(x) % 2 == 0]
                near = (x[:, None] ^ _MASKS[None, :65]).ravel()
                far = (even[:, None] ^ _MASKS[None, 65:]).ravel()
                v = np.concatenate([near, far])
                how = np.concatenate([np.tile(np.arange(65, dtype=np.uint16), len(x)), np.tile(np.arange(65, len(_MASKS), dtype=np.uint16), len(even))])
                to = (mix(v) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(to, kind="stable")
                v, how, to = v[order], how[order], to[order]
                at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                end = np.append(at[1:], len(to))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to[at]), pa.array([v[s:e].tobytes() for s, e in zip(at, end)], pa.binary()), pa.array([how[s:e].tobytes() for s, e in zip(at, end)], pa.binary())],
                    names=["bucket", "v", "how"],
                )

    return arrow_map(fps.select("fp"), run, "bucket int, v binary, how binary")


def _meet(group: pa.Table) -> pa.Table:
    """Links of one bucket: each variant's first near sender with all its other senders."""
    v = np.frombuffer(b"".join(group.column("v").to_pylist()), np.uint64)
    how = np.frombuffer(b"".join(group.column("how").to_pylist()), np.uint16)
    order = np.argsort(v, kind="stable")
    v, how = v[order], how[order]
    same = v[1:] == v[:-1]
    kept = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
    v, how = v[kept], how[kept]
    if not len(v):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    fp = v ^ _MASKS[how]
    new = np.concatenate([[True], v[1:] != v[:-1]])
    at, group_of = np.flatnonzero(new), np.cumsum(new) - 1
    near = how < 65
    first = np.minimum.reduceat(np.where(near, fp, np.uint64(0xFFFFFFFFFFFFFFFF)), at)[group_of]
    ok = np.logical_or.reduceat(near, at)[group_of] & (fp != first) & (np.bitwise_count(fp ^ first) <= RADIUS)
    pairs = np.unique(np.stack([first[ok], fp[ok]], axis=1), axis=0) if ok.any() else np.zeros((0, 2), np.uint64)
    return pa.table({"a": pa.array(pairs[:, 0].view(np.int64)), "b": pa.array(np.ascontiguousarray(pairs[:, 1]).view(np.int64))}) if len(pairs) else pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})


def _links(found: list[np.ndarray]) -> pa.Table:
    both = np.unique(np.concatenate([np.zeros((0, 2), np.uint64), *found]), axis=0)
    return pa.table({c: pa.array(np.ascontiguousarray(both[:, i]).view(np.int64)) for i, c in enumerate("ab")})


def _keys(fp: np.ndarray, how: np.ndarray) -> np.ndarray:
    """The half, with which one it is."""
    x = fp ^ _HALVES[how]
    return np.where(how < 33, x & np.uint64(0xFFFFFFFF), x >> np.uint64(32) | np.uint64(1 << 32))


def _half_entries(fps: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        for b in batches:
            every = b.column(0).to_numpy().view(np.uint64)
            low = np.bitwise_count(every & np.uint64(0xFFFFFFFF)) % 2 == 0
            high = np.bitwise_count(every >> np.uint64(32)) % 2 == 0
            parts = [(every, (0,)), (every[low], range(1, 33)), (every, (33,)), (every[high], range(34, 66))]
            fp = np.concatenate([np.repeat(x, len(h)) for x, h in parts])
            how = np.concatenate([np.tile(np.array(h, dtype=np.uint8), len(x)) for x, h in parts])
            to = (mix(_keys(fp, how)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            fp, how, to = fp[order], how[order], to[order]
            at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
            end = np.append(at[1:], len(to)) if len(to) else at
            yield pa.RecordBatch.from_arrays(
                [pa.array(to[at]), pa.array([fp[s:e].tobytes() for s, e in zip(at, end)], pa.binary()), pa.array([how[s:e].tobytes() for s, e in zip(at, end)], pa.binary())],
                names=["bucket", "fp", "how"],
            )

    return arrow_map(fps.select("fp"), run, "bucket int, fp binary, how binary")


def _compare(group: pa.Table) -> pa.Table:
    """Links that connect all that are linked and share a key of one bucket. Senders of keys with too many come as links with themselves."""
    fp = np.frombuffer(b"".join(group.column("fp").to_pylist()), np.uint64)
    key = _keys(fp, np.frombuffer(b"".join(group.column("how").to_pylist()), np.uint8))
    order = np.argsort(key, kind="stable")
    fp, key = fp[order], key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(at, len(key)))
    found = []
    few = np.repeat(size <= _FEW, size)
    x, k = fp[few], key[few]
    for apart in range(1, _FEW):
        hit = np.flatnonzero((k[apart:] == k[:-apart]) & (np.bitwise_count(x[apart:] ^ x[:-apart]) <= RADIUS))
        found.append(np.stack([x[hit], x[hit + apart]], axis=1))
    for s, n in zip(at[size > _FEW].tolist(), size[size > _FEW].tolist()):
        left = fp[s : s + n]
        if n > _SHARED:
            found.append(np.stack([left, left], axis=1))
            continue
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                one = todo.pop()
                hit = np.bitwise_count(left ^ one) <= RADIUS
                new = left[hit]
                found.append(np.stack([np.full(len(new), one), new], axis=1))
                todo += list(new)
                left = left[~hit]
    return _links(found)


def _ball_links(fps: DataFrame, n: int) -> DataFrame:
    buckets = max(1, -(-n * _MEAN // _BUCKET))
    fps = fps.select("fp").repartition(max(1, -(-n // (4 * _BLOCK))), "fp")
    return _variants(fps, buckets).groupBy("bucket").applyInArrow(_meet, "a long, b long").distinct()


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of fingerprints at three bits or fewer that connect all that are so linked.

    ``fps`` has distinct fingerprints in the column fp.
    """
    n = fps.count()
    buckets = max(1, -(-n * _HALF_MEAN // _BUCKET))
    dealt = fps.select("fp").repartition(max(1, -(-n // (32 * _BLOCK))), "fp")
    found = durable(_half_entries(dealt, buckets).groupBy("bucket").applyInArrow(_compare, "a long, b long").distinct())
    shared = found.where("a = b").select(F.col("a").alias("fp"))
    many = shared.count()
    found = found.where("a <> b")
    return found.union(_ball_links(shared, many)).distinct() if many else found


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hex digits) and component_id, the smallest key reachable over links.

    Null texts count as empty; texts without words share fingerprint zero. Null keys are members
    but never a component's id unless it has no other. Repeated rows give repeated rows.
    """
    rows = durable(with_fingerprints(df, key, text))
    fps = durable(rows.groupBy("fp").agg(F.min(key).alias("first_key")))
    roots = components(links(fps))
    placed = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first_key", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first_key").alias("component_id"))
    found = placed.join(least, "root").select(F.col("fp").alias("__fp"), "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    ids, found, on = salted(rows.select(F.col(key).alias("__id"), "fp"), found.withColumnRenamed("__fp", "fp"), "fp", frequent_keys(rows, "fp"))
    return ids.join(found, on).select(F.col("__id").alias(key), hexed.alias("fingerprint"), "component_id")


def without_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, all columns, that stay, exactly one of each component: that with the smallest key, a null one only without
    others; of rows with the same key and text any."""
    place = F.struct(F.col(key).alias("k"), mark(key, text).alias("mark"))
    rows = durable(with_fingerprints(df.select(place.alias("place"), F.col(text).alias("t")), "place", "t").select("place.k", "place.mark", "fp"))
    order = F.struct(F.col("k").isNull().alias("last"), "k", "mark", "n")
    fps = durable(rows.groupBy("fp", "k", "mark").agg(F.count("*").alias("n")).groupBy("fp").agg(F.min(order).alias("first")))
    roots = components(links(fps))
    placed = fps.join(roots, fps.fp == roots.node, "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    return first_only(df, durable(placed.select("first.k", "first.mark", "first.n")), key, text)
