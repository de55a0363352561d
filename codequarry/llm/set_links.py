"""Exact links of sets of word shingles that others have found to be possible.

Sets go by 128-bit names. Two things keep large groups of near copies out of single tasks:

- Leaders are sets of a sample that many others of it resemble. Every set is compared with all leaders
  where its text is read, without a shuffle. One that is similar to a leader is linked at once and takes
  no part in any other search: 1 - similarity is a metric (Jaccard's distance), so whatever links to it
  lies within twice the distance of a link from its leader. Sets that do (and aren't linked themselves)
  meet just those of the leader's own that are far enough from it; as a rule there are few or none.
- Groups in which all pairs are to be compared are cut into blocks by sets and shingles, and each pair of
  blocks is a task of its own, which returns the links of a spanning forest.

Sets come from their texts again, and texts that aren't wanted are told off by a bit table of fixed size
before the shuffle, so that no more than the wanted texts move; beyond that size more move, none is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, arrow_map, chunks, durable, frequent_keys, mix, salted
from .decontamination import _grams

#: Sets and shingles of one block.
BLOCK, BLOCK_SHINGLES = 512, 1 << 21
#: Texts of the sample; how many of them a leader has to resemble; leaders at most and the largest of them, which bounds what is broadcast.
SAMPLE, RESEMBLED, LEADERS, LEADER_SHINGLES = 4096, 16, 64, 1 << 17
#: Bits of the table of wanted texts: 2^24, in words of 64.
_BITS, _SLACK = 1 << 24, 1e-9


def sets(texts: list[str], shingle: int):
    """The sorted distinct shingles of each text, lower-cased (A-Z); fewer words are one shingle together."""
    data = [t.encode().lower() for t in texts]
    for i, j in chunks(data):
        w = Words(data[i:j])
        grams = w.grams(shingle)
        for first, n in zip(w.first.tolist(), w.counts.tolist()):
            if n < shingle:
                yield _grams(w.hash[first : first + n], n) if n else np.zeros(0, np.uint64)
            else:
                yield np.unique(grams[first : first + n - shingle + 1])


def set_name(x: np.ndarray) -> bytes:
    """128 bits that name a set; nothing for the empty one."""
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else b""


def short_name(name: bytes) -> int:
    """The first 64 bits, for searches that may take two sets for one without losing either."""
    return int.from_bytes(name[:8], "little", signed=True) if name else 0


def packed(rows: np.ndarray, often: dict[int, int], buckets: int) -> pa.RecordBatch:
    """Entries, longs whose first two are a key and a short name, packed by the bucket they go to. The entries of a
    key in ``often`` are dealt over so many blocks, and each goes to all pairs of blocks that its own is in."""
    key = rows[:, 0].view(np.uint64)
    to = mix(key) % np.uint64(buckets)
    frequent = np.isin(rows[:, 0], np.fromiter(often, np.int64, len(often))) if often else np.zeros(len(rows), dtype=bool)
    if frequent.any():
        extra, target = [rows[~frequent]], [to[~frequent]]
        own = mix(rows[frequent, 1].view(np.uint64))
        for row, k, block in zip(rows[frequent], key[frequent], own):
            n = often[int(row[0])]
            b = int(block % np.uint64(n))
            pairs = np.array([min(b, i) * n + max(b, i) + 1 for i in range(n)], dtype=np.uint64)
            extra.append(np.repeat(row[None, :], n, axis=0))
            target.append(mix(mix(np.full(n, k)) ^ pairs) % np.uint64(buckets))
        rows, to = np.concatenate(extra), np.concatenate(target)
    order = np.argsort(to, kind="stable")
    rows, to = rows[order], to[order].astype(np.int32)
    at = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
    end = np.append(at[1:], len(to)) if len(to) else at
    return pa.RecordBatch.from_arrays([pa.array(to[at]), pa.array([rows[s:e].tobytes() for s, e in zip(at, end)], pa.binary())], names=["bucket", "rows"])


def met(group: pa.Table, width: int):
    """The entries of a bucket by key and name, each once, and where the keys that several have begin and end."""
    rows = np.frombuffer(b"".join(group.column("rows").to_pylist()), np.int64).reshape(-1, width)
    order = np.argsort(rows[:, 0], kind="stable")
    same = np.diff(rows[order, 0]) == 0
    rows = rows[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(rows) else rows
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    if len(rows):
        rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])]
    at = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])) if len(rows) else np.zeros(0, np.int64)
    end = np.append(at[1:], len(rows)) if len(rows) else at
    several = end - at > 1
    return rows, at[several], end[several]


def pairs(found: list[np.ndarray]) -> pa.Table:
    """The components of links of one task: each member (b) with the least one (a)."""
    both = np.concatenate([np.zeros((0, 2), np.int64), *found])
    nodes, at = np.unique(both, return_inverse=True)
    at, least = at.reshape(-1, 2), np.arange(len(nodes))
    while True:
        low = np.minimum(least[at[:, 0]], least[at[:, 1]])
        now = least.copy()
        for side in (0, 1):
            np.minimum.at(now, least[at[:, side]], low)
            np.minimum.at(now, at[:, side], low)
        now = now[now]
        if (now == least).all():
            break
        least = now
    others = np.flatnonzero(least != np.arange(len(nodes)))
    return pa.table({"a": pa.array(nodes[least[others]]), "b": pa.array(nodes[others])})


def key_counts(keys: DataFrame, step: int, block: int) -> dict[int, int]:
    """How many blocks each key needs that a sample (one text in ``step``) finds too often for one."""
    counts = keys.groupBy("key").count().where((F.col("count") * step > block) & (F.col("count") >= 8))
    return {r.key: -(-r["count"] * step // block) for r in counts.collect()}


def new_sets(batches, leaders: "Leaders", shingle: int):
    """Short names and sets, in chunks, of the non-empty sets that are new to the task and follow no leader."""
    seen: set[int] = set()
    for b in batches:
        texts = b.column("t").to_pylist()
        for i, j in chunks([x.encode() for x in texts]):
            names, found = [], []
            for x in sets(texts[i:j], shingle):
                short = short_name(set_name(x))
                if len(x) and short not in seen:
                    seen.add(short)
                    if not leaders.compare(x)[0]:
                        names.append(short)
                        found.append(x)
            if found:
                yield np.array(names, dtype=np.int64), found


def similar(shared, a, b, similarity: float):
    return shared >= similarity * (a + b - shared) - _SLACK


def clusters(n: int, near) -> np.ndarray:
    """Which cluster each of n belongs to; ``near(i, others)`` tells those of others that i links to."""
    of, left = np.full(n, -1), np.arange(n)
    while len(left):
        root, left = left[0], left[1:]
        of[root], todo = root, [root]
        while todo and len(left):
            hit = near(todo.pop(), left)
            of[left[hit]] = root
            todo += left[hit].tolist()
            left = left[~hit]
    return of


class Leaders:
    """Compares sets with all leaders at once, by a table from shingles to the leaders that have them."""

    def __init__(self, members: list[np.ndarray], similarity: float):
        self.names, self.similarity = [set_name(x) for x in members], similarity
        self.sizes = np.array([len(x) for x in members], dtype=np.int64)
        every = np.concatenate(members) if members else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(members)), self.sizes)
        order = np.lexsort((owner, every))
        self.shingles, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.owner = owner[order]

    def compare(self, x: np.ndarray) -> tuple[list[int], list[int], list[float]]:
        """The leaders similar to x, the best first; those within twice the distance, and their similarity."""
        if not len(x) or not len(self.names):
            return [], [], []
        at = np.minimum(np.searchsorted(self.shingles, x), len(self.shingles) - 1)
        at = at[self.shingles[at] == x]
        n = self.count[at]
        which = np.repeat(self.first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(self.owner[which], minlength=len(self.names))
        j = shared / (len(x) + self.sizes - shared)
        link = similar(shared, len(x), self.sizes, self.similarity)
        near = np.flatnonzero(~link & (j >= 2 * self.similarity - 1 - _SLACK) & (j > 0))
        links = np.flatnonzero(link)
        return links[np.argsort(-j[links], kind="stable")].tolist(), near.tolist(), j[near].tolist()

    def best(self, x: np.ndarray, links: list[int]) -> float:
        """The similarity of x to the first of its leaders."""
        shared = np.isin(x, self.shingles_of(links[0]), assume_unique=True).sum()
        return float(shared / (len(x) + self.sizes[links[0]] - shared))

    def shingles_of(self, i: int) -> np.ndarray:
        return self.shingles[np.searchsorted(self.first, np.flatnonzero(self.owner == i), side="right") - 1]


def _sampled(texts: DataFrame, shingle: int, run, schema: str, n: int) -> DataFrame:
    some = texts.where(F.pmod("th", F.lit(max(1, n // SAMPLE))) == 0)
    return arrow_map(some.groupBy("th").agg(F.first("t").alias("t")).select("t"), run, schema)


def find_leaders(texts: DataFrame, shingle: int, similarity: float) -> Leaders:
    """The leaders of ``texts`` (t, th): of the sample's texts, whose number doesn't grow with the table, the one that
    most others resemble, then the one that most of the rest do, and so on. Bottom sketches of 64 hashes tell that."""
    n = texts.count()

    def sketches(batches):
        for b in batches:
            found = [(set_name(x), len(x), x[:64].tobytes()) for x in sets(b.column("t").to_pylist(), shingle) if 0 < len(x) <= LEADER_SHINGLES]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*found) if found else ([], [], []), (pa.binary(), pa.int64(), pa.binary()))], names=["name", "size", "least"])

    table = _sampled(texts, shingle, sketches, "name binary, size long, least binary", n).distinct().toArrow().sort_by("name")
    names, sizes = table.column("name").to_pylist(), table.column("size").to_numpy()
    least = [np.frombuffer(x, np.uint64) for x in table.column("least").to_pylist()]
    owner = np.repeat(np.arange(len(least)), [len(x) for x in least])
    _, word = np.unique(np.concatenate([*least, np.zeros(0, np.uint64)]), return_inverse=True)
    often = np.bincount(word, minlength=1)[word] >= RESEMBLED
    left = np.unique(owner[often])
    held = np.bincount(owner, minlength=len(names))
    chosen: list[bytes] = []
    begins = np.searchsorted(owner, np.arange(len(names) + 1))
    flags = np.zeros(int(word.max(initial=0)) + 1, dtype=bool)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        flags[own := word[begins[i] : begins[i + 1]]] = True
        shared = np.add.reduceat(flags[word], begins[:-1], dtype=np.int64)[others]
        flags[own] = False
        size = np.minimum(sizes[others], sizes[i]) >= similarity * np.maximum(sizes[others], sizes[i])
        return size & (shared >= 0.5 * np.minimum(held[others], held[i]))

    while len(left) >= RESEMBLED and len(chosen) < LEADERS:
        counts = [near(i, left).sum() for i in left[:: max(1, len(left) // 256)].tolist()]
        if max(counts) < RESEMBLED:
            break
        leader = left[:: max(1, len(left) // 256)][int(np.argmax(counts))]
        chosen.append(names[leader])
        left = left[~near(leader, left) & (left != leader)]
    wanted = frozenset(chosen)
    if not wanted:
        return Leaders([], similarity)

    def members(batches):
        for b in batches:
            found = [x.tobytes() for x in sets(b.column("t").to_pylist(), shingle) if len(x) <= LEADER_SHINGLES and set_name(x) in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["x"])

    found = _sampled(texts, shingle, members, "x binary", n).distinct().toArrow().sort_by("x")
    return Leaders([np.frombuffer(x, np.uint64) for x in found.column("x").to_pylist()], similarity)


def named_rows(texts: DataFrame, columns: list[str], leaders, shingle: int) -> DataFrame:
    """The rows' columns with their set's name, short name, number of shingles, and what leaders say of it: the one it
    follows (null: none) and its similarity, all similar ones, and the near ones with theirs."""
    kinds = {f.name: f for f in texts.schema.fields}
    schema = ", ".join(f"{c} {kinds[c].dataType.simpleString()}" for c in columns) + ", name binary, short long, size long, leader int, j double, links array<int>, near array<int>, near_j array<double>"

    def run(batches):
        known = leaders.value
        for b in batches:
            found = []
            for x in sets(b.column("t").to_pylist(), shingle):
                name = set_name(x)
                links, near, near_j = known.compare(x)
                found.append((name, short_name(name), len(x), links[0] if links else None, known.best(x, links) if links else None, links, near, near_j))
            types = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()))
            more = [pa.array(list(c), t) for c, t in zip(zip(*found) if found else [[]] * len(types), types)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *more], names=[*columns, "name", "short", "size", "leader", "j", "links", "near", "near_j"])

    return arrow_map(texts.select(*columns, "t"), run, schema)


def _wanted_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts whose hash ``th`` is wanted, and perhaps a few others."""
    bit = F.pmod("th", F.lit(_BITS))
    bits = wanted.select(bit.alias("bit")).groupBy((F.shiftright("bit", 6)).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits"))
    word = texts.withColumn("word", F.shiftright(bit, 6))
    return word.join(F.broadcast(bits), "word").where(F.expr(f"(bits & shiftleft(1L, int(pmod(th, {_BITS}) & 63))) <> 0")).select("t")


def _tile(similarity: float):
    """Links of a spanning forest of each cluster of similar sets in a pair of blocks."""

    def run(group: pa.Table) -> pa.Table:
        names, where = np.unique(np.array(group.column("name").to_pylist(), dtype=object), return_index=True)
        packed = group.column("shingles")
        lists = [np.frombuffer(packed[i].as_buffer(), np.uint64) for i in where.tolist()]
        size = np.array([len(x) for x in lists], dtype=np.int64)
        begins = np.cumsum(size) - size
        vocabulary, word = np.unique(np.concatenate(lists), return_inverse=True)
        flags = np.zeros(len(vocabulary), dtype=bool)

        def near(i, others):
            flags[own := word[begins[i] : begins[i] + size[i]]] = True
            shared = np.add.reduceat(flags[word], begins, dtype=np.int64)[others]
            flags[own] = False
            return similar(shared, size[others], size[i], similarity)

        of = clusters(len(names), near)
        links = np.flatnonzero(of != np.arange(len(names)))
        return pa.table({"a": pa.array(names[of[links]].tolist(), pa.binary()), "b": pa.array(names[links].tolist(), pa.binary())})

    return run


def _tiles(members: DataFrame, block: int) -> DataFrame:
    """Members (grp, side, name, th, size) with the pairs of blocks they go to. Members of side 0 meet all others
    of their group, those of side 1 meet side 2."""
    need = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / BLOCK_SHINGLES))
    blocks = members.groupBy("grp", "side").agg(need.cast("int").alias("n"))
    sides = blocks.groupBy("grp").agg(*(F.coalesce(F.max(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(f"n{s}") for s in (0, 1, 2)))
    rows, found, on = salted(members, sides, "grp", frequent_keys(members, "grp"))
    own = rows.join(found, on)
    b = lambda n: F.pmod(F.xxhash64("name"), F.greatest(F.lit(1), F.col(n))).cast("int")
    every = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.greatest(F.lit(1), F.col(n)) - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda x, y: F.struct(x.cast("int").alias("i"), y.cast("int").alias("k"))
    tiles = (
        F.when(F.col("side") == 0, F.transform(every("n0"), lambda i: pair(F.least(b("n0"), i), F.greatest(b("n0"), i))))
        .when(F.col("side") == 1, F.transform(every("n2"), lambda i: pair(b("n1"), i)))
        .otherwise(F.transform(every("n1"), lambda i: pair(i, b("n2"))))
    )
    return own.select("grp", "name", "th", F.explode(tiles).alias("tile")).select("grp", "tile.i", "tile.k", "name", "th")


def exact_links(texts: DataFrame, rows: DataFrame, places: DataFrame, leaders: Leaders, shingle: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """(a, b): names of similar sets, which join all those that belong together.

    ``rows`` are named_rows with ``th``; ``places`` has (short, grp) of sets that may be similar to others of
    their group. Followers of leaders meet what is near their leader whether they have a place or not.
    """
    spark = rows.sparkSession
    one = durable(rows.where("size > 0").groupBy("name").agg(F.min("th").alias("th"), *(F.first(c).alias(c) for c in ("short", "size", "leader", "j", "links", "near", "near_j"))))
    inside = one.join(places, "short").select(F.concat(F.lit("c"), "grp").alias("grp"), F.lit(0).alias("side"), "name", "th", "size")
    near = one.select("name", "th", "size", F.explode(F.arrays_zip("near", "near_j")).alias("x")).select("name", "th", "size", F.col("x.near").alias("l"), F.col("x.near_j").alias("j"))
    stars = None
    if leaders.names:
        # the distance of a leader's nearest stranger tells which of its followers that one could link to
        nearest = {r.l: r.j for r in near.groupBy("l").agg(F.max("j").alias("j")).collect()}
        reach = F.coalesce(*(F.when(F.col("leader") == l, F.lit(j + 1 - similarity + _SLACK)) for l, j in nearest.items()), F.lit(0.0))
        followers = one.where(F.col("j") <= reach).select(F.concat(F.lit("l"), "leader").alias("grp"), F.lit(1).alias("side"), "name", "th", "size")
        strangers = near.select(F.concat(F.lit("l"), "l").alias("grp"), F.lit(2).alias("side"), "name", "th", "size")
        inside = inside.union(followers).union(strangers)
        known = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(leaders.names)], "l int, a binary")
        stars = one.select("name", F.explode("links").alias("l")).join(F.broadcast(known), "l").select("a", F.col("name").alias("b")).where("a <> b")
    tiles = durable(_tiles(inside, block))

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            found = []
            for x in sets(b.column("t").to_pylist(), shingle):
                name = set_name(x)
                if name and name not in seen:
                    seen.add(name)
                    found.append((name, x.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in (0, 1)], names=["name", "shingles"])

    contents = arrow_map(_wanted_texts(texts, tiles), run, "name binary, shingles binary")
    met = tiles.drop("th").join(contents, "name").groupBy("grp", "i", "k").applyInArrow(_tile(similarity), "a binary, b binary")
    return met if stars is None else met.union(stars)
