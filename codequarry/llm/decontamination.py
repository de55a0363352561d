"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks.

Words are lower-cased (A-Z) runs without white space and ASCII punctuation; shingles have five. A
window of a document has as many words as the benchmark item, wherever it starts. Similarity is
exact: the sum of the lesser over the sum of the greater weights of both sides' shingles, where a
shingle weighs its count times its rarity among all items, counted once over the whole benchmark.

- A window can only be similar to an item if the shingles they share weigh 0.8 of the item; sums
  over the document find these windows, wherever the shingles stand in them, and all others are told
  apart for certain.
- Every such window gets a fingerprint, by sliding sums of its shingles' weighted bits.
- Four blocks of 16 bits index the items' fingerprints: within the radius of 15 some block differs
  by three bits or fewer, so looking up the 697 values at that distance finds every item in reach.
- Exact similarity verifies the pairs. At similarity 0.8 fingerprints lie about 9.6 bits apart with
  a deviation of 2.9, so a few of the windows just there are lost (tests/llm measures the recall).

The benchmark goes to the workers in blocks of a bounded number of shingles, each in one pass over
the documents; 12 bytes of each distinct shingle of the whole benchmark go along.

Null and empty texts match nothing; an item without words is left out; an item of fewer than five
words has one shingle of all its words; a document shorter than an item is one window. Of windows
equally similar the first counts; repeated rows give repeated results; other columns are left alone.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_WORD, Words, arrow_map, chunks, mix, whole_text

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 15
#: Shingles of the items that go to the workers together, and windows that are fingerprinted together.
BLOCK_SHINGLES, _STRETCH = 2_000_000, 4096
_FILTER = 1 << 20
#: Rarities are whole numbers of this part, so that sums don't depend on their order.
_PART = 1024
_BLOCKS, _BITS = 4, 16
#: All ways to change up to RADIUS // _BLOCKS bits of a block.
_NEAR = np.array([sum(1 << i for i in c) for n in range(RADIUS // _BLOCKS + 1) for c in combinations(range(_BITS), n)], dtype=np.uint16)


def _signs(grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row for each shingle: its weight with the sign of each of 64 bits."""
    bits = np.unpackbits(mix(grams).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.where(bits, weights[:, None], -weights[:, None])


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


class Rarity:
    """How much each shingle of the whole benchmark weighs, and any other."""

    def __init__(self, known: np.ndarray, held: np.ndarray, items: int):
        """``known``: sorted shingles; ``held``: how many items hold each."""
        self.known = known
        self.weight = np.round(_PART * (1.0 + np.log((items + 1) / (np.append(held, 0) + 1)))).astype(np.int64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(grams), self.weight[-1])
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        return self.weight[np.where(self.known[at] == grams, at, len(self.known))]


class HammingIndex:
    """Finds all fingerprints within the radius by tables of block values."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        values = prints.astype("<u8").view("<u2").reshape(-1, _BLOCKS)
        self.order = [np.argsort(values[:, b], kind="stable").astype(np.int32) for b in range(_BLOCKS)]
        self.start = [np.searchsorted(values[self.order[b], b], np.arange((1 << _BITS) + 1)).astype(np.int32) for b in range(_BLOCKS)]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) of every pair within the radius, sorted."""
        values = prints.astype("<u8").view("<u2").reshape(-1, _BLOCKS)
        found = [np.zeros(0, np.int64)]
        for b in range(_BLOCKS):
            wanted = values[:, b, None] ^ _NEAR
            begin = self.start[b][wanted]
            n = self.start[b][wanted.astype(np.int32) + 1] - begin
            query, _ = np.nonzero(n)
            begin, n = begin[n > 0], n[n > 0]
            query = np.repeat(query, n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
            entry = self.order[b][place].astype(np.int64)
            ok = np.bitwise_count(self.prints[entry] ^ prints[query]) <= RADIUS
            found.append(query[ok] * len(self.prints) + entry[ok])
        both = np.unique(np.concatenate(found))
        return both // max(1, len(self.prints)), both % max(1, len(self.prints))


class ItemIndex:
    """Shingles, fingerprints and Hamming blocks of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], rarity: Rarity | None = None):
        """``rarity``: of the whole benchmark; of these items alone without it."""
        lists, sizes = _shingles([t for _, t in items])
        if rarity is None:
            known, held = np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, lists)]), return_counts=True)
            rarity = Rarity(known, held, len(items))
        self.rarity = rarity
        kept = np.flatnonzero(sizes > 0).tolist()
        self.ids = [items[i][0] for i in kept]
        self.sizes = sizes[kept]
        self.shingles = [np.unique(lists[i], return_counts=True) for i in kept]
        self.weight = np.array([int(rarity(lists[i]).sum()) for i in kept], dtype=np.int64)
        self.index = HammingIndex(np.array([_packed(_signs(lists[i], rarity(lists[i])).sum(axis=0, keepdims=True))[0] for i in kept], dtype=np.uint64))
        #: What an item must share with a window.
        self.need = np.ceil(SIMILARITY * self.weight - 1e-6).astype(np.int64)
        #: By number of words of a shingle: its sorted hashes, a bitmap of their low bits, the items that hold each, and the least need.
        self.steps: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]] = {}
        step_of = np.minimum(SHINGLE, self.sizes)
        for step in np.unique(step_of).tolist():
            mine = np.flatnonzero(step_of == step)
            grams = np.concatenate([self.shingles[i][0] for i in mine.tolist()])
            holder = np.repeat(mine, [len(self.shingles[i][0]) for i in mine.tolist()]).astype(np.int32)
            order = np.argsort(grams, kind="stable")
            every, first = np.unique(grams[order], return_index=True)
            seen = np.zeros(_FILTER, dtype=bool)
            seen[every & np.uint64(_FILTER - 1)] = True
            self.steps[step] = (every, seen, holder[order], np.append(first, len(order)), int(self.need[mine].min()))

    def similarity(self, item: int, grams: np.ndarray, counts: np.ndarray) -> float:
        """Of an item and a window with these distinct shingles, sorted, and their counts."""
        own, n = self.shingles[item]
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        same = grams[at] == own
        weights = self.rarity(own)
        low = int((weights * np.where(same, np.minimum(n, counts[at]), 0)).sum())
        high = int(self.weight[item]) + int((self.rarity(grams) * counts).sum()) - low
        return low / high

    def _windows(self, grams: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of windows of n shingles from each of the sorted ``starts``."""
        out = []
        i = 0
        while i < len(starts):
            a = int(starts[i])
            j = int(np.searchsorted(starts, a + _STRETCH))
            part = grams[a : int(starts[j - 1]) + n]
            sums = np.zeros((len(part) + 1, 64), dtype=np.int64)
            np.cumsum(_signs(part, self.rarity(part)), axis=0, out=sums[1:])
            at = starts[i:j] - a
            out.append(_packed(sums[at + n] - sums[at]))
            i = j
        return np.concatenate(out)

    def _best(self, grams: np.ndarray, places: np.ndarray, items: np.ndarray, step: int, count: int, best: dict[int, tuple[float, int]]) -> None:
        """Adds to ``best`` what matches in one text of ``count`` words, of which the shingle at each of ``places`` stands in the item beside it."""
        weights = self.rarity(grams[places])
        enough = np.bincount(items, weights=weights, minlength=len(self.need)) >= self.need
        live: dict[int, list[np.ndarray]] = {}
        for item in np.unique(items[enough[items]]).tolist():
            sums = np.zeros(count - step + 2, dtype=np.int64)
            mine = items == item
            sums[places[mine] + 1] = weights[mine]
            sums = np.cumsum(sums)
            n = min(int(self.sizes[item]), count) - step + 1
            live.setdefault(int(self.sizes[item]), []).append(np.flatnonzero(sums[n:] - sums[:-n] >= self.need[item]))
        for size, found in live.items():
            starts = np.unique(np.concatenate(found))
            if not len(starts):
                continue
            n = min(size, count) - step + 1
            query, entry = self.index.near(self._windows(grams, starts, n))
            mine = self.sizes[entry] == size
            last = -1
            for q, item in zip(query[mine].tolist(), entry[mine].tolist()):
                if q != last:
                    start, last = int(starts[q]), q
                    window = np.unique(grams[start : start + n], return_counts=True)
                s = self.similarity(item, *window)
                if s >= SIMILARITY and (item not in best or s > best[item][0]):
                    best[item] = s, start

    def matches(self, texts: list[bytes]) -> list[list[tuple[int, int, float]]]:
        """Per text: (item, start word, similarity) of the best window of each item that is similar and in reach."""
        w = Words([t.lower() for t in texts], NON_WORD)
        best: list[dict[int, tuple[float, int]]] = [{} for _ in texts]
        for step, (every, seen, holder, first, least) in self.steps.items():
            inside = w.inside(step)
            if not len(inside):
                continue
            grams = w.grams(step)
            maybe = inside[seen[grams[inside] & np.uint64(_FILTER - 1)]]
            place = np.minimum(np.searchsorted(every, grams[maybe]), len(every) - 1)
            known = every[place] == grams[maybe]
            hits, place = maybe[known], place[known]
            total = np.bincount(w.owner[hits], weights=self.rarity(grams[hits]), minlength=len(texts))
            for t in np.flatnonzero(total >= least).tolist():
                a, count = int(w.first[t]), int(w.counts[t])
                i, j = np.searchsorted(hits, (a, a + count))
                held = first[place[i:j] + 1] - first[place[i:j]]
                at = np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held) + np.repeat(first[place[i:j]], held)
                self._best(grams[a : a + count - step + 1], np.repeat(hits[i:j] - a, held), holder[at], step, count, best[t])
        return [[(i, start, s) for i, (s, start) in sorted(found.items())] for found in best]


def _shingles(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """The shingles of each item in order, and its number of words."""
    words = Words([(t or "").encode().lower() for t in texts], NON_WORD)
    ends = zip(words.first.tolist(), words.counts.tolist())
    return [_grams(words.hash[i : i + n], min(SHINGLE, n)) if n else np.zeros(0, np.uint64) for i, n in ends], words.counts


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """As Words.grams, over the words of one text."""
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[k : len(hashes) - n + 1 + k]
    return mix(out)


def _blocks(benchmark: DataFrame, item: str, text: str):
    """The items in blocks of a bounded number of characters, one block in memory at a time; a longer item stands alone."""
    block, size = [], 0
    for r in benchmark.select(item, text).toLocalIterator():
        n = len(r[1] or "")
        if block and size + n > 6 * BLOCK_SHINGLES:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    if block:
        yield block


def _rarity(benchmark: DataFrame, text: str) -> Rarity:
    """Over the whole benchmark, counted with partial sums."""

    def run(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            sets = [np.unique(x) for i, j in chunks([(t or "").encode() for t in texts]) for x in _shingles(texts[i:j])[0]]
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["g"])

    held = arrow_map(benchmark.select(text), run, "g long").groupBy("g").agg(F.count("*").cast("int").alias("n")).toArrow()
    known, n = held.column("g").to_numpy().view(np.uint64), held.column("n").to_numpy()
    order = np.argsort(known)
    return Rarity(known[order], n[order], benchmark.count())


def _indexes(benchmark: DataFrame, item: str, text: str):
    """A broadcast index of each block of items."""
    rarity = _rarity(benchmark, text)
    for block in _blocks(benchmark, item, text):
        yield benchmark.sparkSession.sparkContext.broadcast(ItemIndex(block, rarity))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, start_word, similarity) of every document that holds an item's passage."""
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, key), (benchmark, item)))
    rows = docs.select(F.col(key).alias("k"), whole_text(text).alias("t"))
    schema = f"k {kind}, i {item_kind}, start_word long, similarity double"
    out = None
    for index in _indexes(benchmark, item, item_text):

        def run(batches, index=index):
            own = index.value
            for b in batches:
                texts = [t.encode() for t in b.column(1).to_pylist()]
                at, found = [], []
                for i, j in chunks(texts):
                    for n, row in enumerate(own.matches(texts[i:j])):
                        at += [i + n] * len(row)
                        found += row
                ids = pa.array([own.ids[m[0]] for m in found], pa.from_numpy_dtype(np.int64) if item_kind == "bigint" else None)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), ids, pa.array([m[1] for m in found], pa.int64()), pa.array([m[2] for m in found], pa.float64())], names=["k", "i", "start_word", "similarity"])

        part = arrow_map(rows, run, schema)
        out = part if out is None else out.union(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"k": key, "i": item})


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents, all columns, that hold no item's passage."""
    where = docs.columns.index(text)
    out = docs
    for index in _indexes(benchmark, item, item_text):

        def run(batches, index=index):
            own = index.value
            for b in batches:
                texts = [(t or "").encode() for t in b.column(where).to_pylist()]
                clean = [not row for i, j in chunks(texts) for row in own.matches(texts[i:j])]
                yield b.filter(pa.array(clean, pa.bool_()))

        out = arrow_map(out, run, docs.schema)
    return out
