"""Exact substring deduplication by super-k-mer partitioning.

A window is k consecutive words. Consecutive windows that share a minimiser (the least hash among
their runs of m words) travel as one packed string to the minimiser's bucket, where sorting counts
windows; windows of one fingerprint are compared byte by byte. Minimisers with more strings than a
bucket can hold are cut into strings of one window each, which go to buckets of their own by 128
bits of BLAKE2b and are counted by these bits.

What a task sees twice is combined before the shuffle: an exact copy of a text loses every word
without being sent; a string or window that occurs again in about 16 MB of text is sent once, marked
as repeated, so a passage that stands in a third of all texts sends its bucket no more than one
entry for each 16 MB. Texts share one content key with their copies, results are computed once a
content, and rows whose content is frequent are salted when they fetch their result.

Null texts have no words; texts shorter than a window lose nothing; repeated rows are copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Words, arrow_map, chunks, durable, frequent_keys, give_back, mix, salted, whole_text

WINDOW, GRAM = 35, 6
#: A minimiser is cut into single windows from this share of all packed strings and this number; a million are so at most.
HOT_SHARE, HOT_LEAST = 1e-6, 1000
#: Packed strings of a bucket, on average, and single windows of one.
BUCKET, WINDOWS = 30_000, 500_000
_FLUSH = 16 << 20
_SALT = np.uint64(0x8EBC6AF09C88C6E3)
_EVERYTHING = 0x7FFFFFFF


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    out, have = v, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


class _Runs:
    """The super-k-mers of a chunk of texts: text, first window's word in the text, windows, minimiser."""

    def __init__(self, texts: list[bytes], k: int, m: int):
        self.words = w = Words(texts, SPACES)
        self.k = k
        at = w.inside(k)
        if not len(at):
            self.begin = self.count = self.text = np.zeros(0, np.int64)
            self.minimiser = np.zeros(0, np.uint64)
            return
        grams = w.grams(m)
        # the leftmost of the least hashes, told by place below the upper bits of the hash
        place = np.uint64((1 << max(24, len(grams).bit_length())) - 1)
        keyed = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
        least = _sliding_min(keyed, k - m + 1)[at] & place
        minimiser = grams[least.astype(np.int64)]
        owner = w.owner[at]
        new = np.concatenate([[True], (minimiser[1:] != minimiser[:-1]) | (owner[1:] != owner[:-1])])
        first = np.flatnonzero(new)
        self.begin, self.count = at[first], np.diff(np.append(first, len(at)))
        self.text, self.minimiser = owner[first], minimiser[first]

    def packed(self, i: int) -> bytes:
        """The words of run i, as they stand with single spaces."""
        w, a = self.words, int(self.begin[i])
        b = a + int(self.count[i]) + self.k - 2
        return b" ".join(w.buf[w.start[a] : w.end[b]].split())


def _texts(batches):
    """Chunks of (key, text) rows that are new to the task, as (keys, texts, keys of copies)."""
    seen: set[bytes] = set()
    for b in batches:
        keys, texts, copies = [], [], []
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if key in seen:
                copies.append(key)
            else:
                seen.add(key)
                keys.append(key)
                texts.append((text or "").encode())
        for i, j in chunks(texts):
            yield keys[i:j], texts[i:j], []
        if copies:
            yield [], [], copies


def _hot_minimisers(df: DataFrame, k: int, m: int, share: float, least: int) -> tuple[dict[int, int], int]:
    """Minimisers of more than their share of all runs with their runs, and the number of runs.

    A task passes on the minimisers that it sees twice; no more than 1 / share come to the driver.
    """

    def merged(parts):
        values, n = (np.concatenate(x) for x in zip(*parts))
        values, at = np.unique(values, return_inverse=True)
        return values, np.bincount(at, weights=n, minlength=len(values)).astype(np.int64)

    def count(batches):
        parts, size, total = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0, 0
        for _, texts, _ in _texts(batches):
            if texts:
                found = _Runs(texts, k, m).minimiser
                parts.append((found, np.ones(len(found), np.int64)))
                size, total = size + len(found), total + len(found)
                if size > 1 << 20:
                    parts = [merged(parts)]
                    size = 0
        values, n = merged(parts)
        out = n > 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(values[out], np.uint64(0)).view(np.int64)), pa.array(np.append(n[out], 0)), pa.array(np.append(np.zeros(out.sum(), np.int64), total))], names=["minimiser", "n", "total"])

    found = durable(arrow_map(df.select("key", "text"), count, "minimiser long, n long, total long").groupBy("minimiser").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    total = found.agg(F.sum("total")).first()[0] or 0
    need = max(least, total * share)
    return {r[0]: r[1] for r in found.where(F.col("n") >= need).select("minimiser", "n").collect()}, total


def _is_hot(runs: _Runs, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(runs.minimiser), dtype=bool)
    at = np.minimum(np.searchsorted(hot, runs.minimiser), len(hot) - 1)
    return hot[at] == runs.minimiser


class _Pending:
    """What a task has for the buckets since the last flush: entries with the one place where each stands, or that it is repeated."""

    def __init__(self):
        self.buckets: dict[int, dict[bytes, tuple[bytes, int] | None]] = {}
        self.keys: list[bytes] = []
        self.spans: list[tuple[int, int]] = []

    def add(self, bucket: int, entry: bytes, key: bytes, begin: int, words: int) -> None:
        """``words`` are covered by the entry from ``begin`` on."""
        entries = self.buckets.setdefault(bucket, {})
        if entry not in entries:
            entries[entry] = key, begin
            return
        before = entries[entry]
        if before is not None:
            self.lose(before[0], before[1], before[1] + words)
            entries[entry] = None
        self.lose(key, begin, begin + words)

    def lose(self, key: bytes, start: int, stop: int) -> None:
        self.keys.append(key)
        self.spans.append((start, stop))

    def rows(self, squeeze, cold: int):
        """(bucket, kind, blob): kind 0 packed strings, 1 single windows, 2 spans that are known."""
        for bucket, entries in self.buckets.items():
            once = [p for p in entries.values() if p is not None]
            flags = bytes(p is None for p in entries.values())
            words = np.array([p[1] for p in once], "<u4").tobytes()
            head = np.array([len(flags), len(once)], "<u4").tobytes()
            window = bucket >= cold
            body = (b"" if window else b"\n").join(entries)
            yield bucket, int(window), squeeze.compress(b"".join([head, flags, words, *(p[0] for p in once), body]))
        if self.keys:
            spans = np.array(self.spans, "<u4").tobytes()
            yield int.from_bytes(self.keys[0][:6]) % cold, 2, squeeze.compress(spans + b"".join(self.keys))


def _bucketed(df: DataFrame, hot: np.ndarray, cold: int, windows: int, k: int, m: int) -> DataFrame:
    """(bucket, kind, blob): buckets from ``cold`` on are those of single windows."""
    shared = df.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        pending, size = _Pending(), 0
        squeeze = zstandard.ZstdCompressor(level=6)

        def flush():
            rows = list(pending.rows(squeeze, cold))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "kind", "blob"])

        for keys, texts, copies in _texts(batches):
            for key in copies:
                pending.lose(key, 0, _EVERYTHING)
            size += 64 * len(copies)
            if texts:
                runs = _Runs(texts, k, m)
                to = (mix(runs.minimiser ^ _SALT) % np.uint64(cold)).astype(np.int64).tolist()
                single = _is_hot(runs, shared.value).tolist()
                text, first = runs.text.tolist(), runs.words.first[runs.text].tolist()
                for r, (n, begin) in enumerate(zip(runs.count.tolist(), runs.begin.tolist())):
                    s, key = runs.packed(r), keys[text[r]]
                    if not single[r]:
                        pending.add(to[r], s, key, begin - first[r], n + k - 1)
                        continue
                    ends = np.cumsum(runs.words.end[begin : begin + n + k - 1] - runs.words.start[begin : begin + n + k - 1] + 1).tolist()
                    at = [0, *ends]
                    for i in range(n):
                        digest = hashlib.blake2b(s[at[i] : at[i + k] - 1], digest_size=16).digest()
                        pending.add(cold + int.from_bytes(digest[:6]) % windows, digest, key, begin - first[r] + i, k)
                size += sum(map(len, texts))
            if size >= _FLUSH:
                yield from flush()
                pending, size = _Pending(), 0
        yield from flush()

    return arrow_map(df.select("key", "text"), run, "bucket long, kind int, blob binary")


def _same(entries: np.ndarray, spans: list[tuple[int, int, int]], strings: list[bytes], times: np.ndarray) -> np.ndarray:
    """How often each of the entries of one fingerprint occurs, by their bytes."""
    who, off, size = spans[int(entries[0])]
    first = strings[who][off : off + size]
    every = [first] + [strings[w][o : o + n] for w, o, n in (spans[e] for e in entries[1:].tolist())]
    if every.count(first) == len(every):
        return np.full(len(every), times.sum())
    sums: dict[bytes, int] = {}
    for x, n in zip(every, times.tolist()):
        sums[x] = sums.get(x, 0) + n
    return np.array([sums[x] for x in every])


def _repeated_windows(strings: list[bytes], times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, word of the string) of the windows that occur again, in order."""
    prints, who, where, off, size = [], [], [], [], []
    for i, j in chunks(strings):
        w = Words(strings[i:j])
        at = w.inside(k)
        owner = w.owner[at]
        begin = w.first[owner]
        prints.append(w.grams(k)[at])
        who.append((owner + i).astype(np.int32))
        where.append((at - begin).astype(np.int32))
        off.append((w.start[at] - w.start[begin]).astype(np.int32))
        size.append((w.end[at + k - 1] - w.start[at]).astype(np.int32))
    prints, who, where, off, size = (np.concatenate(x) for x in (prints, who, where, off, size))
    n = times[who]
    order = np.argsort(prints, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], prints[order][1:] != prints[order][:-1]]))
    total = np.zeros(len(prints), np.int64)
    total[order] = np.repeat(np.add.reduceat(n[order], new), np.diff(np.append(new, len(order))))
    del prints
    several = np.diff(np.append(new, len(order)))
    for a, c in zip(new[several > 1].tolist(), several[several > 1].tolist()):
        entries = order[a : a + c]
        total[entries] = _same(np.arange(c), list(zip(who[entries].tolist(), off[entries].tolist(), size[entries].tolist())), strings, n[entries])
    again = np.flatnonzero(total > 1)
    return who[again], where[again]


def _counted(k: int):
    """Counts the windows of one bucket and gives back the words covered by those that occur again."""

    def count(group: pa.Table) -> pa.Table:
        strings: list[bytes] = []
        flags, words, keys, out = [], [], [], []
        spread = zstandard.ZstdDecompressor()
        window = False
        for kind, blob in zip(group.column("kind").to_pylist(), group.column("blob").to_pylist()):
            data = spread.decompress(blob)
            if kind == 2:
                n = len(data) // 24
                spans = np.frombuffer(data, "<u4", 2 * n).reshape(-1, 2)
                out.append((data[8 * n :], spans[:, 0], spans[:, 1]))
                continue
            window = kind == 1
            n, p = np.frombuffer(data, "<u4", 2).tolist()
            flag = np.frombuffer(data, np.uint8, n, 8)
            # the row of ``words`` and ``keys`` where an entry that isn't repeated already stands, else -1
            place = np.where(flag == 0, np.cumsum(flag == 0) - 1 + sum(map(len, words)), -1)
            flags.append(place)
            words.append(np.frombuffer(data, "<u4", p, 8 + n))
            keys.append(data[8 + n + 4 * p : 8 + n + 20 * p])
            body = data[8 + n + 20 * p :]
            strings += [body[i : i + 16] for i in range(0, len(body), 16)] if window else body.split(b"\n")
        if strings:
            place, begin, names = np.concatenate(flags), np.concatenate(words), b"".join(keys)
            if window:
                both = np.frombuffer(b"".join(strings), np.dtype([("a", "<u8"), ("b", "<u8")]))
                _, of = np.unique(both, return_inverse=True)
                total = np.bincount(of, weights=np.where(place < 0, 2, 1))[of]
                at = place[(total > 1) & (place >= 0)]
                start, stop = begin[at], begin[at] + k
            else:
                who, where = _repeated_windows(strings, np.where(place < 0, 2, 1), k)
                who, where = who[place[who] >= 0], where[place[who] >= 0]
                cut = np.concatenate([[True], (np.diff(where) != 1) | (np.diff(who) != 0)]) if len(who) else np.zeros(0, bool)
                first = np.flatnonzero(cut)
                last = np.append(first[1:], len(who))[: len(first)] - 1
                at = place[who[first]]
                start, stop = begin[at] + where[first], begin[at] + where[last] + k
            out.append((b"".join(names[16 * i : 16 * i + 16] for i in at.tolist()), start, stop))
        names = b"".join(o[0] for o in out)
        start, stop = (np.concatenate([o[i] for o in out]).astype(np.int32) for i in (1, 2))
        del strings, flags, words, keys, out
        give_back()
        return pa.table({"key": pa.array([names[i : i + 16] for i in range(0, len(names), 16)], pa.binary()), "start": pa.array(start), "stop": pa.array(stop)})

    return count


def repeated_spans(df: DataFrame, k: int = WINDOW, m: int = GRAM, share: float = HOT_SHARE, least: int = HOT_LEAST) -> DataFrame:
    """(key, start, stop): words of a text that lie in windows occurring again anywhere; stop may lie beyond the text.

    ``df`` has the content key of 16 bytes and the text of every document, copies included.
    """
    m = min(m, k)
    found, total = _hot_minimisers(df, k, m, share, least)
    hot = np.sort(np.array(list(found), dtype=np.int64).view(np.uint64))
    cold = max(1, -(-total // BUCKET))
    windows = max(1, -(-sum(found.values()) * (k - m + 2) // 2 // WINDOWS))
    return _bucketed(df, hot, cold, windows, k, m).groupBy("bucket").applyInArrow(_counted(k), "key binary, start int, stop int")


def substring_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = WINDOW, m: int = GRAM, share: float = HOT_SHARE, least: int = HOT_LEAST, with_text: bool = False) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 and, if wanted, the kept text (words joined by single spaces)."""
    rows = df.select(F.col(key).alias("id"), whole_text(text).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    spans = repeated_spans(rows, k, m, share, least).groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def new(batches):
        for keys, texts, _ in _texts(batches):
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([t.decode() for t in texts], pa.string())], names=["key", "text"])

    def keep(batches):
        for b in batches:
            n_words, n_removed, sha, kept = [], [], [], []
            for t, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = t.encode().split()
                n = len(words)
                if found and n >= k:
                    gone = np.zeros(n + 1, np.int64)
                    np.add.at(gone, [s["start"] for s in found], 1)
                    np.add.at(gone, [min(s["stop"], n) for s in found], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]
                n_words.append(n)
                n_removed.append(n - len(words))
                out = b" ".join(words)
                sha.append(hashlib.sha256(out).hexdigest())
                kept.append(out.decode())
            columns = [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string())] if with_text else columns, names=names)

    names = ["key", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text]
    schema = "key binary, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    contents = arrow_map(rows.select("key", "text"), new, "key binary, text string").join(spans.hint("shuffle_hash"), "key", "left")
    results = arrow_map(contents.select("key", "text", "spans"), keep, schema).dropDuplicates(["key"])
    ids, results, on = salted(rows.select("id", "key"), results, "key", frequent_keys(rows, "key"))
    return ids.join(results, on).select(F.col("id").alias(key), *names[1:])
