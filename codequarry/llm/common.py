"""Shared helpers: tables, durable cuts of lineage, and vectorised word fingerprints."""

from __future__ import annotations

import ctypes
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folds import running  # noqa: F401

#: White space of the word contracts: space and 0x09-0x0D.
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the session names none, a local master gets a temporary
    one, as in tests; on a cluster that is an error, since executors couldn't see it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key is frequent from this share of all rows and this number of rows: a thousand keys at most.
FREQUENT_SHARE, FREQUENT_LEAST = 1e-3, 64


def frequent_keys(rows: DataFrame, key: str) -> list:
    """The keys that hold more than their share of all rows, counted with partial sums."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT_LEAST)
    total = rows.count()
    return [r[0] for r in counts.where(F.col("n") >= total * FREQUENT_SHARE).select(key).collect()]


def salted(rows: DataFrame, found: DataFrame, key: str, frequent: list) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with a salt, and the columns to join on: rows of a frequent key are dealt over all
    partitions, and what was found for such a key is repeated once a salt; other keys have one salt."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    often = F.col(key).isin(frequent) if frequent else F.lit(False)
    dealt = F.when(often, F.pmod(F.xxhash64(*rows.columns) + F.spark_partition_id(), F.lit(n)).cast("int")).otherwise(0)
    every = F.when(often, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("__salt", dealt), found.withColumn("__salt", F.explode(every)), [key, "__salt"]


#: Rows of one Arrow batch at most, since texts are long.
BATCH_ROWS = 2000


def give_back() -> None:
    """Returns a worker's freed memory to the system, since idle workers stay for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps it
        return


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of few rows, which bounds the memory of workers; a smaller setting of the session stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)

    def tidy(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def whole_text(column: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def own_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


# ---------------------------------------------------------------- fingerprints of words

_CHUNK = 1 << 19
#: Words longer than this are hashed one by one.
_LONG = 256
_M = 0xFFFFFFFFFFFFFFFF
_SEED = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _word_hashes(buf: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each span of ``buf``: eight bytes at a time are folded in, and all bits are mixed between them."""
    data = buf + bytes(8)
    eight = np.ndarray((len(buf),), dtype="<u8", buffer=data, strides=(1,))
    size = end - start
    out = mix(size.astype(np.uint64) + _SEED)
    left = np.flatnonzero(size <= _LONG)
    done = 0
    while len(left):
        rest = np.minimum(size[left] - done, 8).astype(np.uint64)
        part = eight[start[left] + done] & (np.uint64(_M) >> (np.uint64(64) - rest * np.uint64(8)))
        out[left] = mix(out[left] ^ part)
        done += 8
        left = left[size[left] > done]
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[start[i] : end[i]])
    return out


def separator_table(extra: bytes = b"") -> np.ndarray:
    """Which bytes are part of a word: all but white space and ``extra``."""
    out = np.ones(256, dtype=bool)
    out[list(SPACE_BYTES + extra)] = False
    return out


SPACES = separator_table()
#: White space and ASCII punctuation.
NON_WORD = separator_table(bytes(b for b in range(128) if not chr(b).isalnum()))


class Words:
    """The words of several texts in one buffer: byte spans, 64-bit hashes, owning text."""

    def __init__(self, texts: list[bytes], word_bytes: np.ndarray = SPACES):
        self.buf = b"\n".join(texts) + b"\n"
        data = np.frombuffer(self.buf, dtype=np.uint8)
        inside = word_bytes[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = _word_hashes(self.buf, self.start, self.end)
        begins = np.cumsum([0] + [len(x) + 1 for x in texts])
        #: The words of text i are first[i] to first[i + 1].
        self.first = np.searchsorted(self.start, begins)
        self.counts = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(texts)), self.counts)

    def grams(self, n: int) -> np.ndarray:
        """The hash of the n words from each position; valid where position + n stays in the text."""
        h, size = self.hash, len(self.hash)
        if size < n:
            return np.zeros(0, dtype=np.uint64)
        out = np.zeros(size - n + 1, dtype=np.uint64)
        for k in range(n):
            out = out * np.uint64(0xC2B2AE3D27D4EB4F) + h[k : size - n + 1 + k]
        return mix(out)

    def inside(self, n: int) -> np.ndarray:
        """Positions from which n words stay in one text."""
        if len(self.hash) < n:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.owner[: len(self.owner) - n + 1] == self.owner[n - 1 :])


def chunks(texts: list[bytes], limit: int = _CHUNK):
    """(from, to) of runs of texts with about ``limit`` bytes together; a longer text stands alone."""
    at, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > limit:
            yield at, i
            at, size = i, 0
        size += len(x) + 1
    if at < len(texts):
        yield at, len(texts)
