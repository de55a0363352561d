"""Hard negatives by blocked dense products.

Anchors go to all tasks in broadcast blocks of bounded size; every task multiplies them with its
candidates block by block in float64, whose sums of integers are exact below 2^53, and keeps the best
few of each anchor. These lists merge: whatever the tasks are, the best of all lists are the best of all
rows. A first pass finds each anchor's positives, a second one the best negatives inside the window that
each positive's score spans. A pass reads all candidates once for each block of anchors, and a block is
large enough that its products take far longer than the reading.

Rows without id, label or vector, or with a null or non-finite component, take no part. Components become
integers, floor(scale * x). Vectors of other lengths count as if zeros followed. Where values are so large
that float64 might round, the block is multiplied in Python's integers; a score beyond 62 bits is an error.
Rows that repeat an id are candidates of their own, but never another row of an anchor with that id, and an
anchor that stands in several rows gets its results once a row. Ties go by the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable

#: Components of the anchors in one broadcast block (float64), and rows of one product.
BLOCK_VALUES, ROWS, COLUMNS = 1 << 22, 512, 4096
_NONE = -(1 << 63) + 1
_LAST = (1 << 63) - 1
_EXACT, _LARGEST = float(1 << 53), 1 << 62


def _vectors(batch: pa.RecordBatch, width: int, scale: float) -> tuple[np.ndarray, ...]:
    """The columns of the rows (id, label, vector, ...) that take part, with integer components (float64) as vectors."""
    lists = batch.column(2)
    offsets = lists.offsets.to_numpy()
    flat = np.asarray(lists.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False), dtype=np.float64)
    x = np.zeros((len(lists), width))
    x[np.arange(width) < np.diff(offsets)[:, None]] = flat
    good = np.isfinite(x).all(axis=1)
    return tuple(np.floor(scale * x[good]) if i == 2 else batch.column(i).to_numpy(zero_copy_only=False)[good] for i in range(batch.num_columns))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows as 64-bit integers."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = np.dot(whole(a), whole(b).T)
    if max(map(abs, exact.ravel()), default=0) >= _LARGEST:
        raise ValueError("a score needs more than 62 bits")
    return exact.astype(np.int64)


class _Best:
    """The best ``n`` (score, id) of each row so far: higher scores first, then smaller ids."""

    def __init__(self, rows: int, n: int):
        self.n, self.score, self.id = n, np.full((rows, n), _NONE), np.full((rows, n), _LAST)

    def add(self, at: int, scores: np.ndarray, order: np.ndarray, wanted: np.ndarray, ids: np.ndarray) -> None:
        """Scores of rows from ``at`` with candidates ``ids``, of which those wanted count; order ranks them in a row."""
        ranked = np.where(wanted, order, _NONE)
        top = ranked.argmax(axis=1)
        every = np.arange(len(top))
        better = (ranked[every, top] > _NONE) & (scores[every, top] >= self.score[at : at + len(top), -1])
        rows = np.flatnonzero(better)
        if not len(rows):
            return
        ranked = ranked[rows]
        if ranked.shape[1] > self.n:
            columns = np.argpartition(ranked, ranked.shape[1] - self.n, axis=1)[:, -self.n :]
        else:
            columns = np.broadcast_to(np.arange(ranked.shape[1]), ranked.shape)
        real = np.take_along_axis(ranked, columns, 1) > _NONE
        score = np.hstack([self.score[at + rows], np.where(real, scores[rows[:, None], columns], _NONE)])
        id_ = np.hstack([self.id[at + rows], np.where(real, ids[columns], _LAST)])
        first = np.lexsort((id_, -score), axis=1)[:, : self.n]
        self.score[at + rows], self.id[at + rows] = np.take_along_axis(score, first, 1), np.take_along_axis(id_, first, 1)

    def batch(self, rows: np.ndarray, more: dict[str, np.ndarray]) -> pa.RecordBatch:
        """What was found, with the number of its row and its other columns."""
        r, c = np.nonzero(self.score > _NONE)
        values = {"no": rows[r], **{k: v[r] for k, v in more.items()}, "id": self.id[r, c], "score": self.score[r, c]}
        return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in values.items()})


def _blocks(batches, width: int, scale: float):
    """Blocks of candidates, each by rising id."""
    step = max(1, min(COLUMNS, BLOCK_VALUES // max(1, width)))
    for b in batches:
        for at in range(0, b.num_rows, step):
            ids, labels, x = _vectors(b.slice(at, step), width, scale)
            if len(ids):
                by_id = np.argsort(ids, kind="stable")
                yield ids[by_id], labels[by_id], x[by_id]


def _ranks(scores: np.ndarray) -> np.ndarray:
    """One number for (score, place), by which the scores of a row are in order: of equal scores the first is largest."""
    n = scores.shape[1]
    if max(-int(scores.min()), int(scores.max())) >= _LARGEST // n:
        scores = np.unique(scores, return_inverse=True)[1].reshape(scores.shape)
    return scores * n + np.arange(n - 1, -1, -1)


def _positives(block, width: int, scale: float, n: int):
    def run(batches):
        no, ids, labels, x = block.value
        best = _Best(len(no), n)
        for other, their, y in _blocks(batches, width, scale):
            for at in range(0, len(no), ROWS):
                scores = _products(x[at : at + ROWS], y)
                wanted = (labels[at : at + ROWS, None] == their) & (ids[at : at + ROWS, None] != other)
                best.add(at, scores, _ranks(scores), wanted, other)
        yield best.batch(no, {})

    return run


def _negatives(block, width: int, scale: float, n: int, low: int, high: int):
    def run(batches):
        (no, _, labels, x), (of, score) = block.value
        # windows of the anchors in rows: the least and the largest score of each
        least, most = (np.array([f(s) for s in score.tolist()], dtype=np.int64) for f in (lambda s: -(-low * s // 100), lambda s: high * s // 100))
        best, bounds = _Best(len(of), n), np.searchsorted(of, np.arange(0, len(no) + ROWS, ROWS))
        for other, their, y in _blocks(batches, width, scale):
            for i, at in enumerate(range(0, len(no), ROWS)):
                scores = _products(x[at : at + ROWS], y)
                order, differ = _ranks(scores), labels[at : at + ROWS, None] != their
                for w in range(bounds[i], bounds[i + 1], ROWS):
                    own = slice(w, min(w + ROWS, bounds[i + 1]))
                    row = of[own] - at
                    s = scores[row]
                    best.add(w, s, order[row], differ[row] & (s >= least[own, None]) & (s <= most[own, None]), other)
        yield best.batch(no[of], {"positive_score": score})

    return run


def _first(found: DataFrame, n: int, *by: str) -> DataFrame:
    """The best n rows of each group, from lists that have them."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(
    vectors: DataFrame, anchors: Column | str = "vec_id % 100 = 0", key: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
    scale: float = 256.0, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its
    best ``positives`` of the same label, the best ``negatives`` of other labels whose score lies between ``low`` and
    ``high`` per cent of the positive's. See the module for rows that take no part, ties and repeated rows."""
    label = F.col(label) if isinstance(label, str) else label
    condition = F.expr(anchors) if isinstance(anchors, str) else anchors
    rows = vectors.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).alias("v"), F.coalesce(condition, F.lit(False)).alias("anchor"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    width = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    candidates = rows.select("id", "label", "v")
    named = durable(rows.where("anchor").select("id", "label", "v", F.monotonically_increasing_id().alias("no")))
    blocks = max(1, -(-named.count() * max(1, width) // block_values))
    context = vectors.sparkSession.sparkContext
    parts = []
    for i in range(blocks):
        own = named.where(F.pmod(F.xxhash64("no"), F.lit(blocks)) == i)
        batches = own.select("id", "label", "v", "no").toArrow().combine_chunks().to_batches()
        if not batches:
            continue
        ids, labels, x, no = (np.concatenate(c) for c in zip(*(_vectors(b, width, scale) for b in batches)))
        block = context.broadcast((no, ids, labels, x))
        found = candidates.mapInArrow(_positives(block, width, scale, positives), "no long, id long, score long")
        best = durable(_first(found, positives, "no").select("no", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
        windows = best.select("no", "positive_score").distinct().toArrow()
        by_no = np.argsort(no, kind="stable")
        of = by_no[np.searchsorted(no, windows.column("no").to_numpy(), sorter=by_no)]
        order = np.argsort(of, kind="stable")
        spans = context.broadcast(((no, ids, labels, x), (of[order], windows.column("positive_score").to_numpy()[order])))
        found = candidates.mapInArrow(_negatives(spans, width, scale, negatives, low, high), "no long, positive_score long, id long, score long")
        ranked = _first(found, negatives, "no", "positive_score").withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
        placed = ranked.join(best, ["no", "positive_score"]).join(own.select("no", F.col("id").alias("anchor_id")), "no")
        part = placed.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
        parts.append(part if blocks == 1 else durable(part))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


#: The query's contract at its parameters; doubles add up these integers exactly.
ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding]::DOUBLE[] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id, score FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INT AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.alike AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
"""
