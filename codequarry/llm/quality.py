"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-
maximisation over the counts of all vote patterns of the corpus estimates each labeller's
behaviour, and so the probability of each pattern. A linear scorer over hashed words and word
shapes learns these probabilities from a bounded sample (``SAMPLE`` documents on average) and scores
every document from its whole text.

Null and empty texts get no votes and the prior's score; repeated rows get equal scores and count once
in the sample; the order of rows and partitions doesn't matter; a score at the limit keeps its
document; where a column has the name of an output, the output takes another one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Words, arrow_map, chunks, mix, own_name, whole_text

#: Documents of the corpus on which the scorer is fitted, on average.
SAMPLE = 3000
DIMS = 1 << 16
_ALL = DIMS + 2
#: A document is kept from this score.
KEEP = 0.5
#: Share of the least sure pattern's weight in the fit, steps and step width of the fit.
_STEPS, _RATE, _DECAY = 200, 4.0, 1e-5

#: Frequent function words of four languages. Fixed values.
FUNCTION_WORDS = """the of and to in a is that it for was on with be by as at this have from are not or an they you he
der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er sie nach bei
de la le les et des en un une du que est pour qui dans par sur au il pas plus ne se ce avec
el los las y un una que por con para del se lo su al como más pero sus""".split()

_CLASS = np.full(256, 5, dtype=np.uint8)  # other symbols
for _kind, _chars in ((0, range(97, 123)), (0, range(128, 256)), (1, range(65, 91)), (2, range(48, 58)), (3, b".,;:?'\"()-"), (4, b"!")):
    _CLASS[list(_chars)] = _kind

#: Measure, where it speaks for a bad document and where for a good one (at least or at most, after
#: which limit is the higher).
LABELLERS = (
    ("upper", 0.5, 0.15),
    ("symbols", 0.08, 0.02),
    ("marks", 0.15, 0.03),
    ("shouts", 0.3, 0.05),
    ("same_again", 0.2, 0.05),
    ("top_word", 0.35, 0.15),
    ("function_words", 0.015, 0.1),
    ("lower_letters", 0.5, 0.8),
)
#: Labellers don't vote on fewer words.
LEAST_WORDS = 8


def measures(w: Words) -> np.ndarray:
    """One row per text, one column per labeller; NaN where there are too few words.

    Function words and lower-case letters count only in words that don't repeat the one before.
    """
    n_texts = len(w.counts)
    data = np.frombuffer(w.buf, np.uint8)
    kind = _CLASS[data]
    lengths = w.end - w.start
    per_word = np.zeros((6, len(lengths)))
    if len(lengths):
        for k in range(6):
            sums = np.concatenate([[0], np.cumsum(kind == k)])
            per_word[k] = sums[w.end] - sums[w.start]

    def total(x: np.ndarray) -> np.ndarray:
        return np.bincount(w.owner, weights=x, minlength=n_texts)

    words = w.counts.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        letters = total(per_word[0] + per_word[1])
        size = total(lengths.astype(float))
        upper = total(per_word[1]) / letters
        symbols = total(per_word[5]) / size
        marks = total((per_word[0] + per_word[1] + per_word[2] == 0).astype(float)) / words
        shouts = total((per_word[4] > 0).astype(float)) / words
        same = np.zeros(len(lengths))
        if len(lengths):
            same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.owner[1:] == w.owner[:-1])
        again = total(same) / words
        fresh = 1 - same
        order = np.lexsort((w.hash, w.owner))
        top = np.zeros(n_texts)
        if len(order):
            h, o = w.hash[order], w.owner[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])]))
            np.maximum.at(top, o[new], np.diff(np.append(new, len(order))))
        function = total(np.isin(w.hash, _function_hashes()) * fresh) / words
        lower = total(per_word[0] * fresh) / size
        out = np.stack([upper, symbols, marks, shouts, again, top / words, function, lower], axis=1)
    out[words < LEAST_WORDS] = np.nan
    return out


_HASHES: list[np.ndarray] = []


def _function_hashes() -> np.ndarray:
    if not _HASHES:
        both = [x.encode() for x in dict.fromkeys([*FUNCTION_WORDS, *(f.capitalize() for f in FUNCTION_WORDS)])]
        _HASHES.append(np.unique(Words(both).hash))
    return _HASHES[0]


def votes(m: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, -1 none."""
    out = np.full(m.shape, -1, dtype=np.int8)
    for i, (_, bad, good) in enumerate(LABELLERS):
        x = m[:, i]
        with np.errstate(invalid="ignore"):
            if bad > good:
                out[x >= bad, i] = 0
                out[x <= good, i] = 1
            else:
                out[x <= bad, i] = 0
                out[x >= good, i] = 1
    return out


def _codes(v: np.ndarray) -> np.ndarray:
    return (v + 1).astype(np.int64) @ (3 ** np.arange(v.shape[1], dtype=np.int64))


def _uncoded(code: np.ndarray) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3).astype(np.int8) - 1


@dataclass
class LabelModel:
    """Prior of good documents and, per labeller, the chance of each vote given the class."""

    prior: float
    chance: np.ndarray  # class, labeller, vote + 1

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """Chance that a document with these votes is good."""
        log = np.log([1 - self.prior, self.prior])[:, None] + np.zeros((2, len(v)))
        for i in range(v.shape[1]):
            voted = v[:, i] >= 0
            log[:, voted] += np.log(self.chance[:, i, :][:, v[voted, i] + 1])
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def fit_label_model(v: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over vote patterns and how often they occur; smoothed by one vote.

    Not voting says nothing of the class. The first guess is that any bad vote makes a document bad,
    which also fixes which class is the good one; a document without votes is no evidence.
    """
    voted = v >= 0
    n = voted.sum(axis=1)
    good = np.where((v == 0).any(axis=1), 0.1, 0.9)
    counts = np.where(n > 0, counts, 0)
    model = LabelModel(0.5, np.full((2, v.shape[1], 3), 0.5))
    for _ in range(rounds):
        mass = np.stack([(1 - good) * counts, good * counts])
        prior = float((mass[1].sum() + 1) / (mass.sum() + 2))
        chance = np.ones((2, v.shape[1], 3))
        for c in range(2):
            for i in range(v.shape[1]):
                seen = np.bincount(v[:, i] + 1, weights=mass[c], minlength=3)[1:] + 1
                chance[c, i, 1:] = seen / seen.sum()
        model = LabelModel(min(max(prior, 1e-4), 1 - 1e-4), chance)
        again = np.where(n > 0, model.posterior(v), good)
        if np.abs(again - good).max() < 1e-6:
            break
        good = again
    return model


def _hashed(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature indices of each word, of its shape (its classes of characters without repeats), and of
    whether it repeats the word before."""
    data = np.frombuffer(w.buf, np.uint8)
    kind = _CLASS[data].astype(np.uint64)
    change = np.concatenate([[True], kind[1:] != kind[:-1]])
    change[w.start] = True
    step = np.where(change, kind + np.uint64(1), np.uint64(0))
    rank = np.cumsum(change).astype(np.int64)
    # at most eight changes tell shapes apart
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    first = np.zeros(len(data), dtype=np.int64)
    first[w.start] = rank[w.start]
    first = np.maximum.accumulate(first)
    place = np.clip(rank - first, 0, 9).astype(np.uint64) * np.uint64(6)
    np.cumsum(step << place, out=sums[1:])
    shape = sums[w.end] - sums[w.start]
    half = np.uint64(DIMS // 2)
    again = np.full(len(w.hash), DIMS, dtype=np.int64)
    if len(again):
        again[1:] += (w.hash[1:] == w.hash[:-1]) & (w.owner[1:] == w.owner[:-1])
    return (w.hash % half).astype(np.int64), (mix(shape) % half + half).astype(np.int64), again


def _texts(b: pa.RecordBatch, column: int) -> list[bytes]:
    return [(t or "").encode() for t in b.column(column).to_pylist()]


def vote_patterns(df: DataFrame, text: str = "text") -> DataFrame:
    """(pattern, n) over all documents; there are at most 3 to the number of labellers."""

    def run(batches):
        for b in batches:
            texts = _texts(b, 0)
            for i, j in chunks(texts):
                code, n = np.unique(_codes(votes(measures(Words(texts[i:j], SPACES)))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["pattern", "n"])

    return arrow_map(df.select(whole_text(text).alias("t")), run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def _sampled_features(df: DataFrame, text: str) -> DataFrame:
    """(pattern, at, share) of sampled documents: hashed features with their share of the words."""

    def run(batches):
        for b in batches:
            texts = _texts(b, 0)
            for i, j in chunks(texts):
                w = Words(texts[i:j], SPACES)
                code = _codes(votes(measures(w)))
                word, shape, again = _hashed(w)
                at, share = [], []
                for d in range(j - i):
                    s, e = int(w.first[d]), int(w.first[d + 1])
                    x, n = np.unique(np.concatenate([word[s:e], shape[s:e], again[s:e]]), return_counts=True)
                    at.append(x.astype(np.int32))
                    share.append((n / max(1, e - s)).astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], names=["pattern", "at", "share"])

    return arrow_map(df.select(whole_text(text).alias("t")), run, "pattern long, at array<int>, share array<float>")


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray
    bias: float


def _fit_scorer(rows: list[tuple[int, list[int], list[float]]], labels: LabelModel) -> tuple[np.ndarray, float]:
    """Logistic regression on the posterior labels by full gradients; both classes weigh the same."""
    weights, bias = np.zeros(_ALL), 0.0
    if not rows:
        return weights, bias
    v = _uncoded(np.array([r[0] for r in rows]))
    y = labels.posterior(v)
    owner = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    at = np.concatenate([np.array(r[1], np.int64) for r in rows])
    share = np.concatenate([np.array(r[2]) for r in rows])
    good, bad = max(y.sum(), 1e-6), max((1 - y).sum(), 1e-6)
    balance = np.where((v >= 0).any(axis=1), y * len(y) / (2 * good) + (1 - y) * len(y) / (2 * bad), 0.0)
    if min(good, bad) < 1:  # one class only: there is nothing to tell apart
        return weights, 6.0 if good > bad else -6.0
    scale = np.zeros(_ALL) + 1e-8
    bias_scale = 1e-8
    for _ in range(_STEPS):
        score = np.bincount(owner, weights=weights[at] * share, minlength=len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - y) * balance / len(rows)
        slope = np.bincount(at, weights=error[owner] * share, minlength=_ALL) + _DECAY * weights
        scale += slope * slope
        weights -= _RATE / 4 * slope / np.sqrt(scale)
        bias_scale += error.sum() ** 2
        bias -= _RATE / 4 * error.sum() / np.sqrt(bias_scale)
    return weights, float(bias)


def fit(df: DataFrame, text: str = "text", sample: int = SAMPLE) -> QualityModel:
    """Votes of all documents for the label model, a sample by content hash for the scorer."""
    patterns = vote_patterns(df, text).collect()
    if not patterns:
        return QualityModel(LabelModel(0.5, np.full((2, len(LABELLERS), 3), 0.5)), np.zeros(_ALL), 0.0)
    patterns.sort()
    code, n = (np.array([r[i] for r in patterns], dtype=np.int64) for i in (0, 1))
    labels = fit_label_model(_uncoded(code), n.astype(float))
    share = min(1.0, sample / int(n.sum()))
    mark = F.xxhash64(*[F.col(c) for c, t in df.dtypes if t in ("string", "bigint", "int")])
    marked = df.select(mark.alias("mark"), F.col(text).alias("t")).where(F.col("mark").bitwiseAND(F.lit((1 << 30) - 1)) < int(share * (1 << 30)))
    # repeated rows count once, and the order of partitions doesn't matter
    chosen = marked.dropDuplicates(["mark"]).orderBy("mark").limit(2 * sample)
    rows = [(r[0], r[1], r[2]) for r in _sampled_features(chosen, "t").collect()]
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    weights, bias = _fit_scorer(rows, labels)
    return QualityModel(labels, weights, bias)


def score(df: DataFrame, model: QualityModel, text: str = "text", prefix: str = "quality_") -> DataFrame:
    """All columns, ``prefix`` + score (0 to 1), label (posterior of the votes) and n_votes."""
    names = [own_name(df, prefix + x) for x in ("score", "label", "n_votes")]
    schema = df.withColumns({names[0]: F.lit(0.0), names[1]: F.lit(0.0), names[2]: F.lit(0).cast("long")}).schema
    where = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast((model.labels, model.weights.astype(np.float32), model.bias))

    def run(batches):
        labels, weights, bias = shared.value
        for b in batches:
            texts = _texts(b, where)
            scores, posts, counts = [], [], []
            for i, j in chunks(texts):
                w = Words(texts[i:j], SPACES)
                v = votes(measures(w))
                word, shape, again = _hashed(w)
                total = np.bincount(w.owner, weights=weights[word].astype(float) + weights[shape] + weights[again], minlength=j - i)
                scores.append(1 / (1 + np.exp(-np.clip(total / np.maximum(w.counts, 1) + bias, -50, 50))))
                posts.append(labels.posterior(v))
                counts.append((v >= 0).sum(axis=1))
            new = [pa.array(np.concatenate(x) if x else [], t) for x, t in ((scores, pa.float64()), (posts, pa.float64()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *names])

    return arrow_map(df, run, schema)


def quality(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """key, score, label, n_votes, kept."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    out = score(rows, fit(rows, "t", sample), "t", "")
    return out.select(F.col("k").alias(key), "score", "label", "n_votes", (F.col("score") >= KEEP).alias("kept"))
