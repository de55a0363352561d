"""The quality classifier against a version in plain Python: measures, votes, labels, the scorer and its scores."""

import math
import random

import numpy as np

from codequarry.llm import quality
from codequarry.llm.common import SPACES, Words

rng = random.Random(12)
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def plain_words(text):
    out, word = [], b""
    for c in (text or "").encode() + b" ":
        if c in SPACE_BYTES:
            if word:
                out.append(word)
            word = b""
        else:
            word += bytes([c])
    return out


def kind(c):
    if 97 <= c <= 122 or c >= 128:
        return "lower"
    if 65 <= c <= 90:
        return "upper"
    if 48 <= c <= 57:
        return "digit"
    return "mark" if c in b".,;:?'\"()-" else "shout" if c == 33 else "symbol"


def slow_measures(text):
    w = plain_words(text)
    if len(w) < quality.LEAST_WORDS:
        return None
    n = {k: sum(kind(c) == k for x in w for c in x) for k in ("lower", "upper", "symbol")}
    size = sum(map(len, w))
    fresh = [i == 0 or w[i] != w[i - 1] for i in range(len(w))]
    known = {x.encode() for f in quality.FUNCTION_WORDS for x in (f, f.capitalize())}
    return {
        "upper": n["upper"] / (n["upper"] + n["lower"]) if n["upper"] + n["lower"] else math.nan,
        "symbols": n["symbol"] / size,
        "marks": sum(not any(kind(c) in ("lower", "upper", "digit") for c in x) for x in w) / len(w),
        "shouts": sum(b"!" in x for x in w) / len(w),
        "same_again": sum(not f for f in fresh) / len(w),
        "top_word": max(w.count(x) for x in set(w)) / len(w),
        "function_words": sum(f and x in known for x, f in zip(w, fresh)) / len(w),
        "lower_letters": sum(kind(c) == "lower" for x, f in zip(w, fresh) if f for c in x) / size,
    }


def slow_votes(text):
    m = slow_measures(text)
    out = []
    for name, bad, good in quality.LABELLERS:
        x = math.nan if m is None else m[name]
        is_bad, is_good = (x >= bad, x <= good) if bad > good else (x <= bad, x >= good)
        out.append(0 if is_bad else 1 if is_good else -1)
    return tuple(out)


def slow_posterior(votes, prior, chance):
    good, bad = prior, 1 - prior
    for i, v in enumerate(votes):
        if v >= 0:
            good *= chance[1][i][v]
            bad *= chance[0][i][v]
    return good / (good + bad)


def slow_labels(votes):
    """Expectation-maximisation, a document at a time."""
    good = [0.1 if 0 in v else 0.9 for v in votes]
    for _ in range(100):
        some = [(v, g) for v, g in zip(votes, good) if any(x >= 0 for x in v)]
        prior = (sum(g for _, g in some) + 1) / (len(some) + 2)
        prior = min(max(prior, 1e-4), 1 - 1e-4)
        chance = [[None] * len(quality.LABELLERS) for _ in range(2)]
        for c in range(2):
            for i in range(len(quality.LABELLERS)):
                seen = [1 + sum((g if c else 1 - g) for v, g in some if v[i] == x) for x in range(2)]
                chance[c][i] = [s / sum(seen) for s in seen]
        again = [slow_posterior(v, prior, chance) if any(x >= 0 for x in v) else g for v, g in zip(votes, good)]
        if max(abs(a - b) for a, b in zip(again, good)) < 1e-6:
            break
        good = again
    return prior, chance


def slow_features(text):
    """Feature -> how many words of the text carry it."""
    w = Words([(text or "").encode()], SPACES)
    out = {}
    for part in quality._hashed(w):
        for at in part.tolist():
            out[at] = out.get(at, 0) + 1
    return out, len(w.hash)


def slow_scorer(rows, prior, chance):
    """(votes, features, words) -> weights by feature and a bias."""
    weights, scale, bias, bias_scale = {}, {}, 0.0, 1e-8
    y = [slow_posterior(v, prior, chance) for v, _, _ in rows]
    good, bad = sum(y), sum(1 - p for p in y)
    balance = [(p * len(y) / (2 * good) + (1 - p) * len(y) / (2 * bad)) if any(x >= 0 for x in v) else 0.0 for (v, _, _), p in zip(rows, y)]
    shares = [{a: c / max(1, n) for a, c in f.items()} for _, f, n in rows]
    for _ in range(quality._STEPS):
        slope, total = {}, 0.0
        for share, p, b in zip(shares, y, balance):
            z = sum(weights.get(a, 0.0) * s for a, s in share.items()) + bias
            error = (1 / (1 + math.exp(-min(max(z, -50), 50))) - p) * b / len(rows)
            total += error
            for a, s in share.items():
                slope[a] = slope.get(a, 0.0) + error * s
        for a, d in slope.items():
            d += quality._DECAY * weights.get(a, 0.0)
            scale[a] = scale.get(a, 1e-8) + d * d
            weights[a] = weights.get(a, 0.0) - quality._RATE / 4 * d / math.sqrt(scale[a])
        bias_scale += total**2
        bias -= quality._RATE / 4 * total / math.sqrt(bias_scale)
    return weights, bias


def corpus():
    good = ["the of and to in is that it was for".split(), [f"word{i}" for i in range(150)]]
    plain = lambda n=60: " ".join(rng.choice(good[rng.random() < 0.6]) for _ in range(n)) + "."
    makers = (plain, plain, plain, lambda: plain().upper().replace(" ", "!! "), lambda: plain().replace(" ", "%$# "), lambda: " ".join([rng.choice(good[1])] * 50), lambda: plain(5), lambda: "Über das Maß!  " + plain(20))
    return [makers[i % len(makers)]() for i in range(160)] + ["", None, " \t\n", "a", "9 9 9 9 9 9 9 9 9"]


def test_measures_and_votes():
    for t in corpus():
        m = quality.measures(Words([(t or "").encode()], SPACES))
        want = slow_measures(t)
        for i, (name, _, _) in enumerate(quality.LABELLERS):
            x = math.nan if want is None else want[name]
            assert math.isnan(m[0, i]) and math.isnan(x) or abs(m[0, i] - x) < 1e-12, (t, name)
        assert tuple(quality.votes(m)[0].tolist()) == slow_votes(t)


def test_fit_and_scores(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: r for r in quality.quality(docs, sample=len(texts)).collect()}
    votes = [slow_votes(t) for t in texts]
    prior, chance = slow_labels(votes)
    features = [slow_features(t) for t in texts]
    weights, bias = slow_scorer([(v, f, n) for v, (f, n) in zip(votes, features)], prior, chance)
    for i, (f, n) in enumerate(features):
        z = sum(weights.get(a, 0.0) * c for a, c in f.items()) / max(n, 1) + bias
        assert abs(found[i].label - slow_posterior(votes[i], prior, chance)) < 1e-6
        assert abs(found[i].score - 1 / (1 + math.exp(-z))) < 2e-4, i
        assert found[i].kept == (found[i].score >= quality.KEEP)
    again = quality.fit(docs.repartition(2).select("doc_id", "text"), sample=40)
    other = quality.fit(docs.coalesce(1).select("doc_id", "text"), sample=40)
    assert np.array_equal(again.weights, other.weights) and again.bias == other.bias
