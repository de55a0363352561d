"""Texts with very many matches, and redaction against a slow version."""

import random
import time

from codequarry.llm import pii

rng = random.Random(8)


def slow_redacted(text, spans):
    out, at = "", 0
    for s in spans:
        if s.start >= at:
            out += text[at : s.start] + f"[{s.kind.upper()}]"
        at = max(at, s.end)
    return out + text[at:]


def test_redaction_against_a_slow_version(spark):
    parts = ["a.b@c.de", "1.2.3.4@y.org", "4111111111111111@x.com", "+4111111111111111", "10.0.0.1", "é🙂", " ", "x", "DE89 3704 0044 0532 0130 00", "4111 1111 1111 1111"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(200)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.pii_spans(docs, spans="s").withColumn("clean", pii.redacted("text", "s")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.clean == (None if r.text is None else slow_redacted(r.text, r.s)), r.text
    assert sum(len(r.s) for r in found) > 500


def test_time_grows_with_the_number_of_matches(spark):
    n = 20000
    text = " ".join(f"mail a{i}@b.org or 10.0.{i % 256}.1" for i in range(n))
    began = time.perf_counter()
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.pii_digest(docs).first()
    assert (r.n_email, r.n_ip, r.max_score) == (n, n, 1.0)
    clean = pii.pii_spans(docs, spans="s").select(pii.redacted("text", "s").alias("clean")).first().clean
    assert clean == " ".join(["mail [EMAIL] or [IP]"] * n)
    assert time.perf_counter() - began < 40
