"""Licence signatures: keywords, wordings, order and containment, against a slow version."""

import random
import re
import time

from codequarry.llm import licenses


def wordings(pattern):
    """Texts that a signature matches: all branches, optional parts both ways, one character of each class."""
    from re import _parser as parser

    def every(items):
        out = [""]
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                parts = [chr(arg)]
            elif name == "SUBPATTERN":
                parts = every(arg[3])
            elif name == "BRANCH":
                parts = [x for branch in arg[1] for x in every(branch)]
            elif name == "MAX_REPEAT":
                low, high, body = arg
                parts = [x * n for x in every(body) for n in {low, min(int(high), max(low, 1))}]
            elif name == "IN":
                parts = [chr(v) if str(k) == "LITERAL" else chr(v[0]) if str(k) == "RANGE" else None for k, v in arg]
                parts = ["x"] if None in parts else parts[:2]
            else:
                parts = ["x"]
            out = [a + b for a in out for b in dict.fromkeys(parts)][:400]
        return out

    return every(parser.parse(pattern))


def test_hundreds_of_signatures_each_behind_a_word_it_holds():
    rules = licenses.rules()
    assert len(rules) >= 200 and len({r.pattern for r in rules}) == len(rules)
    for r in rules:
        for w in wordings(r.pattern):
            assert re.fullmatch(r.pattern, w), (r.pattern, w)
            assert r.keyword in w, (r.keyword, w)
            assert not set(w.split()).isdisjoint(licenses._GATE), w


def slow(text):
    """Kept detections by trying every rule on the whole text."""
    low = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())) + " "
    hits = [(m.start(), m.end(), r.priority, rank, r.label) for rank, r in enumerate(licenses.rules()) for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", low)]
    hits.sort(key=lambda h: (h[0], -h[1], -h[2], h[3]))
    kept = []
    for i, h in enumerate(hits):
        if not any(o[2] >= h[2] and o[1] >= h[1] for o in hits[:i]):
            kept.append(h)
    return kept


def test_scan_against_every_rule(spark):
    rng = random.Random(4)
    every = [w for r in licenses.rules() for w in rng.sample(wordings(r.pattern), 1)]
    rows = [(i, "Some words. " + rng.choice(["", "CC-BY 4.0, "]).join(x.title().replace(" ", rng.choice([" ", "-", ",\n"])) + " and. " for x in rng.sample(every, 4))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "MIT"), (903, every[0]), (903, every[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = licenses.license_scan(docs).select("doc_id", "text", "license_hits").collect()
    assert len(found) == len(rows)
    for r in found:
        assert [(h.start, h.stop, h.priority, h.rank, h.label) for h in r.license_hits] == slow(r.text or ""), r.text


def test_wordings_without_the_short_name(spark):
    names = {"bsd": "Berkeley Software Distribution", "mit": "Massachusetts Institute of Technology", "isc": "Internet Systems Consortium"}
    docs = spark.createDataFrame([(k, f"Licensed under the {v} license") for k, v in names.items()], "doc_id string, text string")
    assert {(r.doc_id, r.labels) for r in licenses.license_digest(docs).collect()} == {(k, k) for k in names}


def test_time_grows_with_the_number_of_places(spark):
    texts = ["All rights reserved. MIT License; " * n for n in (2000, 20000)]
    took = []
    for t in texts:
        began = time.perf_counter()
        r = licenses.license_digest(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
        took.append(time.perf_counter() - began)
        assert r.n_base == t.count("All") and r.labels == "mit,reserved"
    assert took[1] < 20
