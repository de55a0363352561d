"""The crawl of pages end to end, and records that are damaged or lack what a revisit needs."""

import hashlib
import time

from codequarry.llm import warc


def records(spark, rows):
    return spark.createDataFrame(rows, "record_id string, kind string, url string, ts long, status int, headers map<string,string>, payload_bytes long, payload_sha256 string, canonical_url string, hit int")


def test_negative_length_ends_the_blob():
    good = warc.record_bytes("urn:1", "response", "http://e.org", 5, 200, {}, b"x")
    began = time.perf_counter()
    bad = b"WARC/1.1\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: -70\r\n\r\n"
    assert [r[0] for r in warc.parse_records(good + bad)] == ["urn:1"]
    assert list(warc.parse_records(bad)) == []
    assert time.perf_counter() - began < 1


def test_revisits_without_time_url_or_full_response(spark):
    tag = {"etag": '"1"'}
    rows = [
        ("a", "response", None, 1, 200, tag, 1, "s", "x", 1),
        ("b", "response", "http://e.org/p", 1, 206, tag, 1, "s", "x", 1),
        ("c", "response", "http://e.org/q", None, 200, tag, 1, "s", "x", 1),
        ("d", "response", "http://e.org/r", 1, 203, tag, 1, "s", "x", 1),
        *((f"r{i}", "revisit", u, t, 304, tag, 0, "", "x", 1) for i, (u, t) in enumerate([(None, 9), ("", 9), ("http://e.org/p", 9), ("http://e.org/q", 9), ("http://e.org/r", None), ("http://e.org/r", 9), ("http://e.org/r", 9)])),
    ]
    found = sorted((r.record_id, r.outcome, r.response_id) for r in warc.resolve_revisits(records(spark, rows)).collect())
    assert found == [(f"r{i}", "no_response", None) for i in range(5)] + [("r5", "resolved", "d"), ("r6", "resolved", "d")]


def test_digest_of_pages_against_brute_force(spark):
    rows = [(i, f"http://www.E{i % 3}.org/{i // 3}/?b=1&a={i}" if i % 9 else (None, "")[i % 2], "<p>é" * (i % 7) if i % 11 else None, "clash") for i in range(60)]
    rows += [(13, rows[13][1], rows[13][2], "clash"), (None, "http://n.org/", "x", "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, status string").repartition(3)
    made = []
    for r in warc.captures(pages).collect():
        made += [(r.page_id, *x) for x in warc.parse_records(bytes(r.warc))]
    assert warc.revisit_digest(pages.limit(0)).count() == 0

    def canon(url):
        if "://" not in (url or ""):
            return ""
        host, _, rest = url.split("://", 1)[1].partition("/")
        path, _, query = rest.partition("?")
        path = ("/" + path).rstrip("/")
        kept = sorted(p for p in query.split("&") if p and not p.startswith("utm_"))
        return host.lower().removeprefix("www.") + path + ("?" + "&".join(kept) if kept else "")

    want = []
    for page_id, rid, kind, url, ts, status, headers, _ in made:
        if kind != "revisit":
            continue
        old = [m for m in made if m[2] == "response" and canon(m[3]) == canon(url) and m[4] < ts] if canon(url) else []
        if not old:
            want.append((page_id, rid, "no_response", None, None, None, None))
            continue
        hit = max(old, key=lambda m: (m[4], m[1]))
        tags = [h["etag"].removeprefix("W/") for h in (headers, hit[6]) if "etag" in h]
        same = tags[0] == tags[1] if len(tags) == 2 else headers["last-modified"] == hit[6]["last-modified"]
        if not same:
            want.append((page_id, rid, "mismatch", None, None, None, None))
            continue
        merged = {**hit[6], **{k: v for k, v in headers.items() if k not in warc.NOT_MERGED}}
        want.append((page_id, rid, "resolved", hit[1], len(hit[7]), hashlib.sha256(hit[7]).hexdigest(), "\n".join(sorted(f"{k}: {v}" for k, v in merged.items()))))
    found = [(r.page_id, r.record_id, r.outcome, r.response_id, r.payload_bytes, r.payload_sha256, r.headers) for r in warc.revisit_digest(pages).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert {w[2] for w in want} == {"no_response", "mismatch", "resolved"}


def test_page_ids_may_be_text(spark):
    pages = spark.createDataFrame([("a", "http://e.org/a", "x"), (None, None, None)], "page_id string, url string, html string")
    assert {r.page_id for r in warc.revisit_digest(pages).collect()} == {"a", None}


def test_dates_with_fractions_and_of_any_precision():
    def record(date, body):
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <{body}>\r\nWARC-Target-URI: http://a.b/\r\nWARC-Date: {date}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()

    dates = {"2024-05-06T07:08:09.123456789Z": 1714979289, "2024-05-06T07:08:09Z": 1714979289, "2024-05-06T07:08Z": 1714979280, "2024-05-06": 1714953600, "2024-05": 1714521600, "2024": 1704067200}
    blob = b"".join(record(d, f"r{i}") for i, d in enumerate(dates))
    assert [r[3] for r in warc.parse_records(blob)] == list(dates.values())
    assert [r[0] for r in warc.parse_records(record("2024", "a") + record("2024-13", "b") + record("2024", "c"))] == ["a"]
