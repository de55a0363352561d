"""WARC records, and not-modified revisits resolved to the response they stand for.

``write_warc`` and ``read_warc`` turn records into WARC/1.1 bytes and back. ``resolve_revisits``
is an as-of join by canonical URL: a revisit takes the latest strictly earlier full response, its
validators are compared (entity tags weakly, else dates of last modification), and the headers of
the 304 that may update a stored response are merged into that response's.

A URL's records are windowed by day, and the days' last responses are carried over in a second,
small window, so that no URL's whole history sorts in one task.

A full response has status 200 or 203. Revisits without a URL or a time have no response; among
responses of the same second the greatest record id counts; damaged blobs (such as a negative
length) give the records before the damage; repeated records resolve alike; extra columns of
``resolve_revisits`` are kept out unless named, also where their names clash with its own.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map

PROFILE = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: Fields of a 304 that don't update a stored response: they are about the message. Fixed values.
NOT_MERGED = (
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authorization",
    "proxy-connection",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
)
#: Query parameters that don't tell resources apart. Fixed values.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|msclkid|mc_cid|mc_eid|sessionid|phpsessid"
#: Statuses of responses that hold the whole resource. Fixed values.
FULL = (200, 203)
DAY = 86400
RECORD = "record_id string, kind string, url string, ts long, status int, headers map<string,string>, payload_bytes long, payload_sha256 string"


def canonical_url(url: Column | str) -> Column:
    """Host in lower case without www. or m., path without a closing slash, parameters sorted without trackers.

    Scheme, user, default port and fragment go.
    """
    u = F.regexp_replace(F.trim(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(u, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)$", ""), "^(www|m)\\.", "")
    path = F.regexp_replace(F.regexp_extract(u, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(u, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^({TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def record_bytes(record_id: str, kind: str, url: str, ts: int, status: int, headers: dict[str, str], body: bytes) -> bytes:
    """One WARC/1.1 record that holds an HTTP response."""
    reason = {200: "OK", 304: "Not Modified"}.get(status, "")
    http = f"HTTP/1.1 {status} {reason}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    block = http.encode() + body
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {datetime.fromtimestamp(ts, UTC):%Y-%m-%dT%H:%M:%SZ}",
        *([f"WARC-Profile: {PROFILE}"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _head(data: bytes) -> dict[str, str]:
    """Fields by lower-case name; a repeated field's values are joined, as HTTP has it."""
    out: dict[str, str] = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", data).split(b"\r\n"):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            key = name.strip().lower()
            out[key] = f"{out[key]}, {value.strip()}" if key in out else value.strip()
    return out


def _seconds(date: str) -> int:
    """Whole seconds of a record's date, which may have a fraction, or end after the year, month, day or minute."""
    m = re.fullmatch(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:T(\d\d):(\d\d)(?::(\d\d)(?:\.\d{1,9})?)?Z)?)?)?", date.strip(), re.A)
    if m is None:
        raise ValueError(date)
    year, month, day, *clock = (int(x) if x else None for x in m.groups())
    return int(datetime(year, month or 1, day or 1, *(x or 0 for x in clock), tzinfo=UTC).timestamp())


def parse_records(data: bytes):
    """(record_id, kind, url, ts, status, headers, body) of each whole record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            return
        head = _head(data[at:end])
        try:
            size = int(head["content-length"])
            if size < 0:
                return
            ts = _seconds(head["warc-date"])
        except (KeyError, ValueError):
            return
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            return
        at = end + 4 + size + 4
        cut = block.find(b"\r\n\r\n")
        first = block[: max(cut, 0)].split(b"\r\n", 1)
        status = re.match(rb"HTTP/\S+ (\d{3})", first[0])
        yield (head.get("warc-record-id", "").strip("<>"), head.get("warc-type", ""), head.get("warc-target-uri", ""), ts, int(status[1]) if status else 0, _head(first[1]) if len(first) > 1 else {}, block[cut + 4 :] if cut >= 0 else block)


def read_warc(df: DataFrame, blob: str = "warc", keep: tuple[str, ...] = ()) -> DataFrame:
    """The records of every blob with the ``keep`` columns; payloads as size and SHA-256."""
    kept = df.select(*keep).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields), RECORD])
    names = ["record_id", "kind", "url", "ts", "status", "headers", "payload_bytes", "payload_sha256"]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string()]

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, data in enumerate(b.column(0).to_pylist()):
                for *fields, headers, body in parse_records(data or b""):
                    at.append(i)
                    rows.append((*fields, list(headers.items()), len(body), hashlib.sha256(body).hexdigest()))
            take = pa.array(at, pa.int64())
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns[1:]), *columns], names=[*kept.names, *names])

    return arrow_map(df.select(F.col(blob).alias("__blob"), *keep), run, schema)


def resolve_revisits(records: DataFrame, keep: tuple[str, ...] = (), width: int = DAY) -> DataFrame:
    """One row per revisit: record_id, url, canonical_url, ts, outcome, response_id, payload_bytes, payload_sha256,
    merged headers, and the ``keep`` columns.

    Outcomes: resolved, mismatch (validators differ), unchecked (none in common), no_response.
    """
    r = records.select(*dict.fromkeys((*keep, "record_id", "kind", "url", "ts", "status", "headers", "payload_bytes", "payload_sha256")))
    r = r.withColumns({"canonical_url": canonical_url("url"), "span": F.floor(F.col("ts") / width)})
    full = (F.col("kind") == "response") & F.col("status").isin(*FULL)
    response = F.struct("ts", "record_id", "payload_bytes", "payload_sha256", F.to_json("headers").alias("headers"))
    known = F.col("ts").isNotNull() & (F.col("canonical_url") != "")
    # what has no URL or time stands alone, so that it meets nothing and makes no common place
    place = F.when(known, F.col("canonical_url")).otherwise(F.concat(F.lit("\0"), F.coalesce("record_id", F.lit(""))))
    r = r.where((full & known) | (F.col("kind") == "revisit")).withColumns({"full": F.when(full & known, response), "place": place, "span": F.coalesce("span", F.lit(0))})
    inside = Window.partitionBy("place", "span").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("near", F.max("full").over(inside))
    spans = r.groupBy("place", "span").agg(F.max("full").alias("latest"))
    before = Window.partitionBy("place").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("place", "span", F.max("latest").over(before).alias("far"))
    found = r.where(F.col("kind") == "revisit").join(carried, ["place", "span"]).withColumn("hit", F.coalesce("near", "far"))
    old = F.from_json("hit.headers", "map<string,string>")
    found = found.withColumn("old", F.coalesce(old, F.create_map().cast("map<string,string>")))
    tag = lambda m: F.regexp_replace(F.col(m)["etag"], "^W/", "")
    outcome = (
        F.when(F.col("hit").isNull(), "no_response")
        .when(tag("headers").isNotNull() & tag("old").isNotNull(), F.when(tag("headers") == tag("old"), "resolved").otherwise("mismatch"))
        .when(F.col("headers")["last-modified"].isNotNull() & F.col("old")["last-modified"].isNotNull(), F.when(F.col("headers")["last-modified"] == F.col("old")["last-modified"], "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    fresh = F.map_filter("headers", lambda k, v: ~k.isin(*NOT_MERGED))
    merged = F.map_concat(F.map_filter("old", lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    ok = F.col("outcome").isin("resolved", "unchecked")
    return found.withColumn("outcome", outcome).select(
        *keep,
        "record_id",
        "url",
        "canonical_url",
        "ts",
        "outcome",
        F.when(ok, F.col("hit.record_id")).alias("response_id"),
        F.when(ok, F.col("hit.payload_bytes")).alias("payload_bytes"),
        F.when(ok, F.col("hit.payload_sha256")).alias("payload_sha256"),
        F.when(ok, merged).alias("headers"),
    )


#: When the crawl of ``captures`` begins, and the seconds between two pages.
EPOCH, STEP = 1_700_000_000, 600


def captures(pages: DataFrame) -> DataFrame:
    """page_id and WARC bytes of a crawl of the pages: a response, and later a revisit by another spelling of the URL.

    An id that isn't a number counts by its CRC-32, a null one as 0. Pages whose id leaves 7 by 13 have a revisit only; the entity tag has changed where it leaves 5
    by 11; where it leaves 1 by 5 there are only dates.
    """

    def run(batches):
        for b in batches:
            blobs = []
            for page_id, url, page in zip(*(c.to_pylist() for c in b.columns)):
                n = page_id if isinstance(page_id, int) else zlib.crc32(str(page_id or "").encode())
                url, body = url or "", (page or "").encode()
                ts = EPOCH + n % 1_000_000 * STEP
                tag = hashlib.md5(body).hexdigest()[:16]
                dated = f"{datetime.fromtimestamp(EPOCH - n % 1000 * 3600, UTC):%a, %d %b %Y %H:%M:%S GMT}"
                headers = {"Content-Type": "text/html; charset=utf-8", "Server": "crawl", "Cache-Control": "max-age=60", "Content-Length": str(len(body)), "Last-Modified": dated}
                again = {"Date": f"{datetime.fromtimestamp(ts + 7200, UTC):%a, %d %b %Y %H:%M:%S GMT}", "Cache-Control": "max-age=600", "Content-Length": "0", "Last-Modified": dated}
                if n % 5 != 1:
                    headers["ETag"] = f'"{tag}"'
                    again["ETag"] = f'W/"{tag[::-1] if n % 11 == 5 else tag}"'
                parts = [] if n % 13 == 7 else [record_bytes(f"urn:capture:{n}:response", "response", url, ts, 200, headers, body)]
                parts.append(record_bytes(f"urn:capture:{n}:revisit", "revisit", url + ("&" if "?" in url else "?") + "utm_source=again" if "#" not in url else url, ts + 7200, 304, again, b""))
                blobs.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(blobs, pa.binary())], names=["page_id", "warc"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return arrow_map(pages.select("page_id", "url", "html"), run, f"page_id {kind}, warc binary")


def revisit_digest(pages: DataFrame) -> DataFrame:
    """Writes and reads the crawl of ``captures`` and resolves its revisits; merged headers as sorted lines."""
    found = resolve_revisits(read_warc(captures(pages), keep=("page_id",)), keep=("page_id",))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.withColumn("headers", F.array_join(lines, "\n"))
