"""Each operator against a brute-force version, over nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from codequarry.llm import decontamination, gif, html_text, licenses, pii, quality, sentencepiece_fst, simhash, substring_dedup, warc

random.seed(7)
VOCABULARY = [f"w{i}" for i in range(300)]
PASSAGE = " ".join(random.choices(VOCABULARY, k=60))


def words(n):
    return " ".join(random.choices(VOCABULARY, k=n))


TEXTS = [
    None,
    "",
    "   ",
    "one",
    "one two",
    "É🙂 wörld",
    "tie tie tie",
    "tie tie tie",
    PASSAGE,
    PASSAGE + " tail",
    words(20) + "\n" + PASSAGE + "\t" + words(30),
    words(100) + " " + PASSAGE,
    "a " * 5000,
    words(4000),
    "Mail to a.b@c.de, x@y.zz_d@e.fg! ip 10.0.0.255 and 300.1.1.1; card 4111 1111 1111 1111, +49 (30) 1234-5678 DE89 3704 0044 0532 0130 00.",
    "9" * 4000 + " 4111-1111-1111-1111 +1234567 1.2.3.4.5.6.7.8 @@ a@b",
    "Licensed under the Apache License, Version 2.0. CC  by cc-BY 4.0! General PUBLIC license; all rights\nreserved reserved",
    "accby general public licenses allrights reserved cc by",
    "4111111111111111@x.com 1.2.3.4@y.org 0000000000000.0.0.1 +4111111111111111",
    "%$# THE!! NOISE!! HERE!! IS!! LOUD!! AND!! GOES!! ON!! AND!! ON!!",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, "clash", 2.0) for i, t in enumerate(TEXTS)] + [(8, PASSAGE, "x", 1, "clash", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, __text string, fp int, key string, score double").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def by_id(rows):
    return {r.doc_id: r for r in rows}


def slow_feature(payload):
    """Frames of 256 rows over one another, pixel by pixel: index 0 keeps what is below."""
    step, canvas, counts, clock = 64 * 256, {}, [0] * 65, 0
    area = min(len(payload), step)
    parts = [payload[i : i + step] for i in range(0, len(payload), step)]
    for n, part in enumerate(parts):
        before = dict(canvas)
        canvas.update((i, v) for i, v in enumerate(part) if v)
        for i in range(area):
            v = canvas.get(i)
            counts[64 if v is None else (v >> 6) * 16 + (v >> 3 & 3) * 4 + (v & 3)] += 1
        clock += 10 + n % 5
        if n % 3 == 1:  # this frame's place is cleared
            for i in range(len(part)):
                canvas.pop(i, None)
        elif n % 3 == 2:
            canvas = before
    return f"frames={len(parts)};cs={clock};hist={','.join(map(str, counts))}"


def test_gif_stores_texts(docs, none):
    assert gif.gif_media(none).count() == 0
    rows = gif.gif_media(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        raw = (TEXTS[r.doc_id] or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        media = gif.payload_gif(payload)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert r.feature == slow_feature(payload)


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_lzw_round_trip(bits):
    for n in (0, 1, 2, 100, 5000, 60000):
        for data in (bytes(random.randrange(1 << bits) for _ in range(n)), bytes(n)):
            assert gif.lzw_decode(gif.lzw_encode(data, bits), bits) == data


def test_gif_long_payload_takes_several_frames():
    payload = bytes(64 * (gif.FRAME_ROWS + 3))
    back, frames = gif.gif_payload(gif.payload_gif(payload))
    assert back == payload and [f.height for f in frames] == [gif.FRAME_ROWS, 3]


def test_gif_disposal_transparency_and_interlace(spark):
    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0])
    frames = [
        gif.Frame(4, 8, bytes([0] * 32), delay_cs=5, disposal=1),
        gif.Frame(2, 2, bytes([1, 3, 3, 1]), 1, 1, delay_cs=7, disposal=3, transparent=3),
        gif.Frame(4, 4, bytes([2] * 16), delay_cs=9, disposal=2),
        gif.Frame(1, 8, bytes(range(4)) * 2, delay_cs=1, interlaced=True, palette=palette[::-1]),
    ]
    media = gif.encode_gif(4, 8, palette, frames)
    assert [f.samples for f in gif.read_gif(media)[3]] == [f.samples for f in frames]
    shown = [(start, delay, canvas.copy()) for start, delay, canvas in gif.composed(media)]
    assert [s[:2] for s in shown] == [(0, 5), (5, 7), (12, 9), (21, 1)]
    assert shown[1][2][1, 1].tolist() == [0, 255, 0, 255] and shown[1][2][1, 2].tolist() == [255, 0, 0, 255]
    assert shown[2][2][5, 1].tolist() == [255, 0, 0, 255]  # frame 1 was undone
    assert shown[3][2][0, 1].tolist() == [0, 0, 0, 0]  # frame 2 was cleared
    rows = gif.gif_frames(spark.createDataFrame([(1, bytearray(media)), (2, None), (3, bytearray(b"GIF89a"))], "k long, media binary"), "k").collect()
    assert [(r.k, r.frame_no, r.start_cs) for r in rows] == [(1, 0, 0), (1, 1, 5), (1, 2, 12), (1, 3, 21)]
    assert all(sum(r.histogram) == 32 for r in rows)


def test_gif_with_a_huge_canvas_has_no_frames(spark):
    head = b"GIF89a" + (65535).to_bytes(2, "little") * 2 + b"\x80\0\0" + bytes(6)
    image = b"\x2c" + bytes(4) + b"\1\0\1\0\0" + b"\2\2\x44\1\0"
    large = head + b"\x2c" + bytes(4) + (65535).to_bytes(2, "little") * 2 + b"\0\2\2\x44\1\0\x3b"
    rows = [(1, bytearray(head + image + b"\x3b")), (2, bytearray(large)), (3, bytearray(gif.payload_gif(bytes(64))))]
    assert [r.k for r in gif.gif_frames(spark.createDataFrame(rows, "k long, media binary"), "k").collect()] == [3]


def page(body):
    return f"<html><head><title>T</title></head><body>{body}</body></html>"


def test_html_main_text(spark):
    article = "<article><h1>Title</h1><p><b>One,&nbsp; two &amp; three<br>four<p>Five &#233;</p></article>"
    around = "<nav><a href=/>Home</a></nav><div class='cookie-notice'>We use</div><header>Top</header>{}<aside>Side</aside><form>Mail</form><div id=comments><p>nice, very nice, indeed</p></div><footer>End</footer><script>x='<p>no</p>'</script>"
    want = "Title\nOne, two & three four\nFive é"
    assert html_text.main_text(page(around.format(article))) == want
    plain = article.replace("article", "div")
    assert html_text.main_text(page(around.format(plain))) == want
    assert html_text.main_text(page("<div><p>Some words, and more</p><ul><li><a href=a>A</a><li><a href=b>B</a></ul></div>")) == "Some words, and more"
    for odd in (None, "", "<", "<p", "</div>", "<!-- open", "&", "<script>only", "<a href='x", "<html><body></body></html>"):
        assert isinstance(html_text.main_text(odd), str)
    deep = "<div>" * 3000 + "<p>deep words, here</p>"
    assert html_text.main_text(deep) == "deep words, here"
    df = spark.createDataFrame([(1, "u", page(article), "c"), (2, None, None, None), (1, "u", page(article), "c")], "page_id long, url string, html string, n_chars string")
    rows = html_text.extract_main_text(df, keep=("page_id", "url")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in rows) == [(1, want, len(want))] * 2 + [(2, "", 0)]


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
)


def test_pii_spans(docs, none, spark):
    assert pii.pii_digest(none).count() == 0
    noise = ["".join(random.choices("ab1239.@-+ ()_%é🙂", k=random.randrange(60))) for _ in range(400)]
    more = spark.createDataFrame(list(enumerate(noise, 1000)), "doc_id long, text string")
    texts = {**dict(enumerate(TEXTS)), **dict(enumerate(noise, 1000))}
    rows = pii.pii_digest(docs).collect() + pii.pii_digest(more).collect()
    seen = Counter()
    for r in rows:
        spans = []
        for k, (name, pattern, good) in enumerate(KINDS):
            for m in re.finditer(pattern, texts[r.doc_id] or ""):
                if good(m.group()):
                    spans.append((m.start(), k, f"{name}:{m.start()}:{m.end()}"))
                    seen[name] += 1
        listed = [s for _, _, s in sorted(spans)]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest(), (texts[r.doc_id], listed, r.spans)
        assert set(listed) <= set(r.spans.split(","))
    assert min(seen.values()) > 0 and len(seen) == 4
    assert "iban:" in by_id(rows)[14].spans
    out = pii.pii_spans(docs, spans="s").withColumn("clean", pii.redacted("text", "s")).where("doc_id = 14").first()
    assert out.clean.startswith("Mail to [EMAIL], [EMAIL][EMAIL]! ip [IP] and 300.1.1.1; card [CARD], [PHONE]")


def test_license_scan(docs, none):
    assert licenses.license_digest(none).count() == 0
    assert len(licenses.rules()) >= 200
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = licenses.license_digest(docs).collect()
    for r in rows:
        w = word.findall((TEXTS[r.doc_id] or "").translate(lower))
        places = []
        for phrase, label in licenses.BASE_PHRASES:
            p = phrase.split()
            places += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places}))
        assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
    assert "apache-2.0" in by_id(rows)[16].labels.split(",")


def brute_windows(docs, k):
    count = Counter()
    split = [(i, (t or "").encode().split()) for i, t in docs]
    for _, w in split:
        count.update(tuple(w[a : a + k]) for a in range(len(w) - k + 1))
    out = []
    for i, w in split:
        gone = set()
        for a in range(len(w) - k + 1):
            if count[tuple(w[a : a + k])] > 1:
                gone.update(range(a, a + k))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("k", "share", "least"), [(35, 1e-6, 1000), (35, 1e-9, 2), (7, 1e-9, 3), (4, 1e-4, 64)])
def test_substring_dedup(docs, none, k, share, least):
    assert substring_dedup.substring_dedup(none).count() == 0
    rows = substring_dedup.substring_dedup(docs, k=k, share=share, least=least).collect()
    want = brute_windows([(i, t) for i, t in enumerate(TEXTS)] + [(8, PASSAGE)], k)
    assert sorted(map(tuple, rows)) == want


def _thue_morse(n):
    x = [0]
    while len(x) < n:
        x += [1 - b for b in x]
    return x


def test_words_that_collide_in_polynomial_hashes_differ(spark):
    a = "".join("ab"[b] for b in _thue_morse(1024))
    b = "".join("ba"[b] for b in _thue_morse(1024))
    around = [words(20), words(20)]
    texts = [(0, f"{around[0]} {a} {around[1]}"), (1, f"{around[0]} {b} {around[1]}")]
    rows = substring_dedup.substring_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(map(tuple, rows)) == brute_windows(texts, 35)
    assert all(r.n_removed == 0 for r in rows)


def test_one_fingerprint_of_different_windows_is_told_apart(monkeypatch):
    monkeypatch.setattr(substring_dedup.Words, "grams", lambda self, n: np.zeros(max(0, len(self.hash) - n + 1), np.uint64))
    strings = [b"a b c d", b"x b c d", b"a b c e"]
    who, where = substring_dedup._repeated_windows(strings, np.array([1, 1, 1]), 3)
    assert sorted(zip(who.tolist(), where.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 0)]


@pytest.mark.parametrize("least", [20, 1000])
def test_hot_passage_between_different_neighbours(spark, least):
    texts = [(i, f"{words(40)} {PASSAGE} {words(40)}" if i % 3 else words(90)) for i in range(240)] + [(900 + i, "") for i in range(100)] + [(2000 + i, PASSAGE) for i in range(100)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    rows = substring_dedup.substring_dedup(docs, least=least).collect()
    assert sorted(map(tuple, rows)) == brute_windows(texts, 35)


def test_tokenizer_agrees_with_the_library(docs, none):
    library = pytest.importorskip("sentencepiece")
    path = sentencepiece_fst.DEFAULT_MODEL
    known = library.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        own = sentencepiece_fst.Transducer(f.read())
    texts = [t or "" for t in TEXTS] + ["".join(random.choices(" ab▁e\n\t\x00théü漢字🙂AB1,.", k=random.randrange(40))) for _ in range(500)]
    for t in texts:
        ids = known.encode(t)
        assert own.encode(t) == ids
        assert own.decode(ids) == known.decode(ids)
    assert sentencepiece_fst.encoding_digest(none).count() == 0
    for r in sentencepiece_fst.encoding_digest(docs).collect():
        assert r.round_trip and r.n_tokens == len(known.encode(TEXTS[r.doc_id] or ""))
    both = sentencepiece_fst.decode(sentencepiece_fst.encode(docs)).collect()
    assert all(r.decoded == (r.text or "") and r.key == "clash" for r in both)


def test_unigram_path_is_the_least(tmp_path):
    def field(n, kind, body):
        return bytes([n << 3 | kind]) + (bytes([len(body)]) if kind == 2 else b"") + body

    pieces = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁ab", -4.0, 1), ("c", -1.5, 1), ("bc", -2.5, 1)]
    model = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, np.float32(s).tobytes()) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    t = sentencepiece_fst.Transducer(model + field(2, 2, field(3, 0, b"\x01")))
    assert [t.pieces[i] for i in t.encode("abc")] == ["▁a", "bc"] and [t.pieces[i] for i in t.encode("ab")] == ["▁a", "b"]
    assert t.encode("ax") == [1, 0]


def double_array(rules):
    """A compiled character map: the units of a double-array trie over the keys' bytes, and the targets."""
    targets, places = b"", {}
    for key, value in rules.items():
        places[key.encode()] = len(targets)
        targets += value.encode() + b"\0"
    units, taken = {0: 0}, {0}
    todo = [(0, b"")]
    while todo:
        at, prefix = todo.pop(0)
        next_bytes = sorted({k[len(prefix)] for k in places if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in places
        for base in range(1, 1 << 16):
            free = (base ^ at) & ~0x1FFFFF == 0 and base not in taken and all(base ^ c not in taken for c in next_bytes)
            offset = base ^ at
            if free and offset < 1 << 21:
                break
        taken.add(base)
        units[at] |= offset << 10 | (256 if leaf else 0)
        if leaf:
            units[base] = places[prefix] | 1 << 31
        for c in next_bytes:
            taken.add(base ^ c)
            units[base ^ c] = c
            todo.append((base ^ c, prefix + bytes([c])))
    n = (max(units) // 256 + 1) * 256
    blob = b"".join(units.get(i, 0).to_bytes(4, "little") for i in range(n))
    return len(blob).to_bytes(4, "little") + blob + targets


def test_character_map_agrees_with_the_library():
    library = pytest.importorskip("sentencepiece")
    rules = {"Ａ": "A", "ﬁ": "fi", "\u3000": " ", "\t": " ", "é": "e\u0301", "e\u0301x": "[ex]", "ß": "ss", "\u200b": "", "...": "…"}
    charsmap = double_array(rules)

    def field(n, kind, body):
        size, out = len(body), b""
        while kind == 2:
            out += bytes([size & 127 | (128 if size > 127 else 0)])
            size >>= 7
            if not size:
                break
        return bytes([n << 3 | kind]) + out + body

    letters = [chr(c) for c in (*range(33, 127), 0x2581, 0x301, 0x2026, 0x2047)]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((c, -5.0 - i / 100, 1) for i, c in enumerate(letters)), ("▁A", -2.0, 1), ("fi", -2.5, 1), ("[ex]", -3.0, 1)]
    body = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, np.float32(s).tobytes()) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    for shrink in (0, 1):
        model = body + field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(2, 2, charsmap) + field(3, 0, b"\x01") + field(4, 0, bytes([shrink])) + field(5, 0, b"\x01"))
        known = library.SentencePieceProcessor(model_proto=model)
        own = sentencepiece_fst.Transducer(model)
        rng = random.Random(4)
        texts = ["", " ", "Ａ", " Ａ  ﬁ\u3000x ", "e\u0301x e\u0301y éx", "a\t\tb", "....", "\u200b", "x\u200b y"]
        texts += ["".join(rng.choices([*rules, " ", "a", "x", "e", ".", "fi"], k=rng.randrange(12))) for _ in range(300)]
        for t in texts:
            assert own.encode(t) == known.encode(t), (shrink, t)


def test_path_is_the_least_of_all(spark):
    with open(sentencepiece_fst.DEFAULT_MODEL, "rb") as f:
        own = sentencepiece_fst.Transducer(f.read())

    def every(text, start=0, before=""):
        if start == len(text):
            yield 0.0, []
        for end in own._arcs(text, start) if start < len(text) else ():
            weight = own._weigh(before, text[start:end])
            for rest, path in every(text, end, text[start:end]):
                yield weight + rest, [text[start:end], *path]

    for word in ("▁banana", "▁theater", "▁über", "▁aaaa", "▁12ab", "▁🙂a"):
        paths = [p for w, p in every(word) if w == 0]
        assert paths == [own._path(word)]


def brute_simhash(text):
    import xxhash

    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(docs, none, spark):
    assert simhash.near_duplicates(none).count() == 0
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    prints = {i: brute_simhash(t) for i, t in enumerate(TEXTS)}
    assert all(int(r.fingerprint, 16) == prints[r.doc_id] for r in rows)
    root = {i: min(j for j in reach(i, prints)) for i in prints}
    assert all(r.component_id == root[r.doc_id] for r in rows)


def reach(i, prints, radius=3):
    seen, todo = {i}, [i]
    while todo:
        x = todo.pop()
        new = [j for j in prints if j not in seen and bin(prints[x] ^ prints[j]).count("1") <= radius]
        seen.update(new)
        todo += new
    return seen


def test_ball_hashing_finds_every_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64).tolist()
    prints = set(base)
    for b in base:
        for _ in range(6):
            x = b
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = {i: p & (2**64 - 1) for i, p in enumerate(sorted(prints))}
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints.values()]
    links = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 3 for r in links)
    where = {p: i for i, p in prints.items()}
    parent = dict.fromkeys(prints)
    group = {i: {i} for i in prints}
    for r in links:
        a, b = (group[where[x & (2**64 - 1)]] for x in (r.a, r.b))
        if a is not b:
            a |= b
            for x in b:
                group[x] = a
    assert all(group[i] == reach(i, prints) for i in parent)


def test_decontamination(docs, none, spark):
    changed = PASSAGE.split()
    changed[3] = "other"
    items = spark.createDataFrame([(1, PASSAGE.upper() + "."), (2, " ".join(changed)), (3, None), (4, ""), (5, "tie, tie tie"), (6, words(40)), (6, words(30))], "item_id long, text string")
    assert decontamination.contamination(none, items).count() == 0
    assert decontamination.contamination(docs, items.limit(0)).count() == 0
    found = {(r.doc_id, r.item_id): r for r in decontamination.contamination(docs, items).collect()}
    with_passage = {i for i, t in enumerate(TEXTS) if t and PASSAGE in t}
    assert {d for d, i in found if i == 1} == with_passage and {d for d, i in found if i == 5} == {6, 7}
    assert found[10, 1].start_word == 20 and found[10, 1].similarity == 1.0
    assert {d for d, i in found if i == 2} == with_passage and all(0.8 <= r.similarity < 1 for (d, i), r in found.items() if i == 2)
    clean = decontamination.without_contaminated(docs, items)
    assert {r.doc_id for r in clean.collect()} == set(range(len(TEXTS))) - {d for d, _ in found} and clean.columns == docs.columns


def test_quality(docs, none, spark):
    assert quality.quality(none).count() == 0
    assert len(quality.quality(docs).collect()) == len(TEXTS) + 1
    rng = random.Random(1)
    good = ["the of and to in is that it was for".split(), [f"word{i}" for i in range(200)]]

    def plain():
        return " ".join(rng.choice(good[rng.random() < 0.6]) for _ in range(80)) + "."

    makers = [plain, plain, plain, plain, lambda: plain().upper().replace(" ", "!! "), lambda: plain().replace(" ", "%$# "), lambda: " ".join([rng.choice(good[1])] * 90)]
    rows = [(i, makers[i % 7](), int(i % 7 < 4)) for i in range(700)]
    out = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, q int"), sample=300).collect()}
    assert sum(out[i].kept == bool(q) for i, _, q in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 and 0 <= r.label <= 1 for r in out.values())


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.7
    accuracy = [0.9, 0.8, 0.95, 0.7, 0.85, 0.9, 0.8, 0.75]
    v = np.stack([np.where(rng.random(20000) < 0.3, -1, np.where(rng.random(20000) < a, truth, ~truth)) for a in accuracy], axis=1).astype(np.int8)
    model = quality.fit_label_model(v, np.ones(len(v)))
    assert abs(model.prior - 0.7) < 0.03
    assert all(abs(model.chance[1, i, 2] - a) < 0.04 for i, a in enumerate(accuracy))


def test_warc_round_trip_and_revisits(spark):
    body = "é\r\n\r\nWARC/1.1".encode()
    data = warc.record_bytes("urn:1", "response", "http://e.org/a", 100, 200, {"ETag": '"x"', "Content-Length": "9", "A": "1"}, body) + warc.record_bytes("urn:2", "revisit", "http://e.org/a#f", 200, 304, {"ETag": 'W/"x"', "A": "2", "Connection": "close"}, b"")
    found = list(warc.parse_records(data + b"WARC/1.1\r\nContent-Length: 99"))
    assert [f[:5] for f in found] == [("urn:1", "response", "http://e.org/a", 100, 200), ("urn:2", "revisit", "http://e.org/a#f", 200, 304)]
    assert found[0][6] == body
    blobs = spark.createDataFrame([(1, bytearray(data), "c"), (2, None, "c"), (3, bytearray(b"junk"), "c")], "n long, warc binary, url string")
    r = warc.resolve_revisits(warc.read_warc(blobs, keep=("n",)), keep=("n",)).collect()
    assert len(r) == 1 and (r[0].outcome, r[0].response_id, r[0].payload_sha256) == ("resolved", "urn:1", hashlib.sha256(body).hexdigest())
    assert r[0].headers == {"etag": 'W/"x"', "content-length": "9", "a": "2"}


def test_revisits_against_brute_force(spark):
    rng = random.Random(5)
    urls = ["http://www.E.org/a/", "https://m.e.org:443/a#x", "http://e.org/a?utm_source=1", "http://e.org/b?y=1&x=2", "http://e.org/b?x=2&y=1&ref=q", "", None]
    rows = []
    for i in range(400):
        full = rng.random() < 0.4
        headers = {k: v for k, v in (("etag", rng.choice(['"1"', 'W/"1"', '"2"', None])), ("last-modified", rng.choice(["m1", "m2", None]))) if v}
        rows.append((f"r{i:03}", "response" if full else "revisit", rng.choice(urls), rng.randrange(4) * warc.DAY + rng.randrange(6), 200 if full else 304, headers, i, f"s{i}"))
    df = spark.createDataFrame(rows, "record_id string, kind string, url string, ts long, status int, headers map<string,string>, payload_bytes long, payload_sha256 string")
    got = {r.record_id: (r.outcome, r.response_id) for r in warc.resolve_revisits(df).collect()}
    canon = {None: "", "": "", urls[0]: "e.org/a", urls[1]: "e.org/a", urls[2]: "e.org/a", urls[3]: "e.org/b?x=2&y=1", urls[4]: "e.org/b?x=2&y=1"}
    want = {}
    for rid, kind, url, ts, _, h, *_ in rows:
        if kind == "response":
            continue
        before = [(r[3], r[0], r[5]) for r in rows if r[1] == "response" and canon[url] and canon[r[2]] == canon[url] and r[3] < ts]
        if not before:
            want[rid] = ("no_response", None)
            continue
        _, hit, old = max(before, key=lambda x: x[:2])
        strip = lambda t: t.removeprefix("W/")
        if "etag" in h and "etag" in old:
            outcome = "resolved" if strip(h["etag"]) == strip(old["etag"]) else "mismatch"
        elif "last-modified" in h and "last-modified" in old:
            outcome = "resolved" if h["last-modified"] == old["last-modified"] else "mismatch"
        else:
            outcome = "unchecked"
        want[rid] = (outcome, None if outcome == "mismatch" else hit)
    assert got == want and len(set(v[0] for v in want.values())) == 4
    assert warc.resolve_revisits(df.limit(0)).count() == 0
