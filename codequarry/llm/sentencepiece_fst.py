"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The model file is compiled into three machines. The normaliser rewrites by the model's character
map (longest match first, along its compiled trie) and then treats spaces by arcs of three states.
The lexicon's trie has an arc for each piece and, for a character that no piece stands for, one that
puts out its bytes. The acceptor weighs a piece by the one before it.

An input composed with them is a lattice over its places, and the encoding is the path of least
weight in the tropical semiring: weights add along a path, the lesser of two is taken where paths
meet. For a unigram model an arc weighs minus the piece's score. For a BPE model a pair of
neighbours weighs 0 if merging the pair's characters gives back just that pair, else infinity. The
one path of finite weight is the result of the merges, since the merges inside two neighbours
happen in the same order whatever stands around them; so no more than one finite path reaches a
place, and a place needs one weight and the piece before it.

Null texts count as empty; the empty text has no pieces. Words of any length take time that grows
with their length times the longest piece; of unigram paths that weigh the same the one whose last
piece begins first is taken; repeated rows give repeated results, and columns that clash with the
output are replaced by it.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, whole_text

SPACE = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2
#: Words whose encoding a worker keeps.
CACHE = 1 << 18


def _fields(data: bytes):
    """(field, value) of a protobuf message: int, 4 or 8 raw bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 2:
            n = varint()
            value = data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            value = data[at : at + n]
            at += n
        yield tag >> 3, value


_BEGIN, _WORD, _GAP = range(3)
_RUNS = re.compile(" +|[^ ]+")


class Normaliser:
    """The model's character map and treatment of spaces as a machine that is composed with an input."""

    def __init__(self, charsmap: bytes, prefix: bool, shrink: bool, escape: bool):
        mark = SPACE if escape else " "
        first = mark if prefix else ""
        #: By state and whether the run is of spaces: what goes before the run, what each of its characters becomes (None: itself), next state.
        self.arcs = {
            (_BEGIN, False): (first, None, _WORD),
            (_WORD, False): ("", None, _WORD),
            (_GAP, False): (mark, None, _WORD),
            (_BEGIN, True): ("", "", _BEGIN) if shrink else (first, mark, _WORD),
            (_WORD, True): ("", "", _GAP) if shrink else ("", mark, _WORD),
        }
        self.units, self.targets = np.zeros(0, "<u4"), b""
        if charsmap:
            size = int.from_bytes(charsmap[:4], "little")
            self.units, self.targets = np.frombuffer(charsmap[4 : 4 + size], "<u4"), charsmap[4 + size :]
        #: Whether no key holds a space beside other bytes, so that runs can be mapped one by one.
        self.by_run = not any(b" " in k and k.strip(b" ") for k in self._keys())
        self.mapped = lru_cache(CACHE)(self._mapped)

    def _keys(self):
        """All keys of the trie."""
        units = self.units
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        todo = [(offset(int(units[0])), b"")] if len(units) else []
        while todo:
            node, key = todo.pop()
            for c in range(1, 256):
                if node ^ c < len(units) and int(units[node ^ c]) & 0x800000FF == c:
                    unit = int(units[node ^ c])
                    if unit >> 8 & 1:
                        yield key + bytes([c])
                    todo.append((node ^ c ^ offset(unit), key + bytes([c])))

    def _longest(self, data: bytes, at: int) -> tuple[int, int]:
        """Length of the longest key of the trie that ``data`` goes on with, and where its target begins; a double-array trie."""
        units = self.units
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node, best = offset(int(units[0])), (0, -1)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = int(units[node])
            if unit & 0x800000FF != data[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                best = i + 1 - at, int(units[node]) & 0x7FFFFFFF
        return best

    def _mapped(self, run: str) -> str:
        data, out, at = run.encode(), [], 0
        while at < len(data):
            n, target = self._longest(data, at)
            if n:
                out.append(self.targets[target : self.targets.index(b"\0", target)])
            else:
                n = 1
                while at + n < len(data) and data[at + n] & 0xC0 == 0x80:
                    n += 1
                out.append(data[at : at + n])
            at += n
        return b"".join(out).decode()

    def __call__(self, text: str) -> str:
        given = text
        if len(self.units):
            text = "".join(map(self.mapped, _RUNS.findall(text))) if self.by_run else self._mapped(text)
        body = text.lstrip(" ")
        out, state = [], _BEGIN
        if len(body) < len(text):
            before, becomes, state = self.arcs[state, True]
            out += (before, becomes * (len(text) - len(body)))
        if body:
            out.append(self.arcs[state, False][0])
            _, becomes, after = self.arcs[_WORD, True]
            # a loop of one state only substitutes; else each gap is left by the arc of the next word
            out.append(body.replace(" ", becomes) if after == _WORD else self.arcs[_GAP, False][0].join(filter(None, body.split(" "))))
        elif given and not out and self.arcs[_WORD, True][2] == _WORD:
            out.append(self.arcs[_BEGIN, False][0])  # a text that the map takes away keeps the prefix
        return "".join(out)


class Transducer:
    """Normaliser, lexicon and neighbour acceptor of one model."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.model_type, prefix, shrink, escape, charsmap = _UNIGRAM, True, True, True, b""
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, _NORMAL))
            elif field == 2:
                self.model_type = dict(_fields(value)).get(3, _UNIGRAM)
            elif field == 3:
                norm = dict(_fields(value))
                charsmap, prefix = norm.get(2, b""), bool(norm.get(3, 1))
                shrink, escape = bool(norm.get(4, 1)), bool(norm.get(5, 1))
        if self.model_type not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.prefix, self.escape = prefix, escape
        self.normalise = Normaliser(charsmap, prefix, shrink, escape)
        self.unknown = self.kinds.index(_UNKNOWN)
        self.lexicon = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (_NORMAL, _USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _BYTE}
        self.longest = max(map(len, self.lexicon), default=1)
        #: The lexicon's states: by character the next one, and an empty key where a longer piece ends.
        self.states: dict = {}
        for p in self.lexicon:
            state = self.states
            for c in p:
                state = state.setdefault(c, {})
            if len(p) > 1:
                state[""] = True
        self.lowest = min((self.scores[i] for i in self.lexicon.values()), default=0.0)
        # no merge crosses a place that no piece spans: words are encoded one by one, and where no
        # piece goes on after a letter with anything but letters, so is what follows a letter
        self.by_word = escape and not any(SPACE in p.lstrip(SPACE) for p in self.lexicon)
        line = "" if any("\n" in p for p in self.lexicon) else "\n"
        letter = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0370-\u04ff"
        if any(re.search(f"[{letter}][^{letter}]", p) for p in self.lexicon):
            cut = f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+"
        else:
            cut = f"{SPACE}*[{letter}]+|{SPACE}*[^{SPACE}{line}{letter}]+[{letter}]*|{SPACE}+"
        self.cut = re.compile(cut + f"|{line}" * bool(line))
        #: What an arc puts out, four bytes an id.
        self.outputs = {p: struct.pack("<i", i) for p, i in self.lexicon.items()}
        self._word = lru_cache(CACHE)(self._shortest)
        self._pairs: dict[tuple[str, str], float] = {}
        self._weigh = self._merged if self.model_type == _BPE else self._scored

    def _merge(self, text: str) -> list[str]:
        """BPE by its definition: the best-scored neighbours join first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                piece = self.lexicon.get(parts[i] + parts[i + 1])
                if piece is not None and self.scores[piece] > best:
                    best, at = self.scores[piece], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _scored(self, before: str, piece: str) -> float:
        """The acceptor of a unigram model; a character without a piece costs more than any piece."""
        i = self.lexicon.get(piece)
        return 10.0 - self.lowest if i is None else -self.scores[i]

    def _merged(self, before: str, piece: str) -> float:
        """The acceptor of a BPE model: 0 if merging the characters of both gives back just them, else infinity."""
        weight = self._pairs.get((before, piece))
        if weight is None:
            if len(self._pairs) >= CACHE:
                self._pairs.clear()
            wanted = [before, piece] if before else [piece]
            weight = self._pairs[before, piece] = 0.0 if self._merge(before + piece) == wanted else math.inf
        return weight

    def _arcs(self, text: str, start: int) -> list[int]:
        """Ends of the lexicon's arcs from ``start``, shortest first; one character always is an arc."""
        out, end, state = [start + 1], start, self.states
        for c in text[start : start + self.longest]:
            state = state.get(c)
            if state is None:
                break
            end += 1
            if "" in state:
                out.append(end)
        return out

    def _path(self, text: str) -> list[str]:
        """The path of least weight through input o lexicon o acceptor."""
        last = (self._furthest_first if self.model_type == _BPE else self._by_place)(text)
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _by_place(self, text: str) -> list[str]:
        """The last piece of the least sum of weights into each place."""
        size, weigh = len(text), self._weigh
        total = [0.0] + [math.inf] * size
        last = [""] * (size + 1)
        for start in range(size):
            for end in self._arcs(text, start):
                piece = text[start:end]
                weight = total[start] + weigh(last[start], piece)
                if weight < total[end]:
                    total[end], last[end] = weight, piece
        return last

    def _furthest_first(self, text: str) -> list[str]:
        """The same where weights are 0 or infinite: all places that wait weigh the same, so the furthest may go first,
        and the search may end with the text; arcs are weighed when their turn comes."""
        size, weigh, known, infinite = len(text), self._weigh, self._pairs.get, math.inf
        last = [""] * (size + 1)
        todo = [(end, 0) for end in self._arcs(text, 0)]
        while todo:
            end, start = todo.pop()
            if last[end]:
                continue
            piece = text[start:end]
            weight = known((last[start], piece))
            if weight is None:
                weight = weigh(last[start], piece)
            if weight == infinite:
                continue
            last[end] = piece
            if end == size:
                break
            todo += [(far, end) for far in self._arcs(text, end)]
        return last

    def _shortest(self, text: str) -> bytes:
        """Output of the least-weight path, four bytes an id."""
        return b"".join([self.outputs.get(p) or self._fallback(p) for p in self._path(text)])

    def _fallback(self, piece: str) -> bytes:
        """What the arc of a character without a piece puts out: its bytes, or the unknown piece."""
        ids = [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]
        return struct.pack(f"<{len(ids)}i", *ids)

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        text = self.normalise(text)
        if not self.by_word:
            return self._shortest(text)
        return b"".join(map(self._word, self.cut.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<i4").tolist()

    def decode(self, ids) -> str:
        """Bytes of byte pieces are read as UTF-8; the dummy prefix goes."""
        out = self._joined(ids).replace(SPACE, " ") if self.escape else self._joined(ids)
        return out[1:] if self.prefix and out.startswith(" ") else out

    def _joined(self, ids) -> str:
        table = self._raw
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")

    @property
    def _raw(self) -> list[bytes]:
        if not hasattr(self, "_raws"):
            self._raws = [bytes([int(p[3:5], 16)]) if k == _BYTE else b"" if k == _CONTROL else " ⁇ ".encode() if k == _UNKNOWN else p.encode() for p, k in zip(self.pieces, self.kinds)]
        return self._raws


_LOADED: dict[int, Transducer] = {}


def _transducer(model: bytes) -> Transducer:
    """One per worker and model."""
    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Transducer(model)
    return _LOADED[key]


def _model(spark: SparkSession, path: str):
    """The file, read by the driver, for all workers; a model file has a fixed size of about a megabyte."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, text: str = "text", ids: str = "token_ids", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """All columns and ``ids``, the piece ids of each whole text; an ``ids`` column of the input is replaced."""
    model = _model(df.sparkSession, model_path)
    out = df.drop(ids)
    schema = out.withColumn(ids, F.array(F.lit(0))).schema
    where = out.columns.index(text)

    def run(batches):
        t = _transducer(model.value)
        for b in batches:
            found = [t.encode_packed(x or "") for x in b.column(where).to_pylist()]
            offsets = np.cumsum([0, *map(len, found)]) // 4
            flat = np.frombuffer(b"".join(found), "<i4")
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, ids])

    return arrow_map(out, run, schema)


def decode(df: DataFrame, ids: str = "token_ids", text: str = "decoded", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """All columns and ``text``, decoded; a null list gives an empty text."""
    model = _model(df.sparkSession, model_path)
    out = df.drop(text)
    schema = out.withColumn(text, F.lit("")).schema
    where = out.columns.index(ids)

    def run(batches):
        t = _transducer(model.value)
        for b in batches:
            found = [t.decode(x or []) for x in b.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=[*b.schema.names, text])

    return arrow_map(out, run, schema)


def encoding_digest(df: DataFrame, key: str = "doc_id", text: str = "text", model_path: str = DEFAULT_MODEL) -> DataFrame:
    """key, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256, round_trip."""
    model = _model(df.sparkSession, model_path)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        t = _transducer(model.value)
        for b in batches:
            n, ids_sha, back_sha, same = [], [], [], []
            for x in b.column(1).to_pylist():
                ids = t.encode_packed(x)
                back = t.decode(np.frombuffer(ids, "<i4").tolist())
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                back_sha.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(back_sha), pa.array(same)], names=["k", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    rows = df.select(F.col(key).alias("k"), whole_text(text).alias("t"))
    return arrow_map(rows, run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean").withColumnRenamed("k", key)
