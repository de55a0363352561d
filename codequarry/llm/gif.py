"""GIF media columns: LZW code streams, palettes, disposal, transparency and timed frames.

``encode_gif`` and ``decode_gif`` work on bytes; ``text_to_gif`` and ``gif_frames`` are the
DataFrame operators; ``gif_media`` stores texts as GIFs, reads them back and describes their composed
frames. Defined results: a null text counts as empty; null or damaged media, or media whose canvas
has more pixels than the parameter ``most`` of gif_frames (None: no limit), gives no frames; frames are composed one at a time; equal bytes give
equal results, repeated rows too; and extra columns of the input are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, whole_text

ROW = 64
#: Rows of one frame at most, so that a frame holds 16 KiB; a longer payload goes to more frames.
FRAME_ROWS = 256
#: Pixels of a canvas at most unless a caller says otherwise, which bounds the memory of damaged or hostile files.
MAX_PIXELS = 1 << 26
_FULL = 4096


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """The variable-width LZW code stream of samples below 2**bits."""
    clear = 1 << bits
    codes, table, next_code = [clear], {}, clear + 2
    put = codes.append
    prefix = -1
    find = table.get
    for s in samples:
        if prefix < 0:
            prefix = s
            continue
        key = prefix << 8 | s
        known = find(key)
        if known is not None:
            prefix = known
            continue
        put(prefix)
        prefix = s
        if next_code < _FULL:
            table[key] = next_code
            next_code += 1
        else:
            put(clear)
            table.clear()
            next_code = clear + 2
    if prefix >= 0:
        put(prefix)
    put(clear + 1)
    return _pack(np.array(codes, dtype=np.uint32), bits)


@cache
def _widths(bits: int) -> np.ndarray:
    """Bits of the k-th code after a clear code: as many as the table's codes need, 12 at most; the last goes for all further ones."""
    top = np.minimum((1 << bits) + 1 + np.arange(_FULL), _FULL - 1)
    return np.maximum(bits + 1, np.floor(np.log2(top)).astype(np.int64) + 1)


@cache
def _ends(bits: int) -> np.ndarray:
    """Where the k-th code after a clear code ends."""
    return np.cumsum(_widths(bits))


def _pack(codes: np.ndarray, bits: int) -> bytes:
    clears = np.flatnonzero(codes == 1 << bits)
    since = np.arange(len(codes)) - np.repeat(clears, np.diff(np.append(clears, len(codes)))) - 1
    # a clear code still has the width that the table before it had
    since[clears[1:]] = np.diff(clears) - 1
    since[0] = 0
    width = _widths(bits)[np.minimum(since, _FULL - 1)]
    ends = np.cumsum(width)
    at = ends - width
    spread = codes.astype(np.int64) << (at & 7)
    n = (int(ends[-1]) + 7) // 8
    # codes share bytes but no bits, so sums put them together
    out = sum(np.bincount((at >> 3) + i, weights=(spread >> (8 * i)) & 255, minlength=n + 3) for i in range(3))
    return out[:n].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, bits: int = 8, size: int | None = None) -> bytes:
    """The samples of a code stream; also of encoders that clear late or never.

    Widths follow from a code's place after the last clear code, so the codes of a whole table
    are cut out at once and only the phrases are looked up one by one.
    """
    clear, end = 1 << bits, (1 << bits) + 1
    total, widths = 8 * len(stream), _widths(bits)
    four = np.ndarray((len(stream),), dtype="<u4", buffer=stream + bytes(4), strides=(1,))
    out: list[bytes] = []
    at, length, wanted = 0, 0, float("inf") if size is None else size
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, previous, since = list(roots), b"", 0
    while length < wanted:
        n = min(_FULL - clear, (total - at) // (bits + 1))
        if since:
            width = widths[np.minimum(since + np.arange(n), _FULL - 1)]
            ends = at + np.cumsum(width)
        else:
            width, ends = widths[:n], at + _ends(bits)[:n]
        n = int(np.searchsorted(ends, total, side="right"))
        if not n:
            break
        width, ends = width[:n], ends[:n]
        begin = ends - width
        codes = four[begin >> 3] >> (begin & 7).astype(np.uint32) & ((1 << width) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else n
        for c in codes[:stop].tolist():
            if c < len(table):
                phrase = table[c]
            elif c == len(table) and previous:
                phrase = previous + previous[:1]
            else:
                raise ValueError("LZW code out of range")
            if previous and len(table) < _FULL:
                table.append(previous + phrase[:1])
            out.append(phrase)
            length += len(phrase)
            if length >= wanted:
                break
            previous = phrase
        since += stop
        at = int(ends[stop]) if stop < n else int(ends[-1])
        if stop < n:
            if codes[stop] == end:
                break
            table, previous, since = list(roots), b"", 0
    data = b"".join(out)
    return data if size is None else data[:size]


@dataclass
class Frame:
    """One image: samples are palette indices in row order."""

    width: int
    height: int
    samples: bytes
    left: int = 0
    top: int = 0
    palette: bytes | None = None
    delay_cs: int = 0
    disposal: int = 0
    transparent: int | None = None
    interlaced: bool = False


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(b := data[i : i + 255])]) + b for i in range(0, len(data), 255)) + b"\0"


def _lace(height: int) -> np.ndarray:
    """Stored order of the rows of an interlaced image."""
    return np.concatenate([np.arange(a, height, step) for a, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def encode_gif(width: int, height: int, palette: bytes, frames: list[Frame]) -> bytes:
    """A GIF89a file; the global palette has 2 to 256 colours as RGB bytes."""
    depth = max(1, (len(palette) // 3 - 1).bit_length())
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | 0x70 | depth - 1, 0, 0), palette.ljust(3 << depth, b"\0")]
    for f in frames:
        shown = 0 if f.transparent is None else 1
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", f.disposal << 2 | shown, f.delay_cs, f.transparent or 0) + b"\0")
        own = max(1, (len(f.palette) // 3 - 1).bit_length()) if f.palette else depth
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, f.width, f.height, (0x80 | own - 1 if f.palette else 0) | (0x40 if f.interlaced else 0)))
        if f.palette:
            out.append(f.palette.ljust(3 << own, b"\0"))
        samples = f.samples
        if f.interlaced:
            samples = np.frombuffer(samples, np.uint8).reshape(f.height, f.width)[_lace(f.height)].tobytes()
        bits = max(2, own)
        out.append(bytes([bits]) + _blocks(lzw_encode(samples, bits)))
    out.append(b"\x3b")
    return b"".join(out)


def _fits(width: int, height: int, most: int | None) -> bool:
    return most is None or width * height <= most


def read_gif(data: bytes, most: int | None = MAX_PIXELS) -> tuple[int, int, bytes, list[Frame]]:
    """Canvas width and height, global palette, frames. Raises ValueError for damaged files and frames of more than ``most`` pixels."""
    try:
        return _read(data, most)
    except (IndexError, struct.error) as e:
        raise ValueError("truncated GIF") from e


def _read(data: bytes, most: int | None) -> tuple[int, int, bytes, list[Frame]]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, palette = 13, b""
    if flags & 0x80:
        palette = data[at : at + (6 << (flags & 7))]
        at += len(palette)
    frames, control = [], (0, 0, None)

    def joined(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = joined(at + 2)
            if kind == 0xF9:
                f, delay, index = struct.unpack("<BHB", body[:4])
                control = (delay, f >> 2 & 7, index if f & 1 else None)
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown GIF block")
        left, top, w, h, f = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        own = None
        if f & 0x80:
            own = data[at : at + (6 << (f & 7))]
            at += len(own)
        bits = data[at]
        if not 1 <= bits <= 8 or not _fits(w, h, most):
            raise ValueError("too many colours or pixels")
        stream, at = joined(at + 1)
        samples = lzw_decode(stream, bits, w * h)
        if len(samples) < w * h:
            raise ValueError("too few samples")
        if f & 0x40:
            rows = np.empty((h, w), np.uint8)
            rows[_lace(h)] = np.frombuffer(samples, np.uint8).reshape(h, w)
            samples = rows.tobytes()
        frames.append(Frame(w, h, samples, left, top, own, control[0], control[1], control[2], bool(f & 0x40)))
        control = (0, 0, None)
    return width, height, palette, frames


def composed(data: bytes, most: int | None = MAX_PIXELS) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start in 1/100 s, duration, RGBA canvas) of each frame after disposal and transparency.

    Disposal 2 clears the frame's rectangle afterwards, 3 restores what was there before;
    others leave it. A sample equal to the transparent index keeps the canvas below. The canvas is
    the same array for all frames.
    """
    return _composed(*read_gif(data, most), most)


def _composed(width: int, height: int, shared: bytes, frames: list[Frame], most: int | None = MAX_PIXELS) -> Iterator[tuple[int, int, np.ndarray]]:
    if not _fits(width, height, most):
        raise ValueError("canvas too large")
    canvas, clock = np.zeros((height, width), "<u4"), 0
    shown = canvas.view(np.uint8).reshape(height, width, 4)
    for f in frames:
        colours = np.zeros((256, 4), np.uint8)
        rgb = np.frombuffer(f.palette or shared, np.uint8).reshape(-1, 3)
        colours[: len(rgb), :3] = rgb
        colours[:, 3] = 255
        area = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        before = area.copy() if f.disposal == 3 else None
        index = np.frombuffer(f.samples, np.uint8).reshape(f.height, f.width)[: area.shape[0], : area.shape[1]]
        drawn = colours.view("<u4").ravel()[index]
        if f.transparent is None:
            area[:] = drawn
        else:
            np.copyto(area, drawn, where=index != f.transparent)
        yield clock, f.delay_cs, shown
        clock += f.delay_cs
        if f.disposal == 2:
            area[:] = 0
        elif before is not None:
            area[:] = before


def histogram(canvas: np.ndarray, bits: int = 2) -> np.ndarray:
    """Pixels of each cell of a grid of opaque RGB colours by the upper ``bits`` (1 or 2) of each part; the last number counts see-through ones."""
    part = canvas >> (8 - bits)
    cell = part[..., 0] << (2 * bits) | part[..., 1] << bits | part[..., 2]
    cell[canvas[..., 3] == 0] = 8**bits
    return np.bincount(cell.ravel(), minlength=8**bits + 1)


#: Three bits of red, three of green, two of blue.
CUBE = bytes(v for i in range(256) for v in ((i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85))


def payload_gif(payload: bytes) -> bytes:
    """A payload of whole rows of 64 bytes as frames of 64 columns over one another.

    Frames stay, clear their place or give it back by turns; their padding, index 0, is see-through.
    """
    rows = len(payload) // ROW
    step = FRAME_ROWS * ROW
    parts = [payload[i : i + step] for i in range(0, len(payload), step)]
    return encode_gif(ROW, min(rows, FRAME_ROWS), CUBE, [Frame(ROW, len(p) // ROW, p, delay_cs=10 + i % 5, disposal=1 + i % 3, transparent=0) for i, p in enumerate(parts)])


def gif_payload(media: bytes) -> tuple[bytes, list[Frame]]:
    frames = read_gif(media)[3]
    return b"".join(f.samples for f in frames), frames


def text_to_gif(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key and the text's UTF-8 bytes, padded with zeros to whole rows of 64, as a GIF.

    Null and empty texts give one row of zeros.
    """
    schema = df.select(F.col(key), F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("media")).schema

    def store(batches):
        for b in batches:
            raw = [(x or "").encode() for x in b.column(1).to_pylist()]
            media = [payload_gif(x + b"\0" * (-len(x) % ROW if x else ROW)) for x in raw]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=schema.names)

    return arrow_map(df.select(key, text), store, schema)


def gif_frames(df: DataFrame, key: str, media: str = "media", most: int | None = MAX_PIXELS) -> DataFrame:
    """Timed frames: key, frame_no, start_cs, duration_cs, width, height, rgba, histogram.

    Rows whose media is null or damaged, or whose canvas has more than ``most`` pixels, give no frames.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, frame_no int, start_cs long, duration_cs int, width int, height int, rgba binary, histogram array<long>"

    def frames(batches):
        for b in batches:
            for k, m in zip(b.column(0), b.column(1).to_pylist()):
                try:
                    read = read_gif(m, most) if m is not None else (0, 0, b"", [])
                except ValueError:
                    continue
                if not _fits(read[0], read[1], most):
                    continue
                for i, (start, delay, canvas) in enumerate(_composed(*read, most)):
                    row = [[k.as_py()], [i], [start], [delay], [canvas.shape[1]], [canvas.shape[0]], [canvas.tobytes()], [histogram(canvas).tolist()]]
                    types = [b.column(0).type, pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["key", "frame_no", "start_cs", "duration_cs", "width", "height", "rgba", "histogram"])

    named = "key " + schema.split("`", 2)[2].strip()
    return arrow_map(df.select(key, media), frames, named).withColumnRenamed("key", key)


def media_digest(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads media back: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The feature joins the frame count, the total duration and the colour histograms of the composed
    frames, summed up. Media must be readable.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def one(media: bytes) -> tuple:
        width, height, shared, frames = read_gif(media)
        back = b"".join(f.samples for f in frames)
        length, bins = 0, 0
        for start, delay, canvas in _composed(width, height, shared, frames):
            length, bins = start + delay, bins + histogram(canvas)
        feature = f"frames={len(frames)};cs={length};hist={','.join(map(str, bins.tolist()))}"
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def digests(batches):
        names = [f.split()[0] for f in schema.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            rows = [one(m) for m in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=names)

    return arrow_map(df.select(key, "n_bytes", "media"), digests, schema).withColumnRenamed("key", key)


def gif_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores every whole text as a GIF, reads it back and returns its digest."""
    stored = text_to_gif(df.select(F.col(key), whole_text(text).alias("text")), key, "text")
    return media_digest(stored, key)
