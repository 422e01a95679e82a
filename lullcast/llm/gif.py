"""GIF media columns: write and read GIF89a, composite timed frames, colour histograms.

``encode`` stores bytes as 8-bit palette indices.  ``decode`` reads any
GIF: LZW code streams, global and local palettes, interlacing, transparency and
the four disposal rules.  Both directions build the LZW dictionary.

Cases: null or empty bytes raise no error in the column operators (a null payload
is an empty one, which is stored as 64 zero bytes; a null or broken media value, one
without a frame, and one whose canvas has more than ``MAX_PIXELS`` pixels give null
results); equal inputs give equal outputs; an empty table gives an empty table; other
columns pass through, but for those that have the name of an added one, which the
added one replaces.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .work import small_batches

WIDTH = 64
FRAME_ROWS = 1024
DELAY = 10
#: Pixels of the largest canvas, or frame, that is read.
MAX_PIXELS = 1 << 26
#: Codes from one clear code to the next: by then 12-bit codes are used up.
_CODES = 4096 - 257
_GREY = bytes(v for i in range(256) for v in (i, i, i))


def pad(data: bytes, unit: int = WIDTH) -> bytes:
    """Zero bytes are appended up to a positive multiple of ``unit``."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


@functools.cache
def _widths(bits: int) -> np.ndarray:
    """Bits of each code after a clear code."""
    made = np.arange(1, _CODES + 2) + (1 << bits)
    return np.minimum(12, np.maximum(bits + 1, np.floor(np.log2(made)).astype(np.int64) + 1))


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of the given widths, least significant bit first."""
    end = np.cumsum(widths)
    at = end - widths
    whole = codes.astype(np.int64) << (at & 7)
    size = int(end[-1] + 7) // 8
    out = sum(np.bincount((at >> 3) + k, whole >> (8 * k) & 255, size + 2) for k in range(3))
    return out[:size].astype(np.uint8).tobytes()


def lzw_encode(data: bytes) -> bytes:
    """The LZW stream of 8-bit values: a clear code first and whenever the table is full."""
    first = {(256 << 8) | i: i for i in range(256)}
    codes, widths, each = [256], [np.array([9])], _widths(8)
    table, after, code, used = dict(first), 258, 256, 0
    for c in data:
        key = code << 8 | c
        if (longer := table.get(key)) is not None:
            code = longer
            continue
        codes.append(code)
        used += 1
        if after < 4096:
            table[key] = after
            after += 1
            code = c
        else:
            codes.append(256)
            widths.append(each[: used + 1])
            table, after, code, used = dict(first), 258, c, 0
    if code != 256:
        codes.append(code)
        used += 1
    codes.append(257)
    widths.append(each[: used + 1])
    return _pack(np.array(codes), np.concatenate(widths))


def _blocks(data: bytes) -> bytes:
    whole = len(data) // 255
    out = np.empty((whole, 256), np.uint8)
    out[:, 0] = 255
    out[:, 1:] = np.frombuffer(data, np.uint8, whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return out.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode(payload: bytes, width: int = WIDTH, rows: int = FRAME_ROWS, delay: int = DELAY) -> bytes:
    """A GIF of timed grey frames whose palette indices are ``payload`` (a positive multiple of ``width``)."""
    frame = width * rows
    height = min(rows, len(payload) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), _GREY]
    for at in range(0, len(payload), frame):
        part = payload[at : at + frame]
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, delay, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b"\x3b"])


def _expand(codes: np.ndarray, clear: int) -> np.ndarray:
    """The values that the codes after one clear code stand for.

    Code number i either is a literal or names entry k: what code k stood for and the first
    value after it.  So each output value is a literal or a copy of one further ahead, and
    following these pointers, doubled in every round, ends at literals.
    """
    n = len(codes)
    i = np.arange(n)
    literal = codes < clear
    parent = np.where(literal, i, codes - (clear + 2))
    if np.any(~literal & ((parent >= i) | (parent < 0))):
        raise ValueError("bad LZW code")
    up, more = parent, np.where(literal, 0, 1)
    while np.any(more[up]):
        more = more + more[up]
        up = up[up]
    size = 1 + more
    at = np.cumsum(size) - size
    owner = np.repeat(i, size)
    place = np.arange(len(owner))
    frm = at[parent][owner] + place - at[owner]
    while np.any(frm[frm] != frm):
        frm = frm[frm]
    return codes[owner[frm]].astype(np.uint8)


def lzw_decode(data: bytes, bits: int, size: int) -> np.ndarray:
    """``size`` palette indices; those that a stream ends before are 0.

    From one clear code to the next the codes' widths depend on their number only
    (12 bits once the table is full), so they are cut out together.
    """
    clear, limit = 1 << bits, len(data) * 8
    raw = np.frombuffer(data + bytes(8), np.uint8).astype(np.int64)
    each, at, made = _widths(bits), 0, 0
    out: list[np.ndarray] = []
    held: list[np.ndarray] = []
    used, last = 0, False
    while made < size and not last:
        w = each[used : used + 4096] if used < len(each) else np.full(4096, 12)
        w = w[: max(0, (limit - at) // (bits + 1))]
        begin = at + np.cumsum(w) - w
        w, begin = w[begin + w <= limit], begin[begin + w <= limit]
        byte = begin >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (begin & 7)) & ((1 << w) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(stop[0]) if len(stop) else len(codes)
        held.append(codes[:n])
        used += n
        last = not len(codes) or bool(len(stop)) and codes[n] == clear + 1
        at += int(w[: n + 1].sum())
        if len(stop) or last or used >= size:
            part = _expand(np.concatenate(held), clear)
            out.append(part)
            made += len(part)
            held, used = [], 0
    got = np.concatenate([*out, np.zeros(0, np.uint8)])[:size]
    return got if len(got) == size else np.concatenate([got, np.zeros(size - len(got), np.uint8)])


@dataclass
class Frame:
    indices: np.ndarray
    delay_ms: int
    rgb: np.ndarray
    histogram: np.ndarray


def _interlace(rows: np.ndarray) -> np.ndarray:
    n = len(rows)
    order = np.concatenate([np.arange(a, n, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
    out = np.empty_like(rows)
    out[order] = rows
    return out


def histogram(rgb: np.ndarray, bins: int = 8) -> np.ndarray:
    """Counts of each channel's values in ``bins`` equal bins, red, green, blue."""
    v = rgb.reshape(-1, 3) // (256 // bins)
    return np.concatenate([np.bincount(v[:, c], minlength=bins) for c in range(3)])


def decode(media: bytes) -> list[Frame]:
    """All frames as shown: composited under transparency and disposal, with delays in milliseconds."""
    if media[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", media, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(media, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    if width * height > MAX_PIXELS:
        raise ValueError("canvas too large")
    canvas = np.zeros((height, width, 3), np.uint8)
    frames: list[Frame] = []
    delay, disposal, clear_index = 0, 0, None
    while at < len(media):
        kind = media[at]
        at += 1
        if kind == 0x3B:
            break
        if kind == 0x21:
            label = media[at]
            at += 1
            if label == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", media, at + 1)
                disposal, clear_index = bits >> 2 & 7, index if bits & 1 else None
            while media[at]:
                at += media[at] + 1
            at += 1
            continue
        if kind != 0x2C:
            raise ValueError("bad GIF block")
        left, top, w, h, bits = struct.unpack_from("<HHHHB", media, at)
        at += 9
        palette = shared
        if bits & 0x80:
            n = 2 << (bits & 7)
            palette = np.frombuffer(media, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        size = media[at]
        if not 1 <= size <= 8 or w * h > MAX_PIXELS:
            raise ValueError("bad GIF frame")
        at += 1
        parts = []
        while media[at]:
            parts.append(media[at + 1 : at + 1 + media[at]])
            at += media[at] + 1
        at += 1
        grid = lzw_decode(b"".join(parts), size, w * h).reshape(h, w)
        if bits & 0x40:
            grid = _interlace(grid)
        kept = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        seen = grid[: area.shape[0], : area.shape[1]]
        colours = palette[np.minimum(seen, len(palette) - 1)] if palette is not None else np.repeat(seen[:, :, None], 3, 2)
        if clear_index is None:
            area[:] = colours
        else:
            opaque = seen != clear_index
            area[opaque] = colours[opaque]
        shown = canvas.copy()
        frames.append(Frame(grid, delay * 10, shown, histogram(shown)))
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = kept
        delay, disposal, clear_index = 0, 0, None
    return frames


def with_gif(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``n_bytes`` and ``media``: the UTF-8 bytes of ``text``, zero-padded, as a GIF."""
    plain = df.select(*(c for c in df.columns if c not in ("n_bytes", "media")))
    at = plain.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [x or b"" for x in b.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(x) for x in data], pa.int64()), pa.array([encode(pad(x)) for x in data], pa.binary())], names=[*b.schema.names, "n_bytes", "media"])

    small_batches(df.sparkSession)
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


_FRAME = pa.struct([("delay_ms", pa.int64()), ("histogram", pa.list_(pa.int64()))])
_LONGS = T.ArrayType(T.LongType())
_ADDED = T.StructType()
for _name, _kind in (("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"), ("n_frames", "integer"), ("duration_ms", "long"), ("colour_histogram", _LONGS), ("frames", T.ArrayType(T.StructType().add("delay_ms", "long").add("histogram", _LONGS)))):
    _ADDED.add(_name, _kind)
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(_FRAME)]


def read_back(data: bytes | None) -> tuple:
    """The values of the columns that ``gif_features`` adds."""
    if data is None:
        return (None,) * len(_KINDS)
    size, digest = len(data), hashlib.sha256(data).hexdigest()
    try:
        frames = decode(data)
    except (ValueError, IndexError, struct.error):
        frames = []
    if not frames:
        return (None, None, None, size, digest, None, None, None, None, None)
    payload = b"".join(f.indices.tobytes() for f in frames)
    hist = np.sum([f.histogram for f in frames], axis=0)
    feature = f"{len(frames)}f;{frames[0].rgb.shape[1]}x{frames[0].rgb.shape[0]};" + ",".join(map(str, hist[:8]))
    timed = [{"delay_ms": f.delay_ms, "histogram": f.histogram.tolist()} for f in frames]
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), size, digest, feature, len(frames), sum(f.delay_ms for f in frames), hist.tolist(), timed)


def gif_features(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds what is read back from ``media``: payload size, digest and checksum, and the timed frames with their colour histograms; ``media`` goes."""
    plain = df.select(*(c for c in df.columns if c != media and c not in _ADDED.names), media)
    keep = len(plain.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(read_back(x.as_py()) for x in b.column(keep)), strict=True)) or [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], *(pa.array(v, k) for v, k in zip(rows, _KINDS, strict=True))], names=[*b.schema.names[:keep], *_ADDED.names])

    small_batches(df.sparkSession)
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields[:keep], *_ADDED.fields]))
