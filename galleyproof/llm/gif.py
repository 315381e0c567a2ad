"""GIF media columns: LZW decoding, frame composition and colour histograms.

Decoding follows the GIF89a format: logical screen, global and local colour tables,
interlacing, transparent colours, and disposal (keep, clear, restore). LZW streams are
decoded a table at a time with whole-array operations: between two clear codes the width
of each code depends on its index only, and each code stands for a stretch of earlier
output, so lengths and bytes follow by pointer jumping. Frames come with their start and
length in milliseconds and a histogram of 4 x 4 x 4 colours.

``store`` writes any bytes losslessly as the grey samples of 192-pixel wide frames, and
``read_samples`` reads them back from the decoded frames.

Null content gives no frames, and so does content that is not a whole GIF; the column
``error`` of ``gif_frames`` then says why, in a row without frame. Equal bytes, equal rows.
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

from galleyproof.llm.common import text_chunks
from galleyproof.session import map_arrow

WIDTH, FRAME_ROWS, DELAY_MS = 192, 1024, 100
#: Pixels of a canvas beyond which a GIF gives an error row instead of frames, so that no header fills the memory.
MOST_PIXELS = 1 << 25
_MAX_CODES = 4096
_GREY = bytes(v for i in range(256) for v in (i, i, i))


@dataclass
class Frame:
    number: int
    start_ms: int
    delay_ms: int
    box: tuple[int, int, int, int]  #: left, top, width, height of what the frame draws
    disposal: int
    pixels: np.ndarray  #: the whole canvas, rows x columns x RGB
    covered: np.ndarray  #: which pixels of the canvas are drawn

    def histogram(self) -> np.ndarray:
        """Drawn pixels by the two upper bits of red, green and blue."""
        r, g, b = (self.pixels[..., i] >> 6 for i in range(3))
        colour = r << 4 | g << 2 | b
        return np.bincount(colour.ravel() if self.covered.all() else colour[self.covered], minlength=64)


@cache
def _layout(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths and bit offsets of the codes after a clear code, as many as fill the table."""
    free = (1 << bits) + 2 + np.maximum(np.arange(_MAX_CODES + 2) - 1, 0)
    width = np.clip(np.ceil(np.log2(free + 1)).astype(np.int64), bits + 1, 12)
    return width, np.cumsum(width) - width


def _entries(bits: int) -> int:
    return _MAX_CODES - (1 << bits) - 2


@cache
def _longer() -> list[int]:
    """The table that ``lzw_encode`` fills and empties again."""
    return [0] * (_MAX_CODES << 8)


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The LZW code stream of ``data``, whose bytes are below 2**bits."""
    clear, eoi = 1 << bits, (1 << bits) + 1
    segments: list[list[int]] = [[clear << 8]]
    codes: list[int] = []
    if data:
        table = _longer()  # at code << 8 | next byte: longer code << 8, or 0
        used: list[int] = []
        put, use = codes.append, used.append
        free, full = (eoi + 1) << 8, _MAX_CODES << 8
        prefix = data[0] << 8
        for byte in data[1:]:
            key = prefix | byte
            prefix = table[key]
            if prefix:
                continue
            put(key)
            use(key)
            table[key] = free
            free += 256
            prefix = byte << 8
            if free == full:
                put(clear << 8)
                segments.append(codes)
                codes, free = [], (eoi + 1) << 8
                put = codes.append
                for key in used:
                    table[key] = 0
                used.clear()
        put(prefix)
        for key in used:
            table[key] = 0
    codes.append(eoi << 8)
    segments.append(codes)
    widths, _ = _layout(bits)
    value = np.array([c for x in segments for c in x], np.int64) >> 8
    width = np.concatenate([widths[: len(x)] for x in segments])
    place = np.cumsum(width) - width
    size = int(place[-1] + width[-1] + 7) // 8
    # codes of up to 12 bits, shifted by up to 7, span three bytes; the bits of different codes never overlap
    out = np.bincount(np.concatenate([place // 8 + k for k in range(3)]), weights=np.concatenate([value << (place & 7) >> 8 * k & 255 for k in range(3)]), minlength=size)
    return out[:size].astype(np.uint8).tobytes()


def _codes_at(data: np.ndarray, place: np.ndarray, width: np.ndarray) -> np.ndarray:
    at = place >> 3
    held = data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8 | data[at + 2].astype(np.int64) << 16
    return held >> (place & 7) & (1 << width) - 1


def lzw_decode(stream: bytes, bits: int, wanted: int) -> np.ndarray:
    """The first ``wanted`` samples of an LZW code stream; ValueError if it is broken or short."""
    clear, eoi = 1 << bits, (1 << bits) + 1
    data = np.frombuffer(stream + bytes(4), np.uint8)
    total = 8 * len(stream)
    place, made, parts = 0, 0, []
    while made < wanted:
        (width, rel), codes = _layout(bits), []
        while True:  # codes up to the next clear or end code
            inside = int(np.searchsorted(rel + width, total - place, side="right"))
            got = _codes_at(data, place + rel[:inside], width[:inside])
            stops = np.flatnonzero((got == clear) | (got == eoi))
            if len(stops):
                codes.append(got[: stops[0]])
                place += int(rel[stops[0]] + width[stops[0]])
                ended = got[stops[0]] == eoi
                break
            codes.append(got)
            if inside < len(rel):
                ended = True
                break
            place += int(rel[-1] + width[-1])  # the table is full and a clear code is late
            width = np.full(_MAX_CODES, 12)
            rel = 12 * np.arange(_MAX_CODES)
        out = _expand(np.concatenate(codes), bits)
        parts.append(out)
        made += len(out)
        if ended:
            break
    if made < wanted:
        raise ValueError("the code stream ends early")
    return np.concatenate(parts)[:wanted] if parts else np.zeros(0, np.uint8)


def _expand(codes: np.ndarray, bits: int) -> np.ndarray:
    """What the codes after a clear code stand for."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint8)
    base = (1 << bits) + 2
    entry = codes - base  # entry e is what code e stood for and the first sample of code e + 1
    if ((entry >= np.arange(n)) | (entry >= _entries(bits))).any():
        raise ValueError("a code that is not in the table")
    copies = entry >= 0
    jump = np.where(copies, entry, n)
    jump = np.append(jump, n)
    length = np.append(np.ones(n, np.int64), 0)
    add = length.copy()
    while (jump[:n] < n).any():
        add = add + add[jump]
        jump = jump[jump]
    length = add[:n]
    start = np.cumsum(length) - length
    size = int(start[-1] + length[-1])
    source = np.arange(size, dtype=np.int32)
    back = np.where(copies, start - start[np.maximum(entry, 0)], 0)
    source -= np.repeat(back, length).astype(np.int32)
    while True:
        after = source[source]
        if (after == source).all():
            break
        source = after
    value = np.zeros(size, np.uint8)
    value[start[~copies]] = codes[~copies]
    return value[source]


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the data sub-blocks at ``at``, and the place after them."""
    parts = []
    while True:
        size = data[at]
        if not size:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + size])
        if len(parts[-1]) < size:
            raise ValueError("a data block ends early")
        at += 1 + size


def _table(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    colours = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
    return colours, at + 3 * n


def decode_gif(data: bytes, most_pixels: int = MOST_PIXELS) -> Iterator[Frame]:
    """Composed frames of a GIF, in order; ValueError or IndexError if it is broken or its canvas larger than ``most_pixels``."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _background, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > most_pixels:
        raise ValueError(f"a canvas of more than {most_pixels} pixels")
    shared, at = _table(data, 13, flags)
    canvas, covered = np.zeros((height, width, 3), np.uint8), np.zeros((height, width), bool)
    disposal, delay, clear_index, clock, number = 0, 0, -1, 0, 0
    while True:
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1]
            block, at = _blocks(data, at + 2)
            if label == 0xF9:
                flags, delay, index = struct.unpack_from("<BHB", block)
                disposal, clear_index = flags >> 2 & 7, index if flags & 1 else -1
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        local, at = _table(data, at + 10, flags)
        colours = shared if local is None else local
        if colours is None:
            raise ValueError("no colour table")
        if left + w > width or top + h > height:
            raise ValueError("a frame beyond the canvas")
        bits = data[at]
        if not 2 <= bits <= 8:
            raise ValueError("a code size out of range")
        stream, at = _blocks(data, at + 1)
        index = lzw_decode(stream, bits, w * h).reshape(h, w)
        if flags & 0x40:
            rows = np.concatenate([np.arange(*x) for x in ((0, h, 8), (4, h, 8), (2, h, 4), (1, h, 2))])
            straight = np.empty_like(index)
            straight[rows] = index
            index = straight
        before = (canvas.copy(), covered.copy()) if disposal == 3 else None
        colour = colours[index if len(colours) == 256 else np.minimum(index, len(colours) - 1)]
        part = canvas[top : top + h, left : left + w]
        if clear_index < 0:
            part[...] = colour
            covered[top : top + h, left : left + w] = True
        else:
            drawn = index != clear_index
            part[drawn] = colour[drawn]
            covered[top : top + h, left : left + w] |= drawn
        yield Frame(number, clock, 10 * delay, (left, top, w, h), disposal, canvas.copy(), covered.copy())
        if disposal == 2:
            canvas[top : top + h, left : left + w] = 0
            covered[top : top + h, left : left + w] = False
        elif before:
            canvas, covered = before
        number, clock = number + 1, clock + 10 * delay
        disposal, delay, clear_index = 0, 0, -1


def _sub_blocks(data: bytes) -> bytes:
    parts = [data[i : i + 255] for i in range(0, len(data), 255)]
    return b"".join(bytes([len(x)]) + x for x in parts) + b"\0"


def store(samples: bytes) -> bytes:
    """A GIF whose frames hold ``samples`` (a positive multiple of 192 bytes) as grey levels."""
    rows = len(samples) // WIDTH
    if not rows or rows * WIDTH != len(samples):
        raise ValueError("samples must fill rows of 192")
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, FRAME_ROWS), 0xF7, 0, 0), _GREY]
    for top in range(0, rows, FRAME_ROWS):
        part = samples[top * WIDTH : (top + FRAME_ROWS) * WIDTH]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, DELAY_MS // 10, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08" + _sub_blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


def read_samples(frames: Iterator[Frame]) -> Iterator[bytes]:
    """The grey levels that each frame of ``store`` drew."""
    for frame in frames:
        left, top, w, h = frame.box
        yield frame.pixels[top : top + h, left : left + w, 0].tobytes()


_MEDIA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, n_frames int, duration_ms long, histogram array<long>, media binary"
)


def _media_row(text: bytes) -> tuple:
    media = store(text + b" " * (-len(text) % WIDTH or (0 if text else WIDTH)))
    digest, size, tail, frames, ms, colours = hashlib.sha256(), 0, b"", 0, 0, np.zeros(64, np.int64)
    for frame in decode_gif(media):
        part = next(read_samples(iter([frame])))
        colours += frame.histogram()
        digest.update(part)
        size, tail, frames, ms = size + len(part), part[-16:], frames + 1, frame.start_ms + frame.delay_ms
    feature = f"frames={frames};ms={ms};rgb4=" + ",".join(f"{i}:{n}" for i, n in enumerate(colours.tolist()) if n)
    return len(text), size, digest.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature, frames, ms, colours.tolist(), media


def media_table(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """Texts of ``docs`` (doc_id, text) stored as GIFs, with what the stored bytes read back to.

    payload_*, tail_crc32, feature and histogram are computed from the decoded frames.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int32()), ("duration_ms", pa.int64()), ("histogram", pa.list_(pa.int64())), ("media", pa.binary())])
        for ids, texts in text_chunks(batches):
            columns = list(zip(*map(_media_row, texts), strict=True))
            if not with_media:
                columns[-1] = [None] * len(texts)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return map_arrow(docs.select("doc_id", "text"), run, _MEDIA)


_FRAMES = "id long, frame int, start_ms long, delay_ms long, disposal int, width int, height int, pixels binary, histogram array<long>, error string"


def gif_frames(media: DataFrame, key: str = "doc_id", content: str = "media", most_pixels: int = MOST_PIXELS) -> DataFrame:
    """One row for each composed frame of the GIFs in ``content``: its time, RGB pixels and histogram."""

    def row(key_value: int | None, frame: Frame | None, error: str | None = None) -> dict:
        if frame is None:
            return {"id": key_value, "error": error}
        h, w = frame.covered.shape
        return {"id": key_value, "frame": frame.number, "start_ms": frame.start_ms, "delay_ms": frame.delay_ms, "disposal": frame.disposal, "width": w, "height": h, "pixels": frame.pixels.tobytes(), "histogram": frame.histogram().tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("disposal", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])
        for batch in batches:
            for key_value, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if data.as_py() is None:
                    continue
                rows: list[dict] = []
                try:
                    for frame in decode_gif(data.as_py(), most_pixels):
                        yield pa.RecordBatch.from_pylist([row(key_value, frame)], schema)
                except (ValueError, IndexError, struct.error) as e:
                    rows = [row(key_value, None, str(e))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return map_arrow(media.select(key, content), run, _FRAMES)
