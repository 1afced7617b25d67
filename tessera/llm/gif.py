"""GIF columns: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms.

`decode` reads a GIF's blocks, undoes the LZW coding of each image, applies its palette and composes it on the
canvas by the rules of disposal and transparency. `encode` writes frames as GIF with the same coding. A payload of
bytes is stored as 8-bit samples: indices into a palette of 256 greys, in frames of 64 columns.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Codes read at a time, which is more than fill the table.
SEGMENT = 8192
#: Codes after a clear code from which arrays expand them faster than a loop.
MANY = 150
#: Columns of a payload's frames, and the most rows in one.
WIDTH = 64
HEIGHT = 8192
#: Pixels of the largest canvas or image that is decoded: 256 MB as RGBA.
MOST_PIXELS = 1 << 26
GREYS = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


def lzw_codes(data: bytes, bits: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The variable-width code stream of the samples: codes, and for each its width."""
    clear = 1 << bits
    # codes stand eight bits up, so that the table's keys need no shift
    first, full = (clear + 2) << 8, 4096 << 8
    out = [clear << 8]
    put, table, free, at = out.append, {}, first, -1
    samples = iter(data)
    for c in samples:
        at = c << 8
        break
    for c in samples:
        key = at | c
        if key in table:
            at = table[key]
            continue
        put(at)
        at = c << 8
        if free < full:
            table[key] = free
            free += 256
        else:
            put(clear << 8)
            table = {}
            free = first
    if at >= 0:
        put(at)
    put((clear + 1) << 8)
    codes = np.array(out, np.int64) >> 8
    clears = np.flatnonzero(codes == clear)
    places = np.diff(np.append(clears, len(codes) - 1))  # a clear code counts to the codes before it
    widths = [np.array([bits + 1]), *(_widths(bits)[0][:k] for k in places)]
    return codes, np.concatenate(widths)


def pack_bits(codes, widths) -> bytes:
    """Codes in little-endian bit order."""
    c, w = np.asarray(codes, np.int64), np.asarray(widths, np.int64)
    end = np.cumsum(w)
    start = end - w
    at, shifted = start >> 3, c << (start & 7)
    size = int(end[-1] + 7) // 8
    # a code of 12 bits touches three bytes at most; no two codes share a bit, so bytes are sums, exact in doubles
    parts = [np.bincount(at + k, shifted >> (8 * k) & 255, size + 3)[: size + 3] for k in range(3)]
    return (parts[0] + parts[1] + parts[2])[:size].astype(np.uint8).tobytes()


@lru_cache(16)
def _widths(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear code, and the bits before each. The table grows by one from the second code
    on, so the widths depend on the place alone; after 4096 entries they stay at 12."""
    n = (1 << bits) + 2 + np.maximum(np.arange(SEGMENT) - 1, 0)
    widths = np.clip(np.frexp(n.astype(np.float64))[1], bits + 1, 12).astype(np.int64)
    return widths, np.cumsum(widths) - widths


@lru_cache(16)
def _roots(clear: int) -> list[bytes]:
    return [bytes((i,)) for i in range(clear)] + [b"", b""]


def _expanded(codes: np.ndarray, clear: int) -> bytes:
    """The samples of the codes from a clear code on. The entry made at a code is the string of the code before it and
    one sample more, so each string's rest is that of an earlier code; strings are written from their ends, all of them
    a sample at a time."""
    here = np.arange(len(codes))
    root = codes < clear
    rest = np.where(root, -1, codes - clear - 2)
    if (rest >= here).any():
        raise ValueError("a code stands before its table entry")
    up, steps = np.where(root, here, rest), (~root).astype(np.int64)
    while (more := steps[up]).any():
        steps += more
        up = up[up]
    tail = np.where(root, codes, codes[up][rest + 1]).astype(np.uint8)
    ends = np.cumsum(steps + 1)
    out, at, node = np.empty(int(ends[-1]), np.uint8), ends - 1, here
    while len(node):
        out[at] = tail[node]
        node = rest[node]
        kept = np.flatnonzero(node >= 0)
        node, at = node[kept], at[kept] - 1
    return out.tobytes()


def lzw_decode(data: bytes, bits: int, most: int) -> bytes:
    """The samples of a code stream, at most so many. The stream may end without its end code."""
    clear, size, counted, at, end = 1 << bits, 0, 0, 0, 8 * len(data)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    roots = _roots(clear)
    widths, before = _widths(bits)
    out: list[bytes] = []
    table, grows, fresh = list(roots), 4096 - len(roots), True
    while at < end and size < most:
        # the next codes' places are known as far as the table only grows
        if fresh:
            start, wide = at + before, widths
        else:  # a full table: no width changes until a clear code
            start, wide = at + 12 * np.arange(SEGMENT), np.full(SEGMENT, 12, np.int64)
        whole = int(np.searchsorted(start + wide, end, side="right"))
        start, wide = start[:whole], wide[:whole]
        byte = start >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (start & 7) & (1 << wide) - 1
        marks = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(marks[0]) if len(marks) else whole
        mark = int(codes[stop]) if len(marks) else -1
        own = codes[:stop]
        if fresh and stop >= MANY and (len(marks) or whole < SEGMENT):  # no code after these reads the table
            out.append(_expanded(own, clear))
            own = ()
        else:
            own = own.tolist()
        if fresh and own:
            if own[0] >= clear:
                raise ValueError("a code stands before its table entry")
            last = table[own[0]]
            out.append(last)
            add, put = table.append, out.append
            try:
                for code in own[1 : grows + 1]:
                    entry = table[code] if code < len(table) else last + last[:1]
                    add(last + entry[:1])
                    put(entry)
                    last = table[code]  # fails for a code beyond the entry just made
                out.extend([table[code] for code in own[grows + 1 :]])
            except IndexError:
                raise ValueError("a code stands before its table entry") from None
        elif own:
            out.extend([table[code] for code in own])
        if mark == clear + 1 or not whole:
            break
        at = int(start[stop] + wide[stop]) if len(marks) else int(start[-1] + wide[-1])
        if mark == clear:
            table, fresh = list(roots), True
        else:
            fresh = False
        size += sum(map(len, out[counted:]))
        counted = len(out)
    return b"".join(out)[:most]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(data[i : i + 255]),)) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


@dataclass
class Image:
    """An image to be written: indices (rows x columns), place, delay in hundredths of a second, disposal (0 to 3),
    and the transparent index, if any."""

    indices: np.ndarray
    left: int = 0
    top: int = 0
    delay: int = 10
    disposal: int = 0
    transparent: int | None = None


@dataclass
class Frame:
    """A composed frame: time of display, duration (both in hundredths of a second), the canvas as RGBA, and the
    image's own indices."""

    number: int
    start: int
    delay: int
    canvas: np.ndarray
    indices: np.ndarray

    def histogram(self) -> list[int]:
        """Pixels of the canvas by colour: two bits each of red, green and blue; transparent pixels do not count."""
        pixels = self.canvas.reshape(-1, 4)
        bins = pixels[:, 0] >> 6 << 4 | pixels[:, 1] >> 6 << 2 | pixels[:, 2] >> 6
        return np.bincount(bins[pixels[:, 3] > 0], minlength=64).tolist()


def encode(images: list[Image], width: int, height: int, palette: np.ndarray = GREYS, bits: int = 8) -> bytes:
    """The images as one GIF with a global palette of 1 << bits colours."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF0 | bits - 1, 0, 0), palette.astype(np.uint8).tobytes()]
    for i in images:
        flags = i.disposal << 2 | (i.transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", flags, i.delay, i.transparent or 0, 0))
        rows, columns = i.indices.shape
        depth = max(bits, 2)
        out.append(b"\x2c" + struct.pack("<HHHHB", i.left, i.top, columns, rows, 0) + bytes((depth,)))
        out.append(_blocks(pack_bits(*lzw_codes(i.indices.astype(np.uint8).tobytes(), depth))))
    return b"".join(out) + b"\x3b"


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _rows_in_order(height: int) -> np.ndarray:
    """Order in which an interlaced image stores its rows."""
    return np.concatenate([np.arange(s, height, step) for s, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes) -> Iterator[Frame]:
    """The composed frames. An image is drawn where it is not transparent; before the next one its rectangle is left
    (0, 1), cleared (2) or set back to what stood there (3). Sizes are what the header claims, so a canvas or image of
    more than MOST_PIXELS is refused (ValueError)."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    if width * height > MOST_PIXELS:
        raise ValueError("the canvas is larger than MOST_PIXELS")
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, transparent, number, start = 0, 0, None, 0, 0
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            body, end = _sub_blocks(data, at + 2)
            if data[at + 1] == 0xF9 and len(body) >= 4:
                bits, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = bits >> 2 & 7, index if bits & 1 else None
            at = end
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown block")
        left, top, columns, rows, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        if rows * columns > MOST_PIXELS:
            raise ValueError("an image is larger than MOST_PIXELS")
        palette = shared
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        depth = data[at]
        if not 1 <= depth <= 8:
            raise ValueError("samples have 1 to 8 bits")
        body, at = _sub_blocks(data, at + 1)
        samples = np.frombuffer(lzw_decode(body, depth, rows * columns).ljust(rows * columns, b"\0"), np.uint8).reshape(rows, columns)
        if flags & 0x40:
            straight = np.empty_like(samples)
            straight[_rows_in_order(rows)] = samples
            samples = straight
        if palette is None:
            palette = GREYS
        before = canvas.copy() if disposal == 3 else None
        view = canvas[top : top + rows, left : left + columns]
        own = samples[: view.shape[0], : view.shape[1]]
        opaque = np.column_stack([palette, np.full(len(palette), 255, np.uint8)]).view(np.uint32)[:, 0]  # a colour is one number
        drawn = opaque[own if len(palette) == 256 else np.minimum(own, len(palette) - 1)].view(np.uint8).reshape(*own.shape, 4)
        view[...] = drawn if transparent is None else np.where((own == transparent)[..., None], view, drawn)
        yield Frame(number, start, delay, canvas.copy(), samples)
        if disposal == 2:
            view[...] = 0
        elif before is not None:
            canvas = before
        number, start = number + 1, start + delay
        delay, disposal, transparent = 0, 0, None


def decoded(df: DataFrame, id_col: str, gif_col: str) -> DataFrame:
    """One row per frame: id, frame, start_cs, delay_cs, width, height, rgba (the composed canvas) and histogram (64
    colour bins). A null gives no frame; so does what is no GIF, breaks off before its first image or claims more than
    MOST_PIXELS. Repeated rows stay repeated; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data in enumerate(batch.column(1).to_pylist()):
                frames = decode(data) if data else iter(())
                while True:
                    try:
                        f = next(frames, None)
                    except (ValueError, IndexError, struct.error):
                        break
                    if f is None:
                        break
                    one = [pa.array([x], pa.int32()) for x in (f.number, f.start, f.delay, f.canvas.shape[1], f.canvas.shape[0])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), *one, pa.array([f.canvas.tobytes()], pa.binary()), pa.array([f.histogram()], pa.list_(pa.int64()))], ["id", "frame", "start_cs", "delay_cs", "width", "height", "rgba", "histogram"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(gif_col).alias("gif")).mapInArrow(run, f"id {kind}, frame int, start_cs int, delay_cs int, width int, height int, rgba binary, histogram array<bigint>")
    return out.withColumnRenamed("id", id_col)


def store(payload: bytes) -> bytes:
    """The payload (a multiple of WIDTH bytes) as a GIF, losslessly."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    frames = [Image(samples[i : i + HEIGHT]) for i in range(0, len(samples), HEIGHT)]
    return encode(frames, WIDTH, min(len(samples), HEIGHT))


def padded(data: bytes) -> bytes:
    """Zeros appended up to a positive multiple of WIDTH."""
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\0")


def stored_text(text: str) -> tuple:
    """The text's payload written as GIF and read back: sizes, digests and features of what was read."""
    raw = text.encode()
    media = store(padded(raw))
    back, seen, frames = [], np.zeros(64, np.int64), 0
    for f in decode(media):
        # the palette is the greys, so a composed pixel's red is its sample; the last frame may have fewer rows
        back.append(f.canvas[: len(f.indices), :, 0].tobytes())
        seen += np.array(Frame(0, 0, 0, f.canvas[: len(f.indices)], f.indices).histogram())
        frames += 1
    payload = b"".join(back)
    greys = seen[[0, 21, 42, 63]]
    feature = f"frames={frames};rows={len(payload) // WIDTH};grey=" + ",".join(map(str, greys))
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A null text counts as empty: a payload of 64 zeros. Equal texts give equal values, so repeated rows give equal
    rows; other columns are not read; an empty table gives an empty result. One narrow pass; one text's frames are in
    memory at a time, however long it is."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                columns = zip(*[stored_text(t or "") for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], ["id", *names])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("id", id_col)
