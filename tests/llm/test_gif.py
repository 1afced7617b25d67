import hashlib
import random
import sys
import zlib

import numpy as np
import pytest
from tessera.llm import gif, queries


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 5000, 70_000])
@pytest.mark.parametrize("colours", [2, 16, 256])
def test_code_stream_round_trip(n, colours):
    r = random.Random(n * colours)
    data = bytes(r.randrange(colours) for _ in range(n))
    for bits in {8, max(2, (colours - 1).bit_length())}:
        assert gif.lzw_decode(gif.pack_bits(*gif.lzw_codes(data, bits)), bits, n) == data


def plain_decode(data, bits):
    """Code by code, for streams that go on after the table is full."""
    clear, out, at = 1 << bits, [], 0
    value = int.from_bytes(data, "little")
    table, width, last = [bytes((i,)) for i in range(clear)] + [b"", b""], bits + 1, None
    while at + width <= 8 * len(data):
        code = value >> at & (1 << width) - 1
        at += width
        if code == clear:
            table, width, last = table[: clear + 2], bits + 1, None
            continue
        if code == clear + 1:
            break
        entry = table[code] if code < len(table) else last + last[:1]
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
            width = min(12, max(width, len(table).bit_length()))
        out.append(entry)
        last = entry
    return b"".join(out)


def test_stream_with_a_full_table_and_no_clear_code():
    r = random.Random(3)
    codes, widths, n = [256], [9], 258
    for k in range(20_000):
        codes.append(r.choice([x for x in (r.randrange(min(n, 4096)) for _ in range(20)) if x not in (256, 257)]))
        widths.append(min(12, max(9, n.bit_length())))
        n = min(4096, n + (k > 0))
    data = gif.pack_bits(codes, widths)
    assert gif.lzw_decode(data, 8, 10**9) == plain_decode(data, 8)


def test_long_streams_are_decoded_without_a_step_for_each_code():
    r = random.Random(9)
    words = [bytes(r.randrange(97, 123) for _ in range(r.randint(2, 9))) for _ in range(400)]
    data = b" ".join(r.choice(words) for _ in range(8000))
    codes, widths = gif.lzw_codes(data)
    packed, lines = gif.pack_bits(codes, widths), 0

    def trace(frame, event, arg):
        nonlocal lines
        lines += event == "line"
        return trace

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        got = gif.lzw_decode(packed, 8, len(data))
    finally:
        sys.settrace(before)
    assert got == data == plain_decode(packed, 8) and lines < len(codes)


@pytest.mark.parametrize("data", [b"a" * 9000, b"ab" * 9000, bytes(range(256)) * 90, b"a" * 300 + bytes(range(256)) * 40])
def test_long_streams_of_runs(data):
    packed = gif.pack_bits(*gif.lzw_codes(data))
    assert gif.lzw_decode(packed, 8, len(data)) == data == plain_decode(packed, 8)
    assert gif.lzw_decode(packed[: len(packed) // 2], 8, len(data)) == plain_decode(packed[: len(packed) // 2], 8)


def test_long_streams_with_a_code_before_its_entry():
    for at in (0, 1, 5, 200, 299):
        codes = [256] + [97] * 300
        codes[1 + at] = 258 + at  # one beyond the entry that is made there
        widths = [9] * 256 + [10] * 45
        with pytest.raises(ValueError):
            gif.lzw_decode(gif.pack_bits(codes, widths), 8, 10**6)


def test_frames_are_composed_by_disposal_and_transparency(spark):
    palette = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]], np.uint8)
    full = lambda c, rows=2, cols=3: np.full((rows, cols), c, np.uint8)
    images = [
        gif.Image(full(1), delay=5),
        gif.Image(np.array([[2, 0]], np.uint8), left=1, top=1, delay=7, disposal=3, transparent=0),
        gif.Image(full(3, 1, 1), delay=9, disposal=2),
        gif.Image(full(2, 1, 1), left=2),
    ]
    data = gif.encode(images, 3, 2, palette, 2)
    f = list(gif.decode(data))
    R, G, B, O = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0]
    assert f[0].canvas.tolist() == [[R, R, R], [R, R, R]]
    assert f[1].canvas.tolist() == [[R, R, R], [R, G, R]]
    assert f[2].canvas.tolist() == [[B, R, R], [R, R, R]]
    assert f[3].canvas.tolist() == [[O, R, G], [R, R, R]]
    assert [(x.start, x.delay) for x in f] == [(0, 5), (5, 7), (12, 9), (21, 10)]
    df = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(b"no gif")), (4, bytearray(data[:60]))], "doc_id long, gif binary")
    rows = [r for r in gif.decoded(df, "doc_id", "gif").collect() if r.doc_id == 1]
    assert [(r.frame, r.start_cs, r.delay_cs, bytes(r.rgba)) for r in rows] == [(x.number, x.start, x.delay, x.canvas.tobytes()) for x in f]
    assert sum(rows[3].histogram) == 5 and rows[0].histogram[48] == 6
    assert all(r.doc_id in (1, 4) for r in gif.decoded(df, "doc_id", "gif").collect())


def test_interlaced_rows():
    rows = np.arange(40, dtype=np.uint8).reshape(10, 4)
    data = bytearray(gif.encode([gif.Image(rows[gif._rows_in_order(10)])], 4, 10))
    data[data.index(b"\x2c", 13 + 768) + 9] |= 0x40
    assert (next(gif.decode(bytes(data))).indices == rows).all()


def check(text, r):
    raw = (text or "").encode()
    payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
    assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_query_keeps_every_text(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op7_gif_media(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        check(docs[r.doc_id], r)


def test_odd_texts(spark):
    texts = [None, "", "é" * 32, "a" * 63, "a" * 64, "a" * 65, "long text " * 120_000, "same", "same"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    rows = {r.doc_id: r for r in gif.round_trip(df).collect()}
    for i, t in enumerate(texts):
        check(t, rows[i])
    assert rows[7].media_sha256 == rows[8].media_sha256 and rows[6].feature.startswith("frames=3;")
    assert gif.round_trip(df.limit(0)).collect() == []


def test_claimed_sizes_are_refused(spark):
    """A header of a few bytes may ask for gigabytes."""
    head = b"GIF89a" + (65535).to_bytes(2, "little") * 2 + b"\x00\x00\x00"
    image = b"\x2c\x00\x00\x00\x00" + b"\xff\xff\xff\xff" + b"\x00"
    small = b"GIF89a\x01\x00\x01\x00\x00\x00\x00"
    for data in (head + image + b"\x08\x00", small + image + b"\x08\x00", small + image[:5] + b"\x01\x00\x01\x00\x00" + b"\xff\x00"):
        with pytest.raises(ValueError):
            list(gif.decode(data))
    df = spark.createDataFrame([(1, bytearray(head + image)), (2, bytearray(small + image + b"\x08\x00"))], "doc_id long, gif binary")
    assert gif.decoded(df, "doc_id", "gif").collect() == []
