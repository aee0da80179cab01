"""Image files: line filters, limits, JPEG, WebP, PSD, and files that are spoilt."""

import struct
import zlib

import numpy as np
import pytest

from strata.sources import codecs, jpeg, psd, webp


def plain(kind, lines, n):
    """Line filters undone byte by byte."""
    out, above = [], [0] * len(lines[0])
    for k, line in zip(kind, lines, strict=True):
        now = []
        for i, v in enumerate(line):
            a, b, c = (now[i - n] if i >= n else 0), above[i], (above[i - n] if i >= n else 0)
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            now.append((v + (0, a, b, (a + b) // 2, near)[k]) & 255)
        out.append(now)
        above = now
    return np.array(out, np.uint8)


@pytest.mark.parametrize("color", [0, 2, 4, 6])
def test_line_filters(color):
    rng = np.random.default_rng(color)
    n, w, h = codecs._CHANNELS[color], 7, 10
    kind, lines = np.arange(h) % 5, rng.integers(0, 256, (h, w * n), dtype=np.uint8)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    packed = zlib.compress(b"".join(bytes([k]) + line.tobytes() for k, line in zip(kind, lines, strict=True)))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, color, 0, 0, 0))
    got_w, got_h, rgba = codecs.decode_png(b"\x89PNG\r\n\x1a\n" + head + chunk(b"IDAT", packed[:20]) + chunk(b"IDAT", packed[20:]) + chunk(b"IEND", b""))
    px, want = np.frombuffer(rgba, np.uint8).reshape(h, w, 4), plain(kind, lines.tolist(), n).reshape(h, w, n)
    assert (got_w, got_h) == (w, h) and (px[..., :3] == (want[..., :3] if n > 2 else want[..., :1])).all()
    assert (px[..., 3] == (want[..., -1] if n in (2, 4) else 255)).all()


def test_spoilt_files(spark):
    png = codecs.encode_png(3, 2, bytes(range(24)), (4, 1))
    assert codecs.decode_png(png) == (3, 2, bytes(range(24)))
    huge = png[:16] + struct.pack(">II", 1 << 20, 1 << 20) + png[24:]
    bomb = png[:8] + b"".join(struct.pack(">I", len(d)) + k + d + b"crc_" for k, d in ((b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 6, 0, 0, 0)), (b"IDAT", zlib.compress(bytes(1 << 20)))))
    assert codecs.decode_png(bomb) == (1, 1, bytes(4))
    with pytest.raises(ValueError, match="too large"):
        codecs.decode_png(huge)
    files = [None, b"", b"\x89PNG\r\n\x1a\n", png[:8] + struct.pack(">I", 5) + b"IHDR12345crc_", png[:50], huge, b"\xff\xd8\xff\xe0", b"8BPS", b"RIFF0000WEBPVP8 ", b"GIF89a", b"?"]
    rows = spark.createDataFrame([(i, None if f is None else bytearray(f)) for i, f in enumerate(files)], "image_id long, content binary")
    out = codecs.from_files(rows).collect()
    assert len(out) == len(files) and all(r.error and r.data is None for r in out)
    assert all(r.error for r in codecs.from_png(rows.withColumnRenamed("content", "png")).collect())


def test_jpeg():
    x, y = np.meshgrid(np.arange(37), np.arange(21))
    px = np.stack([x * 6, y * 11, 128 + 60 * np.sin(x / 6), np.full(x.shape, 9)], axis=2).astype(np.uint8)
    for quality, most in ((95, 2.5), (40, 8)):
        w, h, rgba = jpeg.decode_jpeg(jpeg.encode_jpeg(37, 21, px.tobytes(), quality))
        got = np.frombuffer(rgba, np.uint8).reshape(h, w, 4)
        assert (w, h) == (37, 21) and (got[..., 3] == 255).all()
        assert np.abs(got[..., :3].astype(int) - px[..., :3]).mean() < most
    assert codecs.decode(jpeg.encode_jpeg(8, 8, bytes(256)))[:2] == (8, 8)
    assert sorted(jpeg.ZIGZAG.tolist()) == list(range(64)) and jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2]


def test_webp(spark):
    rng = np.random.default_rng(4)
    shapes = [(1, 1, 256), (5, 3, 256), (40, 31, 4), (600, 2, 200), (2, 700, 2), (3, 3, 1)]
    images = [(w, h, rng.integers(0, top, (h, w, 4), dtype=np.uint8).tobytes()) for w, h, top in shapes]
    assert [codecs.decode(webp.encode_webp(*x)) for x in images] == images
    buffers = spark.createDataFrame([(i, *x) for i, x in enumerate(images)], "image_id long, width int, height int, data binary")
    back = codecs.from_files(webp.to_webp(buffers).withColumnRenamed("webp", "content"))
    assert {tuple(r)[:4] for r in back.collect()} == {tuple(r) for r in buffers.collect()}
    with pytest.raises(ValueError, match="lossy"):
        webp.decode_webp(b"RIFF\x10\0\0\0WEBPVP8 \x04\0\0\0abcd")
    whole = webp.encode_webp(*images[2])
    with pytest.raises(ValueError):
        webp.decode_webp(whole[:60])
    with pytest.raises(ValueError):
        webp.encode_webp(0, 3, b"")


def _webp(w, h, *pairs):
    """A file of numbers of so many bits each."""
    pairs = [(0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3), *pairs]
    value = place = 0
    for v, n in pairs:
        value, place = value | v << place, place + n
    data = value.to_bytes((place + 7) // 8, "little")
    return b"RIFF" + struct.pack("<I", 12 + len(data)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data


def _one(*symbols):
    """Codes of one symbol."""
    return [p for s in symbols for p in ((1, 1), (0, 1), (1, 1), (s, 8))]


def _two(a, b):
    return [(1, 1), (1, 1), (1, 1), (a, 8), (b, 8)]


def _pair(alphabet, *symbols):
    """A code of two symbols, of one bit each, by its lengths."""
    return [(0, 1), (0, 4), (0, 3), (0, 3), (1, 3), (1, 3), (0, 1), *[(int(i in symbols), 1) for i in range(alphabet)]]


def test_webp_by_hand():
    px = bytes([1, 7, 2, 255])
    # a copy of two pixels from one to the left
    assert webp.decode_webp(_webp(3, 1, (0, 1), (0, 1), (0, 1), *_pair(280, 7, 257), *_one(1, 2, 255, 1), (0, 1), (1, 1)))[2] == px * 3
    # a copy from before the first pixel
    with pytest.raises(ValueError, match="outside"):
        webp.decode_webp(_webp(3, 1, (0, 1), (0, 1), (0, 1), *_pair(280, 7, 257), *_one(1, 2, 255, 1), (1, 1)))
    # a colour that was seen, in a cache of two
    seen = 280 + ((0xFF010702 * 0x1E35A7BD & 0xFFFFFFFF) >> 31)
    assert webp.decode_webp(_webp(2, 1, (0, 1), (1, 1), (1, 4), (0, 1), *_pair(282, 7, seen), *_one(1, 2, 255, 0), (0, 1), (1, 1)))[2] == px * 2
    # two colours, eight pixels in a number
    colors = [bytes([3, 5, 4, 255]), bytes([6, 15, 8, 255])]
    palette = [(1, 1), (3, 2), (1, 8), (0, 1), *_two(5, 10), *_one(3, 4), *_two(0, 255), *_one(0), (0, 1), (1, 1), (1, 1), (0, 1)]
    assert webp.decode_webp(_webp(5, 1, *palette, (0, 1), (0, 1), (0, 1), *_one(0b10110, 0, 0, 0, 0)))[2] == b"".join(colors[i] for i in (0, 1, 1, 0, 1))
    # red and blue by green, blue by red
    blocks = [(1, 1), (1, 2), (0, 3), (0, 1), *_one(32, 16, 224, 255, 0)]
    assert webp.decode_webp(_webp(1, 1, *blocks, (0, 1), (0, 1), (0, 1), *_one(10, 50, 20, 9, 0)))[2] == bytes([40, 10, 50, 9])
    # two groups of codes, for blocks of four pixels
    meta = [(0, 1), (0, 1), (1, 1), (0, 3), (0, 1), *_two(0, 1), *_one(0, 0, 0, 0), (0, 1), (1, 1)]
    assert webp.decode_webp(_webp(6, 1, *meta, *_one(7, 1, 2, 255, 0), *_one(8, 1, 2, 255, 0)))[2] == px * 4 + bytes([1, 8, 2, 255]) * 2


def test_webp_modes():
    a, b, c, d = [10, 20, 30, 40], [200, 21, 33, 0], [7, 250, 30, 1], [90, 10, 255, 40]
    assert webp._MODES[5](a, b, c, d) == [(((x + z) >> 1) + y) >> 1 for x, y, z in zip(a, b, c, strict=True)]
    assert webp._MODES[11](a, b, c, d) == (a if 110 + 11 + 222 + 40 < 80 + 10 + 225 else b)
    assert webp._MODES[12](a, b, c, d) == [120, 31, 0, 0]
    assert webp._MODES[13](a, b, c, d) == [105 + 7, 20 + 5, 0, 20 - 10]
    rng = np.random.default_rng(6)
    px, modes = rng.integers(0, 256, (9, 11, 4)), rng.integers(0, 14, (3, 3))
    flat, rest = px.reshape(-1, 4).tolist(), px.copy()
    for y in range(9):
        for x in range(11):
            i = y * 11 + x
            guess = [255, 0, 0, 0] if not i else flat[i - 1] if not y else flat[i - 11] if not x else webp._MODES[modes[y >> 2, x >> 2]](flat[i - 1], flat[i - 11], flat[i - 10], flat[i - 12])
            rest[y, x] = (px[y, x] - guess) % 256
    assert (webp._unpredicted(rest, modes, 2) == px).all()



def test_jpeg_by_another_reader(spark, tmp_path):
    """What is written can be read by the JVM's reader, and gives nearly the same pixels."""
    x, y = np.meshgrid(np.arange(24), np.arange(16))
    px = np.stack([x * 10, y * 15, (x + y) * 6, np.full(x.shape, 255)], axis=2).astype(np.uint8)
    (tmp_path / "a.jpg").write_bytes(jpeg.encode_jpeg(24, 16, px.tobytes(), 95))
    row = spark.read.format("image").load(str(tmp_path)).select("image.*").first()
    theirs = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels)[..., 2::-1]
    ours = np.frombuffer(jpeg.decode_jpeg((tmp_path / "a.jpg").read_bytes())[2], np.uint8).reshape(16, 24, 4)[..., :3]
    assert np.abs(theirs.astype(int) - ours).max() <= 3 and np.abs(theirs.astype(int) - px[..., :3]).mean() < 3


def _psd(layers, packing=0):
    def plane(v):
        if not packing:
            return struct.pack(">H", 0) + v.tobytes()
        lines = [bytes([(1 - len(line)) & 255, line[0]]) if len(set(line)) == 1 and len(line) > 1 else bytes([len(line) - 1]) + bytes(line) for line in v.tolist()]
        return struct.pack(">H", 1) + b"".join(struct.pack(">H", len(x)) for x in lines) + b"".join(lines)

    records = data = b""
    for name, x, y, px, opacity, flags in layers:
        h, w = px.shape[:2]
        planes = [(-1, plane(px[..., 3])), *((i, plane(px[..., i])) for i in range(3))]
        more = struct.pack(">II", 0, 0) + bytes([len(name)]) + name + bytes(-(len(name) + 1) % 4)
        records += struct.pack(">iiiiH", y, x, y + h, x + w, 4) + b"".join(struct.pack(">hI", k, len(p)) for k, p in planes)
        records += b"8BIMnorm" + bytes([opacity, 0, flags, 0]) + struct.pack(">I", len(more)) + more
        data += b"".join(p for _, p in planes)
    info = struct.pack(">h", -len(layers)) + records + data
    about = struct.pack(">I", len(info)) + info
    head = b"8BPS" + struct.pack(">H6sHIIHH", 1, bytes(6), 3, 5, 6, 8, 3)
    return head + struct.pack(">II", 0, 0) + struct.pack(">I", len(about)) + about + struct.pack(">H", 0) + bytes(90)


@pytest.mark.parametrize("packing", [0, 1])
def test_psd(spark, packing):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 256, (2, 3, 4), dtype=np.uint8), np.full((4, 2, 4), 7, np.uint8)
    raw = _psd([(b"low", 1, 2, a, 255, 0), (b"none", 0, 0, a[:0], 9, 0), (b"high", -1, 0, b, 51, 2)], packing)
    w, h, layers = psd.decode_psd(raw)
    assert (w, h) == (6, 5) and [x["name"] for x in layers] == ["low", "high"]
    assert layers[0]["data"] == a.tobytes() and layers[1]["data"] == b.tobytes()
    assert [(x["x"], x["y"], x["opacity"], x["visible"]) for x in layers] == [(1, 2, 1.0, True), (-1, 0, 0.2, False)]
    assert codecs.decode(raw) == (3, 2, a.tobytes()) and codecs.decode(_psd([])) == (6, 5, bytes(120))
    spoilt = [raw[:30], raw[:60], raw[:-91], raw[:4] + b"\0\2" + raw[6:], raw.replace(b"8BIM", b"8BIX")]
    files = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate([raw, *spoilt])], "image_id long, psd binary")
    rows = psd.from_psd(files).collect()
    assert {r.image_id for r in rows if r.error} == set(range(1, 6)) and sum(r.image_id == 0 for r in rows) == 2
