"""PNG pixels against images that are filtered and packed here."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from quire.sources.pixels import image_tiles, tiles


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(pixels, color, depth=8, filters=(0, 1, 2, 3, 4), extra=b"", cut=None, laced=0):
    """A PNG of samples (h, w, n) whose rows have the filters in turn; IDAT is cut into pieces of ``cut`` bytes."""
    h, w, n = pixels.shape
    packed = pixels.reshape(h, -1).astype(np.uint8)
    if depth < 8:
        bits = ((packed[:, :, None] >> np.arange(depth)[::-1]) & 1).reshape(h, -1)
        packed = np.packbits(bits, axis=1)
    size = n if depth == 8 else 1
    lines, above = [], [0] * packed.shape[1]
    for y in range(h):
        row, kind, out = packed[y].tolist(), filters[y % len(filters)], []
        for i, v in enumerate(row):
            a, b, c = row[i - size] if i >= size else 0, above[i], above[i - size] if i >= size else 0
            p = a + b - c
            near = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            out.append((v - [0, a, b, (a + b) // 2, near][kind]) & 255)
        lines.append(bytes([kind, *out]))
        above = row
    data = zlib.compress(b"".join(lines))
    step = cut or len(data)
    body = b"".join(chunk(b"IDAT", data[i : i + step]) for i in range(0, len(data), step))
    head = struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, laced)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + body + chunk(b"IEND", b"")


def digests(rgba, edge=256):
    h, w, _ = rgba.shape
    return [
        (x, y, min(edge, w - x), min(edge, h - y), hashlib.sha256(rgba[y : y + edge, x : x + edge].tobytes()).hexdigest())
        for y in range(0, h, edge) for x in range(0, w, edge)
    ]


RNG = np.random.default_rng(7)


def cases():
    opaque = lambda rgb: np.concatenate([rgb, np.full((*rgb.shape[:2], 1), 255)], axis=2).astype(np.uint8)
    rgb = RNG.integers(0, 256, (300, 270, 3))
    yield "rgb", png(rgb, 2, cut=1000), opaque(rgb)
    rgba = RNG.integers(0, 256, (9, 520, 4))
    yield "rgba", png(rgba, 6), rgba.astype(np.uint8)
    gray = RNG.integers(0, 256, (7, 5, 1))
    yield "gray", png(gray, 0, filters=(4,)), opaque(np.repeat(gray, 3, axis=2))
    pair = RNG.integers(0, 256, (7, 5, 2))
    yield "pair", png(pair, 4, filters=(3,)), np.concatenate([np.repeat(pair[..., :1], 3, axis=2), pair[..., 1:]], axis=2).astype(np.uint8)
    palette = RNG.integers(0, 256, (4, 3)).astype(np.uint8)
    index = RNG.integers(0, 4, (6, 11, 1))
    alpha = np.array([0, 128, 255, 255], np.uint8)
    extra = chunk(b"PLTE", palette.tobytes()) + chunk(b"tRNS", b"\x00\x80")
    want = np.concatenate([palette[index[..., 0]], alpha[index]], axis=2)
    for depth in (2, 4, 8):
        yield f"palette {depth}", png(index, 3, depth, extra=extra), want
    for depth, scale in ((1, 255), (2, 85), (4, 17)):
        low = RNG.integers(0, 1 << depth, (5, 13, 1))
        yield f"gray {depth}", png(low, 0, depth), opaque(np.repeat(low * scale, 3, axis=2))
    key = RNG.integers(0, 2, (8, 8, 3))
    want = opaque(key)
    want[(key == 1).all(axis=2), 3] = 0
    yield "key", png(key, 2, filters=(0, 1, 2), extra=chunk(b"tRNS", struct.pack(">3H", 1, 1, 1))), want


@pytest.mark.parametrize("name, payload, rgba", list(cases()), ids=lambda v: v if isinstance(v, str) else "")
def test_tiles_equal_a_brute_force_cut(name, payload, rgba):
    got = list(tiles(payload, 0, 16, 256))
    assert [r[1:6] for r in got] == digests(rgba) and [r[0] for r in got] == list(range(len(got))) and {r[6] for r in got} == {len(got)}
    assert [r[1:6] for r in tiles(payload, 1, 1, 256)] == digests(rgba)[1:2]


def test_ranges_cover_a_source_and_errors_are_rows(spark):
    rgb = RNG.integers(0, 256, (600, 600, 3))
    whole = png(rgb, 2, filters=(1, 2), cut=4000)
    damaged = bytearray(whole)
    damaged[len(whole) - 5000] ^= 1
    files = [
        ("a.png", whole), ("b.png", bytes(damaged)), ("c.png", png(rgb[:4, :4], 2, laced=1)), ("d.jpg", b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x02\x00\x02\x03"),
        ("e.png", b""), ("f.png", png(rgb[:4, :4, :1], 3, extra=chunk(b"PLTE", b"\0\0\0"))), ("g.png", whole[:2000]),
    ]
    df = spark.createDataFrame(files, "path string, content binary")
    found = [r for start in (0, 4, 8) for r in image_tiles(df, start, 4, 256).collect()]
    good = [r for r in found if not r.error]
    assert {r.path for r in good} == {"a.png"} and sorted(r.tile for r in good) == list(range(9))
    want = digests(np.concatenate([rgb, np.full((600, 600, 1), 255)], axis=2).astype(np.uint8))
    assert [(r.x, r.y, r.width, r.height, r.rgba_sha256) for r in sorted(good, key=lambda r: r.tile)] == want
    codes = {r.path: r.error for r in found if r.error}
    assert codes == {"b.png": "IMAGE_DAMAGED", "c.png": "IMAGE_INTERLACED", "d.jpg": "IMAGE_PIXELS_UNSUPPORTED", "e.png": "IMAGE_UNSUPPORTED", "f.png": "IMAGE_INVALID", "g.png": "IMAGE_DAMAGED"}
    for bad in ({"edge": 255}, {"count": 17}, {"start": -1}):
        with pytest.raises(ValueError):
            image_tiles(df, **bad)
    assert image_tiles(df.limit(0)).count() == 0
