"""Pixels of PNG images by tile: inflated and unfiltered in bands, so a task never holds a whole image.

A tile is a square of ``edge`` pixels, cut off at the right and lower border; tiles are counted row by row from 0. Its digest
is of its RGBA bytes, row by row. Reading stops behind the band of the last tile that is asked for.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from quire.sources.base import SourceError, parse_files
from quire.sources.images import header

# The edges and the number of tiles that a range may have.
EDGES, MAX_TILES = (256, 2048), 16
TILES = "tile int, x int, y int, width int, height int, rgba_sha256 string, total_tiles int"
# Samples of a pixel by colour type.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_BAND = 256
#: Bytes that the sequential filters do one by one in the time of a diagonal's array calls.
_STEPS = 400


def _chunks(payload: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 12 <= len(payload):
        (size,) = struct.unpack_from(">I", payload, at)
        kind, body = payload[at + 4 : at + 8], payload[at + 8 : at + 8 + size]
        if len(body) < size or payload[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise SourceError("IMAGE_DAMAGED")
        yield kind, body
        at += 12 + size


def _averaged(row: list[int], up: list[int], size: int) -> list[int]:
    """Bytes of a row filtered by the mean of the pixels left and above."""
    out = [0] * size
    for x, u, k in zip(row, up, range(len(row))):
        out.append((x + ((out[k] + u) >> 1)) & 255)
    return out[size:]


def _paeth(row: list[int], up: list[int], size: int) -> list[int]:
    """Bytes of a row filtered by the nearest of the pixels left, above and above left."""
    out, corners = [0] * size, [0] * size + up
    for x, b, c, k in zip(row, up, corners, range(len(row))):
        a = out[k]
        p, q = b - c, a - c
        r = abs(p + q)
        p, q = abs(p), abs(q)
        out.append((x + (a if p <= q and p <= r else b if q <= r else c)) & 255)
    return out[size:]


def unfilter(filters: np.ndarray, rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Pixels of rows (n, width, bytes) from what their filters left, below the row ``above``.

    A pixel needs those left of, above and above left of it, so pixels of one anti-diagonal are done at once.
    """
    n, width, size = rows.shape
    out = np.zeros((n + 1, width + 1, size), dtype=np.int16)
    out[0, 1:] = above
    if filters.max(initial=0) <= 2:
        for y in range(n):
            if filters[y] == 1:
                out[y + 1, 1:] = np.cumsum(rows[y], axis=0, dtype=np.uint8)
            else:
                out[y + 1, 1:] = (rows[y] + (out[y, 1:] if filters[y] == 2 else 0)) & 255
        return out[1:, 1:].astype(np.uint8)
    slow = int((filters > 2).sum())
    if slow * width * size < _STEPS * (n + width):
        # Few rows: a diagonal would be shorter than what its array calls cost, so the sequential filters go byte by byte.
        last = above.reshape(-1).tolist()
        for y, (kind, row) in enumerate(zip(filters.tolist(), rows)):
            if kind == 3:
                line = _averaged(row.reshape(-1).tolist(), last, size)
            elif kind == 4:
                line = _paeth(row.reshape(-1).tolist(), last, size)
            else:
                done = np.cumsum(row, axis=0, dtype=np.uint8) if kind == 1 else row if kind == 0 else row + np.array(last, np.uint8).reshape(width, size)
                line = done.reshape(-1).tolist()
            out[y + 1, 1:] = np.array(line, np.uint8).reshape(width, size)
            last = line
        return out[1:, 1:].astype(np.uint8)
    for d in range(n + width - 1):
        ys = np.arange(max(0, d - width + 1), min(n - 1, d) + 1)
        xs = d - ys
        left, up, corner = out[ys + 1, xs], out[ys, xs + 1], out[ys, xs]
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        near = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        kind = filters[ys][:, None]
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) >> 1, near], 0)
        out[ys + 1, xs + 1] = (rows[ys, xs] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


class _Png:
    def __init__(self, payload: bytes):
        self.data, self.palette, self.clear = [], None, b""
        chunks = _chunks(payload)
        kind, head = next(chunks, (b"", b""))
        if kind != b"IHDR" or len(head) != 13:
            raise SourceError("IMAGE_INVALID")
        self.width, self.height, self.depth, self.color, packed, filtered, laced = struct.unpack(">IIBBBBB", head)
        if laced:
            raise SourceError("IMAGE_INTERLACED")
        if self.color not in _SAMPLES or packed or filtered or not (self.depth == 8 or (self.color in (0, 3) and self.depth in (1, 2, 4))):
            raise SourceError("IMAGE_DEPTH_UNSUPPORTED")
        for kind, body in chunks:
            if kind == b"IDAT":
                self.data.append(body)
            elif kind == b"PLTE":
                self.palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
            elif kind == b"tRNS":
                self.clear = body
        if self.color == 3 and self.palette is None:
            raise SourceError("IMAGE_INVALID")
        self.samples = _SAMPLES[self.color]
        self.stride = (self.width * self.samples * self.depth + 7) // 8

    def bands(self, edge: int) -> Iterator[np.ndarray]:
        """RGBA rows, at most ``edge`` at a time."""
        inflate, waiting, pieces = zlib.decompressobj(), b"", iter(self.data)
        above = np.zeros((self.stride // (self.samples if self.depth == 8 else 1), self.samples if self.depth == 8 else 1), np.uint8)
        for top in range(0, self.height, edge):
            parts = []
            for low in range(top, min(top + edge, self.height), _BAND):
                n = min(low + _BAND, top + edge, self.height) - low
                want = n * (self.stride + 1)
                raw = bytearray()
                while len(raw) < want:
                    try:
                        if not waiting:
                            waiting = next(pieces)
                        raw += inflate.decompress(waiting, want - len(raw))
                    except (StopIteration, zlib.error):
                        raise SourceError("IMAGE_DAMAGED") from None
                    waiting = inflate.unconsumed_tail
                lines = np.frombuffer(bytes(raw), np.uint8).reshape(n, self.stride + 1)
                if lines[:, 0].max() > 4:
                    raise SourceError("IMAGE_DAMAGED")
                rows = unfilter(lines[:, 0], lines[:, 1:].reshape(n, *above.shape), above)
                above = rows[-1]
                parts.append(self._rgba(rows.reshape(n, self.stride)))
            yield np.concatenate(parts)

    def _rgba(self, rows: np.ndarray) -> np.ndarray:
        if self.depth < 8:
            bits = np.unpackbits(rows, axis=1)[:, : self.width * self.depth].reshape(len(rows), self.width, self.depth)
            rows = (bits * (1 << np.arange(self.depth)[::-1])).sum(axis=2).astype(np.uint8)
        pixels = rows.reshape(len(rows), self.width, self.samples)
        out = np.full((len(rows), self.width, 4), 255, np.uint8)
        key = np.array(struct.unpack(f">{len(self.clear) // 2}H", self.clear[: len(self.clear) // 2 * 2])) if self.clear else None
        if self.color == 3:
            if int(pixels.max()) >= len(self.palette):
                raise SourceError("IMAGE_INVALID")
            alpha = np.full(len(self.palette), 255, np.uint8)
            alpha[: len(self.clear)] = np.frombuffer(self.clear, np.uint8)[: len(alpha)]
            out[..., :3], out[..., 3] = self.palette[pixels[..., 0]], alpha[pixels[..., 0]]
            return out
        scale = 255 // ((1 << self.depth) - 1)
        out[..., :3] = pixels[..., :3] if self.samples >= 3 else pixels[..., :1] * scale
        if self.samples in (2, 4):
            out[..., 3] = pixels[..., -1]
        elif key is not None and len(key) == self.samples:
            out[..., 3] = np.where((pixels == key).all(axis=2), 0, 255)
        return out


def tiles(payload: bytes, start: int, count: int, edge: int) -> Iterator[tuple]:
    """(tile, x, y, width, height, rgba_sha256, total_tiles) of a PNG's tiles from ``start`` on."""
    kind, *_ = header(payload)
    if kind != "png":
        raise SourceError("IMAGE_PIXELS_UNSUPPORTED")
    image = _Png(payload)
    across, down = -(-image.width // edge), -(-image.height // edge)
    stop = min(start + count, across * down)
    if start >= stop:
        return
    for row, band in enumerate(image.bands(edge)):
        for tile in range(max(start, row * across), min(stop, (row + 1) * across)):
            x = (tile - row * across) * edge
            part = band[:, x : x + edge]
            yield tile, x, row * edge, part.shape[1], part.shape[0], hashlib.sha256(part.tobytes()).hexdigest(), across * down
        if stop <= (row + 1) * across:
            return


def image_tiles(files: DataFrame, start: int = 0, count: int = MAX_TILES, edge: int = 512) -> DataFrame:
    """(path, source_sha256, error, tile, x, y, width, height, rgba_sha256, total_tiles) of a range of each file's tiles.

    Files (path, content) that aren't readable PNGs are one row with a code: other formats, interlaced images and samples of 16 bits too.
    A range behind the last tile has no row. Edges are 256 to 2048 and ranges 1 to 16 tiles.
    """
    if not EDGES[0] <= edge <= EDGES[1] or not 1 <= count <= MAX_TILES or start < 0:
        raise ValueError("RANGE_INVALID")
    return parse_files(files, TILES, lambda name, payload: tiles(payload, start, count, edge))
