"""PNG as a stream: bands of rows are deflated apart, and files are read a few rows at a time.

A file is written in parts: what stands before the pixels, one part a band, and what stands after them. Bands end at a
byte of the deflate stream and are chunks of their own, so only the check sum over all pixels is put together, from the
bands' sums. Reading inflates by chunks, undoes the filter of a row with the row before, and holds these two rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes that are inflated at a time.
CHUNK = 1 << 16
_ADLER = 65521
#: Samples a pixel by colour type: grey, RGB, palette, grey with alpha, RGBA.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


class Unreadable(ValueError):
    """The content isn't a PNG that this reads; the text says why."""


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def band(rgba: np.ndarray, first: bool) -> tuple[bytes, int, int]:
    """The chunk of a band of rows, and the check sum and number of its bytes before deflating. first: of its image."""
    h, w, _ = rgba.shape
    lines = np.concatenate([np.zeros((h, 1), dtype=np.uint8), rgba.astype(np.uint8).reshape(h, w * 4)], axis=1).tobytes()
    deflate = zlib.compressobj(wbits=-15)
    data = deflate.compress(lines) + deflate.flush(zlib.Z_FULL_FLUSH)
    return chunk(b"IDAT", (b"\x78\x9c" if first else b"") + data), zlib.adler32(lines), len(lines)


def head(width: int, height: int) -> bytes:
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0))


def combined(sums: list[tuple[int, int]]) -> int:
    """The Adler-32 of texts one after the other, from the sum and the length of each."""
    a, b = 1, 0
    for adler, n in sums:
        low, high = adler & 0xFFFF, adler >> 16
        b = (b + high + n % _ADLER * (a - 1)) % _ADLER
        a = (a + low - 1) % _ADLER
    return b << 16 | a


def tail(sums: list[tuple[int, int]]) -> bytes:
    """An empty last block with the check sum, and the end."""
    return chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", combined(sums))) + chunk(b"IEND", b"")


def encoded(rgba: np.ndarray, rows: int = 64) -> bytes:
    """A whole PNG, by bands of so many rows."""
    bands = [band(rgba[y : y + rows], y == 0) for y in range(0, len(rgba), rows)]
    return b"".join([head(rgba.shape[1], rgba.shape[0]), *[data for data, _, _ in bands], tail([x[1:] for x in bands])])


def _chunks(content: bytes) -> Iterator[tuple[bytes, memoryview]]:
    view, at = memoryview(content), len(SIGNATURE)
    while at + 8 <= len(view):
        n, kind = struct.unpack(">I4s", view[at : at + 8])
        if at + 12 + n > len(view):
            raise Unreadable("the file ends within a chunk")
        yield kind, view[at + 8 : at + 8 + n]
        at += 12 + n


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row's bytes; step: bytes a pixel."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise Unreadable(f"a row has filter {kind}")
    out, up = bytearray(line.tobytes()), above.tobytes()
    for i in range(len(out)):
        left, corner = (out[i - step], up[i - step]) if i >= step else (0, 0)
        if kind == 3:
            guess = (left + up[i]) >> 1
        else:  # whichever of the three is nearest to left + above - corner
            p = left + up[i] - corner
            a, b, c = abs(p - left), abs(p - up[i]), abs(p - corner)
            guess = left if a <= b and a <= c else up[i] if b <= c else corner
        out[i] = (out[i] + guess) & 255
    return np.frombuffer(bytes(out), dtype=np.uint8)


class Reader:
    """width, height, and the rows of a PNG: 8 or 16 bits a sample, or fewer in grey and palettes; not interlaced."""

    def __init__(self, content: bytes):
        if not content.startswith(SIGNATURE):
            raise Unreadable("not a PNG")
        self.content, self.colors, self.clear = content, None, None
        chunks = _chunks(content)
        kind, data = next(chunks, (b"", b""))
        if kind != b"IHDR" or len(data) != 13:
            raise Unreadable("no header")
        self.width, self.height, self.depth, self.type, _, _, lace = struct.unpack(">IIBBBBB", data)
        if self.type not in _SAMPLES or self.depth not in (1, 2, 4, 8, 16) or not self.width or not self.height:
            raise Unreadable("the header has unknown values")
        if lace:
            raise Unreadable("interlaced")
        for kind, data in chunks:
            if kind == b"PLTE":
                self.colors = np.frombuffer(data, dtype=np.uint8).reshape(-1, 3)
            elif kind == b"tRNS":
                self.clear = np.frombuffer(data, dtype=np.uint8)
            elif kind == b"IDAT":
                break
        else:
            raise Unreadable("no pixels")
        if self.type == 3 and self.colors is None:
            raise Unreadable("no palette")

    def _lines(self) -> Iterator[np.ndarray]:
        """Rows of bytes without their filters."""
        bits = self.depth * _SAMPLES[self.type]
        n, step = (self.width * bits + 7) // 8, max(1, bits // 8)
        most = max(CHUNK, n + 1)
        above, inflate, held = np.zeros(n, dtype=np.uint8), zlib.decompressobj(), b""
        done = 0
        for kind, data in _chunks(self.content):
            if kind != b"IDAT":
                continue
            for at in range(0, len(data), CHUNK):
                rest, more = bytes(data[at : at + CHUNK]), True
                while more and done < self.height:
                    try:
                        got = inflate.decompress(rest, most)
                    except zlib.error as e:
                        raise Unreadable(f"the pixels don't inflate: {e}") from e
                    rest, held = inflate.unconsumed_tail, held + got
                    more = bool(rest) or len(got) == most
                    whole = len(held) // (n + 1)
                    for k in range(min(whole, self.height - done)):
                        line = np.frombuffer(held, dtype=np.uint8, count=n + 1, offset=k * (n + 1))
                        above = _unfiltered(int(line[0]), line[1:], above, step)
                        yield above
                        done += 1
                    held = held[whole * (n + 1) :]
        if done < self.height:
            raise Unreadable(f"{done} of {self.height} rows are there")

    def rows(self) -> Iterator[np.ndarray]:
        """The pixels of each row as r, g, b, a."""
        samples = _SAMPLES[self.type]
        for line in self._lines():
            if self.depth < 8:
                bits = np.unpackbits(line).reshape(-1, self.depth)
                v = (bits @ (1 << np.arange(self.depth)[::-1])).astype(np.int64)[: self.width * samples].reshape(self.width, samples)
            else:
                wide = line.reshape(-1, self.depth // 8).astype(np.int64)
                v = (wide[:, 0] if self.depth == 8 else wide[:, 0] << 8 | wide[:, 1]).reshape(self.width, samples)
            out = np.full((self.width, 4), 255, dtype=np.uint8)
            if self.type == 3:
                at = np.minimum(v[:, 0], len(self.colors) - 1)
                out[:, :3] = self.colors[at]
                if self.clear is not None:
                    out[:, 3] = np.concatenate([self.clear, np.full(256, 255, dtype=np.uint8)])[at]
                yield out
                continue
            if self.type in (0, 2) and self.clear is not None and len(self.clear) >= 2 * samples:
                key = self.clear[: 2 * samples : 2].astype(np.int64) << 8 | self.clear[1 : 2 * samples : 2]
                out[(v == key).all(axis=1), 3] = 0
            full = (1 << self.depth) - 1
            v = v >> 8 if self.depth == 16 else v if self.depth == 8 else v * 255 // full
            out[:, :3] = v[:, :3] if samples >= 3 else v[:, :1]
            if samples in (2, 4):
                out[:, 3] = v[:, -1]
            yield out
