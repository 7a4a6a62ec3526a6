"""PNG files as arrays, by zlib and numpy: Spark's image source keeps only the low byte of 16-bit samples."""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel of each colour type: grey, RGB, grey with alpha, RGB with alpha.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def _chunks(content: bytes):
    at = len(SIGNATURE)
    while at + 8 <= len(content):
        size, kind = struct.unpack_from(">I4s", content, at)
        yield kind, content[at + 8 : at + 8 + size]
        at += size + 12


def _unfilter(rows: np.ndarray, step: int) -> np.ndarray:
    """Bytes of the picture from filtered rows; the first byte of each row names its filter."""
    out = np.zeros((len(rows), rows.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    for row, target in zip(rows, out):
        kind, line = row[0], row[1:]
        if kind == 0:
            target[:] = line
        elif kind == 1:  # running sums of each byte of a pixel
            target[:] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
        elif kind == 2:
            target[:] = line + above
        elif kind in (3, 4):
            before, corner = np.zeros(step, np.int32), np.zeros(step, np.int32)
            for i in range(0, len(line), step):
                up = above[i : i + step].astype(np.int32)
                if kind == 3:
                    guess = (before + up) // 2
                else:
                    p = before + up - corner
                    a, b, c = abs(p - before), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), before, np.where(b <= c, up, corner))
                before = (line[i : i + step] + guess) & 255
                target[i : i + step] = before
                corner = up
        else:
            raise ValueError(f"PNG filter {kind} is unknown")
        above = target
    return out


def decode(content: bytes) -> np.ndarray:
    """(height, width) or (height, width, channels) samples of 8 or 16 bits, not interlaced, without palette."""
    if not content.startswith(SIGNATURE):
        raise ValueError("not a PNG file")
    data, head = [], None
    for kind, body in _chunks(content):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
    if head is None:
        raise ValueError("a PNG file without a header")
    width, height, depth, colour, _, _, interlaced = head
    if depth not in (8, 16) or colour not in CHANNELS or interlaced:
        raise ValueError(f"PNG of depth {depth}, colour type {colour}, interlacing {interlaced} is not read")
    n, size = CHANNELS[colour], depth // 8
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * n * size)
    samples = _unfilter(rows, n * size).view(np.dtype(">u2" if size == 2 else "u1"))
    return samples.reshape((height, width) if n == 1 else (height, width, n)).astype(np.uint16 if size == 2 else np.uint8)


def encode(samples: np.ndarray) -> bytes:
    """A PNG file of grey or RGB samples, rows filtered by the row above."""
    size = samples.dtype.itemsize
    height, width = samples.shape[:2]
    raw = samples.astype(f">u{size}").reshape(height, -1).view(np.uint8)
    up = np.vstack([raw[:1], raw[1:] - raw[:-1]])
    rows = np.hstack([np.full((height, 1), 2, np.uint8), up])
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8 * size, 0 if samples.ndim == 2 else 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")
