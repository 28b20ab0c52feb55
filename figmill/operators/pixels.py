"""PNG files as pixel arrays and back, without an image library."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Samples per pixel of each PNG colour type (grey, colour, palette, grey and alpha, colour and alpha).
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Bytes of pixels that are handed on together.
BATCH_BYTES = 4 << 20
#: First column and row, and steps, of the seven passes of an interlaced file.
_PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(_SIGNATURE)
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at:at + 8])
        yield kind, data[at + 8:at + 8 + size]
        at += size + 12


def _unfilter(raw: np.ndarray, rows: int, width: int, step: int) -> np.ndarray:
    """Bytes of the rows after undoing each row's filter; ``step`` is the distance to the pixel on the left."""
    lines = raw[:rows * (width + 1)].reshape(rows, width + 1)
    if not lines[:, 0].any():
        return lines[:, 1:]
    out = np.zeros((rows + 1, width), np.uint8)
    for y in range(rows):
        kind, line, up = lines[y, 0], lines[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 2:
            out[y + 1] = line + up
        elif kind == 1:
            # sums along every step-th byte
            for s in range(step):
                out[y + 1, s::step] = np.cumsum(line[s::step], dtype=np.uint8)
        elif kind in (3, 4):
            left, corner, now, above = [0] * step, [0] * step, line.tolist(), up.tolist()
            for x in range(width):
                a, b, c = left[x % step], above[x], corner[x % step]
                if kind == 3:
                    v = (now[x] + (a + b) // 2) & 255
                else:
                    p = a + b - c
                    near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))
                    v = (now[x] + near[2]) & 255
                left[x % step], corner[x % step], now[x] = v, b, v
            out[y + 1] = now
        else:
            raise ValueError(f"unknown filter {kind}")
    return out[1:]


def _samples(raw: np.ndarray, rows: int, cols: int, samples: int, depth: int) -> np.ndarray:
    """Rows x columns x samples of one pass."""
    width = -(-cols * samples * depth // 8)
    data = _unfilter(raw, rows, width, max(1, samples * depth // 8))
    if depth == 16:
        return data.reshape(rows, -1, 2).astype(np.uint16).dot(np.array([256, 1], np.uint16)).reshape(rows, cols, samples)
    if depth < 8:
        data = np.unpackbits(data, axis=1).reshape(rows, -1, depth) @ (1 << np.arange(depth - 1, -1, -1))
        data = data[:, :cols * samples].astype(np.uint8)
    return data.reshape(rows, cols, samples)


def read_png(data: bytes) -> np.ndarray:
    """Height x width x samples, 8 or 16 bits: palettes are looked up, grey below 8 bits is stretched to 8."""
    if not data.startswith(_SIGNATURE):
        raise ValueError("not a PNG file")
    body, palette, alpha, head = [], None, None, None
    for kind, content in _chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"PLTE":
            palette = np.frombuffer(content, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(content, np.uint8)
        elif kind == b"IDAT":
            body.append(content)
    if head is None or not body:
        raise ValueError("a PNG file without pixels")
    w, h, depth, colour, _, _, interlaced = head
    samples = _SAMPLES[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if interlaced:
        out, at = np.zeros((h, w, samples), np.uint16 if depth == 16 else np.uint8), 0
        for x0, y0, dx, dy in _PASSES:
            cols, rows = max(0, -(-(w - x0) // dx)), max(0, -(-(h - y0) // dy))
            if cols and rows:
                out[y0::dy, x0::dx] = _samples(raw[at:], rows, cols, samples, depth)
                at += rows * (-(-cols * samples * depth // 8) + 1)
    else:
        out = _samples(raw, h, w, samples, depth)
    if colour == 3:
        rgb = palette[out[..., 0]]
        if alpha is None:
            return rgb
        full = np.full(len(palette), 255, np.uint8)
        full[:len(alpha)] = alpha
        return np.concatenate((rgb, full[out]), axis=2)
    return out * (255 // ((1 << depth) - 1)) if colour == 0 and depth < 8 else out


def write_png(pixels: np.ndarray) -> bytes:
    """A PNG file of height x width (x 1 to 4 samples), 8 or 16 bits; booleans become 0 and 255."""
    a = np.where(pixels, 255, 0).astype(np.uint8) if pixels.dtype == bool else pixels
    a = a[..., None] if a.ndim == 2 else a
    depth = 16 if a.dtype == np.uint16 else 8
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[a.shape[2]]
    lines = (a.astype(">u2") if depth == 16 else a.astype(np.uint8)).reshape(a.shape[0], -1)
    raw = np.concatenate((np.zeros((a.shape[0], 1), np.uint8), lines.view(np.uint8).reshape(a.shape[0], -1)), axis=1).tobytes()
    chunk = lambda kind, content: struct.pack(">I", len(content)) + kind + content + struct.pack(">I", zlib.crc32(kind + content))
    return _SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], depth, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def as_rgb(pixels: np.ndarray) -> np.ndarray:
    """Three 8-bit samples per pixel: grey is repeated, alpha left out, 16 bits cut to the upper 8."""
    a = (pixels >> 8).astype(np.uint8) if pixels.dtype == np.uint16 else pixels
    a = a[..., None] if a.ndim == 2 else a
    return np.repeat(a[..., :1], 3, axis=2) if a.shape[2] < 3 else a[..., :3]


def as_bgr(pixels: np.ndarray) -> np.ndarray:
    return as_rgb(pixels)[..., ::-1]


def mask_png(mask: np.ndarray) -> bytes:
    """A mask as a file: 16 bits stay as they are, 8 bits of at most 1 become 0 and 255."""
    if mask.dtype == np.uint16:
        return write_png(mask)
    m = mask.astype(np.uint8)
    return write_png(m * 255 if m.size and m.max() <= 1 else m)


def frames(batches: Iterator[pd.DataFrame], path: str, content: str, turn: Callable) -> Iterator[pd.DataFrame]:
    """Decoded files, handed on before their pixels are more than BATCH_BYTES and one file: pixels are many times their files."""
    def frame(out: list) -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series([r[i] for r in out], dtype=t) for i, (n, t) in enumerate([("path", object), ("height", "Int32"), ("width", "Int32"), ("pixels", object), ("error", object)])})

    for pdf in batches:
        out, size = [], 0
        for p, c in zip(pdf[path], pdf[content]):
            try:
                a = turn(read_png(bytes(c)))
                out.append((p, a.shape[0], a.shape[1], a.tobytes(), None))
                size += a.size
            except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error) as e:
                out.append((p, None, None, None, str(e) or type(e).__name__))
            if size >= BATCH_BYTES:
                yield frame(out)
                out, size = [], 0
        if out:
            yield frame(out)


def decoded(files: DataFrame, path: str = "path", content: str = "content", colours: str = "rgb") -> DataFrame:
    """``path, height, width, pixels, error``: files as bytes of three samples per pixel, rows from the top.

    A file that cannot be read keeps its row, with NULL pixels and the reason.
    """
    turn = {"rgb": as_rgb, "bgr": as_bgr}[colours]
    return files.select(path, content).mapInPandas(lambda batches: frames(batches, path, content, turn), "path string, height int, width int, pixels binary, error string")
