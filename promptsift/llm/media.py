"""Binary media columns: PNG images, and hashes of their low frequencies.

The encoder writes 8-bit RGB rows of 64 pixels, each filtered by none, by its left or by its
upper neighbour, whichever leaves the least, deflated into chunks with their checksums. The
decoder takes any 8-bit grey, grey with alpha, RGB or RGBA file without interlace: it tests
each checksum, inflates, and undoes the five filters in numpy, runs of rows at a time for the
filters that allow it. A file that fails a test raises ValueError; in a column it gives a row
of nulls with the error. The feature is the sign of the lowest cosine frequencies of the image,
against their median.

Results for edge cases: a null text counts as empty, whose payload is 192 spaces; equal texts
have equal files and features; texts of any length are stored whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsift.llm.common import fresh, text_column

ROW = 192
WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHUNK = 1 << 16
#: Samples of a pixel by PNG colour type.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
_GRID, _LOW = 32, 8
_COSINE = np.cos(np.pi / _GRID * (np.arange(_GRID) + 0.5)[None, :] * np.arange(_LOW)[:, None])


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_of(payload: bytes) -> bytes:
    """The PNG file of a payload of whole rows."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    left = x.copy()
    left[:, 3:] -= x[:, :-3]
    up = x.copy()
    up[1:] -= x[:-1]
    ways = (x, left, up)
    left_over = np.stack([np.abs(w.view(np.int8).astype(np.int16)).sum(1, dtype=np.int32) for w in ways])
    best = left_over.argmin(0)
    rows = np.empty((len(x), ROW + 1), np.uint8)
    rows[:, 0] = best
    for k, w in enumerate(ways):
        rows[best == k, 1:] = w[best == k]
    data = zlib.compress(rows.tobytes(), 6)
    head = struct.pack(">IIBBBBB", WIDTH, len(x), 8, 2, 0, 0, 0)
    parts = [_chunk(b"IDAT", data[k : k + CHUNK]) for k in range(0, len(data), CHUNK)]
    return SIGNATURE + _chunk(b"IHDR", head) + b"".join(parts) + _chunk(b"IEND", b"")


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, up and upper left, the nearest to left + up - upper left."""
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def _unfilter(kinds: np.ndarray, rows: np.ndarray, bpp: int) -> np.ndarray:
    """The samples of filtered rows."""
    out = np.zeros_like(rows)
    edges = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(kinds)]
    for a, b in zip(edges, edges[1:]):
        kind = kinds[a]
        part = rows[a:b]
        if kind == 0:
            out[a:b] = part
        elif kind == 1:
            pixels = part.reshape(b - a, -1, bpp)
            out[a:b] = np.add.accumulate(pixels, axis=1, dtype=np.uint8).reshape(b - a, -1)
        elif kind == 2:
            out[a:b] = np.add.accumulate(part, axis=0, dtype=np.uint8)
            if a:
                out[a:b] += out[a - 1]
        elif kind in (3, 4):
            for y in range(a, b):
                above = out[y - 1].astype(np.int16) if y else np.zeros(rows.shape[1], np.int16)
                now = np.zeros(rows.shape[1] + bpp, np.int16)
                above = np.concatenate((np.zeros(bpp, np.int16), above))
                for at in range(bpp, len(now), bpp):
                    here, before = slice(at, at + bpp), slice(at - bpp, at)
                    guess = (now[before] + above[here]) // 2 if kind == 3 else _paeth(now[before], above[here], above[before])
                    now[here] = (rows[y, at - bpp : at] + guess) & 255
                out[y] = now[bpp:]
        else:
            raise ValueError(f"PNG filter {kind}")
    return out


def _header(data: bytes) -> tuple[int, int, int]:
    """Width, height and samples of a pixel."""
    if len(data) != 13:
        raise ValueError("PNG header of another size")
    width, height, depth, colour, method, filters, interlace = struct.unpack(">IIBBBBB", data)
    if depth != 8 or colour not in CHANNELS or method or filters or interlace or not width or not height:
        raise ValueError("PNG of a form that isn't read")
    return width, height, CHANNELS[colour]


def samples_of(media: bytes) -> np.ndarray:
    """The samples of a PNG file: height, width, channels."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, head, inflate, raw, ended = 8, None, zlib.decompressobj(), [], False
    size = got = 0
    while at < len(media) and not ended:
        if at + 12 > len(media):
            raise ValueError("PNG chunk cut short")
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if len(data) < n or zlib.crc32(kind + data) != int.from_bytes(media[at + 8 + n : at + 12 + n], "big"):
            raise ValueError(f"PNG checksum of {kind!r}")
        if kind == b"IHDR":
            head = _header(data)
            size = head[1] * (head[0] * head[2] + 1)
        elif kind == b"IDAT":
            if head is None:
                raise ValueError("PNG data before its header")
            try:
                # no more than the header says, and a byte to tell
                part = inflate.decompress(data, size + 1 - got) if got <= size else b""
            except zlib.error as e:
                raise ValueError("PNG data that can't be inflated") from e
            raw.append(part)
            got += len(part)
        ended = kind == b"IEND"
        at += 12 + n
    if head is None or not ended:
        raise ValueError("PNG without its header or end")
    width, height, bpp = head
    if got != size or not inflate.eof:
        raise ValueError("PNG data of another size")
    lines = np.frombuffer(b"".join(raw), np.uint8).reshape(height, width * bpp + 1)
    return _unfilter(lines[:, 0], lines[:, 1:], bpp).reshape(height, width, bpp)


def low_frequencies(samples: np.ndarray) -> str:
    """A 64-bit hash, as hexadecimal digits."""
    grey = samples.sum(2, dtype=np.int64)
    for axis in (0, 1):
        n = grey.shape[axis]
        if n < _GRID:
            grey = grey.take(np.arange(_GRID) * n // _GRID, axis)
        else:
            edges = np.arange(_GRID) * n // _GRID
            sizes = np.diff(np.append(edges, n))
            grey = np.add.reduceat(grey, edges, axis=axis) / (sizes[:, None] if axis == 0 else sizes)
    low = (_COSINE @ grey @ _COSINE.T).ravel()
    # rounded, so that a flat image doesn't hash noise of the arithmetic
    low = np.round(low, 6)
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


def payload_of(text: str | None) -> bytes:
    """The text's UTF-8 and spaces up to whole rows."""
    data = (text or "").encode("utf-8")
    return data.ljust(max(1, -(-len(data) // ROW)) * ROW)


def _stored(texts: list[str | None]) -> list[tuple]:
    return [(len((t or "").encode("utf-8")), png_of(payload_of(t))) for t in texts]


def _read(files: list[bytes | None]) -> list[tuple]:
    rows = []
    for media in files:
        try:
            samples = None if media is None else samples_of(media)
        except ValueError as e:
            samples, error = None, f"{e}"
        else:
            error = None
        if samples is None:
            rows.append((*(None,) * 6, error))
            continue
        payload = samples.tobytes()
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), low_frequencies(samples), None))
    return rows


def store_column():
    """A column function: text to a struct of its size in bytes and its PNG file."""
    return text_column(_stored, "n_bytes long, media binary")


def read_column():
    """A column function: a PNG file's bytes to a struct of digests and the feature; null for null, and an error for a bad file."""
    return text_column(_read, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def stored(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, media."""
    return docs.select("doc_id", store_column()(F.col("text")).alias("stored")).select("doc_id", "stored.*")


def features(images: DataFrame) -> DataFrame:
    """Per image: its other columns, and what is read from its media column, in place of columns of the same names."""
    made = ("media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")
    others = [c for c in images.columns if c.lower() not in made]
    r = fresh(images, "read")
    return images.select(*others, read_column()(F.col("media")).alias(r)).select(*others, f"{r}.*")
