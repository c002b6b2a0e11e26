"""Exact substring deduplication: bytes of strings of 100 bytes that also start earlier go.

1. Texts are written once, compressed and in buckets by row, so that later joins read them in place.
2. Anchors: among the 32-byte strings inside a 100-byte window the one with the least hash is
   its anchor (the first of equal ones), so that equal windows have equal anchors at equal
   places. Windows with the same anchor in a row are a piece; its key is the anchor's hash.
   Only pieces whose key occurs again can hold a window that occurs again.
3. Pieces of equal content are one to all later steps: their first stays, and every window of
   the others has an earlier start. What a batch of texts shows of that isn't shuffled by key.
4. The different pieces of a key are one lane of a suffix array (linear grouping, see
   ``suffix_array``). Windows that share 100 bytes are neighbours there, compared byte by
   byte; all but the first of them are repeated.
5. A text's repeated windows meet the text again, and what they cover goes.

Skew: a key with more than a thousandth of a batch's pieces, and as much of all, is cut by
its windows' places around the anchor: four windows share 97 bytes, whose hash is then their
key. So are the pieces of a key with over ``CROWD`` contents, in a second round. Nothing is
dropped; a finer key only separates windows that differ.

Edge cases: a null text is empty; texts under 100 bytes lose nothing. A null doc_id counts as
the smallest. Rows that share a doc_id are documents of their own, in the order of the table's
files. An empty table gives no rows. Other columns are ignored, whatever their names. Matches
go by bytes, so what is kept may begin or end inside a character, and is binary.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsift.llm.common import bucketed, written
from promptsift.llm.suffix_array import ranges, suffix_arrays

SPAN = 100
ANCHOR = 32
#: Windows of a slice of a crowded piece.
SLICE = 4
#: Contents of a key that a lane holds; the pieces of a key with more are sliced.
CROWD = 256
#: A key with one in so many pieces is hot.
HOT_ONE_IN = 1000
#: Bytes of texts that are cut into pieces together, and of pieces that are sorted together.
_CHUNK, _LANES = 1 << 20, 3 << 19
_PLACES = np.uint64((1 << 22) - 1)
_BACK = SPAN - ANCHOR
#: An anchor's place that says that a piece is a slice already, and one that says that it is a run of copies.
_SLICED, _COPY = 255, 254

#: at: where the first window starts, the anchor's place from there, the number of windows (16 and 8 bits up from 0). Of copies, content is the number.
_PIECE = pa.schema([(c, pa.int64()) for c in ("key", "content", "ref", "row", "at")])
_FOUND = "row long, start long, n long, mid short, key long, crowded boolean"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and the powers of an odd number and of its inverse modulo 2^64."""
    size, base = 2 * _CHUNK + 2 * SPAN, 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    powers = [np.multiply.accumulate(np.append(np.uint64(1), np.full(size, b, np.uint64))) for b in (base, inverse)]
    return _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base)), *powers


class _Sums:
    """Hashes of any part of joined texts, from one running sum."""

    def __init__(self, text: np.ndarray):
        of_byte, self.up, down = _powers()
        self.sums = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(of_byte[text] * down[: len(text)], out=self.sums[1:])

    def parts(self, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
        return _mixed((self.sums[starts + sizes] - self.sums[starts]) * self.up[starts] + np.asarray(sizes, np.uint64))

    def anchors(self) -> np.ndarray:
        n = len(self.sums) - ANCHOR
        return _mixed((self.sums[ANCHOR:] - self.sums[:n]) * self.up[:n] + np.uint64(ANCHOR))


def _sliced(starts: np.ndarray, sizes: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The slices of pieces: the piece's number, the first window, how many, and where the bytes that they share begin."""
    first = (starts - anchors + _BACK) // SLICE
    counts = (starts + sizes - 1 - anchors + _BACK) // SLICE - first + 1
    of = np.repeat(np.arange(len(starts)), counts)
    begin = anchors[of] - _BACK + SLICE * ranges(first, counts)
    a = np.maximum(starts[of], begin)
    return of, a, np.minimum(starts[of] + sizes[of], begin + SLICE) - a, begin + SLICE - 1


@functools.cache
def _numbers() -> np.ndarray:
    return np.arange(2 * _CHUNK + 2 * SPAN, dtype=np.uint64)


@dataclass
class _Cut:
    """Pieces of joined slices of texts: first window, how many, the anchor, the slice and the key of each."""

    sums: _Sums
    low: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    mids: np.ndarray
    of: np.ndarray
    keys: np.ndarray

    @staticmethod
    def of_texts(texts: list[bytes]) -> _Cut | None:
        sizes = np.array([len(t) for t in texts])
        text = np.frombuffer(b"".join(texts), np.uint8)
        low = np.cumsum(sizes) - sizes
        n = len(text) - SPAN + 1
        if n < 1:
            return None
        sums = _Sums(text)
        anchor = sums.anchors()
        least = anchor & ~_PLACES
        least |= _numbers()[: len(least)]
        width, wanted = 1, _BACK + 1
        while 2 * width <= wanted:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:n], least[wanted - width : wanted - width + n])
        stops = np.maximum(low, low + sizes - SPAN + 1)
        edge = np.empty(n + 1, bool)
        edge[0] = edge[n] = True
        np.not_equal(least[1:], least[:-1], out=edge[1:n])
        edge[low[low <= n]] = edge[stops[stops <= n]] = True
        cuts = np.flatnonzero(edge)
        starts, counts = cuts[:-1], np.diff(cuts)
        of = np.searchsorted(low, starts, side="right") - 1
        inside = starts < stops[of]
        starts, counts, of = starts[inside], counts[inside], of[inside]
        mids = (least[starts] & _PLACES).astype(np.int64)
        return _Cut(sums, low, starts, counts, mids, of, anchor[mids])

    def contents(self, at: np.ndarray | slice) -> np.ndarray:
        return self.sums.parts(self.starts[at], self.counts[at] + SPAN - 1)

    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys that have over a thousandth of the pieces, and how many different ones."""
        keys, of, counts = np.unique(self.keys, return_inverse=True, return_counts=True)
        least = max(16, len(self.keys) // HOT_ONE_IN)
        at = np.flatnonzero((counts > least)[of])
        pairs = np.unique(np.stack([of[at].astype(np.uint64), self.contents(at)]), axis=1)[0].astype(np.int64)
        counts = np.bincount(pairs, minlength=len(keys))
        often = counts > least
        return keys[often].view(np.int64), counts[often]


def _pieces_of(slices: list[tuple[bytes, int, int, int]], hot: np.ndarray) -> list[np.ndarray]:
    """The pieces of texts' slices (bytes, ref, row, where the slice begins in its text), as columns of _PIECE."""
    cut = _Cut.of_texts([s[0] for s in slices])
    if cut is None:
        return [np.empty(0, np.int64)] * len(_PIECE)
    starts, counts, of, keys, mids = cut.starts, cut.counts, cut.of, cut.keys, cut.mids - cut.starts
    is_hot = np.isin(keys, hot) if len(hot) else np.zeros(len(keys), bool)
    content = cut.contents(slice(None))
    if is_hot.any():
        p, a, n_windows, core = _sliced(starts[is_hot], counts[is_hot], cut.mids[is_hot])
        core_keys = cut.sums.parts(core, SPAN - SLICE + 1) + (core - cut.mids[is_hot][p]).astype(np.uint64)
        cold = ~is_hot
        content = np.append(content[cold], cut.sums.parts(a, n_windows + SPAN - 1))
        starts, counts, of = np.append(starts[cold], a), np.append(counts[cold], n_windows), np.append(of[cold], of[is_hot][p])
        keys, mids = np.append(keys[cold], core_keys), np.append(mids[cold], np.full(len(a), _SLICED))
    refs, rows, begins = (np.array([s[k] for s in slices], np.int64) for k in (1, 2, 3))
    by_doc = np.empty(len(slices), np.int64)
    by_doc[np.lexsort((begins, rows, refs))] = np.arange(len(slices))
    order = np.lexsort((starts, by_doc[of], content, keys))
    copy = np.zeros(len(order), bool)
    copy[order[1:]] = (keys[order[1:]] == keys[order[:-1]]) & (content[order[1:]] == content[order[:-1]])
    begin = starts - cut.low[of] + begins[of]
    own = ~copy
    columns = [keys.view(np.int64)[own], content.view(np.int64)[own], refs[of[own]], rows[of[own]], begin[own] << 16 | mids[own] << 8 | counts[own]]
    if copy.any():
        # windows with an earlier start, in runs, which only pass through: they are dealt by their place
        at = np.flatnonzero(copy)
        at = at[np.lexsort((starts[at], of[at]))]
        first = np.flatnonzero(np.append(True, (starts[at[1:]] != starts[at[:-1]] + counts[at[:-1]]) | (of[at[1:]] != of[at[:-1]])))
        n, at = np.add.reduceat(counts[at], first), at[first]
        dealt = _mixed((rows[of[at]] * 1_000_003 + begin[at]).view(np.uint64)).view(np.int64)
        columns = [np.append(c, x) for c, x in zip(columns, (dealt, n, refs[of[at]], rows[of[at]], begin[at] << 16 | _COPY << 8))]
    return columns


def _chunks(texts: Iterator[tuple[bytes, int, int]]) -> Iterator[list[tuple[bytes, int, int, int]]]:
    """Slices of texts, about _CHUNK bytes at a time; those of a long text overlap by a window."""
    held, size = [], 0
    for text, ref, row in texts:
        for at in range(0, max(1, len(text) - SPAN + 1), _CHUNK):
            held.append((text[at : at + _CHUNK + SPAN - 1], ref, row, at))
            size += len(held[-1][0])
            if size >= _CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _pieces(hot: list[int]):
    keys = np.array(hot, np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ((zlib.decompress(packed), ref, row) for ref, row, packed in zip(*(batch[c].to_pylist() for c in ("ref", "row", "packed"))))
            for held in _chunks(texts):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _pieces_of(held, keys)], schema=_PIECE)

    return run


def hot_keys(texts: DataFrame) -> list[int]:
    """Keys that have over a thousandth of all pieces: fewer than a thousand."""
    total = texts.agg(F.sum("n_pieces")).first()[0] or 0
    counted = texts.select(F.explode("common").alias("c")).groupBy("c.key").agg(F.sum("c.n").alias("n"))
    return [r.key for r in counted.filter(F.col("n") * HOT_ONE_IN > total).select("key").collect()]


_OUT = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("mid", pa.int16()), ("key", pa.int64()), ("crowded", pa.bool_())])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pieces sorted by key, content and place: copies (without a key), and the first pieces of contents of keys that have several.

    Of a key that goes on in the next batch at most CROWD + 1 pieces are held.
    """
    names = ("row", "start", "n", "mid", "key")
    held = {c: np.empty(0, np.int64) for c in names}
    last, crowded = None, False

    def rows(of: dict[str, np.ndarray], key: np.ndarray | None, crowded) -> pa.RecordBatch:
        n = len(of["row"])
        keys = pa.nulls(n, pa.int64()) if key is None else pa.array(key)
        return pa.RecordBatch.from_arrays([*(pa.array(of[c], _OUT.field(c).type) for c in names[:4]), keys, pa.array(np.broadcast_to(crowded, n))], schema=_OUT)

    for batch in batches:
        at = {c: batch[c].to_numpy(zero_copy_only=False) for c in ("key", "content", "row", "at")}
        packed = at.pop("at")
        at |= {"start": packed >> 16, "n": packed & 255, "mid": packed >> 8 & 255}
        if (passing := at["mid"] == _COPY).any():
            yield rows({c: at[c][passing] for c in names} | {"n": at["content"][passing]}, None, False)
            at = {c: v[~passing] for c, v in at.items()}
        if not len(at["key"]):
            continue
        keys, contents = at["key"], at["content"]
        new = np.append(last != (keys[0], contents[0]), (keys[1:] != keys[:-1]) | (contents[1:] != contents[:-1]))
        if not new.all():
            yield rows({c: at[c][~new] for c in names}, None, False)
        if last is not None and last[0] != keys[0]:
            if crowded or len(held["key"]) > 1:
                yield rows(held, held["key"], crowded)
            held, crowded = {c: v[:0] for c, v in held.items()}, False
        firsts = {c: np.append(held[c], at[c][new]) for c in names}
        key = firsts["key"]
        last = (keys[-1], contents[-1])
        goes_on = key == keys[-1] if len(key) else np.zeros(0, bool)
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        counts = np.repeat(np.diff(begin, append=len(key)), np.diff(begin, append=len(key)))
        was = crowded & (key == key[0]) if crowded and len(key) else np.zeros(len(key), bool)
        crowds = was | (counts > CROWD)
        out = crowds | ~goes_on & (counts > 1)
        if out.any():
            yield rows({c: firsts[c][out] for c in names}, key[out], crowds[out])
        crowded = bool((crowds & goes_on).any()) or (crowded and last[0] == keys[0] and not len(key))
        rest = goes_on & ~out
        held = {c: firsts[c][rest] for c in names}
    if len(held["key"]) > 1:
        yield rows(held, held["key"], False)


_BYTES = pa.schema([("key", pa.int64()), ("ref", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("piece", pa.binary())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted pieces; those of crowded keys by slices, with the slices' keys."""
    for batch in batches:
        out, size = [], 0
        for ref, row, packed, wanted in zip(*(batch[c].to_pylist() for c in ("ref", "row", "packed", "wanted"))):
            text = zlib.decompress(packed)
            for w in wanted:
                key, start, n = w["key"], w["start"], w["n"]
                parts = [(key, start, n)]
                if w["crowded"] and w["mid"] != _SLICED:
                    of, a, counts, core = _sliced(np.array([start]), np.array([n]), np.array([start + w["mid"]]))
                    salts = (core - start - w["mid"]).tolist()
                    parts = [(int.from_bytes(hashlib.blake2b(text[c : c + SPAN - SLICE + 1], digest_size=8, key=f"{key} {salt}".encode()).digest(), "little", signed=True), b, k) for b, k, c, salt in zip(a.tolist(), counts.tolist(), core.tolist(), salts)]
                for k, b, c in parts:
                    out.append((k, ref, row, b, c, text[b : b + c + SPAN - 1]))
                    size += c + SPAN - 1
            if size > _CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _BYTES)], schema=_BYTES)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _BYTES)], schema=_BYTES)


def _same(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the windows at a and at b have the same bytes."""
    words = np.ndarray(len(text) - 7, "<u8", text, strides=(1,))
    same = np.arange(len(a))
    for k in (*range(0, SPAN - 8, 8), SPAN - 8):
        same = same[words[a[same] + k] == words[b[same] + k]]
    equal = np.zeros(len(a), bool)
    equal[same] = True
    return equal


def repeated_windows(lanes: list[list[tuple[int, int, int, int, bytes]]]) -> dict[str, np.ndarray]:
    """Runs of windows that start earlier in another piece of their lane; pieces are (ref, row, start, n, bytes)."""
    lanes = sorted(lanes, key=lambda pieces: -sum(len(p[4]) for p in pieces))
    pieces = [p for lane in lanes for p in lane]
    text, bounds, order = suffix_arrays([np.frombuffer(b"".join(p[4] for p in lane), np.uint8) for lane in lanes])
    refs, rows, starts, counts = (np.array([p[k] for p in pieces], np.int64) for k in range(4))
    sizes = np.array([len(p[4]) for p in pieces])
    low = np.cumsum(sizes) - sizes
    rank = np.empty(len(pieces), np.int64)
    rank[np.lexsort((starts, rows, refs))] = np.arange(len(pieces))
    of = np.repeat(np.arange(len(pieces)), sizes)
    place = np.arange(len(text)) - low[of]
    windows = order[place[order] < counts[of[order]]]
    lane = np.searchsorted(bounds, windows, side="right")
    apart = np.append(True, (lane[1:] != lane[:-1]) | ~_same(text, windows[1:], windows[:-1]))
    first = (rank[of] << 20 | place)[windows]
    runs = np.flatnonzero(apart)
    again = np.sort(windows[first != np.repeat(np.minimum.reduceat(first, runs), np.diff(runs, append=len(windows)))])
    begin = np.flatnonzero(np.append(True, (again[1:] != again[:-1] + 1) | (of[again[1:]] != of[again[:-1]]))) if len(again) else again
    at = again[begin]
    return {"row": rows[of[at]], "start": starts[of[at]] + place[at], "n": np.diff(begin, append=len(again))}


_RUNS = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of pieces sorted by key, bytes and place."""
    lanes, size, key, before = [], 0, None, None

    def flush() -> pa.RecordBatch:
        found = repeated_windows([x for x in lanes if len(x) > 1])
        return pa.RecordBatch.from_arrays([pa.array(found[f.name]) for f in _RUNS], schema=_RUNS)

    for batch in batches:
        copies = []
        for k, *piece in zip(*(batch[c].to_pylist() for c in ("key", "ref", "row", "start", "n", "piece"))):
            if k != key:
                if size >= _LANES:
                    yield flush()
                    lanes, size = [], 0
                lanes.append([])
                key, before = k, None
            if piece[4] == before:
                copies.append(piece[1:4])
                continue
            before = piece[4]
            lanes[-1].append(tuple(piece))
            size += len(before)
        if copies:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*copies)], schema=_RUNS)
    if any(len(x) > 1 for x in lanes):
        yield flush()


_PACKED = "row long, ref long, doc_id long, packed binary, n_pieces long, common array<struct<key:long,n:long>>"
_COMMON = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, compressed; at the first text of a batch, how many pieces it has and its common keys."""
    for batch in batches:
        texts = [(t or "").encode() for t in batch["text"].to_pylist()]
        n, common = 0, []
        for held in _chunks((t, 0, 0) for t in texts):
            if (cut := _Cut.of_texts([s[0] for s in held])) is not None:
                n += len(cut.keys)
                common += [{"key": k, "n": c} for k, c in zip(*(x.tolist() for x in cut.common()))]
        counts, keys = [n, *[0] * (len(texts) - 1)], [common, *[None] * (len(texts) - 1)]
        columns = [*(batch[c] for c in ("row", "ref", "doc_id")), pa.array([zlib.compress(t, 1) for t in texts], pa.binary()), pa.array(counts[: len(texts)], pa.int64()), pa.array(keys[: len(texts)], _COMMON)]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "ref", "doc_id", "packed", "n_pieces", "common"])


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("kept", pa.binary())])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, size = [], 0
        for doc_id, packed, runs in zip(*(batch[c].to_pylist() for c in ("doc_id", "packed", "runs"))):
            text, spans = zlib.decompress(packed), []
            for start, n in sorted((r["start"], r["n"]) for r in runs or ()):
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], start + n + SPAN - 1)
                else:
                    spans.append([start, start + n + SPAN - 1])
            edges = [0, *(e for s in spans for e in s), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((doc_id, len(text), len(text) - len(kept), len(spans), [{"start": a, "length": b - a} for a, b in spans], kept))
            size += len(kept)
            if size > 4 * _CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _KEPT)], schema=_KEPT)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _KEPT)], schema=_KEPT)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (start and length of each run that goes) and kept (the bytes left)."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("ref"), doc_id.alias("doc_id"), "text")
    texts = bucketed(rows.mapInArrow(_packed, _PACKED), "row")
    pieces = texts.select("ref", "row", "packed").mapInArrow(_pieces(hot_keys(texts)), "key long, content long, ref long, row long, at long")
    found = written(pieces.repartition("key").sortWithinPartitions("key", "content", "ref", "row", "at").mapInArrow(_repeated, _FOUND), "windows")
    wanted = found.filter("key IS NOT NULL").groupBy("row").agg(F.collect_list(F.struct("key", "start", "n", "mid", "crowded")).alias("wanted"))
    read = texts.join(wanted, "row").select("ref", "row", "packed", "wanted").mapInArrow(_read, "key long, ref long, row long, start long, n long, piece binary")
    sorted_out = read.repartition("key").sortWithinPartitions("key", "piece", "ref", "row", "start").mapInArrow(_sorted_out, "row long, start long, n long")
    runs = found.filter("key IS NULL").select("row", "start", "n").unionByName(sorted_out).groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    return texts.join(runs, "row", "left").select("doc_id", "packed", "runs").mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,length:long>>, kept binary")
