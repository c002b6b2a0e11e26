"""Byte-pair encoding by a contiguous rank array.

A word (a piece of the pre-tokenizer) is encoded by holding the boundaries of its parts and,
in a second list of the same order, the merge ranks of adjacent parts, which the bytes between
the boundaries name. The lowest rank is looked for by a scan, its boundary is deleted and the
two neighbouring ranks are looked up again. Scans are quadratic, so words of over ``SHORT``
bytes take a heap over linked parts instead, with the same result.

Results for edge cases: a null text counts as empty and has no ids; equal texts have equal
ids; texts of any length are encoded whole; special tokens of the file are recognised inside
texts, as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from functools import lru_cache
from itertools import pairwise

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsift.llm.common import text_column

SHORT = 256
NONE = 1 << 60
#: Holds the length of a part.
LEFT = (1 << 10) - 1
#: Fixed value: the public pre-tokenizer pattern of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space that the quick split by single spaces and line ends can't place.
ODD_SPACE = regex.compile(r"[^\S \n]|[\x1c-\x1f]")
CACHE = 500_000


def printable_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary file stands for.

    Bytes that print stand for themselves; the others are written, in order, as the code
    points from 256 on.
    """
    shown = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    hidden = [b for b in range(256) if b not in shown]
    return {c: b for b, c in shown.items()} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Ranks:
    """The merges of a byte-level tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_byte = printable_bytes()
        vocab = spec["model"]["vocab"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.text = {i: bytes(as_byte[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.id_of = {data: i for i, data in self.text.items()}
        self.text |= {i: s.encode() for s, i in self.special.items()}
        self.first = [0] * 256
        for s, i in vocab.items():
            if len(s) == 1:
                self.first[as_byte[s]] = i
        self.pair: dict[int, int] = {}
        self.made: list[int] = []
        #: By what a merge makes: its rank, and below that the length of its left part, which tells it from other cuts of the same bytes.
        self.merge: dict[bytes, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pair[vocab[left] << 20 | vocab[right]] = rank
            self.made.append(vocab[left + right])
            self.merge[self.text[vocab[left + right]]] = rank * (LEFT + 1) + len(self.text[vocab[left]])

    def encode(self, word: bytes) -> list[int]:
        return self._short(word) if len(word) <= SHORT else self._long(word)

    def _short(self, word: bytes) -> list[int]:
        merge_of, id_of = self.merge.get, self.id_of
        cuts = list(range(len(word) + 1))  # part k is word[cuts[k]:cuts[k + 1]]
        ranks = [x if (x := merge_of(word[k : k + 2], NONE)) & LEFT == 1 else NONE for k in range(len(word) - 1)]
        while ranks and (least := min(ranks)) != NONE:
            k = ranks.index(least)
            del cuts[k + 1], ranks[k]
            if k < len(ranks):
                a, b, c = cuts[k : k + 3]
                ranks[k] = x if (x := merge_of(word[a:c], NONE)) & LEFT == b - a else NONE
            if k:
                a, b, c = cuts[k - 1 : k + 2]
                ranks[k - 1] = x if (x := merge_of(word[a:c], NONE)) & LEFT == b - a else NONE
        return [id_of[word[a:b]] for a, b in pairwise(cuts)]

    def _long(self, word: bytes) -> list[int]:
        rank_of, made, n = self.pair.get, self.made, len(word)
        parts = [self.first[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank_of(parts[k] << 20 | parts[k + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            if parts[k] < 0 or (j := after[k]) >= n or rank_of(parts[k] << 20 | parts[j], NONE) != rank:
                continue
            parts[k], parts[j] = made[rank], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for at in (before[k], k):
                if at >= 0 and after[at] < n and (r := rank_of(parts[at] << 20 | parts[after[at]], NONE)) != NONE:
                    heapq.heappush(heap, (r, at))
        return [p for p in parts if p >= 0]


class PieceCache(dict):
    """The little-endian ids of each piece met so far; emptied when full, so that it stays small."""

    def __init__(self, ids_of):
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = array("I", self.ids_of(piece)).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Codec:
    """encode() and decode() of whole texts, ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.ranks = Ranks(path)
        self.pieces = regex.compile(PIECES).findall
        self.cache = PieceCache(lambda piece: self.ranks.encode(piece.encode("utf-8")))
        self.chunks = ChunkCache(self)
        special = sorted(self.ranks.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.marks = special

    def plain(self, text: str) -> bytes:
        """Of a text without special tokens."""
        return b"".join(map(self.cache.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> bytes:
        if self.special and any(mark in text for mark in self.marks):
            at = self.ranks.special
            return b"".join(array("I", [at[x]]).tobytes() if x in at else self.plain(x) for x in self.special.split(text))
        if "  " in text or " \n" in text or "\n\n" in text or "\n " in text or text[-1:] == " ":
            return self.plain(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            return (self.plain(first) if first else b"") + b"".join(map(self.chunks.__getitem__, rest))
        except OddSpace:
            return self.plain(text)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.ranks.text.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class OddSpace(Exception):
    """A chunk holds white space that may belong to a run around it."""


class ChunkCache(dict):
    """The ids of what stands between single spaces, with its space; of a line's start, with its line end.

    Between those, pieces never reach over a chunk's border, so chunks can be encoded alone.
    """

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, chunk: str) -> bytes:
        if ODD_SPACE.search(chunk):
            raise OddSpace
        if len(self) >= CACHE:
            self.clear()
        ids = self.codec.plain(chunk if chunk[:1] == "\n" else " " + chunk)
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each Python worker and file."""
    return Codec(path)


def _digests(path: str):
    def each(texts: list[str | None]) -> list[tuple]:
        c = codec(path)
        rows = []
        for text in texts:
            ids = c.encode(text or "")
            back = c.decode(ids)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode("utf-8")).hexdigest()))
        return rows

    return each


def encode_column(path: str):
    """A column function: text to its ids, as little-endian unsigned 32-bit integers in a binary."""
    return text_column(lambda texts: [(codec(path).encode(t or ""),) for t in texts], "ids binary")


def decode_column(path: str):
    """A column function: the ids' bytes to the text."""
    return text_column(lambda rows: [(codec(path).decode(b or b""),) for b in rows], "text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and digests of its ids and of the text decoded from them."""
    made = text_column(_digests(path), "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select("doc_id", made(F.col("text")).alias("made")).select("doc_id", "made.*")
