"""Ids by the tokenizers library, quickly: each distinct chunk of text is encoded once.

Texts are cut where no token can reach over: at white space for a tokenizer that drops it;
before single spaces and around line ends for a byte-level one; for both before punctuation
that follows a letter or digit. Arrow cuts and numbers the chunks of about ``GROUP``
characters of texts, only distinct ones become Python strings, and numpy gathers their ids.
What was encoded is kept by chunk, up to ``CACHE`` entries for a Python worker. Texts with
other white space at such places are encoded whole by the library. New words of letters alone
go to it in one line, which is cut again at the tokens that begin or end a word.

Edge cases: an empty text (callers pass one for a null) has no ids. Very long words, and texts
without white space, are chunks of their own.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from promptsift.llm.common import gathered

CACHE = 1_000_000
#: Characters of text that are encoded together.
GROUP = 4_000_000
#: A letter that lower-casing leaves one, or a digit, and ASCII punctuation.
_BORDER = r"([\p{Ll}A-Za-z0-9])([!-/:-@\[-`{-~])"
#: Stands between a byte-level text's chunks.
_GAP = "\x01"
_ODD = re.compile(r"[^\S \n]|[\x1c-\x1f]")


class Library:
    """A tokenizers file; byte_level: its pieces hold the space before them."""

    def __init__(self, path: str, byte_level: bool, limit: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.byte_level, self.limit = byte_level, limit
        self.cache: dict[str, bytes] = {}
        #: Chunks with odd white space: their texts are encoded whole.
        self.odd: set[str] = set()
        #: Strings that are tokens wherever they stand.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # tokens that begin (byte-level) or else end a word of a line of plain words
        vocab = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocab.values()) + 1, bool)
        self.edge[[i for s, i in vocab.items() if (s[:1] == "\u0120" if byte_level else s.endswith("</w>"))]] = True
        self.line_end = np.zeros_like(self.edge)
        if byte_level:
            self.line_end[vocab["\u010a"]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _cut(self, line: str, edge: np.ndarray, words: list[str], ends: bool) -> list[bytes]:
        """The ids of each word in the line; each has one edge token, at its end or its start."""
        ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
        edges = np.flatnonzero(edge[ids])
        if len(edges) != len(words):
            return self.whole(words)
        cuts = [0, *(4 * edges + 4).tolist()] if ends else (4 * edges).tolist() + [4 * len(ids)]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn(self, new: list[str], used: list[str]) -> None:
        """Encodes new chunks; where the cache is full, keeps what is in use."""
        if len(self.cache) + len(new) > self.limit:
            self.cache = {c: self.cache[c] for c in used if c in self.cache}
            self.odd.intersection_update(used)
        line: list[str] = []
        starts: list[str] = []
        rest: list[str] = []
        if self.byte_level:
            for chunk in new:
                if chunk[:1] == " ":
                    (line if chunk[1:].isalpha() else rest).append(chunk)
                else:
                    (starts if chunk.isalpha() else rest).append(chunk)
            odd = [c for c in rest if _ODD.search(c)]
            self.odd.update(odd)
            rest = [c for c in rest if c not in self.odd] if odd else rest
            self.cache.update(zip(line, self._cut("".join(line), self.edge, line, False)))
            # words at a text's or line's start, behind line ends, whose ids are taken off
            behind = ["\n" + c for c in starts]
            self.cache.update((c, x[4:]) for c, x in zip(starts, self._cut("".join(behind), self.line_end, behind, False)))
        else:
            for chunk in new:
                (line if chunk.isalpha() else rest).append(chunk)
            self.cache.update(zip(line, self._cut(" ".join(line), self.edge, line, True)))
        self.cache.update(zip(rest, self.whole(rest)))

    def _chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Lists of the texts' chunks, and which texts can't be cut."""
        odd = pc.match_substring_regex(texts, "[\x1c-\x1f]")
        for mark in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, mark))
        if not self.byte_level:
            return pc.utf8_split_whitespace(pc.replace_substring_regex(pc.if_else(odd, "", texts), _BORDER, r"\1 \2")), odd.to_numpy(zero_copy_only=False)
        odd = pc.or_(odd, pc.or_(pc.ends_with(texts, " "), pc.match_substring(texts, _GAP)))
        for pair in ("  ", " \n", "\n\n", "\n "):
            odd = pc.or_(odd, pc.match_substring(texts, pair))
        cut = pc.replace_substring_regex(pc.if_else(odd, "", texts), _BORDER, rf"\1{_GAP}\2")
        cut = pc.replace_substring(pc.replace_substring(cut, " ", _GAP + " "), "\n", f"{_GAP}\n{_GAP}")
        return pc.split_pattern(cut, _GAP), odd.to_numpy(zero_copy_only=False)

    def _strings(self, chunks: pa.Array) -> list[str]:
        """The chunks as Python strings: joined by what none of them holds, and cut again."""
        if not len(chunks):
            return []
        gap = _GAP if self.byte_level else "\n"
        return pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], chunks), pa.scalar(gap, chunks.type))[0].as_py().split(gap)

    def _group(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the end id, and how many each has with it."""
        lists, odd = self._chunks(texts)
        coded = lists.flatten().dictionary_encode()
        names = self._strings(coded.dictionary)
        codes, sizes = coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy()
        got = list(map(self.cache.get, names))
        missing = [k for k, x in enumerate(got) if x is None]
        if missing:
            self._learn([names[k] for k in missing if names[k] not in self.odd], names)
            for k in missing:
                got[k] = self.cache.get(names[k], b"")
            lacks = [k for k in missing if names[k] in self.odd]
            if lacks:
                is_odd = np.zeros(len(names), bool)
                is_odd[lacks] = True
                odd = odd.copy()
                odd[np.repeat(np.arange(len(sizes)), sizes)[is_odd[codes]]] = True
        # besides the chunks: texts that are encoded whole, and the end
        at = np.flatnonzero(odd)
        whole = self.whole(texts.take(pa.array(at)).to_pylist()) if len(at) else []
        if len(at):
            kept = np.where(odd, 0, sizes)
            codes = codes[~np.repeat(odd, sizes)]
            codes = np.insert(codes, (np.cumsum(kept) - kept)[at], len(names) + np.arange(len(at)))
            sizes = np.where(odd, 1, sizes)
        stops = np.cumsum(sizes)
        codes = np.insert(codes, stops, len(names) + len(whole))
        every = [*got, *whole, end.to_bytes(4, "little")]
        starts = np.zeros(len(every) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, every), np.int64, len(every)) >> 2, out=starts[1:])
        ids, lengths = gathered(starts, np.frombuffer(b"".join(every), "<u4"), codes)
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], stops + np.arange(1, len(stops) + 1)))]
        return ids, np.diff(ends)

    def encode(self, texts: pa.Array, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of the texts in order (null: empty), in groups: all ids, each text followed by the end id, and how many each has with it."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        stops = np.cumsum(pc.utf8_length(texts).to_numpy())
        at = 0
        while at < len(texts):
            before = int(stops[at - 1]) if at else 0
            to = min(len(texts), int(np.searchsorted(stops, before + GROUP)) + 1)
            yield self._group(texts[at:to], end)
            at = to

    def blocks(self, batches: Iterable[pa.RecordBatch], size: int, end: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        """Of batches (doc_id, text): documents of size ids or a little more at a time, as their doc_ids, all ids and how many each has."""
        doc_ids: list = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for ids, lengths in self.encode(batch.column(1), end):
                stops = np.cumsum(lengths)
                first, done = 0, 0
                while first < len(lengths):
                    to = min(len(lengths), int(np.searchsorted(stops, done + size - n)) + 1)
                    stop = int(stops[to - 1])
                    doc_ids += names[at + first : at + to]
                    held.append((ids[done:stop], lengths[first:to]))
                    n, first, done = n + stop - done, to, stop
                    if n >= size:
                        yield doc_ids, *map(np.concatenate, zip(*held))
                        doc_ids, held, n = [], [], 0
                at += len(lengths)
        if doc_ids:
            yield doc_ids, *map(np.concatenate, zip(*held))


@lru_cache(maxsize=2)
def library(path: str, byte_level: bool, limit: int = CACHE) -> Library:
    """One for each Python worker and file."""
    return Library(path, byte_level, limit)
