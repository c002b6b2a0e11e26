"""Language-model scores by causal self-attention over subword ids, in numpy.

Texts are lower-cased (A-Z) words, each cut into subwords: the tokens of a public byte-level
tokenizer, each taken apart along its merges until the parts are bytes or among the
``MERGES`` tokens that the training texts hold most often. A word's first subword has the
space before it. An end follows the words.

The model predicts an id as a mixture over the ``CONTEXT`` positions before it: the query of
the last position and the keys of all of them, with a bias for the distance, give causal
attention weights by a masked softmax, and a position's value is the distribution of ids at
its distance after its own id. Each distance has values of its own, the nearest one further
ones by the last position's place in its word (of ``PLACES``), and so have the biases. A slot
without a position, whose value is the distribution of all ids, can take weight, too. The
values are counted over all training texts (so the mixture is a probability as it is), and
queries, keys and biases are trained by gradient ascent on the log probability, over all
windows of the training texts, with each position's own count left out of the values. A block's documents are one stream, cut into windows of
``WINDOW`` positions, each led in by the ``CONTEXT`` positions before it: attention is masked
where it would reach another document, and each id is scored once.

Passes over the corpus, none of which brings texts, words or scores to the driver:

1. Blocks of about ``BLOCK`` characters are written to the shared folder: the words of each
   document by their number in the block, the words' tokens, and a row with the training
   count of each word of the block. The tokens are counted alongside, for the choice above.
2. What the values need is counted over all blocks; its size depends on the vocabulary only.
3. Each block trains the weights from the same start, on all windows of its training texts;
   the driver gets their mean.
4. Word counts are added up over the corpus and joined back to the blocks' words (a word has
   a row for each block at most), and each block scores its documents with both models.

How rows fall into tasks decides which documents share a block, and so, through the mean of
step 3, the model's score: on sf0.1 dealings differ by about 0.2 %. The base score doesn't depend on it.

The base score is that of single words, with 0.1 added to counts. Documents whose crc32 of
their id as text is 0 modulo 10 are held out of all counts and of training.

Results for edge cases: a null or empty text is an end alone. A null doc_id counts as empty
text there, and so is held out. Repeated rows count and are scored each. Without training
texts all counts are 0 and the model is uniform. Words of over ``PIECE`` characters are cut
into pieces of so many before they are taken apart.
"""

from __future__ import annotations

import base64
import io
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptsift.llm.common import dropped, gathered, shared_dir

MERGES = 1278
#: Ids: bytes, merges, the end of a text, its start.
END, START = 256 + MERGES, 257 + MERGES
SIZE = 258 + MERGES
CONTEXT = 8
WINDOW = 1 << 16
WIDTH = 16
#: Places in a word that are told apart; the last one stands for all later ones.
PLACES = 4
#: Tables of values: the nearest distance by place, then each other distance.
TABLES = PLACES + CONTEXT - 1
#: Characters of texts in a block, or those of one longer text.
BLOCK = 10_000_000
PIECE = 64
RATE, BIAS_RATE = 2.0, 32.0
#: Steps of training in a block at least; fewer windows are gone through again.
STEPS = 32
ADDED = 0.1
#: Weight of the distribution that a value falls back on, as a count.
PRIOR = 20.0
#: Groups that add up a table that tasks counted.
GROUPS = 32
#: Values are kept as halves, times this, so that small ones keep their digits.
HALVES = np.float32(1 << 15)


class Tokens:
    """A file of ranks: the bytes of each token and the tokenizer."""

    def __init__(self, path: str):
        pairs = (line.split() for line in Path(path).read_bytes().splitlines() if line)
        self.ranks = {base64.b64decode(data): int(rank) for data, rank in pairs}
        self.size = max(self.ranks.values()) + 1
        self.encoding = tiktoken.Encoding("words", pat_str=f" [^ ]{{1,{PIECE}}}|[^ ]{{1,{PIECE}}}", mergeable_ranks=self.ranks, special_tokens={})
        self.spaced = np.zeros(self.size, bool)
        self.spaced[[rank for data, rank in self.ranks.items() if data[:1] == b" "]] = True

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words, each with a space before it, and how many each word has."""
        ids = self.encoding.encode_to_numpy((b" " + b" ".join(words)).decode()) if words else np.zeros(0, np.uint32)
        starts = np.flatnonzero(self.spaced[ids])
        return ids, np.diff(np.append(starts, len(ids)))

    def parts(self, token: bytes) -> tuple[bytes, bytes]:
        """The two that the token is merged of."""
        pieces = [token[k : k + 1] for k in range(len(token))]
        while len(pieces) > 2:
            joined = [self.ranks.get(a + b, self.size) for a, b in zip(pieces, pieces[1:])]
            k = joined.index(min(joined))
            pieces[k : k + 2] = [pieces[k] + pieces[k + 1]]
        return pieces[0], pieces[1]


@lru_cache(maxsize=1)
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


class Subwords:
    """The subwords of each token: where they start among all, all of them, and which begin a word."""

    def __init__(self, tokens: Tokens, counts: np.ndarray):
        """counts: of the tokens; the most frequent of several bytes stay whole, ties in the order of their ids."""
        text = {rank: data for data, rank in tokens.ranks.items()}
        chosen = [i for i in np.argsort(-counts.astype(np.int64), kind="stable").tolist() if len(text.get(i, b"")) > 1][:MERGES]
        small = {data: k for k, data in enumerate([*sorted(d for d in tokens.ranks if len(d) == 1), *(text[i] for i in chosen)])}
        known: dict[bytes, list[int]] = {}

        def subwords(data: bytes) -> list[int]:
            if data not in known:
                known[data] = [small[data]] if data in small else [x for part in tokens.parts(data) for x in subwords(part)]
            return known[data]

        used = set(np.flatnonzero(counts).tolist())
        found = [subwords(text[i]) if i in text and i in used else [small[text[i][k : k + 1]] for k in range(len(text[i]))] if i in text else [] for i in range(tokens.size)]
        self.starts = np.zeros(len(found) + 1, np.int64)
        np.cumsum([len(x) for x in found], out=self.starts[1:])
        self.ids = np.array([x for f in found for x in f], np.uint16)
        self.begins = np.zeros(SIZE, bool)
        self.begins[[k for data, k in small.items() if data[:1] == b" "]] = True
        self.begins[[END, START]] = True


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _dumped(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return zstandard.ZstdCompressor(level=1).compress(out.getbuffer())


def _loaded(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data))) as found:
        return dict(found)


class Stream:
    """The subword ids of a block's documents, one after the other, each with its start and end.

    ``CONTEXT`` starts lead in. place: of an id in its document, as far as the context reaches;
    in_word: its place in its word.
    """

    def __init__(self, block: dict[str, np.ndarray], subwords: Subwords):
        self.doc_ids, self.missing = block["doc_ids"], block["missing"]
        self.held, self.words = block["held"], block["words"]
        self.n_words = block["n_words"].astype(np.int64)
        of_word = block["n_tokens"]
        subs_of, sizes = gathered(subwords.starts, subwords.ids, block["tokens"])
        firsts = np.concatenate(([0], np.cumsum(of_word, dtype=np.int64)))
        starts = np.concatenate(([0], np.cumsum(sizes)))[firsts]
        # ids of each document, without its start and end
        ends = np.concatenate(([0], np.cumsum(self.n_words)))
        sizes = np.diff(np.concatenate(([0], np.cumsum(np.diff(starts).astype(np.int32).take(self.words), dtype=np.int64)))[ends]) + 2
        self.stops = CONTEXT + np.cumsum(sizes)
        self.starts = self.stops - sizes
        n = int(self.stops[-1]) if len(sizes) else CONTEXT
        self.ids = np.full(n, START, np.int32)
        inner = np.ones(n, bool)
        inner[:CONTEXT] = inner[self.starts] = inner[self.stops - 1] = False
        # some documents at a time, so that what is only needed on the way stays small
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + WINDOW, "right")) - 1)
            here = slice(self.starts[at], self.stops[to - 1])
            self.ids[here][inner[here]] = gathered(starts, subs_of, self.words[ends[at] : ends[to]])[0]
            at = to
        self.ids[self.stops - 1] = END
        self.place = np.full(n, CONTEXT, np.uint8)
        self.place[:CONTEXT] = 0
        for k in range(CONTEXT):
            self.place[self.starts[sizes > k] + k] = k
        self.in_word = np.full(n, PLACES - 1, np.uint8)
        first = np.flatnonzero(subwords.begins[self.ids])
        for k in reversed(range(PLACES - 1)):
            at = first + k
            self.in_word[at[: np.searchsorted(at, n)]] = k
        self.learns = np.zeros(n, bool)
        self.learns[CONTEXT:] = np.repeat(~self.held, sizes)
        self.learns[self.starts] = False  # nothing predicts a start

    def windows(self) -> Iterator[tuple[int, int]]:
        for low in range(CONTEXT, len(self.ids), WINDOW):
            yield low, min(low + WINDOW, len(self.ids))


def tables() -> list[np.ndarray]:
    """What counted() adds to: a task has fewer ids than its smallest whole number of 32 bits counts."""
    return [*(np.zeros(SIZE * SIZE, np.uint32) for _ in range(TABLES)), np.zeros(SIZE, np.int64)]


def counted(s: Stream, totals: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """How often an id follows another, for each table of values; then the ids altogether. Added to totals, a window at a time."""
    totals = tables() if totals is None else totals
    one = np.uint32(1)
    for low, high in s.windows():
        for lag in range(1, CONTEXT + 1):
            ok = s.learns[low:high] & (s.place[low:high] >= lag)
            pair = s.ids[low - lag : high - lag].astype(np.intp)
            pair *= SIZE
            pair += s.ids[low:high]
            if lag > 1:
                np.add.at(totals[PLACES + lag - 2], pair.compress(ok), one)
                continue
            in_word = s.in_word[low - 1 : high - 1]
            for w in range(PLACES):
                np.add.at(totals[w], pair.compress(ok & (in_word == w)), one)
    totals[TABLES] += np.bincount(s.ids[s.learns], minlength=SIZE)
    return totals


class Model:
    """Values, queries, keys and biases."""

    def __init__(self, counts: Callable[[int], np.ndarray | None], weights: np.ndarray | None = None):
        """counts: what counted() has, by number, one at a time; those that lack are zero."""

        def table_of(k: int) -> np.ndarray:
            found = counts(k)
            return np.zeros((SIZE, SIZE), np.float32) if found is None else found.reshape(SIZE, SIZE).astype(np.float32)

        total = counts(TABLES)
        total = (np.zeros(SIZE) if total is None else total) + ADDED
        total[START] = 0
        self.all = (total / total.sum()).astype(np.float32)
        self.values = np.empty((TABLES, SIZE * SIZE), np.float16)
        #: For each id: what its values lose as one count is taken away.
        self.own = np.empty((TABLES, SIZE), np.float32)
        nearest = np.zeros((SIZE, SIZE), np.float32)
        for k in range(PLACES):
            nearest += table_of(k)
        self._smooth(nearest, self.all, nearest)
        nearest /= HALVES
        for k in range(TABLES):
            table = table_of(k)
            self.own[k] = 1 / (table.sum(1) + np.float32(PRIOR - 1))
            self._smooth(table, nearest if k < PLACES else self.all, self.values[k].reshape(SIZE, SIZE))
        self.set(self.start() if weights is None else weights)

    @staticmethod
    def _smooth(table: np.ndarray, other: np.ndarray, out: np.ndarray) -> None:
        """HALVES times the distribution of each row of counts, with PRIOR of the other one."""
        seen = table.sum(1, keepdims=True)
        table += np.float32(PRIOR) * other
        np.multiply(table, HALVES / (seen + np.float32(PRIOR)), out=out, casting="unsafe")

    @staticmethod
    def start() -> np.ndarray:
        """The weights before training."""
        noise = np.random.default_rng(0).normal(0, 0.3, (2 * SIZE, WIDTH))
        bias = np.repeat([-1.0, *(2.0 / k for k in range(1, CONTEXT + 1))], PLACES)
        return np.concatenate((noise.ravel(), bias))

    def set(self, weights: np.ndarray) -> None:
        self.weights = weights.astype(np.float32)
        self.query, self.key = self.weights[: 2 * SIZE * WIDTH].reshape(2, SIZE, WIDTH)
        self.bias = self.weights[2 * SIZE * WIDTH :].reshape(CONTEXT + 1, PLACES)

    def matches(self) -> np.ndarray:
        """All queries by all keys."""
        return (self.query @ self.key.T / np.float32(np.sqrt(WIDTH))).ravel()

    def attention(self, s: Stream, low: int, high: int, matches: np.ndarray, without: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the positions low to high: values and weights by slot (the free one, then each distance), the probability, and the matches' numbers by distance.

        without: each position's own count is taken out of the values, as it would be of a text that isn't counted.
        """
        n = high - low
        target, last = s.ids[low:high], s.ids[low - 1 : high - 1] * SIZE
        in_word, place = s.in_word[low - 1 : high - 1].astype(np.intp), s.place[low:high]
        value, weight = np.empty((CONTEXT + 1, n), np.float32), np.empty((CONTEXT + 1, n), np.float32)
        pair = np.empty((CONTEXT, n), np.int32)
        value[0] = self.all.take(target)
        weight[0] = self.bias[0].take(in_word)
        nearest = self.values[:PLACES].reshape(-1)
        for lag in range(1, CONTEXT + 1):
            before = s.ids[low - lag : high - lag]
            at = before * SIZE
            at += target
            value[lag] = self.values[PLACES + lag - 2].take(at) if lag > 1 else nearest.take(in_word * (SIZE * SIZE) + at)
            value[lag] *= 1 / HALVES
            if without:
                value[lag] += (value[lag] - 1) * (self.own[PLACES + lag - 2].take(before) if lag > 1 else self.own[:PLACES].reshape(-1).take(in_word * SIZE + before))
                np.maximum(value[lag], 0, out=value[lag])
            np.add(last, before, out=pair[lag - 1])
            matches.take(pair[lag - 1], out=weight[lag], mode="clip")
            weight[lag] += self.bias[lag].take(in_word)
            weight[lag][place < lag] = -np.inf  # another document
        weight -= weight.max(0)
        np.exp(weight, out=weight)
        weight /= weight.sum(0)
        return value, weight, np.einsum("kj,kj->j", value, weight), pair

    def score(self, s: Stream) -> np.ndarray:
        """log10 probability of each document."""
        matches, logs = self.matches(), np.zeros(len(s.ids))
        for low, high in s.windows():
            with np.errstate(divide="ignore"):
                logs[low:high] = np.log10(self.attention(s, low, high, matches)[2])
        logs[s.starts] = 0
        return np.add.reduceat(logs, s.starts) if len(s.starts) else np.zeros(0)

    def train(self, s: Stream, steps: int = STEPS) -> np.ndarray:
        """The weights that start() gives after as many passes over all windows of the training texts as take so many steps, one for each window."""
        kept, scale = self.weights, np.float32(1 / np.sqrt(WIDTH))
        self.set(self.start())
        seen = np.ones((2, SIZE, 1), np.float32)  # squares of gradients so far, for the rate
        windows = [(low, high) for low, high in s.windows() if s.learns[low:high].any()]
        for low, high in windows * -(-steps // max(1, len(windows))):
            learns = s.learns[low:high]
            slope, weight, prob, pair = self.attention(s, low, high, self.matches(), True)
            # of log prob by each score: weight * (value / prob - 1)
            slope /= np.maximum(prob, 1e-12)
            slope -= 1
            slope *= weight
            slope *= learns
            in_word = s.in_word[low - 1 : high - 1]
            by_place = [np.bincount(in_word, x, PLACES) for x in slope]
            by_pair = np.bincount(pair.ravel(), slope[1:].ravel(), SIZE * SIZE).astype(np.float32).reshape(SIZE, SIZE)
            self.bias += np.float32(BIAS_RATE / np.count_nonzero(learns)) * np.array(by_place, np.float32)
            slopes = by_pair @ self.key * scale, by_pair.T @ self.query * scale
            for part, step, squares in zip((self.query, self.key), slopes, seen):
                squares += (step * step).sum(1, keepdims=True)
                part += np.float32(RATE) * step / np.sqrt(squares)
        found = self.weights
        self.set(kept)
        return found


_PASS1 = pa.schema([("block", pa.int64()), ("word", pa.binary()), ("number", pa.int32()), ("count", pa.int64()), ("data", pa.binary())])
_ROWS1 = "block long, word binary, number int, count long, data binary"
_SUMS = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_ROWS = 1 << 16
#: Numbers of the rows that aren't words: a block's documents, a task's tokens.
_DOCUMENTS, _TOKENS = -1, -2


def numbered(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct lower-case words, the texts' words by their number among them, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    coded = lists.flatten().dictionary_encode()
    numbers, n_words = coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy()
    names, empty = coded.dictionary, pc.index(coded.dictionary, "").as_py()
    if empty >= 0:  # at white space at a text's ends
        real = numbers != empty
        n_words = np.bincount(np.repeat(np.arange(len(n_words)), n_words)[real], minlength=len(n_words))
        numbers = numbers[real]
        numbers = numbers - (numbers > empty)
        names = pa.concat_arrays([names[:empty], names[empty + 1 :]])
    return names.cast(pa.large_binary()).cast(pa.binary()), numbers.astype(np.uint32), n_words.astype(np.uint32)


def _block_writer(path: str):
    def block_rows(block: int, doc_ids: list, texts: pa.Array, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        names, words, n_words = numbered(texts)
        tokens, n_tokens = tokens_of(path).of_words(names.to_pylist())
        held = np.array([held_out(d) for d in doc_ids], bool)
        known = np.bincount(words[np.repeat(~held, n_words)], minlength=len(names))
        total += np.bincount(tokens, np.repeat(known, n_tokens), len(total)).astype(np.int64)
        for k in range(0, len(names), _ROWS):
            n = min(_ROWS, len(names) - k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), names[k : k + n], pa.array(np.arange(k, k + n, dtype=np.int32)), pa.array(known[k : k + n]), pa.nulls(n, pa.binary())], schema=_PASS1)
        missing = np.array([d is None for d in doc_ids], bool)
        data = _dumped(doc_ids=np.array([d or 0 for d in doc_ids], np.int64), missing=missing, held=held, n_words=n_words, words=words, n_tokens=n_tokens.astype(np.uint32), tokens=tokens)
        yield pa.RecordBatch.from_pylist([{"block": block, "number": _DOCUMENTS, "count": int((~held).sum()), "data": data}], schema=_PASS1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = first = TaskContext.get().partitionId() << 32
        total = np.zeros(tokens_of(path).size, np.int64)
        doc_ids: list = []
        parts: list[pa.Array] = []
        chars = 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy())
            at = 0
            while at < len(ids):  # as many documents as fill the block
                before = int(sizes[at - 1]) if at else 0
                to = min(len(ids), int(np.searchsorted(sizes, before + BLOCK - chars)) + 1)
                doc_ids += ids[at:to]
                parts.append(texts[at:to])
                chars, at = chars + int(sizes[to - 1]) - before, to
                if chars >= BLOCK:
                    yield from block_rows(block, doc_ids, pa.concat_arrays(parts), total)
                    block, doc_ids, parts, chars = block + 1, [], [], 0
        if doc_ids:
            yield from block_rows(block, doc_ids, pa.concat_arrays(parts), total)
            block += 1
        if block > first:
            yield pa.RecordBatch.from_pylist([{"block": first, "number": _TOKENS, "data": _dumped(a=total)}], schema=_PASS1)

    return run


def _sum_row(part: int, n: int, array: np.ndarray) -> pa.RecordBatch:
    if array.dtype.kind in "iu" and array.max(initial=0) < 1 << 32:
        array = array.astype(np.uint32)
    return pa.RecordBatch.from_pylist([{"part": part, "n": n, "data": _dumped(a=array)}], schema=_SUMS)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each part's arrays; rows come in the order of the parts."""
    part, n, total = None, 0, None
    for batch in batches:
        for k, m, data in zip(*(c.to_pylist() for c in batch.columns)):
            array = _loaded(data)["a"]
            if k != part:
                if total is not None:
                    yield _sum_row(part, n, total)
                part, n, total = k, 0, np.zeros(len(array), np.result_type(array.dtype, np.int64))
            total += array
            n += m
    if total is not None:
        yield _sum_row(part, n, total)


def _added(rows: DataFrame) -> dict[int, tuple[int, bytes]]:
    """Per part of rows (part, n, data): the sums of n and of the arrays, by way of GROUPS groups on the executors."""
    ddl = "part int, n long, data binary"
    one = rows.select("part", "n", "data", F.spark_partition_id().alias("task")).withColumn("group", F.pmod("task", F.lit(GROUPS)))
    one = one.repartition("part", "group").sortWithinPartitions("part", "group").select("part", "n", "data").mapInArrow(_add, ddl)
    two = one.repartition("part").sortWithinPartitions("part").mapInArrow(_add, ddl)
    return {r.part: (r.n, r.data) for r in two.collect()}


_KNOWN = pa.schema([("block", pa.int64()), ("numbers", pa.binary()), ("known", pa.binary()), ("distinct", pa.int64())])
#: Counts that a task gathers before it deals them out to their blocks.
_GATHER = 1 << 20


_models: dict[str, Model] = {}


def _forget() -> None:
    """Lets go of what a Python worker keeps of other runs and steps."""
    _models.clear()
    tokens_of.cache_clear()


def _model(run: str, sums: Broadcast) -> Model:
    """The untrained model of a run, which a Python worker makes once and keeps in place of any other's."""
    if run not in _models:
        _forget()
        _models[run] = Model(lambda k: _loaded(sums.value[k])["a"] if k in sums.value else None)
    return _models[run]


def _dealt(blocks: np.ndarray, numbers: np.ndarray, known: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each block: its words' numbers and counts."""
    order = np.argsort(blocks, kind="stable")
    blocks, numbers, known = blocks[order], numbers[order].astype("<i4"), known[order].astype("<i8")
    starts = np.concatenate(([0], 1 + np.flatnonzero(blocks[1:] != blocks[:-1])))
    ends = np.append(starts[1:], len(blocks)).tolist()
    cut = [slice(a, b) for a, b in zip(starts.tolist(), ends)]
    yield pa.RecordBatch.from_arrays([pa.array(blocks[starts]), pa.array([numbers[c].tobytes() for c in cut], pa.binary()), pa.array([known[c].tobytes() for c in cut], pa.binary()), pa.array(np.zeros(len(cut), np.int64))], schema=_KNOWN)


def _totalled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (word, block, number, count), equal words together: by block, the counts in all blocks of its words that are in several; last, how many words are known."""
    last, total, distinct = None, 0, 0
    held: list[tuple[np.ndarray, np.ndarray]] = []
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def end() -> None:
        """Takes the word that batches have in common."""
        nonlocal distinct
        blocks, numbers = (np.concatenate(x) for x in zip(*held))
        if len(blocks) > 1:
            found.append((blocks, numbers, np.full(len(blocks), total)))
        distinct += total > 0

    for batch in batches:
        if not batch.num_rows:
            continue
        words, (blocks, numbers, counts) = batch.column(0), (c.to_numpy() for c in batch.columns[1:])
        starts = np.concatenate(([0], 1 + np.flatnonzero(pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False))))
        stops = np.append(starts[1:], len(words))
        sums = np.add.reduceat(counts, starts)
        if words[0].as_py() == last:  # goes on from the batch before
            held.append((blocks[: stops[0]], numbers[: stops[0]]))
            total += int(sums[0])
            if len(starts) == 1:
                continue
            starts, stops, sums = starts[1:], stops[1:], sums[1:]
        if held:
            end()
        last, total, held = words[int(starts[-1])].as_py(), int(sums[-1]), [(blocks[starts[-1] :], numbers[starts[-1] :])]
        sizes, sums = (stops - starts)[:-1], sums[:-1]
        distinct += int(np.count_nonzero(sums))
        several = np.repeat(sizes > 1, sizes)
        inner = slice(int(starts[0]), int(starts[-1]))
        found.append((blocks[inner][several], numbers[inner][several], np.repeat(sums, sizes)[several]))
        if sum(len(x[0]) for x in found) >= _GATHER:
            yield from _dealt(*map(np.concatenate, zip(*found)))
            found = []
    if held:
        end()
    if sum(len(x[0]) for x in found):
        yield from _dealt(*map(np.concatenate, zip(*found)))
    if distinct:
        yield pa.RecordBatch.from_pylist([{"distinct": distinct}], schema=_KNOWN)


def scored(docs: DataFrame, path: str) -> DataFrame:
    """Per document: SCORES. path: a file of a byte-level tokenizer's ranks."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/lm-{uuid.uuid4().hex}"
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = chosen.mapInArrow(_block_writer(path), _ROWS1)
    made.write.option("parquet.block.size", 32 << 20).option("parquet.block.size.row.check.min", 1).option("compression", "zstd").parquet(f"{folder}/blocks")
    rows = spark.read.parquet(f"{folder}/blocks")
    blocks = rows.filter(F.col("number") == _DOCUMENTS).select("block", "data")

    found = _added(rows.filter(F.col("number") == _TOKENS).select(F.lit(0).alias("part"), F.lit(1).cast("long").alias("n"), "data"))
    tokens = tokens_of(path)
    # all bounded by the vocabulary, not by the corpus
    subwords = spark.sparkContext.broadcast(Subwords(tokens, _loaded(found[0][1])["a"] if found else np.zeros(tokens.size, np.int64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget()
        totals: list[np.ndarray] = []
        for batch in batches:
            for data in batch.column(0):
                totals = counted(Stream(_loaded(data.as_buffer()), subwords.value), totals or None)
        while totals:
            yield _sum_row(len(totals) - 1, 1, totals.pop())

    sums = spark.sparkContext.broadcast({k: data for k, (_, data) in _added(blocks.select("data").mapInArrow(count, "part int, n long, data binary")).items()})

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            for data in batch.column(0):
                s = Stream(_loaded(data.as_buffer()), subwords.value)
                if s.learns.any():
                    weights = _model(folder, sums).train(s).astype(np.float64)
                    total, n = weights if total is None else total + weights, n + 1
        if n:
            yield _sum_row(0, n, total)

    trained = _added(blocks.select("data").mapInArrow(train, "part int, n long, data binary"))
    weights = spark.sparkContext.broadcast(_loaded(trained[0][1])["a"] / trained[0][0] if trained else None)

    words = rows.filter("number >= 0").select("word", "block", "number", "count")
    totals = words.repartition("word").sortWithinPartitions(F.xxhash64("word"), "word").mapInArrow(_totalled, "block long, numbers binary, known binary, distinct long")
    totals.write.option("compression", "zstd").parquet(f"{folder}/words")
    known = spark.read.parquet(f"{folder}/words")
    n_all, texts = rows.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("number") == _DOCUMENTS, F.col("count"))), F.lit(0))).first()
    v_all = known.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0] + (texts > 0)
    # a block knows the counts of the words that are in no other
    none = F.lit(None).cast("binary")
    parts = known.filter("block is not null").select("block", "numbers", "known", none.alias("data")).unionByName(blocks.select("block", none.alias("numbers"), none.alias("known"), "data"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(folder, sums)
        model.set(Model.start() if weights.value is None else weights.value)
        below = n_all + ADDED * (v_all + 1)
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        for _, of_block in groupby(rows, itemgetter(0)):
            data, held = None, []
            for _, numbers, seen, block in of_block:
                if block is None:
                    held.append((np.frombuffer(numbers, "<i4"), np.frombuffer(seen, "<i8")))
                else:
                    data = block
            s = Stream(_loaded(data), subwords.value)
            count = np.bincount(s.words[np.repeat(~s.held, s.n_words)], minlength=int(s.words.max()) + 1 if len(s.words) else 0)
            for where, what in held:
                count[where] = what
            logs = np.concatenate(([0.0], np.cumsum(np.log10((count + ADDED) / below).take(s.words))))
            hits = np.concatenate(([0], np.cumsum((count > 0).take(s.words))))
            stops = np.cumsum(s.n_words)
            first = stops - s.n_words
            base = logs[stops] - logs[first] + np.log10((texts + ADDED) / below)
            n = len(stops)
            columns = [[None if m else int(d) for d, m in zip(s.doc_ids, s.missing)], s.held, s.n_words + 1, hits[stops] - hits[first] + (texts > 0), np.full(n, n_all), base, model.score(s)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCORES.types)], schema=_SCORES)

    dealt = parts.repartition("block").sortWithinPartitions("block")
    dealt.mapInArrow(score, SCORES).write.parquet(f"{folder}/scores")
    dropped(spark, f"{folder}/blocks", f"{folder}/words")
    return spark.read.schema(SCORES).parquet(f"{folder}/scores")
