"""Cost-balanced packing of documents into training sequences.

A document is its ids and the end id. What fills whole sequences is cut off first. The rest
of the documents that are held at a time (``HELD`` ids or a little more) go, longest first,
to the sequence of lowest cost that has room, where a piece's cost is linear plus quadratic
in its length, as attention's is. There are as many sequences as the ids need, so a piece
may find no room; such pieces are cut to fill the gaps that are left. Hence at most one
sequence's length is padding for each ``HELD`` ids of a partition.

Packing is done in the tasks that read the documents: nothing is shuffled, no key has a
group, and a lost task gives the same sequences when it runs again.

Results for edge cases: a null or empty text is one piece of the end id alone. Repeated rows
are packed once for each row. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from promptsift.llm.library import library

CAPACITY = 2048
#: Ids that are packed together.
HELD = 1 << 20
END = 1
#: Chunks whose ids a Python worker keeps.
KNOWN = 600_000
#: Cost of a piece of n ids: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(slots=True)
class Placed:
    """A piece of document number doc in a sequence."""

    doc: int
    start: int
    length: int
    sequence: int
    offset: int


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[Placed]:
    """Places documents of these lengths into sequences numbered from 0."""
    placed: list[Placed] = []
    rest: list[tuple[int, int, int]] = []
    made = 0
    for doc, n in enumerate(lengths):
        whole = n // capacity
        placed += [Placed(doc, k * capacity, capacity, made + k, 0) for k in range(whole)]
        made += whole
        if n % capacity:
            rest.append((n % capacity, doc, whole * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    used = [0] * -(-sum(x[0] for x in rest) // capacity)
    open_ = [(0.0, k) for k in range(len(used))]
    unplaced = []
    for n, doc, start in rest:
        passed = []
        while open_ and used[open_[0][1]] + n > capacity:
            passed.append(heapq.heappop(open_))
        if open_:
            was, k = heapq.heappop(open_)
            placed.append(Placed(doc, start, n, made + k, used[k]))
            used[k] += n
            if used[k] < capacity:
                heapq.heappush(open_, (was + cost(n), k))
        else:
            unplaced.append((n, doc, start))
        for x in passed:
            heapq.heappush(open_, x)
    gaps = [(used[k], k) for k in range(len(used)) if used[k] < capacity]
    heapq.heapify(gaps)
    for n, doc, start in unplaced:
        while n:
            at, k = heapq.heappop(gaps)
            part = min(n, capacity - at)
            placed.append(Placed(doc, start, part, made + k, at))
            n, start = n - part, start + part
            if at + part < capacity:
                heapq.heappush(gaps, (at + part, k))
    return placed


def _rows(doc_ids: list, ids: np.ndarray, lengths: np.ndarray, first: int) -> tuple[pa.RecordBatch, int]:
    lengths = lengths.tolist()
    starts = [0, *accumulate(lengths)]
    placed = pack(lengths)
    schema = pa.schema([(c.split()[0], pa.int64()) for c in COLUMNS.split(", ")])
    columns = [
        [doc_ids[p.doc] for p in placed],
        [p.start for p in placed],
        [p.length for p in placed],
        [zlib.crc32(ids[starts[p.doc] + p.start : starts[p.doc] + p.start + p.length]) for p in placed],
        [lengths[p.doc] for p in placed],
        [first + p.sequence for p in placed],
        [p.offset for p in placed],
    ]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)
    return batch, 1 + max(p.sequence for p in placed)


def packed(docs: DataFrame, path: str) -> DataFrame:
    """Per piece: COLUMNS. A sequence's id is unique over all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for block in library(path, False, KNOWN).blocks(batches, HELD, END):
            out, made = _rows(*block, number)
            yield out
            number += made

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, COLUMNS)
