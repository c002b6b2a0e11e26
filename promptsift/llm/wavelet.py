"""Token ids as wavelet matrices: one succinct file of bit planes for each run of documents.

A file holds an alphabet (the ids that occur, in order), one bit plane for each bit of an
alphabet code with its ones counted up to every 512th bit, and its documents' ids and
lengths. Plane by plane, codes with a 0 bit go before those with a 1 bit, each in their old
order. Access, rank, count and select then take one step for each plane: the counts give the
ones before a place, and by binary search the block of the nth one or zero. ``tokens_at``,
``counts`` and ``occurrences`` ask a whole table of files.

The files are rows of a Parquet table, in ascending doc_id: the shards are the partitions of
a range partitioning by doc_id, and a shard has a file for each ``FILE_IDS`` ids or so, so
that memory doesn't depend on a shard's size.

Results for edge cases: a null or empty text has the end id alone. A null doc_id comes
first. Rows of equal doc_id are ordered by their text. An empty table gives no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptsift.llm.common import dropped, shared_dir
from promptsift.llm.library import library

FILE_IDS = 1 << 19
#: Bytes of input of a shard.
SHARD_BYTES = 64 << 20
END = 2
_MAGIC = b"WMX1"
_HEAD = struct.Struct("<4sQIII")
_BLOCK = 512


def write_matrix(ids: np.ndarray, doc_ids: list[int | None], lengths: Sequence[int]) -> bytes:
    """The file of these documents' ids, all in one array."""
    count = np.bincount(ids) if len(ids) else np.zeros(1, np.int64)
    alphabet = np.flatnonzero(count).astype("<u4")
    code_of = np.zeros(len(count), np.uint32)
    code_of[alphabet] = np.arange(len(alphabet), dtype=np.uint32)
    codes = code_of.astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32).take(ids)
    levels = max(1, int(len(alphabet) - 1).bit_length())
    out = [_HEAD.pack(_MAGIC, len(ids), len(alphabet), levels, len(doc_ids)), alphabet.tobytes()]
    out.append(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    out.append(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    out.append(np.array(lengths, "<u8").tobytes())
    for level in range(levels - 1, -1, -1):
        bit = (codes >> level) & 1 == 1
        packed = np.packbits(bit, bitorder="little")
        blocks = np.add.reduceat(bit, np.arange(0, len(bit), _BLOCK), dtype=np.uint32) if len(bit) else np.zeros(0, np.uint32)
        ones = np.zeros(len(blocks) + 1, "<u4")
        np.cumsum(blocks, out=ones[1:])
        out += [ones.tobytes(), packed.tobytes()]
        if level:
            codes = np.concatenate((codes.compress(~bit), codes.compress(bit)))
    return b"".join(out)


class Matrix:
    """A file of write_matrix()."""

    def __init__(self, data: bytes):
        magic, self.n, size, self.levels, docs = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, n, at)
            at += found.nbytes
            return found

        self.alphabet = take("<u4", size)
        missing = take("u1", docs)
        self.doc_ids = [None if m else int(d) for m, d in zip(missing, take("<i8", docs))]
        self.lengths = take("<u8", docs).astype(np.int64)
        self.planes = []
        for _ in range(self.levels):
            ones = take("<u4", -(-self.n // _BLOCK) + 1)
            bits = take("u1", -(-self.n // 8))
            self.planes.append((ones, bits, self.n - int(ones[-1])))

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        ones, bits, _ = self.planes[level]
        block = i // _BLOCK
        part = np.unpackbits(bits[block * _BLOCK // 8 : -(-i // 8)], bitorder="little", count=i - block * _BLOCK) if i % _BLOCK else ()
        return int(ones[block]) + int(np.sum(part, dtype=np.int64))

    def access(self, i: int) -> int:
        """The id at position i."""
        code = 0
        for level, (_, bits, zeros) in enumerate(self.planes):
            bit = bits[i >> 3] >> (i & 7) & 1
            code = code << 1 | int(bit)
            before = self._ones(level, i)
            i = zeros + before if bit else i - before
        return int(self.alphabet[code])

    def _code(self, token: int) -> int | None:
        k = int(np.searchsorted(self.alphabet, token))
        return k if k < len(self.alphabet) and self.alphabet[k] == token else None

    def _range(self, code: int, i: int) -> tuple[int, int]:
        """Where code's occurrences before i lie below the last plane."""
        low, high = 0, i
        for level, (_, _, zeros) in enumerate(self.planes):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (zeros + a, zeros + b) if code >> (self.levels - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, i: int) -> int:
        """Occurrences of token before position i."""
        if (code := self._code(token)) is None:
            return 0
        low, high = self._range(code, i)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The position of occurrence k, from 0; -1 if there are no more than k."""
        if (code := self._code(token)) is None:
            return -1
        low, high = self._range(code, self.n)
        if not 0 <= k < high - low:
            return -1
        at = low + k
        for level in range(self.levels - 1, -1, -1):
            bit = code >> (self.levels - 1 - level) & 1
            at = self._nth(level, bit, at - self.planes[level][2] if bit else at)
        return at

    def _nth(self, level: int, bit: int, k: int) -> int:
        """The place of occurrence k of bit in a plane: its block by the counts before blocks, then inside the block."""
        ones, bits, _ = self.planes[level]
        before = ones.astype(np.int64) if bit else np.arange(len(ones), dtype=np.int64) * _BLOCK - ones
        block = int(np.searchsorted(before[: len(ones) - 1], k, "right")) - 1
        start = block * _BLOCK
        part = np.unpackbits(bits[start // 8 : (start + _BLOCK) // 8], bitorder="little", count=min(_BLOCK, self.n - start))
        return start + int(np.flatnonzero(part == bit)[k - before[block]])

    def positions(self, token: int) -> np.ndarray:
        """All places of a token, ascending: its run below the last plane, taken back plane by plane."""
        if (code := self._code(token)) is None:
            return np.zeros(0, np.int64)
        at = np.arange(*self._range(code, self.n))
        for level in range(self.levels - 1, -1, -1):
            _, bits, zeros = self.planes[level]
            bit = code >> (self.levels - 1 - level) & 1
            at = np.flatnonzero(np.unpackbits(bits, bitorder="little", count=self.n) == bit)[at - zeros if bit else at]
        return at

    def ids(self) -> np.ndarray:
        """All ids in order, by undoing the planes from the last to the first."""
        codes = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            _, bits, zeros = self.planes[level]
            bit = np.unpackbits(bits, bitorder="little", count=self.n).view(bool)
            out = np.empty_like(codes)
            out[np.flatnonzero(~bit)] = codes[:zeros]
            out[np.flatnonzero(bit)] = codes[zeros:] | (1 << (self.levels - 1 - level))
            codes = out
        return self.alphabet.take(codes)


_FILES = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("n_ids", pa.int64()), ("file", pa.binary())])
_READ = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("inside", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def shards_for(docs: DataFrame) -> int:
    """So many that each has about SHARD_BYTES of the input, by the optimizer's estimate, and no fewer than the session's shuffle partitions.

    Rows that come from elsewhere than files have no estimate, which is then beyond all sizes.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES) if size < 1 << 60 else 1)


def write_files(docs: DataFrame, path: str, folder: str, shards: int | None = None) -> None:
    """Encodes all texts and writes their files into folder, as a Parquet table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        for seq, (doc_ids, ids, lengths) in enumerate(library(path, True).blocks(batches, FILE_IDS, END)):
            columns = [[shard], [seq], [len(ids)], [write_matrix(ids, doc_ids, lengths)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _FILES.types)], schema=_FILES)

    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    dealt = chosen.repartitionByRange(shards or shards_for(chosen), "doc_id").sortWithinPartitions("doc_id", "text")
    # row groups are closed by size, however few rows they have
    writer = dealt.mapInArrow(run, "shard int, seq int, n_ids long, file binary").write
    writer.option("parquet.block.size", 32 << 20).option("parquet.block.size.row.check.min", 1).option("parquet.page.size.row.check.min", 1).parquet(folder)


def _offsets(files: DataFrame) -> DataFrame:
    """shard, seq, first: how many ids lie before each file.

    The window over all shards has a row for each partition of the writer; that over a shard,
    a row for each of its files.
    """
    up_to = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    found = files.select("shard", "seq", "n_ids", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("earlier")).join(shards, "shard")
    return found.select("shard", "seq", (F.col("before") + F.col("earlier")).alias("first"))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, seq, file in zip(*(batch.column(k).to_pylist() for k in range(3))):
                matrix = Matrix(file)
                ids = matrix.ids()
                stops = np.cumsum(matrix.lengths).tolist()
                starts = [0, *stops[:-1]]
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts, stops)]
                n = len(stops)
                columns = [[shard] * n, [seq] * n, matrix.doc_ids, starts, matrix.lengths, crcs]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _READ.types)], schema=_READ)

    files = spark.read.parquet(folder)
    per_doc = files.select("shard", "seq", "file").mapInArrow(run, "shard int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    start = (F.col("first") + F.col("inside")).alias("start")
    return per_doc.join(_offsets(files), ["shard", "seq"]).select("doc_id", start, "n_tokens", "ids_crc32")


_FOUND = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("token", pa.int64()), ("inside", pa.int64()), ("offset", pa.int64()), ("n", pa.int64())])
_FOUND_DDL = "shard int, seq int, doc_id long, token long, inside long, offset long, n long"


def _asked(files: DataFrame, each: Callable[[Matrix, int, int], dict[str, list]]) -> DataFrame:
    """What each(matrix, first, number of ids) finds in every file; first is 0 unless files has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, seq, first, file in zip(*(c.to_pylist() for c in batch.columns)):
                matrix = Matrix(file)
                found = each(matrix, first, matrix.n)
                n = len(next(iter(found.values())))
                found |= {"shard": [shard] * n, "seq": [seq] * n}
                yield pa.RecordBatch.from_arrays([pa.array(found.get(f.name, [None] * n), f.type) for f in _FOUND], schema=_FOUND)

    return files.select("shard", "seq", "first", "file").mapInArrow(run, _FOUND_DDL)


def counts(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """token, n: how often each of the asked tokens occurs in all files, by ranks alone."""
    asked = sorted(set(tokens))
    files = spark.read.parquet(folder).withColumn("first", F.lit(0).cast("long"))
    found = _asked(files, lambda m, first, n: {"token": asked, "n": [m.count(t) for t in asked]})
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """doc_id, offset in the document, start: every place of a token among all ids."""

    def each(m: Matrix, first: int, n: int) -> dict[str, list]:
        at = m.positions(token)
        stops = np.cumsum(m.lengths)
        doc = np.searchsorted(stops, at, "right")
        return {"doc_id": [m.doc_ids[k] for k in doc.tolist()], "offset": (at - (stops - m.lengths)[doc]).tolist(), "inside": at.tolist()}

    files = spark.read.parquet(folder)
    found = _asked(files.withColumn("first", F.lit(0).cast("long")), each)
    return found.join(_offsets(files), ["shard", "seq"]).select("doc_id", "offset", (F.col("first") + F.col("inside")).alias("start"))


def tokens_at(spark: SparkSession, folder: str, places: list[int]) -> DataFrame:
    """start, token of the asked places among all ids; none for those beyond them."""
    asked = np.array(sorted(set(places)), np.int64)
    files = spark.read.parquet(folder)

    def each(m: Matrix, first: int, n: int) -> dict[str, list]:
        own = asked[(asked >= first) & (asked < first + n)].tolist()
        return {"inside": own, "token": [m.access(p - first) for p in own]}

    found = _asked(files.join(_offsets(files), ["shard", "seq"]), each)
    return found.select(F.col("inside").alias("start"), "token")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Writes the documents' files into the shared folder and reads them back; what was read stays there."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/wavelet-{uuid.uuid4().hex}"
    write_files(docs, path, f"{folder}/files")
    read_files(spark, f"{folder}/files").write.parquet(f"{folder}/read")
    dropped(spark, f"{folder}/files")
    return spark.read.schema("doc_id long, start long, n_tokens long, ids_crc32 long").parquet(f"{folder}/read")
