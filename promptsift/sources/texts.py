"""Whole texts and their blocks, and blocks of files that are read in splits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptsift.functions.json_text import parses
from promptsift.functions.pinning import pinned_tier
from promptsift.functions.text import SPACE, is_blank, kind_of
from promptsift.schema import as_chunks
from promptsift.shared import written


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows (request_id: the path, text), line ends made line feeds."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.input_file_name().alias("request_id"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def blocks(texts: DataFrame) -> DataFrame:
    """Chunks of texts (request_id, text and optionally profile): what blank lines part, numbered before blanks are dropped."""
    own = ["profile"] if "profile" in texts.columns else []
    return _chunks(texts.select("request_id", *own, F.posexplode(F.split("text", r"\n{2,}", -1)).alias("pos", "text")))


def _chunks(parts: DataFrame) -> DataFrame:
    parts = parts.filter(~is_blank(F.col("text")))
    maybe = F.when(F.regexp_replace("text", r"\A(?:" + SPACE + ")+", "").rlike(r"\A[\{\[]"), F.col("text"))
    found = parts.withColumns({"kind": kind_of(F.col("text"), parses(maybe)), "source": F.concat(F.lit("in/"), F.col("pos").cast("string"))})
    return as_chunks(found)


_PIECES = "file string, start long, k long, text binary, parts long, before long, after long, bytes long, size long, cr boolean"
_PIECE = pa.schema([("file", pa.string()), ("start", pa.int64()), ("k", pa.int64()), ("text", pa.binary()), ("parts", pa.int64()), ("before", pa.int64()), ("after", pa.int64()), ("bytes", pa.int64()), ("size", pa.int64()), ("cr", pa.bool_())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From lines (value, file, start, size) as they are read: each split's parts (k from 0), and a row for the split itself (k: -1).

    Line ends are line feeds from here on. Each line counts as ended by one; the split's row
    tells whether that of the last one came with a carriage return.
    """
    out: list[tuple] = []
    at: tuple | None = None
    part: list[bytes] = []
    k = feeds = before = total = 0
    cr = False

    def close() -> None:
        if at is not None:
            if part:
                out.append((at[0], at[1], k, b"".join(part), None, None, None, None, None, None))
            parts = k + bool(part)
            out.append((at[0], at[1], -1, None, parts, before if parts else feeds, feeds if parts else 0, total, at[2], cr))

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PIECE.types)], schema=_PIECE)

    for batch in batches:
        for value, *split in zip(*(c.to_pylist() for c in batch.columns)):
            if tuple(split) != at:
                close()
                at, part, k, feeds, before, total = tuple(split), [], 0, 0, 0, 0
            total += len(value) + 1
            cr = value.endswith(b"\r")
            for line in (value[:-1] if cr else value).split(b"\r"):
                if line:
                    if not part:
                        before = feeds
                    elif feeds > 1:
                        out.append((at[0], at[1], k, b"".join(part), None, None, None, None, None, None))
                        part, k = [], k + 1
                    else:
                        part.append(b"\n")
                    part.append(line)
                    feeds = 0
                feeds += 1
        if out:
            yield batch_of()
            out.clear()
    close()
    if out:
        yield batch_of()


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks that ``blocks`` makes of ``read_texts``, with files read in splits (those that aren't compressed).

    A split's inner blocks stay where they are read. Its first and last one are joined with
    what the splits beside it hold of them, by a table with a row for each split.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    meta = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_block_start", "start"), ("file_size", "size"))]
    pieces = written(lines.select(F.col("value").cast("binary").alias("value"), *meta).mapInArrow(_pieces, _PIECES), "pieces")
    upto = Window.partitionBy("file").orderBy("start")
    earlier, every = upto.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file")
    has = F.col("parts") > 0
    splits = pieces.filter("k < 0").drop("k", "text").withColumn("blank", F.sum(F.when(has, 0).otherwise(F.col("before"))).over(upto))
    splits = splits.withColumns({
        "last_after": F.coalesce(F.last(F.when(has, F.col("after")), ignorenulls=True).over(earlier), F.lit(0)),
        "last_blank": F.coalesce(F.last(F.when(has, F.col("blank")), ignorenulls=True).over(earlier), F.lit(0)),
        "is_first": ~F.coalesce(F.max(has).over(earlier), F.lit(False)),
        "is_last": has & (F.max(F.when(has, F.col("start"))).over(every) == F.col("start")),
        "ended": F.sum("bytes").over(every) == F.col("size"),
        "end_cr": F.max_by("cr", "start").over(every),
        "all_blank": F.max("blank").over(every),
    })
    # line feeds between a split's first part and the part before it, and after a file's last part
    gap = F.col("last_after") + F.col("blank") - F.col("last_blank") + F.col("before")
    tail = F.col("after") + F.col("all_blank") - F.col("blank") - F.when(F.col("ended") | F.col("end_cr"), 0).otherwise(1)
    splits = splits.filter(has).withColumns({"gap": gap, "tail": F.when(F.col("is_last"), tail)})
    number = F.sum(F.when(F.col("gap") > 1, 1).otherwise(0)).over(upto) + F.coalesce(F.sum(F.col("parts") - 1).over(earlier), F.lit(0))
    splits = splits.withColumn("number", number).select("file", "start", "parts", "gap", "tail", "number")
    parts = pieces.filter("k >= 0").select("file", "start", "k", F.col("text").cast("string").alias("text")).join(splits, ["file", "start"]).withColumn("pos", F.col("number") + F.col("k"))
    at_border = (F.col("k") == 0) | (F.col("k") == F.col("parts") - 1)
    lead = F.when((F.col("k") == 0) & (F.col("gap") == 1), "\n").otherwise("")
    trail = F.when((F.col("k") == F.col("parts") - 1) & (F.col("tail") == 1), "\n").otherwise("")
    border = parts.filter(at_border).groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("start", F.concat(lead, F.col("text"), trail).alias("text")))).alias("found"))
    joined = border.select("file", "pos", F.array_join(F.transform("found", lambda x: x["text"]), "").alias("text"))
    return _chunks(parts.filter(~at_border).select("file", "pos", "text").unionByName(joined).withColumnRenamed("file", "request_id"))


def ingested(specs: DataFrame, query: str = "", patterns: list[str] | None = None) -> DataFrame:
    """Chunks of specs (request_id, pos, text and optionally kind, source, severity, query), pinned."""
    own = F.col("query") if "query" in specs.columns else F.lit(query)
    severity = F.col("severity") if "severity" in specs.columns else F.lit(None).cast("string")
    return as_chunks(specs.withColumn("tier", pinned_tier(F.coalesce("text", F.lit("")), severity, own, patterns or ())))
