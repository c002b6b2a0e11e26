"""Runs of lines of one template in logs of any length, whose lines are rows.

Lines are dealt by ranges of their log and number, so that a log of any size has many tasks.
Each partition streams its lines into runs. What a border parts is stitched by a table of
each partition's first and last run; no window goes over a log's lines. ``text.deduplicated_lines``
does the same for a log that fits a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptsift.functions.text import template_key
from promptsift.shared import written

_OUT = pa.schema([("log", pa.string()), ("first", pa.int64()), ("line", pa.string()), ("key", pa.string()), ("n", pa.int64()), ("part", pa.int32()), ("border", pa.bool_())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's sorted lines (log, line_no, line, key): its runs; the first and the last one are at its border."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    held: tuple | None = None
    at_start = True

    def rows(found: list[list], border: list[bool]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(found, _OUT.types)), pa.array([part] * len(border), pa.int32()), pa.array(border, pa.bool_())], schema=_OUT)

    for batch in batches:
        if not len(batch):
            continue
        log, number, line, key = batch.columns
        same_log = pc.or_(pc.fill_null(pc.equal(log[1:], log[:-1]), False), pc.and_(pc.is_null(log[1:]), pc.is_null(log[:-1])))
        same = pc.and_(same_log, pc.equal(key[1:], key[:-1])).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, ~same.astype(bool)))
        counts = np.diff(starts, append=len(batch))
        at = pa.array(starts)
        found = [log.take(at).to_pylist(), number.take(at).to_pylist(), line.take(at).to_pylist(), key.take(at).to_pylist(), counts.tolist()]
        if held is not None:
            if (held[0], held[3]) == (found[0][0], found[3][0]):
                first = [*held[:4], held[4] + found[4][0]]
                found = [[v, *c[1:]] for v, c in zip(first, found)]
            else:
                found = [[v, *c] for v, c in zip(held, found)]
        held = tuple(c[-1] for c in found)
        if len(found[0]) > 1:
            border = [at_start, *[False] * (len(found[0]) - 2)]
            at_start = False
            yield rows([c[:-1] for c in found], border)
    if held is not None:
        yield rows([[v] for v in held], [True])


def runs(lines: DataFrame, log: str = "request_id", order: str = "line_no", line: str = "line", key: Column | None = None) -> DataFrame:
    """log, first (the number of the run's first line), line (that line), n: a row for each run of equal keys, which are the lines' templates.

    Numbers order a log's lines and occur once in it. A null log is a log; a null line has an
    empty template.
    """
    template = template_key(F.col(line)) if key is None else key
    rows = lines.select(F.col(log).cast("string").alias("log"), F.col(order).cast("long").alias("number"), F.col(line).alias("line"), F.coalesce(template, F.lit("")).alias("key"))
    dealt = rows.repartitionByRange("log", "number").sortWithinPartitions("log", "number")
    # written down, as ranges are drawn from samples and both parts below must see the same ones
    found = written(dealt.mapInArrow(_runs, "log string, first long, line string, key string, n long, part int, border boolean"), "runs")
    return found.filter(~F.col("border")).select("log", "first", "line", "n").unionByName(_stitched(found.filter("border"))).withColumnRenamed("log", log)


def _stitched(borders: DataFrame) -> DataFrame:
    """Runs at borders, of which each partition has two at most, joined where neighbours go on."""
    order = Window.orderBy("log", "first")
    goes_on = F.col("log").eqNullSafe(F.lag("log").over(order)) & (F.col("key") == F.lag("key").over(order)) & (F.col("part") != F.lag("part").over(order))
    marked = borders.withColumn("new", (~F.coalesce(goes_on, F.lit(False))).cast("long"))
    grouped = marked.withColumn("run", F.sum("new").over(order))
    return grouped.groupBy("run").agg(F.min_by("log", "first").alias("log"), F.min("first").alias("first"), F.min_by("line", "first").alias("line"), F.sum("n").alias("n")).select("log", "first", "line", "n")


def deduplicated(lines: DataFrame, log: str = "request_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """log, first, text: the lines that stay of each log, with the length of runs over 1."""
    found = runs(lines, log, order, line)
    text = F.when(F.col("n") == 1, F.col("line")).otherwise(F.concat("line", F.lit("   (x"), F.col("n").cast("string"), F.lit(")")))
    return found.select(log, "first", text.alias("text"))
