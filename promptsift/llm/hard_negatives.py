"""Hard negatives: rows of another label whose score is close below that of an anchor's positives.

Components become integers, floor(SCALE * x). Rows are dealt by a hash into parts, of which
each grows a ball tree; an anchor goes to every part, since rows that no bound excludes may
lie in any. A part's rows and then the anchors stream through its task, which holds one tree of
at most PART rows and a thousand anchors. Parts' best are merged by windows that end with the k-th.
There are two rounds: positives (the best of the anchor's label), then, in the windows that
their scores open, the best of other labels.

Edge cases: a row takes no part if its id or label is null or its vector is null or holds a
null, NaN or infinite component. Shorter vectors are as if filled up with zeros, and empty ones
are zero. Components are held within 2^26, so that scores of up to 2048 dimensions are exact
longs. Repeated rows are rows of their own; an anchor is only no positive of itself. Ties go
by smaller id. An anchor without positives, or a positive without negatives, gives no rows,
as an empty table does. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptsift.llm.ball_tree import NO_ID, Wanted, grown, searched
from promptsift.llm.common import written
from promptsift.llm.whitening import sound

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is from LOW to HIGH hundredths of the positive's.
LOW, HIGH = 50, 95
#: Rows of a part at most, and anchors that search together.
PART, BLOCK = 1 << 16, 1 << 10
_LIMIT = float(1 << 26)
_EVERY = (-(1 << 62), 1 << 62)


def cleaned(rows: DataFrame, is_anchor: Column, label: Column, key: str, vector: str) -> DataFrame:
    """row, id, label, vector (integers) and is_anchor of the rows that take part, written down so that rows keep their numbers."""
    whole = F.transform(F.col(vector), lambda c: F.floor(F.greatest(F.lit(-_LIMIT), F.least(F.lit(_LIMIT), c.cast("double") * SCALE))))
    good = rows.filter(F.col(key).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & (sound(F.col(vector)) | (F.size(vector) == 0)))
    columns = [F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), whole.cast("array<long>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")]
    return written(good.select(*columns), "vectors")


def _matrix(vectors: pa.Array, width: int = 0) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out


_FIELDS = "part int, is_anchor boolean, row long, id long, label long, vector array<long>, windows array<struct<place:int,low:long,high:long>>"
_HITS = pa.schema([("row", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def _hits(same: bool, k: int):
    """From rows sorted by part, anchors last: each part's k best for each anchor and window."""

    def ask(tree, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(batch), BLOCK):
            block = batch.slice(at, BLOCK)
            rows, labels = (block[c].to_numpy(zero_copy_only=False) for c in ("row", "label"))
            windows = block["windows"].to_pylist()
            of = np.repeat(np.arange(len(block)), [len(w) for w in windows])
            place, low, high = (np.array([w[c] for each in windows for w in each], np.int64) for c in ("place", "low", "high"))
            vectors = _matrix(block["vector"], tree.vectors.shape[1])[:, : tree.vectors.shape[1]]
            best = searched(tree, Wanted(vectors[of], labels[of], same, low, high, rows[of], k))
            query, nth = np.nonzero(best.ids != NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(rows[of[query]]), pa.array(place[query], pa.int32()), pa.array(best.ids[query, nth]), pa.array(best.scores[query, nth])], schema=_HITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, tree = None, [], None
        for batch in batches:
            parts = batch["part"].to_numpy(zero_copy_only=False)
            anchors = batch["is_anchor"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, (parts[1:] != parts[:-1]) | (anchors[1:] != anchors[:-1])))
            for a, b in zip(cuts, np.append(cuts[1:], len(parts))):
                if parts[a] != part:
                    part, held, tree = parts[a], [], None
                some = batch.slice(a, b - a)
                if not anchors[a]:
                    held.append(some)
                    continue
                if tree is None and held:
                    rows = pa.Table.from_batches(held).combine_chunks()
                    numbers = [rows[c].to_numpy() for c in ("row", "id", "label")]
                    tree, held = grown(*numbers, _matrix(rows["vector"].combine_chunks())), []
                if tree is not None:
                    yield from ask(tree, some)

    return run


def _best(rows: DataFrame, anchors: DataFrame, parts: int, same: bool, k: int) -> DataFrame:
    """row (of the anchor), place (of the window), id, score, rank: the k best rows of all parts."""
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    own = rows.select(F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"), F.lit(False).alias("is_anchor"), "row", "id", "label", "vector", F.lit(None).cast("array<struct<place:int,low:long,high:long>>").alias("windows"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(True).alias("is_anchor"), "row", F.lit(None).cast("long").alias("id"), "label", "vector", "windows")
    dealt = own.unionByName(asked).select(*names).repartition(parts, "part").sortWithinPartitions("part", "is_anchor")
    hits = dealt.mapInArrow(_hits(same, k), "row long, place int, id long, score long")
    order = Window.partitionBy("row", "place").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mined(rows: DataFrame, is_anchor: Column, label: Column, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor, label: expressions of rows' columns, before they are cleaned.
    """
    spark = rows.sparkSession
    clean = cleaned(rows, is_anchor, label, key, vector)
    anchors = clean.filter("is_anchor").select("row", "id", "label", "vector")
    n = clean.count()
    parts = max(1, -(-n // PART), min(2 * spark.sparkContext.defaultParallelism, n // 2048))
    every = F.array(F.struct(F.lit(0).alias("place"), F.lit(_EVERY[0]).alias("low"), F.lit(_EVERY[1]).alias("high")))
    positives = written(_best(clean, anchors.withColumn("windows", every), parts, True, POSITIVES).select("row", F.col("rank").alias("place"), "id", "score"), "positives")
    # LOW p <= 100 n <= HIGH p, in whole numbers that don't overflow
    low, high = (F.expr(f"(score div 100) * {share} + ((score % 100) * {share} + {more}) div 100") for share, more in ((LOW, 99), (HIGH, 0)))
    window = F.struct(F.col("place").cast("int").alias("place"), low.alias("low"), high.alias("high"))
    windows = positives.filter("score >= 0").groupBy("row").agg(F.collect_list(window).alias("windows"))
    negatives = _best(clean, anchors.join(windows, "row"), parts, False, NEGATIVES)
    named = positives.join(anchors.select("row", F.col("id").alias("anchor_id")), "row").select("row", "place", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(negatives, ["row", "place"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
