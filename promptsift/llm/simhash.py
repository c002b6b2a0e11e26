"""SimHash near-duplicates by pigeonhole blocks.

A document's fingerprint has a bit set where over half of its three-word shingles' 64-bit
hashes have it. Documents of equal fingerprint are one class, made by an aggregation, so that
copies never meet in pairs. A class's fingerprint is split into ``BLOCKS`` blocks; two that
differ in at most ``DISTANCE`` bits have BLOCKS - DISTANCE blocks in common, so a row for each
choice of so many blocks is joined to the others of its key, and the join tests the distance.

A key that over ``CROWD`` classes share would make a square of pairs. Its classes are linked
by midpoints instead: each gives itself and its 64 neighbours at one bit. Two fingerprints
share such a point exactly if they differ in at most two bits, and at most 65 share one, so
every link is found with 65 rows for a class.

Components come from contraction: every class takes the least of itself and its neighbours as
its parent, parents of parents are followed, and the links between different parents are the
next round's. Tables between rounds are checkpoints in the shared folder.

Results for edge cases: a null or empty text, or one of white space, has the fingerprint 0
and is linked like any other; under three words, the whole sequence is the shingle. Repeated
rows are in one class. A null doc_id names no component: its row gets its class's. In
``deduplicated``, one row of each component stays: of the least doc_id, then the least
fingerprint, then the least hash of its text; one without a doc_id only where no row of its
component has one.
"""

from __future__ import annotations

import uuid
from itertools import accumulate, combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptsift.llm import near_copies
from promptsift.llm.common import dropped, fresh, looked_up, saved, shared_dir, text_column

SEED = 42
SHINGLE = 3
DISTANCE = 2
BLOCKS = 4
#: Classes of one key that are still joined in pairs.
CROWD = 16
_BITS = 64 // BLOCKS


def _words(text: str | None) -> tuple[list[bytes], bytes]:
    """Lower-case words, and them joined by spaces."""
    words = (text or "").encode("utf-8").lower().split()
    return words, b" ".join(words)


def _fingerprint(words: list[bytes], joined: bytes) -> int:
    if not words:
        return 0
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = list(accumulate(map((1).__add__, map(len, words))))
        starts = [0, *ends]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])]
    data = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(data), 1 << 14):
        ones += np.unpackbits(data[k : k + (1 << 14)], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str | None) -> int:
    """Of a whole text, as a signed 64-bit integer."""
    return _fingerprint(*_words(text))


def _sketched(text: str | None) -> tuple:
    words = _words(text)
    return _fingerprint(*words), *near_copies.sketch(*words)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fp."""
    column = text_column(lambda texts: [(fingerprint(t),) for t in texts], "fp long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), column(F.col("text")).alias("s")).select("doc_id", "s.fp")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _block_keys(fp: Column) -> Column:
    """A value for each choice of blocks: its place above, then the blocks' bits."""
    keep = BLOCKS - DISTANCE
    keys = []
    for n, chosen in enumerate(combinations(range(BLOCKS), keep)):
        key = F.lit(n).cast("long")
        for b in chosen:
            block = F.shiftrightunsigned(fp, b * _BITS).bitwiseAND(F.lit((1 << _BITS) - 1).cast("long"))
            key = F.shiftleft(key, _BITS).bitwiseOR(block)
        keys.append(key)
    return F.array(*keys)


def links(classes: DataFrame) -> DataFrame:
    """a < b of all different fingerprints (column fp, distinct) at DISTANCE or fewer bits, or a path between them."""
    keyed = classes.select("fp", F.explode(_block_keys(F.col("fp"))).alias("key"))
    shared = keyed.groupBy("key").count().filter("count > 1")
    met = saved(keyed.join(shared, "key").select("key", "fp", (F.col("count") <= CROWD).alias("few")))
    few = met.filter("few")
    a, b = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (_distance(F.col("a"), F.col("b")) <= DISTANCE)
    pairs = a.join(b, (a["key"] == b["key"]) & near).select("a", "b")
    crowd = met.filter("not few").select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long") for k in range(64)))
    points = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    # at most 65 fingerprints share a point
    around = points.groupBy("point").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    star = around.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b")
    return pairs.unionByName(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Per node of edges (a, b), which are read several times: node, root, which is equal within a component only."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = saved(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = saved(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent")))
        for _ in range(2):
            above = parent.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
            parent = parent.join(above, "parent").select("node", F.col("next").alias("parent"))
        parent = saved(parent)
        to = parent.select(F.col("node").alias("root"), F.col("parent").alias("next"))
        labels = saved(labels.join(to, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        pa = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        pb = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = edges.join(pa, "a").join(pb, "b").filter("pa <> pb")
        edges = saved(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    return labels


def grouped(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    fps = saved(fingerprints(docs))
    classes = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    labels = components(saved(links(classes.select("fp")))).withColumnRenamed("node", "fp")
    rooted = saved(classes.join(labels, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    ids = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n")))
    known = saved(looked_up(rooted.select("fp", "root", F.col("n").alias("rows")), ids, "root", "component_id").select("fp", F.col("rows").alias("n"), "component_id"))
    both = looked_up(fps, known, "fp", "component_id")
    return both.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents, all columns, of which one of each component stays: that of the least doc_id.

    Besides fingerprints, five-word shingles of a similarity of 0.8 or more link documents.
    """
    spark = docs.sparkSession
    doc_id, text = F.col("doc_id").cast("long"), F.xxhash64("text")
    column = text_column(lambda texts: [_sketched(t) for t in texts], "fp long, digest binary, bands array<long>, sketch binary")
    folder = f"{shared_dir(spark)}/sketches-{uuid.uuid4().hex}"
    docs.select(doc_id.alias("doc_id"), text.alias("text_hash"), column(F.col("text")).alias("s")).select("doc_id", "text_hash", "s.*").write.parquet(folder)
    sketched = spark.read.parquet(folder)
    ids_first = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash")
    classes = saved(sketched.groupBy("fp").agg(F.min(ids_first).alias("first")))
    edges = saved(links(classes.select("fp")).unionByName(near_copies.links(sketched, docs)).distinct())
    labels = components(edges).withColumnRenamed("node", "fp")
    root = F.coalesce("root", "fp")
    least = classes.join(labels, "fp", "left").groupBy(root).agg(F.min(F.struct("first.none", "first.id", "fp", "first.text_hash")).alias("first"))
    stay = saved(least.select("first.*"))
    dropped(spark, folder)
    keys = [fresh(docs, name) for name in ("none", "id", "text_hash")]
    own = (doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), text)
    stay = stay.select(*(F.col(c).alias(k) for c, k in zip(("none", "id", "text_hash"), keys)))
    return docs.withColumns(dict(zip(keys, own))).join(stay, keys, "left_semi").dropDuplicates(keys).drop(*keys)
