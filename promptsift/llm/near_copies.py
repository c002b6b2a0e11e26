"""Near copies beyond a fingerprint's reach: five-word shingles with a similarity of 0.8 or more.

At that similarity fingerprints differ in up to a dozen bits, where blocks of 64 bits no
longer tell texts apart. So candidates come from bands of minimum hashes (``BANDS`` of
``ROWS``; a pair at 0.8 shares none with a chance of 2 in 10,000), and each pair of candidates
is tested by the Jaccard similarity of its texts' ``SKETCH`` least shingle hashes, which are
all shingles of a text with no more of them.

Copies of equal words are one content and meet nobody twice. In a band's key of up to
``CROWD`` contents all pairs are candidates. In a larger one every content is first tested
against the least of the key and against the least of its parts of the key (one of ``PARTS``
in each of ``WAYS``, by the content's hash). Those links join most of a key; what they leave
apart is then compared exactly: the contents outside the key's largest group of linked ones with all of
another group, over all their shingles, in cells of two blocks of ``BLOCK`` contents. A
cell returns only the links that join components, so its rows are fewer than its contents.

Edge cases: a text without words (null, empty, blank) has no content and no near copies. One
with fewer than five words has one shingle, of all of them. Case and white space don't count.
Very long texts are sketched like others, and all their shingles are held only where a sketch
leaves a pair open; a cell holds those of two blocks. An empty table has no links.
"""

from __future__ import annotations

import uuid
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from promptsift.llm.common import dropped, saved, shared_dir, text_column

SHINGLE = 5
SIMILARITY = 0.8
ROUGH = 0.7
BANDS, ROWS = 16, 4
SKETCH = 512
CROWD = 12
PARTS, WAYS = 32, 2
#: Contents of a side of a cell.
BLOCK = 256
_RNG = np.random.default_rng(5)
_SCALE = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = _RNG.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PART = 1 << 13


def shingles(words: list[bytes], joined: bytes) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending."""
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined)]
    else:
        ends = list(accumulate(map((1).__add__, map(len, words))))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1]) for a, b in zip([0, *ends], ends[SHINGLE - 1 :])]
    return np.unique(np.array(hashes, np.uint64))


def sketch(words: list[bytes], joined: bytes) -> tuple[bytes | None, list[int], bytes]:
    """Of a text's words, and them joined by spaces: their digest, the bands' keys, the least shingle hashes' upper halves."""
    if not words:
        return None, [], b""
    found = shingles(words, joined)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), _PART):
        part = found[None, k : k + _PART] * _SCALE[:, None] + _SHIFT[:, None]
        # the low bits of such a product are poor
        np.minimum(least, (part ^ (part >> np.uint64(31))).min(1), out=least)
    mixed = (least.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64)
    mixed ^= mixed >> np.uint64(29)
    keys = (mixed * _MIX[0] + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
    return xxhash.xxh3_128_digest(joined), keys.tolist(), (found[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes()


def similarity(a: bytes, b: bytes) -> float:
    """Estimated from the least hashes of the union; exact if both texts have no more than SKETCH."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    union = np.union1d(x, y)
    if len(x) == SKETCH or len(y) == SKETCH:
        union = union[:SKETCH]
    return len(np.intersect1d(np.intersect1d(x, y), union, True)) / max(1, len(union))


@arrow_udf(DoubleType())
def _similar(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([similarity(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def meetings(contents: DataFrame) -> DataFrame:
    """Per content of contents (digest, bands) and band's key that it shares: key, digest, count of the key."""
    keyed = contents.select("digest", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").count().filter("count > 1")
    return saved(keyed.join(shared, "key"))


def candidates(met: DataFrame) -> DataFrame:
    """a < b of contents that share a key: all pairs of the small ones, representatives of the crowded ones."""
    few = met.filter(F.col("count") <= CROWD)
    a, b = few.select("key", F.col("digest").alias("a")), few.select("key", F.col("digest").alias("b"))
    pairs = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b"))).select("a", "b")
    crowd = met.filter(F.col("count") > CROWD)
    first = crowd.groupBy("key").agg(F.min("digest").alias("a"))
    star = crowd.join(first, "key").select("a", F.col("digest").alias("b"))
    # numbers of parts apart from each other for the two ways of dealing
    parts = F.explode(F.array(*(F.pmod(F.xxhash64(F.lit(way), "digest"), F.lit(PARTS)) + way * PARTS for way in range(WAYS))))
    dealt = crowd.select("key", parts.alias("part"), "digest")
    second = dealt.groupBy("key", "part").agg(F.min("digest").alias("a"))
    stars = dealt.join(second, ["key", "part"]).select("a", F.col("digest").alias("b"))
    return pairs.unionByName(star).unionByName(stars).filter("a < b").distinct()


def whole(docs: DataFrame, need: DataFrame) -> DataFrame:
    """digest, all shingle hashes of the long texts among docs whose digest is in need, and of a few others.

    The needed digests' first three bytes go to the tasks as a bitmap of 2 MB, so that few texts are shingled and shuffled.
    """
    bit = F.conv(F.hex(F.substring("digest", 1, 3)), 16, 10).cast("long")
    parts = need.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767).cast("long"))).alias("bits"))
    table = np.zeros(1 << 21, np.uint8)
    for part, bits in parts.collect():
        table[part << 12 : part + 1 << 12] = np.frombuffer(bits, np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def row(text: str | None) -> tuple:
        words = (text or "").encode("utf-8").lower().split()
        joined = b" ".join(words)
        digest = xxhash.xxh3_128_digest(joined)
        at = int.from_bytes(digest[:3], "big")
        return (digest, shingles(words, joined).view(np.int64)) if words and sent.value[at >> 3] >> (at & 7) & 1 else (None, None)

    column = text_column(lambda texts: [row(t) for t in texts], "digest binary, shingles array<long>")
    # so many different shingles that a text of over SKETCH can be near it take more than so many characters
    long = docs.filter(F.length("text") > int(2 * SIMILARITY * SKETCH) - 20)
    found = long.select(column(F.col("text")).alias("s")).select("s.*").filter("digest is not null")
    return found.groupBy("digest").agg(F.first("shingles").alias("shingles"))


def verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b, digests) with the similarity over all shingles in full (digest, shingles)."""
    side = lambda s: full.select(F.col("digest").alias(s), F.col("shingles").alias(f"all_{s}"))
    both = F.size(F.array_intersect("all_a", "all_b"))
    counted = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", both)
    close = F.col("both") / (F.size("all_a") + F.size("all_b") - F.col("both")) >= SIMILARITY
    return counted.filter(close).drop("all_a", "all_b", "both")


def cell_links(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Whether each of left and each of right have the similarity, over whole sets of numbers."""
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    ids, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cut = int(sizes[0].sum())
    owners = [np.repeat(np.arange(len(n)), n) for n in sizes]
    columns = [at[:cut], at[cut:]]
    # those of both sides, numbered anew
    common = np.bincount(columns[0], minlength=len(ids)).astype(bool) & np.bincount(columns[1], minlength=len(ids)).astype(bool)
    number = np.cumsum(common) - 1
    kept = [common[c] for c in columns]
    owners, columns = [o[k] for o, k in zip(owners, kept)], [number[c[k]] for c, k in zip(columns, kept)]
    orders = [np.argsort(c, kind="stable") for c in columns]
    owners, columns = [o[k] for o, k in zip(owners, orders)], [c[k] for c, k in zip(columns, orders)]
    both = np.zeros((len(left), len(right)), np.float32)
    for k in range(0, int(common.sum()), _PART):
        parts = []
        for side in (0, 1):
            a, b = np.searchsorted(columns[side], (k, k + _PART))
            part = np.zeros((len(sizes[side]), _PART), np.float32)
            part[owners[side][a:b], columns[side][a:b] - k] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - both.astype(np.float64)
    return both / np.maximum(union, 1) >= SIMILARITY


def _cell(rows: pa.Table) -> pa.Table:
    """Links (fingerprints) that join components of one cell."""
    own, fp, label, i, j = (rows.column(n).to_numpy() for n in ("own", "fp", "label", "i", "j"))
    a, b = [], []
    if len(np.unique(label)) > 1:
        lists = zip(rows.column("shingles"), rows.column("sketch"))
        sets = [np.unique((x.values.to_numpy().view(np.uint64) >> np.uint64(32)).astype("<u4")) if x.is_valid else np.unique(np.frombuffer(y.as_py(), "<u4")) for x, y in lists]
        sides = [np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0])]
        if all(map(len, sides)):
            near = cell_links(*([sets[k] for k in side] for side in sides)) & (label[sides[0]][:, None] != label[sides[1]][None, :])
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while (up := root.get(x, x)) != x:
                    root[x] = x = root.get(up, up)
                return x

            for x, y in zip(*np.nonzero(near)):
                x, y = sides[0][x], sides[1][y]
                if (p := find(int(label[x]))) != (q := find(int(label[y]))):
                    root[p] = q
                    a.append(min(fp[x], fp[y]))
                    b.append(max(fp[x], fp[y]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def crossings(crowd: DataFrame, contents: DataFrame, full: DataFrame, found: DataFrame) -> DataFrame:
    """The links that found lacks within crowded keys (key, digest), or others that join the same components."""
    # equal labels are connected; those of one component may still differ, which only makes more cells
    near = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b"))
    parent = near.select(F.col("a").alias("fp"), F.least("a", "b").alias("root"))
    labels = parent.join(parent.select(F.col("fp").alias("root"), F.col("root").alias("above")), "root").select("fp", F.col("above").alias("root"))
    members = crowd.select("key", "digest").join(contents.select("digest", "fp"), "digest").join(labels, "fp", "left")
    members = saved(members.select("key", "digest", "fp", F.coalesce("root", "fp").alias("label")))
    sizes = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    keys = sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.max("n").alias("most"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("labels"))
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    apart = keys.filter("labels > 1").select("key", "major", blocks(F.col("all") - F.col("most")).alias("minors"), blocks(F.col("most")).alias("majors"))
    is_major, hashed = F.col("label") == F.col("major"), F.xxhash64("digest")
    own = F.when(is_major, F.col("minors") + F.pmod(hashed, F.col("majors"))).otherwise(F.pmod(hashed, F.col("minors"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("minors") + F.when(is_major, 0).otherwise(F.col("majors")) - 1))
    dealt = members.join(apart, "key").select("key", "digest", "fp", "label", own.alias("own"), other.alias("other"))
    dealt = dealt.select("key", "digest", "fp", "label", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    short = F.when(~F.col("long"), F.col("sketch")).alias("sketch")
    filled = dealt.join(contents.select("digest", short), "digest").join(full, "digest", "left")
    return filled.groupBy("key", "i", "j").applyInArrow(_cell, "a long, b long").distinct()


def links(sketched: DataFrame, docs: DataFrame) -> DataFrame:
    """a < b, fingerprints of near copies among sketched (fp, digest, bands, sketch), or a path between them; docs has the texts."""
    spark = sketched.sparkSession
    folder = f"{shared_dir(spark)}/near-{uuid.uuid4().hex}"
    named = sketched.filter("digest is not null").groupBy("digest").agg(F.min("fp").alias("fp"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    named.withColumn("long", F.length("sketch") >= 4 * SKETCH).write.parquet(folder)
    contents = spark.read.parquet(folder)
    met = meetings(contents.select("digest", "bands"))
    side = lambda s: contents.select(F.col("digest").alias(s), F.col("fp").alias(f"fp_{s}"), F.col("sketch").alias(f"sketch_{s}"), F.col("long").alias(f"long_{s}"))
    both = candidates(met).join(side("a"), "a").join(side("b"), "b").filter("fp_a <> fp_b")
    value, long = _similar.asNondeterministic()("sketch_a", "sketch_b"), F.col("long_a") | F.col("long_b")
    tested = both.select("a", "b", F.least("fp_a", "fp_b").alias("fp_a"), F.greatest("fp_a", "fp_b").alias("fp_b"), long.alias("long"), value.alias("value"))
    tested = saved(tested.filter(F.col("value") >= F.when(F.col("long"), ROUGH).otherwise(SIMILARITY)))
    crowd = met.filter(F.col("count") > CROWD)
    unsure = tested.filter("long")
    need = unsure.select(F.explode(F.array("a", "b")).alias("digest")).unionByName(crowd.join(contents.filter("long").select("digest"), "digest").select("digest"))
    full = saved(whole(docs, need))
    found = saved(tested.filter("not long").unionByName(verified(unsure, full)).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b")).distinct())
    if not crowd.isEmpty():
        found = saved(found.unionByName(crossings(crowd, contents, full, found)).distinct())
    dropped(spark, folder)
    return found
