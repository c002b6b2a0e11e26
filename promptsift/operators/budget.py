"""Budget and assemble: fill each request's tokens greedily, then write one prompt.

The fill is an ordered fold (what fits depends on what was taken before), so it runs over
each request's rows in order, in a sorted partition: rows of (request, place, tokens) only,
streamed, with one number of state. Texts are joined back afterwards.

A request of over ``HUGE`` rows is filled by many tasks (``filled_by_blocks``): up to the first
row that doesn't fit, room is what a running sum leaves. From there on less than MIN_HEAD is
left (or nothing, after a head), so of each number of tokens only a few of the first rows can
matter: at most 473 rows of a request, over which the fold runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptsift.functions.text import chunk_id, head_of, token_count
from promptsift.operators.numbering import HUGE, numbered, ranged
from promptsift.operators.relevance import DIGITS
from promptsift.schema import CRITICAL, DEFERRED, KEY, is_live, order_keys
from promptsift.shared import dealt, saved

MAX_TOKENS = 2000
#: The least room in tokens for which a chunk's head is worth keeping.
MIN_HEAD = 100
KEEP, HEAD, DEFER = "keep", "head", "defer"
_FILLED = "request_id string, pos long, verdict string, room long, place long"


def fill(rows: Iterator[tuple[str, int, int, int]]) -> Iterator[tuple[str, int, str, int, int]]:
    """Of (request, pos, tokens, room at the request's start) in order: _FILLED."""
    last, room, place = None, 0, 0
    for request, pos, tokens, start in rows:
        if request != last:
            last, room, place = request, start, 0
        at = room
        if tokens <= room:
            verdict, room = KEEP, room - tokens
        elif room >= MIN_HEAD:
            verdict, room = HEAD, 0
        else:
            verdict = DEFER
        yield request, pos, verdict, at, place
        place += 1


def _fill_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("request_id", pa.string()), ("pos", pa.int64()), ("verdict", pa.string()), ("room", pa.int64()), ("place", pa.int64())])
    held: list[tuple] = []
    for row in fill(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))):
        held.append(row)
        if len(held) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def filled(chunks: DataFrame, cap: int = MAX_TOKENS, huge: int = HUGE) -> DataFrame:
    """The verdict on each live chunk that isn't CRITICAL; place is its number in the order of filling."""
    sized = chunks.withColumn("tokens", token_count(F.col("text")))
    used = sized.groupBy("request_id").agg(F.sum(F.when(F.col("tier") == CRITICAL, F.col("tokens")).otherwise(0)).alias("used"), F.count(F.lit(1)).alias("rows"))
    open_ = sized.filter(is_live() & (F.col("tier") != CRITICAL)).select("request_id", "pos", "tokens", F.round(F.coalesce("relevance", F.lit(0.0)), DIGITS).alias("relevance"))
    room = F.greatest(F.lit(0), F.lit(cap) - F.col("used")).cast("long")
    rows = open_.join(used, "request_id").select("request_id", "pos", "tokens", "relevance", "rows", room.alias("room"))
    small = _folded(rows.filter(F.col("rows") <= huge), [F.col("relevance").desc(), F.col("pos")])
    if used.filter(F.col("rows") > huge).isEmpty():
        return small
    return small.unionByName(filled_by_blocks(rows.filter(F.col("rows") > huge).drop("rows")))


def _folded(rows: DataFrame, order: list[Column]) -> DataFrame:
    return dealt(rows, "request_id", *order).select("request_id", "pos", "tokens", "room").mapInArrow(_fill_batches, _FILLED)


def filled_by_blocks(rows: DataFrame, block: int = HUGE) -> DataFrame:
    """The same for rows (request_id, pos, tokens, relevance, room), with no task for a whole request."""
    placed = ranged(rows, ["request_id"], [F.col("relevance").desc(), F.col("pos")]).select("request_id", "pos", "tokens", "room", (F.col("place") - 1).alias("place"))
    placed = placed.withColumn("block", F.floor(F.col("place") / block))
    before = Window.partitionBy("request_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = placed.groupBy("request_id", "block").agg(F.sum("tokens").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy("request_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.join(blocks.select("request_id", "block", "earlier"), ["request_id", "block"])
    left = F.col("room") - F.col("earlier") - F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    summed = saved(summed.withColumn("left", left).select("request_id", "pos", "tokens", "place", "left"))
    # the first row that doesn't fit, and the room that it finds and leaves
    stops = summed.filter(F.col("tokens") > F.col("left")).groupBy("request_id").agg(F.min(F.struct("place", "left")).alias("s"))
    stops = saved(stops.select("request_id", F.col("s.place").alias("stop"), F.col("s.left").alias("found"), F.when(F.col("s.left") >= MIN_HEAD, 0).otherwise(F.col("s.left")).alias("rest")))
    later = summed.join(stops, "request_id").filter((F.col("place") > F.col("stop")) & (F.col("tokens") > 0) & (F.col("tokens") <= F.col("rest")))
    nth = F.row_number().over(Window.partitionBy("request_id", "tokens").orderBy("place"))
    few = later.withColumn("nth", nth).filter(F.col("nth") < MIN_HEAD).filter(F.col("nth") * F.col("tokens") <= F.col("rest"))
    taken = _folded(few.select("request_id", F.col("place").alias("pos"), "tokens", F.col("rest").alias("room")), [F.col("pos")]).filter(F.col("verdict") == KEEP)
    taken = taken.join(few.select("request_id", F.col("place").alias("pos"), "tokens"), ["request_id", "pos"])
    steps = taken.groupBy("request_id").agg(F.collect_list(F.struct(F.col("pos").alias("at"), F.col("room").alias("was"), (F.col("room") - F.col("tokens")).alias("then"))).alias("steps"))
    every = summed.join(stops, "request_id", "left").join(steps, "request_id", "left")
    own = F.exists(F.coalesce("steps", F.array().cast("array<struct<at:long,was:long,then:long>>")), lambda x: x["at"] == F.col("place"))
    past = F.array_max(F.filter("steps", lambda x: x["at"] < F.col("place")))["then"]
    fits = F.col("stop").isNull() | (F.col("place") < F.col("stop"))
    verdict = F.when(fits | (F.col("tokens") == 0) | own, KEEP).when((F.col("place") == F.col("stop")) & (F.col("found") >= MIN_HEAD), HEAD).otherwise(DEFER)
    room = F.when(fits | (F.col("place") == F.col("stop")), F.col("left")).otherwise(F.coalesce(past, F.col("rest")))
    return every.select("request_id", "pos", verdict.alias("verdict"), room.alias("room"), "place")


#: What an added copy must share with a deferred row for both to be one.
_SAME = ("request_id", "digest", "kind", "source", "severity", "relevance", "summarized")


def decisions(chunks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """On each live chunk: verdict, room, place, whether its request's pinned chunks alone exceed the cap, whether an equal row is deferred already.

    Only narrow rows are shuffled, with a text's digest in its stead.
    """
    digest = F.sha2(F.encode("text", "UTF-8"), 256).alias("digest")
    rows = chunks.select(*KEY, "tier", digest, *_SAME[2:], token_count(F.col("text")).alias("tokens"))
    live = rows.filter(is_live())
    pinned = rows.filter(F.col("tier") == CRITICAL).groupBy("request_id").agg((F.sum("tokens") > max_tokens).alias("over"))
    there = rows.filter(F.col("tier") == DEFERRED).select(*(F.col(c).alias(f"old_{c}") for c in _SAME)).distinct().withColumn("there", F.lit(True))
    equal = [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in _SAME]
    found = live.join(there, equal, "left").join(filled(chunks, max_tokens), list(KEY), "left").join(pinned, "request_id", "left")
    over = (F.col("tier") == CRITICAL) & F.coalesce("over", F.lit(False))
    return found.select(*KEY, F.coalesce("verdict", F.lit(KEEP)).alias("verdict"), "room", "place", over.alias("over"), F.coalesce("there", F.lit(False)).alias("there"))


def budget(chunks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Chunks in place, with heads cut to fit; then the deferred originals, numbered by seq.

    A deferred copy that equals a row that is there already isn't added. Texts are shuffled
    once, to their verdicts.
    """
    names = chunks.columns
    keys = [F.col(f"c.{k}") == F.col(f"v.{k}") for k in KEY]
    own = chunks.alias("c").join(decisions(chunks, max_tokens).alias("v"), [*keys, F.col("c.tier") < DEFERRED], "left")
    verdict, head = F.coalesce("v.verdict", F.lit(KEEP)), F.coalesce(F.col("v.verdict") == HEAD, F.lit(False))
    cut = {"original_tokens": token_count(F.col("c.text")), "kept_tokens": F.col("v.room"), "truncated": F.lit(True), "text": head_of(F.col("c.text"), F.col("c.source"), F.col("v.room"))}
    here = {c: F.when(head, x).otherwise(F.col(f"c.{c}")) for c, x in cut.items()}
    here["critical_overflow"] = F.when(F.col("v.over"), F.lit(True)).otherwise(F.col("c.critical_overflow"))
    added = {"tier": F.lit(DEFERRED), "seq": F.col("v.place")}
    row = lambda changed: F.struct(*(changed.get(c, F.col(f"c.{c}")).cast(chunks.schema[c].dataType).alias(c) for c in names))
    in_place = F.when(verdict != DEFER, row(here))
    copy = F.when(verdict.isin(HEAD, DEFER) & ~F.col("v.there"), row(added))
    return own.select(F.explode(F.filter(F.array(in_place, copy), lambda x: x.isNotNull())).alias("r")).select("r.*")


def deferred(chunks: DataFrame) -> DataFrame:
    """The deferred rows, numbered by place in their request: request_id, place, id, source, kind, tokens."""
    entry = chunks.filter(F.col("tier") == DEFERRED).select("request_id", *(k.alias(f"at_{n}") for n, k in enumerate(order_keys())), chunk_id(F.col("source"), F.col("text")).alias("id"), "source", "kind", token_count(F.col("text")).alias("tokens"))
    placed = numbered(entry, ["request_id"], [F.col("at_0"), F.col("at_1"), F.col("id")])
    return placed.select("request_id", (F.col("place") - 1).alias("place"), "id", "source", "kind", "tokens")


def manifest(chunks: DataFrame) -> DataFrame:
    """Each deferred id of a request once, where it first stands."""
    first = F.min(F.struct("place", "source", "kind", "tokens")).alias("first")
    return deferred(chunks).groupBy("request_id", "id").agg(first).select("request_id", "first.place", "id", "first.source", "first.kind", "first.tokens")


def assemble(chunks: DataFrame) -> DataFrame:
    """One row for each request: prompt, deferred (a number), critical_overflow.

    Live chunks stand under their source, sources in the order in which they first occur; the
    footer counts what was deferred and names its sources. What was deferred has rows of its
    own: ``deferred``, and ``manifest`` with each id once. Only live texts, which the budget
    bounds, are brought together.
    """
    numbered = F.struct(*order_keys())
    members = chunks.filter(is_live()).groupBy("request_id", "source").agg(F.min(numbered).alias("first"), F.array_sort(F.collect_list(F.struct(numbered.alias("at"), "text"))).alias("members"))
    section = F.concat(F.lit("### "), F.col("source"), F.lit("\n\n"), F.array_join(F.transform("members", lambda x: x["text"]), "\n\n"))
    sections = members.select("request_id", F.struct("first", section.alias("section")).alias("s")).groupBy("request_id").agg(F.array_sort(F.collect_list("s")).alias("sections"))
    bodies = sections.select("request_id", F.array_join(F.transform("sections", lambda x: x["section"]), "\n\n").alias("body"))
    is_out = F.col("tier") == DEFERRED
    # by source first, so that the names are gathered once each
    by_source = chunks.groupBy("request_id", "source").agg(F.count_if(is_out).alias("out"), F.bool_or(F.coalesce(F.col("critical_overflow"), F.lit(False)) & (F.col("tier") == CRITICAL)).alias("over"))
    all_rows = by_source.groupBy("request_id").agg(
        F.sum("out").alias("deferred"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("out") > 0, F.col("source")))), ", ").alias("sources"),
        F.bool_or("over").alias("critical_overflow"),
    )
    footer = F.concat(F.lit("\n\n### deferred ("), F.col("deferred").cast("string"), F.lit(" chunks)\nSources omitted: "), F.col("sources"), F.lit(".\nRetrievable on request by id."))
    prompt = F.concat(F.coalesce("body", F.lit("")), F.when(F.col("deferred") > 0, footer).otherwise(""))
    return all_rows.join(bodies, "request_id", "left").select("request_id", prompt.alias("prompt"), "deferred", "critical_overflow")
