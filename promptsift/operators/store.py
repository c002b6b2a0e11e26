"""The store of deferred chunks: rows keyed by workspace, request and chunk id, which expire.

A store is a table of (workspace_key, request_id, chunk_id, text, kind, source, tokens,
stored_at, seq). Writers append; the newest row of a key counts. ``now`` is seconds since
the epoch.

On disk it is partitioned by workspace and by the hour of ``stored_at``, and its files are
sorted by request, so that a read prunes hours by its time to live and row groups by the
requests that it asks for. What is evicted is told by a mark, a small file that readers heed
and that replaces the one before in one step; whole hours that have expired are then removed.
No file that holds a live row is ever touched, so a failure between any two steps loses none,
and readers and writers need not wait.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptsift.functions.text import chunk_id, token_count
from promptsift.operators.numbering import numbered
from promptsift.schema import DEFERRED, order_keys
from promptsift.shared import path_of

TTL = 3600.0
KEYS = ("workspace_key", "request_id", "chunk_id")
COLUMNS = (*KEYS, "text", "kind", "source", "tokens", "stored_at", "seq")
ROWS = "workspace_key string, request_id string, chunk_id string, text string, kind string, source string, tokens long, stored_at double, seq long, hour long"
#: Seconds of a partition.
HOUR = 3600
#: So many rows that are asked for go to every task, and their requests to the files' statistics; more are joined by shuffles.
FEW = 10_000
#: What a mark is called; names that begin so aren't data to Spark.
_MARK = "_evicted"
#: Seconds by which hours are kept longer than they need be, so that no rounding matters.
_SLACK = 2


def rows_of(chunks: DataFrame, now: float | Column, workspace_key: str = "") -> DataFrame:
    """Store rows of the deferred chunks; seq numbers a request's rows."""
    stored = (now if isinstance(now, Column) else F.lit(now)).cast("double").alias("stored_at")
    found = chunks.filter(F.col("tier") == DEFERRED)
    out = found.select("request_id", chunk_id(F.col("source"), F.col("text")).alias("chunk_id"), "text", "kind", "source", token_count(F.col("text")).alias("tokens"), stored, *(k.alias(f"at_{n}") for n, k in enumerate(order_keys())))
    return numbered(out, ["request_id"], [F.col("at_0"), F.col("at_1")], "seq").select(F.lit(workspace_key).alias("workspace_key"), *COLUMNS[1:])


def alive(store: DataFrame, now: float, ttl: float = TTL) -> DataFrame:
    """Rows within their time to live; hours and row groups that can't hold any are skipped."""
    least = now - ttl
    # a little more than the exact rule, in a form that Parquet's statistics answer
    found = store.filter(F.col("stored_at") >= F.lit(math.nextafter(least, -math.inf) - 1e-6 * abs(least) - 1.0))
    if "hour" in store.columns:
        found = found.filter(F.col("hour") >= math.floor((least - _SLACK) / HOUR))
    return found.filter(F.lit(now) - F.col("stored_at") <= ttl)


def newest(store: DataFrame) -> DataFrame:
    """Of each key the time and seq of its newest row, and of its first; no texts are read."""
    at = Window.partitionBy(*KEYS).orderBy(F.desc("stored_at"), F.desc("seq"))
    every = Window.partitionBy(*KEYS)
    narrow = store.select(*KEYS, "stored_at", "seq").withColumns({"nth": F.row_number().over(at), "first": F.min(F.struct("stored_at", "seq")).over(every)})
    return narrow.filter("nth = 1").drop("nth")


def current(store: DataFrame, few: bool = False) -> DataFrame:
    """The newest row of each key, and the place of its first. Rows written twice count once.

    few: whether there are at most FEW keys, of which each task is then told.
    """
    rows = store.select(*COLUMNS).alias("s")
    found = newest(store)
    found = (F.broadcast(found) if few else found).alias("n")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")) for c in (*KEYS, "stored_at", "seq")]
    return rows.join(found, same).select(*(f"s.{c}" for c in COLUMNS[:-1]), "n.first").distinct()


def put(store: DataFrame | None, chunks: DataFrame, now: float, workspace_key: str = "", ttl: float = TTL) -> DataFrame:
    """The store's rows that are alive and the chunks' rows, newest per key."""
    new = rows_of(chunks, now, workspace_key)
    rows = new if store is None else alive(store, now, ttl).select(*COLUMNS).unionByName(new)
    return current(rows).select(*COLUMNS[:-1], F.col("first")["seq"].alias("seq"))


def asked_only(store: DataFrame, asked: DataFrame, keys: tuple[str, ...] = KEYS) -> tuple[DataFrame, bool]:
    """The rows of the keys that are asked for, before anything else happens to them, and whether these are few.

    Few are told to every task, so that no text is shuffled or sorted, and the names of their
    requests to the files' statistics.
    """
    wanted = asked.select(*keys).distinct()
    few = wanted.limit(FEW + 1).count() <= FEW
    if few:
        store = store.filter(F.col("request_id").isin([r.request_id for r in wanted.select("request_id").distinct().collect()]))
    return store.join(F.broadcast(wanted) if few else wanted, list(keys), "left_semi"), few


def retrieve(store: DataFrame, wanted: DataFrame, now: float, ttl: float = TTL) -> DataFrame:
    """Of wanted (workspace_key, request_id, ids): the rows in the order of ids, repeated ids again; place numbers them."""
    asked = wanted.select("workspace_key", "request_id", F.posexplode("ids").alias("place", "chunk_id"))
    rows, few = asked_only(alive(store, now, ttl), asked)
    found = current(rows, few)
    return asked.join(F.broadcast(found) if few else found, list(KEYS)).select("workspace_key", "request_id", "place", "chunk_id", "text", "kind", "source")


def manifest(store: DataFrame, now: float, ttl: float = TTL, wanted: DataFrame | None = None) -> DataFrame:
    """id, source, kind and tokens of what is alive, of all requests or wanted ones (workspace_key, request_id); place is its place in its request.

    Texts are neither read nor shuffled.
    """
    rows = alive(store, now, ttl)
    if wanted is not None:
        rows, _ = asked_only(rows, wanted, KEYS[:2])
    last = F.max_by(F.struct("source", "kind", "tokens"), F.struct("stored_at", "seq")).alias("row")
    found = rows.groupBy(*KEYS).agg(last, F.min(F.struct("stored_at", "seq")).alias("first")).select(*KEYS, "row.*", "first")
    placed = numbered(found, ["workspace_key", "request_id"], [F.col("first"), F.col("chunk_id")])
    return placed.select("workspace_key", "request_id", F.col("place").cast("int").alias("place"), F.col("chunk_id").alias("id"), "source", "kind", "tokens")


def evicted(store: DataFrame, now: float, ttl: float = TTL) -> DataFrame:
    """One row: how many keys have expired."""
    latest = store.groupBy(*KEYS).agg(F.max("stored_at").alias("stored_at"))
    return latest.agg(F.count_if(F.lit(now) - F.col("stored_at") > ttl).alias("removed"))


def evict(spark: SparkSession, path: str, now: float, ttl: float = TTL) -> int:
    """Evicts what has expired from the stored table; how many keys went.

    First the mark, then the hours that lie before it as a whole. After a failure in between,
    the next call removes the hours that are left.
    """
    removed = evicted(load(spark, path), now, ttl).first()["removed"]
    set_mark(spark, path, now, ttl)
    drop_hours(spark, path)
    return removed


def _mark(spark: SparkSession, path: str) -> tuple[float, float] | None:
    """now and ttl of the eviction that reaches furthest; its file's name says both."""
    files, folder = path_of(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    marks = [tuple(map(float, n.split("@")[1:])) for n in names if n.startswith(_MARK)]
    return max(marks, key=lambda m: m[0] - m[1], default=None)


def set_mark(spark: SparkSession, path: str, now: float, ttl: float) -> None:
    """From here on readers see nothing that has expired by now. A mark goes only when a later one is there."""
    files, folder = path_of(spark, path)
    files.create(path_of(spark, f"{path.rstrip('/')}/{_MARK}@{float(now)!r}@{float(ttl)!r}")[1]).close()
    last = _mark(spark, path)
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith(_MARK) and tuple(map(float, name.split("@")[1:])) != last:
            files.delete(status.getPath(), False)


def drop_hours(spark: SparkSession, path: str) -> int:
    """Removes the hours that the mark has passed as a whole; how many."""
    now, ttl = _mark(spark, path)
    files, hours = path_of(spark, f"{path.rstrip('/')}/workspace_key=*/hour=*")
    gone = [s.getPath() for s in files.globStatus(hours) or () if (int(s.getPath().getName().split("=")[1]) + 1) * HOUR <= now - ttl - _SLACK]
    for hour in gone:
        files.delete(hour, True)
    return len(gone)


def append(rows: DataFrame, path: str) -> None:
    """Adds rows (COLUMNS); large requests are written by several tasks."""
    hour = F.floor(F.col("stored_at") / HOUR)
    dealt = rows.select(*COLUMNS, hour.alias("hour")).hint("rebalance", "workspace_key", "hour")
    dealt.sortWithinPartitions("workspace_key", "hour", "request_id", "chunk_id").write.mode("append").partitionBy("workspace_key", "hour").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows that no eviction has taken; none where everything has been evicted."""
    rows = spark.read.schema(ROWS).parquet(path)
    rows = rows.withColumn("workspace_key", F.coalesce(F.col("workspace_key").cast("string"), F.lit("")))
    mark = _mark(spark, path)
    return (rows if mark is None else alive(rows, *mark)).select(*COLUMNS, "hour")
