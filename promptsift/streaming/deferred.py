"""What a stream defers, kept in a store table: each micro-batch's files take the place of those of its first try."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from promptsift.operators import store
from promptsift.shared import path_of


def put_batch(rows: DataFrame, path: str, batch: str) -> None:
    """Adds rows (store.COLUMNS) under a batch's name. Done again, it leaves what it leaves once.

    The rows are written beside the table, where readers don't look; then what an earlier try
    has moved goes, and the new files are moved, named after the batch.
    """
    spark = rows.sparkSession
    top = path.rstrip("/")
    files, staging = path_of(spark, f"{top}/_staging-{batch}-{uuid.uuid4().hex}")
    store.append(rows, staging.toString())
    for old in files.globStatus(path_of(spark, f"{top}/workspace_key=*/hour=*/{batch}-part-*")[1]) or ():
        files.delete(old.getPath(), False)
    for new in files.globStatus(path_of(spark, f"{staging.toString()}/workspace_key=*/hour=*/part-*")[1]) or ():
        hour = new.getPath().getParent()
        folder = path_of(spark, f"{top}/{hour.getParent().getName()}/{hour.getName()}")[1]
        files.mkdirs(folder)
        target = path_of(spark, f"{folder.toString()}/{batch}-{new.getPath().getName()}")[1]
        if not files.rename(new.getPath(), target):
            raise OSError(f"{target.toString()} can't be written")
    files.delete(staging, True)


def kept_stream(chunks: DataFrame, path: str, stored_at: Column, workspace_key: str = "", name: str = "stream", ttl: float | None = None) -> DataStreamWriter:
    """A writer of a stream's deferred chunks to the store at path; start it with a checkpoint location.

    stored_at: when a chunk was deferred, from its own columns, so that a batch that is tried
    again stores the same. With a ttl, what the latest chunk finds expired is evicted after
    each batch. The newest row of a key counts, as in any store.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = store.rows_of(batch, stored_at, workspace_key).persist()
        try:
            put_batch(rows, path, f"{name}-{number}")
            latest = rows.agg(F.max("stored_at")).first()[0] if ttl is not None else None
        finally:
            rows.unpersist()
        if latest is not None:
            store.set_mark(batch.sparkSession, path, latest, ttl)
            store.drop_hours(batch.sparkSession, path)

    return chunks.writeStream.foreachBatch(put)
