"""Plumbing that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from promptsift.shared import saved, shared_dir, written

__all__ = ["bucketed", "dropped", "fresh", "gathered", "looked_up", "per_text", "saved", "shared_dir", "table", "text_column", "written"]

#: Keys of more than this share of the rows are looked up by broadcast.
HOT = 1 / 1000
#: Characters that separate words: space and the controls 9 to 13, as ``bytes.split()`` has it.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_text(each: Callable, returns: str, names: list[str]) -> Callable[..., Column]:
    """A column function: each(list of texts) gives the rows' tuples, as a struct column.

    It isn't deterministic to the optimizer, which therefore never runs it twice for a row.
    """
    kinds = pa_struct(returns)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = each(texts.to_pylist())
            columns = [list(c) for c in zip(*rows)] or [[] for _ in names]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(run, returns).asNondeterministic()


_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}


def pa_struct(ddl: str) -> list[pa.DataType]:
    """Arrow types of a flat DDL string."""
    return [_KINDS[part.split()[-1]] for part in ddl.split(",")]


def field_names(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(",")]


def text_column(each: Callable, returns: str) -> Callable[..., Column]:
    return per_text(each, returns, field_names(returns))


def dropped(spark: SparkSession, *folders: str) -> None:
    """Removes folders of the shared folder that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """df as a table in the shared folder, in as many buckets of key as a shuffle has partitions.

    Joins on key read it in place. The table's name goes from the catalog at once; its files stay.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def gathered(starts: np.ndarray, values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[starts[k]:starts[k + 1]] for each k of at, joined, and their lengths."""
    lengths = np.diff(starts)[at]
    stops = np.cumsum(lengths)
    kind = np.int32 if max(len(values), int(stops[-1]) if len(stops) else 0) < 1 << 31 else np.int64
    where = np.repeat((starts[at] - (stops - lengths)).astype(kind), lengths)
    where += np.arange(len(where), dtype=kind)
    return values.take(where), lengths


def looked_up(rows: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """rows with known's value of their key, or null; known: key, value, n (how many of rows have the key).

    Keys of more than a HOT share of the rows are fewer than its inverse: they are looked up
    by broadcast, and neither their rows nor those without a key are shuffled.
    """
    bound = rows.count() * HOT
    hot = known.filter(F.col("n") > bound).select(key, F.lit(True).alias("is_hot"), F.col(value).alias("hot_value"))
    at_hot = rows.join(F.broadcast(hot), key, "left")
    settled = F.col("is_hot").isNotNull() | F.col(key).isNull()
    rest = at_hot.filter(~settled).select(*rows.columns).join(known.filter(F.col("n") <= bound).select(key, value), key, "left")
    return at_hot.filter(settled).withColumn(value, F.col("hot_value")).select(*rows.columns, value).unionByName(rest.select(*rows.columns, value))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
