"""TF-IDF scores of documents, as joins and aggregations.

Documents are rows of (key columns, pos, text); keys say what is ranked together. A
document's terms are counted inside its row and written once, as 64-bit hashes, in a row for
each document. Document frequencies are pre-aggregated in the tasks that read these rows, so
that a term of a third of all documents is one row of each task. The weights of the terms
are a table whose size Spark knows before it joins: small ones go to every task, and no
(keys, pos, term) row is shuffled; others are joined by shuffling, with the documents on the
side that adaptive execution splits where a term is hot.

Two terms of one hash would count as one: for a request of ten million different terms, the
odds that any two have are three to a million.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from promptsift.functions.text import terms
from promptsift.shared import saved, unlinked, written


#: Terms that are counted at a time, or those of one longer text.
PIECE = 1 << 18


def _counted(lists: pa.ListArray) -> pa.ListArray:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    coded = lists.flatten().dictionary_encode()
    size = len(coded.dictionary) + 1
    rows = np.repeat(np.arange(len(sizes)), sizes)
    pairs, count = np.unique(rows * size + coded.indices.to_numpy(), return_counts=True)
    starts = pa.array(np.searchsorted(pairs // size, np.arange(len(sizes) + 1)), pa.int32())
    found = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(pairs % size)), pa.array(count, pa.int64())], names=["term", "count"])
    return pa.ListArray.from_arrays(starts, found)


def _count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for lists in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        at = 0
        while at < len(ends):  # some texts at a time, whatever the length of those of a batch
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
            yield _counted(lists[at:to])
            at = to


_count.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def counted(found: Column, kind: str = "string") -> Column:
    """The distinct ones of an array of terms and how often it has each: array<struct<term, count>>.

    It isn't deterministic to the optimizer, which therefore never runs it twice for a row.
    """
    return arrow_udf(_count, f"array<struct<term: {kind}, count: bigint>>").asNondeterministic()(found)


def hashed_terms(text: Column) -> Column:
    return F.transform(terms(text), lambda term: F.xxhash64(term))


def term_counts(docs: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """keys, pos, term, count of documents whose (keys, pos) are distinct."""
    return docs.select(*keys, "pos", F.explode(counted(terms(F.col(text)))).alias("t")).select(*keys, "pos", "t.term", "t.count")


def idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def query_scores(docs: DataFrame, queries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, pos, score: the cosine of every document with its keys' query; saved.

    The query counts as one more document: in the number of documents, and in those that
    have a term. A document without terms, or of keys without a query, scores 0. docs: keys,
    pos, text, of distinct (keys, pos); queries: keys, query.
    """
    keys = list(keys)
    own = written(docs.select(*keys, "pos", counted(hashed_terms(F.col("text")), "bigint").alias("terms")), "terms")
    counts = own.select(*keys, "pos", F.explode_outer("terms").alias("t")).select(*keys, "pos", "t.term", "t.count")
    sizes = own.groupBy(*keys).agg((F.count(F.lit(1)) + 1).alias("n"))
    in_docs = counts.filter("term is not null").select(*keys, "term", F.lit(1).alias("having"), F.lit(0).alias("asked"))
    in_query = queries.select(*keys, F.explode(hashed_terms(F.col("query"))).alias("term")).select("*", F.lit(0).alias("having"), F.lit(1).alias("asked"))
    # every term of documents or query, with its weight for each occurrence
    known = in_docs.unionByName(in_query).groupBy(*keys, "term").agg(F.sum("having").alias("having"), F.sum("asked").alias("asked"))
    df = F.col("having") + (F.col("asked") > 0).cast("int")
    weights = written(known.join(sizes, keys).select(*keys, "term", "asked", idf(F.col("n"), df).alias("idf")), "weights")
    wanted, each = F.col("asked") * F.col("idf"), F.col("count") * F.col("idf")
    lengths = weights.filter("asked > 0").groupBy(*keys).agg(F.sqrt(F.sum(wanted * wanted)).alias("query_norm"))
    by_doc = counts.join(weights, [*keys, "term"], "left").groupBy(*keys, "pos").agg(F.sqrt(F.sum(each * each)).alias("norm"), F.sum(each * wanted).alias("dot"))
    cosine = F.when(F.col("norm") * F.col("query_norm") > 0, F.col("dot") / (F.col("norm") * F.col("query_norm"))).otherwise(0.0)
    scores = saved(by_doc.join(lengths, keys, "left").select(*keys, "pos", cosine.alias("score")))
    unlinked(own)
    unlinked(weights)
    return scores
