"""Scores of a text's sentences, computed inside its row: nothing is shuffled.

Weights are TF-IDF with the text's sentences as documents. ``near`` is a sentence's cosine
with the query, which counts as one more document; ``central`` its mean cosine with the other
sentences, by unit vectors and their sum rather than all pairs. Sentences and terms come from
the JVM's expressions; numpy scores the rows of an Arrow batch together, about ``PART`` terms
at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from promptsift.functions.text import sentences, terms
from promptsift.operators.relevance import DIGITS

PART = 1 << 21
SCORES = "near array<double>, central array<double>"


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy()


def _weights(n: np.ndarray, having: np.ndarray) -> np.ndarray:
    return np.log((n + 1) / (having + 1)) + 1


def scores(parts: pa.Array, asked: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows' sentences as lists of terms, and their queries' terms: sentences of each row; near and central of all."""
    per_row = _lengths(parts)
    inner = parts.flatten()
    per_sentence = _lengths(inner)
    n_sentences = len(per_sentence)
    words = pa.chunked_array([inner.flatten(), asked.flatten()]).combine_chunks().dictionary_encode()
    codes = words.indices.to_numpy().astype(np.int64)
    size = len(words.dictionary) + 1
    of_query = codes[int(per_sentence.sum()) :]
    row_of = np.repeat(np.arange(len(per_row)), per_row)
    sentence_of = np.repeat(np.arange(n_sentences), per_sentence)
    # a sentence's terms and their counts, then a row's terms and the sentences that have them
    pairs, count = np.unique(sentence_of * size + codes[: len(sentence_of)], return_counts=True)
    sentence, row = pairs // size, row_of[pairs // size]
    row_terms, at, having = np.unique(row * size + pairs % size, return_inverse=True, return_counts=True)
    n = per_row.astype(np.float64)
    # central
    w = count * _weights(n[row], having[at])
    norm = np.sqrt(np.bincount(sentence, w * w, n_sentences))
    unit = w / norm[sentence]
    total = np.bincount(at, unit, len(row_terms))
    dot = np.bincount(sentence, unit * total[at], n_sentences)
    others = n[row_of] - 1
    central = np.where((others > 0) & (norm > 0), (dot - 1) / np.maximum(others, 1), 0.0)
    # near
    keys, times = np.unique(np.repeat(np.arange(len(per_row)), _lengths(asked)) * size + of_query, return_counts=True)
    place = np.searchsorted(row_terms, keys)
    known = place < len(row_terms)
    known[known] = row_terms[place[known]] == keys[known]
    in_query = np.zeros(len(row_terms))
    in_query[place[known]] = times[known]
    row_having = np.zeros(len(keys))
    row_having[known] = having[place[known]]
    asked_weight = times * _weights(n[keys // size] + 1, row_having + 1)
    query_norm = np.sqrt(np.bincount(keys // size, asked_weight * asked_weight, len(per_row)))
    idf = _weights(n[row] + 1, having[at] + (in_query[at] > 0))
    w = count * idf
    norm = np.sqrt(np.bincount(sentence, w * w, n_sentences))
    dot = np.bincount(sentence, w * in_query[at] * idf, n_sentences)
    both = norm * query_norm[row_of]
    near = np.divide(dot, both, out=np.zeros(n_sentences), where=both > 0)
    return per_row, near, central


def _slices(parts: pa.Array) -> Iterator[slice]:
    """Rows of about PART terms together."""
    per_row = _lengths(parts)
    each = _lengths(parts.flatten())
    ends = np.concatenate(([0], np.cumsum(each)))[np.cumsum(per_row)]
    at = 0
    while at < len(per_row):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PART, "right")))
        yield slice(at, to)
        at = to


def _score_batches(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for parts, asked in batches:
        found = [scores(parts[s], asked[s]) for s in _slices(parts)]
        starts = pa.array(np.concatenate(([0], np.cumsum(_lengths(parts)))), pa.int32())
        columns = [pa.ListArray.from_arrays(starts, pa.array(np.concatenate([f[k] for f in found]) if found else [], pa.float64())) for k in (1, 2)]
        yield pa.StructArray.from_arrays(columns, names=["near", "central"])


def summaries(share: float):
    """A function of batches of (sentences, their terms, the query's terms): the texts of the best sentences, null for under two."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, parts, asked in batches:
            out: list[str | None] = []
            for s in _slices(parts):
                per_row, near, central = scores(parts[s], asked[s])
                value = np.round(0.5 * near + 0.5 * central, DIGITS)
                for end, n, said in zip(np.cumsum(per_row).tolist(), per_row.tolist(), texts[s].to_pylist()):
                    if n < 2:
                        out.append(None)
                        continue
                    keep = max(1, round(n * share))
                    best = np.sort(np.argsort(-value[end - n : end], kind="stable")[:keep])
                    out.append(" ".join([said[k] for k in best.tolist()]))
            yield pa.array(out, pa.string())

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return arrow_udf(run, "string").asNondeterministic()


def _terms_of(said: Column) -> Column:
    return F.transform(said, terms)


_score_batches.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}


def sentence_scores(text: Column, query: Column) -> Column:
    """near and central of the text's sentences, in order.

    It isn't deterministic to the optimizer, which therefore never runs it twice for a row.
    """
    return arrow_udf(_score_batches, SCORES).asNondeterministic()(_terms_of(sentences(text)), terms(query))


def summary(text: Column, query: Column, share: float) -> Column:
    """The share of the text's sentences with the best mean of both scores, in their order; null for a text of one."""
    said = sentences(text)
    return summaries(share)(said, _terms_of(said), terms(query))
