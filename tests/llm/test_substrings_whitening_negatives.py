"""op11 to op13 against brute force, and their edge cases."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from promptsift.llm import ball_tree, hard_negatives, registry, substrings, suffix_array, whitening

# suffix arrays and substrings


def test_suffix_arrays_are_sorted_suffixes():
    rnd = random.Random(3)
    for _ in range(120):
        letters = rnd.choice([1, 2, 3, 26])
        lanes = [bytes(97 + rnd.randrange(letters) for _ in range(rnd.randrange(60))) for _ in range(rnd.randrange(12))]
        lanes += [b"banana" * 8, b"a" * 50, b"\xff\x00\xff" * 5, b""]
        lanes.sort(key=len, reverse=True)
        _, bounds, found = suffix_array.suffix_arrays([np.frombuffer(x, np.uint8) for x in lanes])
        for lane, low, high in zip(lanes, bounds[:-1], bounds[1:]):
            assert (found[low:high] - low).tolist() == sorted(range(len(lane)), key=lambda k: lane[k:])
    assert len(suffix_array.suffix_arrays([])[2]) == 0


def repeated(docs):
    """doc_id, bytes, bytes removed, spans and the kept bytes' digest of documents in their order."""
    seen, out = set(), []
    for doc_id, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def removed(docs):
    found = substrings.deduplicated(docs)
    rows = found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    for r in found.collect():
        assert sum(s.length for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans and len(r.kept) == r.n_bytes - r.n_removed
    return sorted(map(tuple, rows), key=str)


def test_op13(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = registry.queries()["op13_suffix_array"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == repeated(docs) and sum(r[2] for r in rows) > 0


def test_substring_edges(spark):
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdé 漢\n") for _ in range(n))
    own, part = word(300), word(130)
    docs = [(None, own), (1, None), (2, ""), (3, own), (3, own), (4, "x" * 99), (5, "x" * 99), (6, "x" * 100), (7, "x" * 350), (8, "ab" * 200), (9, "y" + own[:90]), (10, part + word(50) + part), (11, "z" + part), (12, own[100:]), (13, own[:101]), (14, "ab" * 200)]
    rows = [(i, t, 0, b"p", "k", 1) for i, t in docs]
    made = spark.createDataFrame(rows, "doc_id long, text string, row int, packed binary, kept string, start int").repartition(1).sortWithinPartitions(F.col("doc_id"))
    assert removed(made) == repeated(docs)
    assert removed(made.filter("false")) == []
    assert removed(made.filter("doc_id = 1")) == [(1, 0, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_very_long_texts(spark):
    """Texts of several slices, the second shifted against the first's slices; a text that repeats in itself."""
    rng = np.random.default_rng(1)
    long = "".join(map(chr, rng.integers(97, 123, substrings._CHUNK + 40_000)))
    docs = [(1, long), (2, "head " + long[:-7] + " tail"), (3, long[5_000:9_000] * 3)]
    got = removed(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got == repeated(docs)


@pytest.mark.parametrize("n", [40, 1500])
def test_common_passages(spark, n):
    """A passage in most documents, amid different texts: its keys are common, or crowded with contents."""
    rnd = random.Random(n)
    word = lambda k: "".join(rnd.choice("abcdefghij ") for _ in range(k))
    passage = word(260)
    docs = [(k, word(rnd.randrange(150)) + (passage if k % 3 else passage[40:170]) + word(rnd.randrange(150))) for k in range(n)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert removed(frame) == repeated(docs)


def test_hot_keys_are_found_and_sliced():
    rnd = random.Random(7)
    word = lambda k: "".join(rnd.choice("abcdefghij ") for _ in range(k)).encode()
    passage = word(60)
    texts = [(word(200) + passage + word(200), k, k, 0) for k in range(300)]
    keys, counts = substrings._Cut.of_texts([t[0] for t in texts]).common()
    assert len(keys) and counts.max() > 100
    for hot in ([], keys):
        columns = dict(zip(substrings._PIECE.names, substrings._pieces_of(texts, np.array(hot, np.int64).view(np.uint64))))
        n, mid = columns["at"] & 255, columns["at"] >> 8 & 255
        assert n.sum() == sum(len(t[0]) - 99 for t in texts)
        assert ((n <= substrings.SLICE) == (mid == substrings._SLICED))[mid == substrings._SLICED].all() and (mid == substrings._SLICED).any() == bool(len(hot))


def test_repeated_pieces_of_any_batches():
    """Pieces found again are the same, however the sorted rows fall into batches; crowded keys are marked."""
    rnd = random.Random(2)
    rows = sorted((rnd.choice([1, 2, 3, 9, 9, 9]) if k % 3 else k + 10, rnd.randrange(600), 0, k, k << 16 | 5 << 8 | 3) for k in range(2500))

    def run(size):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a : a + size])], schema=substrings._PIECE) for a in range(0, len(rows), size)]
        return sorted(((r["row"], r["key"], r["crowded"]) for b in substrings._repeated(iter(batches)) for r in b.to_pylist()), key=str)

    first, several = {}, {}
    for key, content, _, row, _ in rows:
        first.setdefault((key, content), row)
        several.setdefault(key, set()).add(content)
    want = [(row, None, False) if first[key, content] != row else (row, key, len(several[key]) > substrings.CROWD) for key, content, _, row, _ in rows if first[key, content] != row or len(several[key]) > 1]
    assert {len(s) > substrings.CROWD for s in several.values()} == {True, False}
    for size in (1, 7, 400, 5000):
        assert run(size) == sorted(want, key=str)


# whitening


def whitened_by_hand(rows):
    rows = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(r, sums)] for r in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return rows, deviation, centred @ vectors[:, :8] / np.sqrt(values[:8]), values[:8] / values.sum()


def test_op11(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = {(r.vec_id, r.component): r for r in registry.queries()["op11_whitening"](spark, sf_dir).collect()}
    rows, deviation, white, explained = whitened_by_hand([(r.vec_id, r.embedding) for r in table.collect()])
    assert len(got) == 8 * len(rows)
    for k in range(8):
        own = np.array([got[i, k + 1].whitened for i, _ in rows])
        assert min(abs(own - white[:, k]).max(), abs(own + white[:, k]).max()) < 1e-9
    for (i, _), d in zip(rows, deviation):
        assert got[i, 1].deviation == d and got[i, 1].n == len(rows)
    assert all(abs(got[rows[0][0], k + 1].explained / explained[k] - 1) < 1e-9 for k in range(8))
    assert {r.identity_error for r in got.values()} == {got[rows[0][0], 1].identity_error} and got[rows[0][0], 1].identity_error < 1e-9


def test_scatter_is_exact():
    rng = np.random.default_rng(0)
    for high in (3, 1 << 19, 1 << 20, 1 << 41, 1 << 62):
        y = rng.integers(-high, high, (9000, 3))
        sums, products = whitening.scatter(y)
        z = y.astype(object)
        assert sums == z.sum(0).tolist() and products == z.T.dot(z).tolist()
    for value in (0, 5, -5, 1 << 30, -(1 << 30), 123 << 90, -(123 << 90)):
        limbs = whitening._limbs(value)
        assert sum(x << (30 * k) for k, x in enumerate(limbs)) == value and all(abs(x) < 1 << 30 for x in limbs)


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.5]), (2, [-4.0, 0.25, 0.5]), (None, [5.0, 4.0, 0.0]), (3, None), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [1.0]), (7, []), (1, [1.0, 2.0, 3.5]), (9, [0.0, 0.0, inf]), (10, [0.0, -inf, 1.0]), (11, [0.5, 7.0, -2.0])]
    frame = spark.createDataFrame([(*r, 0, 1.0, "c") for r in rows], "vec_id long, embedding array<double>, n int, whitened double, component string")
    got = whitening.whitened(frame).collect()
    kept, deviation, white, _ = whitened_by_hand([r for r in rows if r[0] != 6 and r[1] != []])
    assert len(got) == 3 * len(kept) and {r.n for r in got} == {len(kept)}
    assert sorted(int(r.deviation) for r in got if r.component == 2) == sorted(deviation)
    assert np.allclose(sorted(abs(r.whitened) for r in got if r.component == 1), sorted(abs(white[:, 0])))
    assert whitening.whitened(frame.filter("false")).collect() == [] == whitening.whitened(frame.filter("vec_id = 1")).collect() == whitening.whitened(frame.filter("vec_id IN (3, 7)")).collect()
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whitened(huge).collect()} == {1}  # the second's share is rounding beside it
    flat = spark.createDataFrame([(k, [float(k), 2.0, 3.0]) for k in range(5)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whitened(flat).collect()} == {1}


# hard negatives


def mined_by_hand(rows):
    """Rows of anchors as the query has them, by all pairs; rows: (id, vector, label, is_anchor)."""
    good = [(k, i, [math.floor(256 * c) for c in v], label, anchor) for k, (i, v, label, anchor) in enumerate(rows) if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for k, i, v, label, anchor in good:
        if not anchor:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for m, j, w, other, _ in good if m != k)
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            close = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(i, j, rank, c[1], -p, -c[0]) for rank, c in enumerate(close, 1)]
    return sorted(out)


def test_op12(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.vec_id % 50 == 0) for r in table]
    got = registry.queries()["op12_hard_negatives"](spark, sf_dir)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == mined_by_hand(rows) != []


def test_negatives_edges(spark):
    rng = np.random.default_rng(2)
    nan = float("nan")
    made = [(k, (rng.normal(size=3) + [1, 0, 0]).tolist(), int(rng.integers(3)), k % 10 == 0) for k in range(150)]
    made += [(k % 7, [1.0, 0.5, 0.0], 1, False) for k in range(200)]  # many equal vectors, ids that repeat
    made += [(400, [1.0, 0.5, 0.0], 1, True)] * 2 + [(401, None, 1, True), (402, [1.0, None], 1, True), (403, [nan, 1.0, 1.0], 1, True), (404, [1.0, 1.0, 1.0], None, True), (None, [1.0, 1.0, 1.0], 1, True)]
    made += [(405, [0.75], 2, True), (406, [], 2, True), (407, [9.0, 9.0, 9.0], 77, True), (408, [-1.0, -1.0, 0.0], 0, True)]
    frame = spark.createDataFrame([(*r, 0, 0.0) for r in made], "vec_id long, embedding array<double>, label int, anchor boolean, row int, score double")
    run = lambda f: sorted(map(tuple, hard_negatives.mined(f, F.col("anchor"), F.col("label")).collect()))
    assert run(frame) == mined_by_hand(made)
    assert run(frame.filter("false")) == [] == run(frame.filter("NOT anchor"))
    huge = spark.createDataFrame([(k, [s * 1e30, 1.0], k % 2, True) for k, s in enumerate([1, 1, 1, -1])], "vec_id long, embedding array<double>, label int, anchor boolean")
    assert run(huge) == []


@pytest.mark.parametrize("same", [True, False])
def test_trees_find_what_all_pairs_find(same):
    rng = np.random.default_rng(int(same))
    for n in (0, 1, 63, 64, 65, 700):
        vectors = rng.integers(-40, 40, (n, 6)) + rng.integers(-3, 3, (n, 1)) * 30
        vectors[: n // 3] = vectors[:1]
        ids, labels = rng.permutation(n) // 2, rng.integers(0, 4, n)
        tree = ball_tree.grown(np.arange(n), ids, labels, vectors)
        q = rng.integers(-60, 60, (50, 6))
        low = rng.integers(-6000, 4000, 50)
        high, wanted, own = low + rng.integers(0, 9000, 50), rng.integers(0, 5, 50), rng.integers(0, max(1, n), 50)
        best = ball_tree.searched(tree, ball_tree.Wanted(q, wanted, same, low, high, own, 4))
        for k in range(50):
            scores = vectors @ q[k]
            good = [(-int(s), int(i)) for r, (s, i, label) in enumerate(zip(scores, ids, labels)) if (label == wanted[k]) == same and low[k] <= s <= high[k] and r != own[k]]
            found = [(-int(s), int(i)) for s, i in zip(best.scores[k], best.ids[k]) if i != ball_tree.NO_ID]
            assert found == sorted(good)[:4]


def test_trees_prune():
    """Clusters far apart: most leaves are never scored."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(64, 8)) * 400
    vectors = np.rint(centres[rng.integers(0, 64, 8192)] + rng.normal(size=(8192, 8)) * 5).astype(np.int64)
    tree = ball_tree.grown(np.arange(8192), np.arange(8192), np.zeros(8192, np.int64), vectors)
    q = vectors[:40]
    far = np.full(40, 1 << 60)
    best = ball_tree.searched(tree, ball_tree.Wanted(q, np.zeros(40, np.int64), True, -far, far, np.arange(40), 5))
    assert best.visited < 0.25 * 40 * 8192
    assert (best.scores[:, 0] == np.where(np.arange(8192)[None, :] == np.arange(40)[:, None], -(1 << 60), q @ vectors.T).max(1)).all()
