"""The pipeline against a brute-force version."""

import re

from helpers import TABLES  # noqa: F401  the tests' folder is on the path

import numpy as np
import pytest
from test_corpus import EDGES, LONG, fingerprint

import corpus_pipeline
from llm_brute import all_spans, brute_pieces, coverage, is_kept, redacted
from promptsift.llm import quality, secret_scan


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        docs = out


def test_run(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_pieces(docs)
    got = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got.setdefault(r.doc_id, set()).add(r.doc_tokens)
    assert got == {k: {n} for k, n in want.items()}


def test_secrets_are_gone(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.secret_scans(spark, docs, sf_dir)
    before, after = ({r.doc_id: r for r in x.collect()} for x in (docs, out))
    assert before.keys() == after.keys() and not any(re.search("[0-9a-f]{24}", r.text) for r in after.values())
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_quality_against_counts(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [t for _, t in EDGES if t is not LONG]
    texts += ["é à ü ó " * 9 + "a b c d e f g h i j k l m n o p q r s t u v w x y z " + "é à ü ó " * k for k in range(4)]
    for t in texts:
        got = quality.measure(t)
        assert got[6] == is_kept(t) and got[7:] == pytest.approx(coverage(t))


def test_secrets_against_definitions(spark, sf_dir):
    rng = np.random.default_rng(21)
    names = list(secret_scan.ENCODINGS)
    plain = ["internationalization_of_words", "getUserNameFromDatabase", "docs/2024/01/15/some-article-title", "THIS_IS_A_LONG_CONSTANT", "550e8400-e29b-41d4-a716-446655440000", "a" * 30, "12345678901234567890"]
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for _ in range(300):
        tokens = [rng.choice(plain) if rng.random() < 0.6 else "".join(rng.choice(list(secret_scan.ENCODINGS[rng.choice(names)][0]), rng.integers(18, 60))) + "=" * int(rng.integers(0, 3)) for _ in range(rng.integers(0, 12))]
        texts.append(" é ".join(["password: ", *tokens, "token=abcdefgh"]))
    found = 0
    for t in texts:
        want = all_spans(t)
        assert secret_scan.scan(t)[4] == ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert secret_scan.redact(t) == redacted(t)
        found += sum(k == "random" for _, _, k in want)
    assert found > 300


ODD_ROWS = [(k, t, "en", "s", 1, "x", "y", "z") for k, t in EDGES] + [(20 + k, " ".join(f"word{(k // 2) * 50 + j} said" for j in range(40)), None, None, None, None, None, None) for k in range(6)]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, `none` string, quality string"


def test_edges_go_through(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns, through all stages."""
    frame = spark.createDataFrame(ODD_ROWS + ODD_ROWS[-2:], ODD_SCHEMA)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    docs = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.schema == docs.schema
        docs = out
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == set(brute_pieces([(k, t) for k, t, *_ in ODD_ROWS if k is not None])) == {20, 22, 24}
    assert docs.count() == 3


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], ODD_SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_crowded_near_copies(spark):
    """Over a thousand edited copies of one text: the groups are those of all pairs."""
    rng = np.random.default_rng(31)
    base = [f"w{k}" for k in range(200)]
    texts = {}
    for k in range(1100):
        words = list(base)
        for j in rng.choice(200, rng.integers(1, 8), replace=False):
            words[j] = f"x{rng.integers(0, 1 << 30)}"
        texts[k] = " ".join(words)
    sets = [frozenset(hash(tuple(w[j : j + 5])) for j in range(196)) for w in (t.split() for t in texts.values())]
    every = {x: n for n, x in enumerate(set().union(*sets))}
    rows = np.zeros((len(sets), len(every)), np.float32)
    for k, s in enumerate(sets):
        rows[k, [every[x] for x in s]] = 1
    both = rows @ rows.T
    size = rows.sum(1)
    near = both / (size[:, None] + size[None, :] - both) >= 0.8
    prints = np.array([fingerprint(t) for t in texts.values()], np.uint64)
    near |= np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2
    label = np.arange(len(sets))
    while True:
        new = np.array([label[near[k]].min() for k in range(len(sets))])
        if (new == label).all():
            break
        label = new
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string").repartition(4)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == set(label.tolist()) and 1 < len(got) < 1000
