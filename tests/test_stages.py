import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import asked, chunks
from pyspark.sql import functions as F

from promptsift.functions.text import token_count
from promptsift.operators import budget, lossless, ranking, relevance, sentences, summarize
from promptsift.plans.funnel import default_funnel, lite_funnel, report
from promptsift.plans.profiles import PROFILES, profile
from promptsift.schema import CRITICAL, DEFERRED, RELEVANT, SUMMARIZED
from promptsift.sources import fixtures, texts


def rows(frame, *by):
    return frame.orderBy(*(by or ("request_id", "pos"))).collect()


def test_guards(spark):
    given = chunks(spark, [{"text": "a 1\na 2", "kind": "log"}, {"text": "a 1\na 2"}, {"text": "a 1\na 2", "kind": "log", "tier": DEFERRED}, {"text": '{"uid": 1, "b": [1, 2]}', "kind": "json"}, {"text": "{bad", "kind": "json"}])
    out = [r.text for r in rows(lossless.prune(lossless.dedup(given), {"uid"}, 1))]
    assert out == ["a 1   (x2)", "a 1\na 2", "a 1\na 2", '{\n "b": [\n  1,\n  "<+1 more items omitted>"\n ]\n}', "{bad"]


def by_hand(docs, query):
    def split(t):
        word, out = "", []
        for c in t.lower() + " ":
            if c.isascii() and (c.isalnum() or c == "_"):
                word += c
            elif word:
                out.append(word)
                word = ""
        return out

    bags = [Counter(split(t)) for t in [*docs, query]]
    df = Counter(w for b in bags for w in b)
    vectors = [{w: c * (math.log((len(bags) + 1) / (df[w] + 1)) + 1) for w, c in b.items()} for b in bags]
    norm = [math.sqrt(sum(x * x for x in v.values())) for v in vectors]
    last = vectors[-1]
    return [sum(x * last.get(w, 0) for w, x in v.items()) / (n * norm[-1]) if n * norm[-1] else 0 for v, n in zip(vectors[:-1], norm)]


def test_query_scores_against_lists(spark):
    rng = random.Random(5)
    docs = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(rng.randint(0, 9))) for _ in range(25)]
    for query in ("alpha zeta other", "nothing here", ""):
        got = rows(ranking.query_scores(chunks(spark, [{"text": t} for t in docs]), asked(spark, query), ["request_id"]))
        assert [r.score for r in got] == pytest.approx(by_hand(docs, query))


def test_query_scores_of_odd_rows(spark):
    """Texts that are null, empty or without terms, requests without a query, a query without documents, no documents."""
    docs = chunks(spark, [{"text": "a b a"}, {"text": None}, {"text": ""}, {"text": "?!"}, {"text": "A-b"}, {"text": "a b", "request_id": "mute", "pos": 0}])
    queries = asked(spark, "a").unionByName(asked(spark, "a", "absent"))
    scores = ranking.query_scores(docs, queries, ["request_id"])
    got = {(r.request_id, r.pos): r.score for r in scores.collect()}
    assert got == pytest.approx(dict(zip([("r", k) for k in range(5)], by_hand(["a b a", "", "", "", "a b"], "a"))) | {("mute", 0): 0.0})
    assert ranking.query_scores(docs.limit(0), queries, ["request_id"]).count() == 0


def test_query_scores_are_alike_however_weights_are_joined(spark):
    """A term that all documents of one request have, weights that go to every task, and weights that are shuffled."""
    rng = random.Random(6)
    docs = chunks(spark, [{"text": "hot " + " ".join(f"t{rng.randint(0, 400)}" for _ in range(rng.randint(0, 30))), "request_id": "big" if k % 3 else f"r{k % 7}"} for k in range(300)])
    queries = docs.select("request_id").distinct().withColumn("query", F.lit("hot t1 t2 t3"))
    found, limit = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for size in (limit, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        found.append({(r.request_id, r.pos): r.score for r in ranking.query_scores(docs, queries, ["request_id"]).collect()})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(found[0]) == 300 and found[0] == pytest.approx(found[1])


def all_pairs(docs):
    bags = [Counter(t) for t in docs]
    df = Counter(w for b in bags for w in b)
    vs = [{w: c * (math.log((len(docs) + 1) / (df[w] + 1)) + 1) for w, c in b.items()} for b in bags]

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
        return sum(x * b.get(w, 0) for w, x in a.items()) / n if n else 0

    return [sum(cos(v, w) for j, w in enumerate(vs) if j != i) / max(1, len(docs) - 1) for i, v in enumerate(vs)]


def test_sentence_scores_against_lists(spark, monkeypatch):
    rng = random.Random(6)
    words = "alpha beta gamma delta epsilon zeta".split()
    rows = [([[rng.choice(words) for _ in range(rng.randint(1, 6))] for _ in range(rng.randint(0, 7))], rng.choice([["alpha", "zeta", "zeta", "other"], ["none"], []])) for _ in range(40)]
    rows += [([["a", "b"], [], ["a"]], ["a"])]
    parts, asked = pa.array([r[0] for r in rows], pa.list_(pa.list_(pa.string()))), pa.array([r[1] for r in rows], pa.list_(pa.string()))
    for size in (1, 30, 1 << 21):
        monkeypatch.setattr(sentences, "PART", size)
        near, central = [], []
        for s in sentences._slices(parts):
            found = sentences.scores(parts[s], asked[s])
            near += found[1].tolist()
            central += found[2].tolist()
        assert near == pytest.approx([x for p, q in rows for x in (by_hand([" ".join(t) for t in p], " ".join(q)) if p else [])])
        want = [x for p, _ in rows[:-1] for x in all_pairs(p)]
        assert central[:-3] == pytest.approx(want) and central[-2] == 0


def test_relevance_demotes_exactly(spark):
    given = chunks(spark, [{"text": f"word{k} common"} for k in range(6)] + [{"text": "needle common"}])
    out = rows(relevance.relevance(given, asked(spark, "needle"), 3))
    assert Counter(r.tier for r in out) == {DEFERRED: 4, RELEVANT: 3}
    assert [r.pos for r in out if r.tier == RELEVANT] == [0, 1, 6] and all(r.relevance is not None for r in out)
    same = rows(relevance.relevance(given, asked(spark, "needle"), 7))
    assert all(r.tier == RELEVANT and r.relevance is None for r in same)


def test_relevance_leaves_critical(spark):
    given = chunks(spark, [{"text": "x", "tier": CRITICAL}, *({"text": f"t{k}"} for k in range(4))])
    out = rows(relevance.relevance(given, asked(spark, "t3"), 1))
    assert [r.tier for r in out] == [CRITICAL, DEFERRED, DEFERRED, DEFERRED, RELEVANT]


def test_relevance_with_embedder(spark):
    def embed(many):
        return [[1.0, 0.0] if "needle" in t else [0.0, 1.0] for t in many]

    given = chunks(spark, [{"text": "hay"}, {"text": "hay too"}, {"text": "a needle"}])
    out = rows(relevance.relevance(given, asked(spark, "needle?"), 1, embedder=embed))
    assert [r.tier for r in out] == [DEFERRED, DEFERRED, RELEVANT] and out[2].relevance == pytest.approx(1)


def test_summarize(spark):
    long = " ".join(f"Sentence number {k} talks about nothing much." for k in range(80)) + " The FATAL signal is here."
    given = chunks(spark, [{"text": long}, {"text": "short"}, {"text": "x" * 900}, {"text": long, "kind": "code"}])
    out = rows(summarize.summarize(given, asked(spark, "FATAL signal"), keep_share=0.3))
    assert [r.tier for r in out] == [SUMMARIZED, RELEVANT, SUMMARIZED, RELEVANT]
    assert len(out[0].text) < len(long) and "FATAL signal" in out[0].text and out[2].text == "x" * 900


def test_summarize_with_model_keeps_text_without_answer(spark):
    given = chunks(spark, [{"text": "a" * 600}, {"text": "b" * 600}])
    out = rows(summarize.summarize(given, asked(spark, "q"), llm=lambda p: "short" if p.endswith("a") else ""))
    assert [r.text for r in out] == ["short", "b" * 600] and all(r.tier == SUMMARIZED for r in out)


def test_budget_truncates_and_defers(spark):
    out = rows(budget.budget(chunks(spark, [{"text": "A" * 8000}]), 500), F.coalesce("seq", F.lit(-1)))
    assert len(out) == 2 and out[0].truncated and out[0].original_tokens == 2000 and out[0].kept_tokens == 500
    assert out[1].tier == DEFERRED and out[1].text == "A" * 8000
    whole = rows(budget.budget(chunks(spark, [{"text": "A" * 8000}]), 50))
    assert [r.tier for r in whole] == [DEFERRED]


def test_budget_is_first_fit_by_relevance(spark):
    given = [{"text": "a" * 400, "relevance": 0.1}, {"text": "b" * 800, "relevance": 0.9}, {"text": "c" * 40}, {"text": "d" * 80, "tier": CRITICAL}]
    out = rows(budget.budget(chunks(spark, given), 250), F.coalesce("seq", F.lit(-1)), "pos")
    assert [(r.text[0], r.tier) for r in out] == [("b", RELEVANT), ("c", RELEVANT), ("d", CRITICAL), ("a", DEFERRED)]


def test_budget_drops_equal_copies_and_flags_overflow(spark):
    given = [{"text": "a" * 400, "tier": DEFERRED}, {"text": "a" * 400}, {"text": "c" * 4000, "tier": CRITICAL}]
    out = rows(budget.budget(chunks(spark, given), 50))
    assert [r.tier for r in out] == [DEFERRED, CRITICAL] and out[1].critical_overflow


def test_budget_of_many_deferred_rows(spark):
    """One request with a hundred thousand deferred rows, which nothing gathers."""
    from promptsift.schema import as_chunks

    given = as_chunks(spark.range(100_000).select(F.lit("r").alias("request_id"), F.col("id").alias("pos"), F.concat(F.lit("text "), (F.col("id") % 50_000).cast("string")).alias("text"), F.when(F.col("id") > 0, DEFERRED).otherwise(RELEVANT).alias("tier")))
    row = budget.assemble(given).first()
    assert row.deferred == 99_999 and row.prompt.startswith("### unknown\n\ntext 0\n\n### deferred (99999 chunks)")
    assert budget.deferred(given).agg(F.max("place")).first()[0] == 99_998 and budget.manifest(given).count() == 50_000


def test_assemble(spark):
    given = [{"text": "1", "source": "b"}, {"text": "2", "source": "a"}, {"text": "3", "source": "b"}, {"text": "4", "source": "z", "tier": DEFERRED}, {"text": "4", "source": "z", "tier": DEFERRED}]
    row = budget.assemble(chunks(spark, given)).first()
    assert row.prompt == "### b\n\n1\n\n3\n\n### a\n\n2\n\n### deferred (2 chunks)\nSources omitted: z.\nRetrievable on request by id."
    assert row.deferred == 2 and not row.critical_overflow
    assert [(r.place, r.source) for r in budget.deferred(chunks(spark, given)).orderBy("place").collect()] == [(0, "z"), (1, "z")]
    assert [(r.place, r.tokens) for r in budget.manifest(chunks(spark, given)).collect()] == [(0, 1)]


def scenario(spark):
    from pyspark.sql import DataFrame

    log = fixtures.as_text(fixtures.crash_loop(spark), "r", "\n").select(F.lit("r").alias("request_id"), F.lit(2).cast("long").alias("pos"), "text", F.lit("log").alias("kind"), F.lit("logs/payments").alias("source"))
    others = chunks(spark, [{"text": "FATAL: DNS lookup timeout - payments", "tier": CRITICAL, "source": "alerts"}, {"text": '{"uid": "u", "reason": "CrashLoopBackOff"}', "kind": "json", "source": "pod"}])
    prose = chunks(spark, [{"pos": 3 + k, "text": f"Runbook part {k}. " * 60, "source": f"docs:{k}"} for k in range(3)])
    from promptsift.schema import as_chunks

    return DataFrame.unionByName(as_chunks(log), others.unionByName(prose))


def test_whole_funnel(spark):
    given, query = scenario(spark), asked(spark, "why is the payments pod crashlooping")
    funnel = default_funnel(800, 4, denied=profile("k8s"))
    metrics = rows(funnel.metrics(given, query), "stage_no")
    assert [m.stage for m in metrics] == ["normalize", "dedup", "prune", "relevance", "summarize", "budget", "assemble"]
    assert all(a.tokens_out == b.tokens_in and a.chunks_out == b.chunks_in for a, b in zip(metrics, metrics[1:]))
    assert 1 - metrics[-1].tokens_out / metrics[0].tokens_in >= 0.99
    row = funnel.run(given, query).first()
    assert "DNS lookup timeout" in row.prompt and "uid" not in row.prompt
    table = report(funnel.metrics(given, query)).split("\n")
    assert table[0].split() == ["stage", "tok_in", "tok_out", "saved", "ratio", "ch_in", "ch_out"] and table[-1].startswith("TOTAL")


def test_lite_funnel_on_a_log(spark):
    log = texts.blocks(fixtures.as_text(fixtures.crash_loop(spark), "f", "\n"))
    row = lite_funnel().run(log, asked(spark, "", "f")).first()
    assert row.prompt.startswith("### in/0\n\n2026-01-15T12:00:00Z payments[1000]") and "(x4000)" in row.prompt and len(row.prompt) // 4 == 36


def test_pinned_chunks_stay(spark):
    specs = spark.createDataFrame([("r", k, f"line {k} " * 40, s) for k, s in enumerate(["FATAL", "ERROR", "INFO", "INFO"])], "request_id string, pos long, text string, severity string")
    given = texts.ingested(specs, "nothing of this")
    row = default_funnel(50, 1).run(given, asked(spark, "nothing of this")).first()
    assert "line 0" in row.prompt and "line 1" in row.prompt and row.critical_overflow


def test_empty_request_set(spark):
    assert default_funnel().run(chunks(spark, []), asked(spark, "q")).count() == 0


def test_profiles():
    assert profile("none such") == frozenset() and {k: len(v) for k, v in PROFILES.items()} == {"passthrough": 0, "k8s": 11, "postgres": 12, "azure": 6}


def test_live_tokens_stay_under_the_cap(spark):
    rng = random.Random(8)
    given = chunks(spark, [{"request_id": str(k % 5), "text": "w" * rng.randint(1, 3000), "relevance": rng.random()} for k in range(60)])
    out = budget.budget(given, 700).filter(f"tier < {DEFERRED} and truncated is null").groupBy("request_id").agg(F.sum(token_count(F.col("text"))).alias("n"))
    assert all(r.n <= 700 for r in out.collect())


def test_terms_are_counted_some_texts_at_a_time(monkeypatch):
    lists = pa.array([["a", "b", "a"], [], None, ["b"] * 9, ["c"], ["a", "c"]])
    want = [[("a", 2), ("b", 1)], [], [], [("b", 9)], [("c", 1)], [("a", 1), ("c", 1)]]
    for piece, n in ((100, 1), (4, 3)):
        monkeypatch.setattr(ranking, "PIECE", piece)
        parts = list(ranking._count(iter([lists, lists[:0]])))
        assert len(parts) == n
        assert [sorted((t["term"], t["count"]) for t in x) for x in pa.chunked_array(parts).to_pylist()] == want


def test_counting_holds_little_beside_a_batch():
    lists = pa.ListArray.from_arrays(np.arange(0, 1_000_001, 500, dtype=np.int32), np.random.default_rng(4).integers(0, 1 << 40, 1_000_000))
    tracemalloc.start()
    try:
        n = sum(len(found) for found in ranking._count(iter([lists])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 2000 and most < 2 * lists.nbytes
