import json
import random

from helpers import chunks
from pyspark.sql import functions as F

from promptsift.functions import hooks, tools
from promptsift.functions.text import contains_all
from promptsift.operators import evals, store
from promptsift.plans import api, suites
from promptsift.plans.funnel import lite_funnel
from promptsift.schema import DEFERRED
from promptsift.sources import fixtures, payloads, texts
from promptsift.streaming import gate


def held(spark, now, workspace=""):
    return store.rows_of(chunks(spark, [{"text": t, "tier": DEFERRED} for t in ("a", "b", "a")]), now, workspace)


def test_store_round_trip(spark, tmp_path):
    table = store.put(None, chunks(spark, [{"text": "a", "tier": DEFERRED}, {"text": "b", "tier": DEFERRED}, {"text": "live"}]), 100.0, "w")
    store.append(table, str(tmp_path / "s"))
    table = store.load(spark, str(tmp_path / "s"))
    ids = {r.text: r.chunk_id for r in table.collect()}
    wanted = spark.createDataFrame([("w", "r", [ids["b"], "none", ids["a"], ids["b"]]), ("other", "r", [ids["a"]])], "workspace_key string, request_id string, ids array<string>")
    got = store.retrieve(table, wanted, 100.0).orderBy("place").collect()
    assert [(r.place, r.text) for r in got] == [(0, "b"), (2, "a"), (3, "b")]


def test_store_expires(spark):
    table = held(spark, 1000.0)
    assert store.manifest(table, 1060.0, 60.0).count() == 2 and store.manifest(table, 1060.1, 60.0).count() == 0
    assert store.evicted(table, 1100.0, 60.0).first().removed == 2
    again = store.put(table, chunks(spark, [{"text": "c", "tier": DEFERRED}]), 2000.0, ttl=60.0)
    assert [r.text for r in again.collect()] == ["c"]


def test_store_keeps_workspaces_apart(spark):
    both = held(spark, 1.0, "x").unionByName(held(spark, 1.0, "y"))
    assert store.manifest(both, 1.0).count() == 4


def event(at, tool, tokens, cleaned=1, path=None, summary=None, guard="", shrinks=None):
    return ("s", at, None, tool, tokens, cleaned, shrinks, path, summary, guard)


def verdicts(settings, *events):
    """Verdict, reason and file of each event of one session, and the last state."""
    state, out = gate.Session(), []
    for e in events:
        state, row = gate.step(state, e, settings)
        out.append((row[5], row[6], row[10]))
    return out, state


def test_gate_cumulative_and_state():
    out, state = verdicts(gate.Settings(cumulative=1000), *(event(float(k), "view", 300, 30) for k in range(5)))
    assert [v for v, _, _ in out] == ["under-threshold"] * 3 + ["fired", "fired"] and out[3][1] == "cumulative"
    assert state.views == 5 and state.nudged and state.total == 960


def test_gate_expiry_and_summaries():
    s = gate.Settings(nudge_after=0)
    out, state = verdicts(s, event(0.0, "view", 10, path="f", summary="short"), event(1.0, "view", 10, path="f", summary="short"), event(2.0, "view", 10, path="g"), event(3.0, "view", 10, path="g"))
    assert out == [("injection-only", "", gate.SHOWN), ("under-threshold", "", gate.SHOWN_BEFORE), ("under-threshold", "", gate.NOT_WORTH), ("under-threshold", "", gate.SHOWN_BEFORE)]
    state, row = gate.step(state, event(4000.0, "bash", 10), s)
    assert row[7] == 10 and row[8] == 0
    assert verdicts(gate.Settings(summaries=False), event(0.0, "view", 10, path="f", summary="short"))[0] == [("under-threshold", "", "")]


def test_gate_verdicts():
    s = gate.Settings(skipped=("mine",))
    given = [event(0.0, "x", 9, guard=tools.DISABLED), event(0.0, "x", 9, guard=tools.PASSED), event(0.0, "sql", 9), event(0.0, "todo_x", 9), event(0.0, "mine", 9), event(0.0, "x", 9, guard=tools.REDUCED)]
    out, state = verdicts(s, *given)
    assert [v[:2] for v in out] == [("disabled", ""), ("passed", ""), ("skipped", tools.BOOKKEEPING), ("skipped", tools.BOOKKEEPING), ("skipped", tools.LISTED), ("skipped", tools.REDUCED)] and state == gate.Session()
    assert [v for v, _, _ in verdicts(s, event(0.0, "x", 5000, None), event(0.0, "x", 5000, 5000), event(0.0, "x", 5000, 5000, shrinks=True), event(0.0, "x", 5000, 4999, shrinks=False))[0]] == ["funnel-empty", "funnel-noop", "fired", "funnel-noop"]


def test_guards(spark):
    rows = [("", "success", "x"), ("bash", "failure", "x"), ("bash", "success", ""), ("sql", "success", "x"), ("todo_list", "success", "x"), ("mine", "success", "x"), ("bash", "success", "### a\n"), ("bash", "success", "x")]
    got = spark.createDataFrame(rows, "t string, k string, r string").select(tools.guard(F.col("t"), F.col("k"), F.col("r"), ["mi ne"]).alias("g")).collect()
    assert [r.g for r in got] == [tools.PASSED] * 3 + [tools.BOOKKEEPING] * 2 + [tools.LISTED, tools.REDUCED, ""]


def test_broken_payloads_are_rows(spark):
    good = json.dumps({"toolName": "bash", "toolArgs": {"command": "ls"}, "toolResult": {"resultType": "success", "textResultForLlm": "x"}})
    rows = [good, "{oops", "", None, "[1]", '"text"', '{"toolName": "view", "toolArgs": "{bad"}', '{"toolName": "view", "toolArgs": ""}', '{"toolName": "view", "toolArgs": null}']
    frame = spark.createDataFrame([(str(k), "s", float(k), r) for k, r in enumerate(rows)], "event_id string, session string, at double, payload string")
    got = {int(r.event_id): (r.verdict, r.answer) for r in api.tool_results(frame).collect()}
    assert {k for k, v in got.items() if v == ("unexpected-error", "{}")} == {1, 2, 3, 4, 5, 6} and got[0][0] == "under-threshold" and got[7][0] == got[8][0] == "passed"


def calls(spark):
    rng = random.Random(1)
    rows = [(f"s{rng.randint(0, 5)}", float((k + 1) * rng.randint(1, 200)), rng.choice(["view", "bash", "sql", "mcp:x"]), rng.randint(1, 3000), rng.choice([None, 5, 5000]), rng.choice([None, "f", "g"]), rng.choice([None, "sum"])) for k in range(300)]
    return spark.createDataFrame(rows, "session string, at double, tool string, tokens long, cleaned long, path string, summary string")


def streamed(spark, folder, name, late="1 hour", files=None):
    stream = spark.readStream.schema(calls(spark).schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    query = gate.decided_stream(stream, late=late).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return query, spark.table(name).collect()


def micro_batches(spark, folder, rows, schema, batches, end=1e9):
    """rows in files that are read one by one, and an event that moves the watermark past all others."""
    for k in range(batches):
        spark.createDataFrame(rows[k::batches], schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    spark.createDataFrame([("the end", end, "sql", 0, None, None, None)], schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def test_shuffled_stream_and_batch_agree(spark, tmp_path):
    given = calls(spark).dropDuplicates(["session", "at", "tool", "tokens"])
    rows = [tuple(r) for r in given.collect()]
    random.Random(4).shuffle(rows)
    micro_batches(spark, tmp_path, rows, given.schema, 4)
    _, got = streamed(spark, tmp_path, "gate", "40 days")
    batch = gate.decided(given)
    assert sorted(map(str, got)) == sorted(map(str, batch.collect())) and {r.file for r in got} > {gate.SHOWN, gate.SHOWN_BEFORE}


def test_waiting_events_are_few_rows(spark, tmp_path, monkeypatch):
    assert [len(json.loads(text)) for (text,) in gate._packed([("s", 1.5, None)] * 2500)] == [1000, 1000, 500] and gate._packed([]) == []
    schema = calls(spark).schema
    rows = [("s", 1.0 + k, "bash", 1, None, None, None) for k in range(400)]
    micro_batches(spark, tmp_path, rows, schema, 2)
    query, got = streamed(spark, tmp_path, "waiting", "1000 seconds")
    assert [r.total for r in sorted(got, key=lambda r: r.at) if r.session == "s"] == list(range(1, 401))
    # the first batch's 200 events, which wait, in place of 200 rows
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 12


def test_stream_drops_old_sessions(spark, tmp_path):
    schema = calls(spark).schema
    for k, (session, at) in enumerate([("a", 1.0), ("b", 10_000.0), ("b", 20_000.0), ("b", 30_000.0)]):
        spark.createDataFrame([(session, at, "bash", 10, 1, None, None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query, got = streamed(spark, tmp_path, "old", "1 second")
    assert [(r.session, r.total) for r in got] == [("a", 10), ("b", 10), ("b", 10)]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 5


def test_stream_touches_one_file_an_event(spark, tmp_path):
    """A session that has seen many files: events neither read nor write the others."""
    schema = calls(spark).schema
    rows = [("s", 1.0 + k, "view", 1, None, f"f{k % 200}", "sum") for k in range(400)]
    micro_batches(spark, tmp_path, rows, schema, 2)
    query, got = streamed(spark, tmp_path, "files", "1000 seconds")
    shown = [r.file for r in sorted(got, key=lambda r: r.at) if r.session == "s"]
    assert shown == [gate.SHOWN] * 200 + [gate.SHOWN_BEFORE] * 200
    files = gate.Files(FakeMap())
    files["a"] = "x"
    assert "a" in files and "b" not in files and files["a"] == "x" and list(files) == ["a"] and len(files) == 1
    files.clear()
    assert not len(files)


class FakeMap:
    def __init__(self):
        self.rows = {}

    def containsKey(self, key):
        return key in self.rows

    def getValue(self, key):
        return self.rows[key]

    def updateValue(self, key, value):
        self.rows[key] = value

    def keys(self):
        return iter(list(self.rows))

    def clear(self):
        self.rows.clear()


def test_gate_texts(spark):
    frame = spark.createDataFrame([("fired", ""), ("fired", "tip"), ("injection-only", "tip"), ("skipped", "")], "v string, i string")
    out = frame.select(gate.notice(F.col("v"), F.lit("bash"), F.lit("k8s"), F.lit(9), F.lit(1), F.lit("clean"), F.lit("orig"), F.col("i")).alias("t")).select("t", gate.answer(F.col("t")).alias("a")).collect()
    head = "[promptsift: 9 → 1 tok | tool=bash profile=k8s]\nclean"
    assert [r.t for r in out] == [head, "tip\n\n" + head, "tip\n\norig", None]
    assert json.loads(out[2].a) == {"modifiedResult": {"resultType": "success", "textResultForLlm": "tip\n\norig"}} and out[3].a == "{}"
    both = spark.range(1).select(gate.injected(F.lit(True), F.lit(4), F.lit(gate.SHOWN), F.lit("p"), F.lit("s")).alias("both"), gate.injected(F.lit(False), F.lit(4), F.lit(gate.NOT_WORTH), F.lit("p"), F.lit(None).cast("string")).alias("none")).first()
    assert both.both.startswith("[promptsift tip: 4 small reads this session. ") and both.both.endswith("]\n\n[promptsift summary of p (file is dedup-able; consider asking for the pattern rather than line-by-line reads):\ns\n--- requested slice below ---]") and both.none == ""


def test_payloads(spark):
    rows = ['{"toolName": "bash", "toolArgs": {"command": "ls"}, "toolResult": {"resultType": "success", "textResultForLlm": "x"}}', '{"toolName": "view", "toolArgs": "{\\"file\\": \\"a.txt\\"}"}', "{}"]
    out = payloads.parsed(spark.createDataFrame([(r,) for r in rows], "payload string")).collect()
    assert [(r.tool, r.command, r.path, r.result) for r in out] == [("bash", "ls", None, "x"), ("view", "", "a.txt", ""), ("", "", None, "")]


def test_judge(spark):
    cases = spark.createDataFrame([("a", "one\ntwo\nneedle here\nfour\nfive\nsix", "where is the needle"), ("b", "\n  first\nsecond", "zzz"), ("c", "x" * 500, "a"), ("d", "", "zzz")], "case_id string, context string, query string")
    got = {r.case_id: r.answer for r in evals.answers(cases).collect()}
    assert got == {"a": "one\ntwo\nneedle here\nfour\nfive", "b": "first", "c": "x" * 400, "d": ""}


def test_failed_judges_are_results(spark):
    def llm(prompt):
        if "broken" in prompt:
            raise OSError("no answer")
        return " yes "

    judge = api.judged_by(llm)
    contexts = lambda *texts: spark.createDataFrame([(f"c{k}", t, "q") for k, t in enumerate(texts) if t is not None], "case_id string, context string, query string")
    sizes = spark.createDataFrame([("c0", 100, 10), ("c1", 100, 10), ("c2", 100, 10), ("c3", 100, None)], "case_id string, raw_tokens long, funneled_tokens long")
    found = evals.compared(sizes, judge(contexts("a", "broken", "a", "a")), judge(contexts("a", "a", "broken", None)), F.col("answer") == "yes")
    got = {r.case_id: (r.funneled_tokens, r.raw_correct, r.funneled_correct, r.error) for r in found.collect()}
    assert got == {"c0": (10, True, True, None), "c1": (100, False, False, "raw judge failed: no answer"), "c2": (10, True, False, "funneled judge failed: no answer"), "c3": (100, True, False, "funnel produced no assembled chunk")}
    assert "(raw judge failed: no answer)" in evals.report(found) and evals.suite(found).first().regressions == 2


def test_suite(spark):
    found = suites.results(spark)
    assert evals.suite(found).first().asDict() == {"cases": 2, "raw_correct": 2, "funneled_correct": 2, "regressions": 0}
    assert all(r.compression > 0.9 for r in found.collect())
    assert suites.judge_from_env({}) is evals.answers and suites.judge_from_env({"RUN_EVALS": "1", "PROMPTSIFT_BACKEND": "fallback"}) is evals.answers


def test_needle_survives(spark):
    given = fixtures.as_text(fixtures.needle_log(spark), "case")
    reduced = lite_funnel(1000).run(texts.blocks(given), spark.createDataFrame([("case", "")], "request_id string, query string"))
    query = F.lit("What FATAL error occurred?").alias("query")
    raw = evals.answers(given.select(F.col("request_id").alias("case_id"), F.col("text").alias("context"), query))
    after = evals.answers(reduced.select(F.col("request_id").alias("case_id"), F.col("prompt").alias("context"), query))
    sizes = spark.createDataFrame([("case", 70_000, 200)], "case_id string, raw_tokens long, funneled_tokens long")
    results = evals.compared(sizes, raw, after, contains_all(F.col("answer"), ["FATAL", "disk quota exceeded"]))
    row = evals.suite(results).first()
    assert (row.cases, row.raw_correct, row.funneled_correct, row.regressions) == (1, 1, 1, 0)
    assert "raw accuracy: 1/1   funneled accuracy: 1/1   regressions: 0" in evals.report(results)


def test_store_evicts(spark, tmp_path):
    path = str(tmp_path / "s")
    store.append(held(spark, 1000.0, "x"), path)
    store.append(held(spark, 5000.0, "y"), path)
    assert store.evict(spark, path, 5000.0, 60.0) == 2
    assert {(r.workspace_key, r.text) for r in store.load(spark, path).collect()} == {("y", "a"), ("y", "b")}
    assert store.evict(spark, path, 5000.0, 60.0) == 0 and store.evict(spark, path, 9000.0, 60.0) == 2
    assert store.load(spark, path).count() == 0


def test_hooks():
    def post(url, payload, headers):
        if "embeddings" in url and "input" in payload:
            return {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}
        if "chat" in url:
            return {"choices": [{"message": {"content": f"t={payload.get('temperature')}"}}]}
        raise OSError("down")

    def down(*args):
        raise OSError("down")

    env = {"AZURE_OPENAI_ENDPOINT": "http://a", "AZURE_OPENAI_API_KEY": "k", "AZURE_OPENAI_LLM_DEPLOYMENT": "m", "AZURE_OPENAI_EMBED_DEPLOYMENT": "e", "PROMPTSIFT_CACHE_STABLE": "Yes"}
    embed, llm = hooks.hooks_from_env(env, post, down)
    assert embed(["a", "b"]) == [[1.0], [2.0]] and llm("x") == "t=0"
    del env["AZURE_OPENAI_EMBED_DEPLOYMENT"]
    assert hooks.hooks_from_env(env, post, down)[0] is None
    # what doesn't answer isn't chosen
    assert hooks.hooks_from_env(env, down, down) == (None, None)
    embed, llm = hooks.hooks_from_env(env, down, lambda url: {})
    assert embed(["a", "b"]) == [[0.0], [0.0]] and llm("x") == ""
    assert hooks.hooks_from_env({"PROMPTSIFT_BACKEND": "fallback"}, post, lambda url: {}) == (None, None)


def test_embedder_calls_are_bounded(spark):
    assert [len(c) for c in hooks.calls(["a"] * 130)] == [64, 64, 2] and [len(c) for c in hooks.calls(["a" * 60_000] * 3 + ["b"])] == [1, 1, 2] and list(hooks.calls([])) == []

    def embed(many):
        if "bad" in many:
            raise OSError
        return [[float(len(many))] for _ in many]

    frame = spark.createDataFrame([(f"t{k}" if k != 70 else "bad",) for k in range(130)], "t string").coalesce(1)
    got = [r.v for r in frame.select(hooks.embedded(hooks.safe_embedder(embed))("t").alias("v")).collect()]
    assert got == [[64.0]] * 64 + [[0.0]] * 64 + [[2.0]] * 2
