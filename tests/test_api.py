import json

from helpers import asked
from pyspark.sql import functions as F

from promptsift.__main__ import main
from promptsift.operators import store
from promptsift.plans import api
from promptsift.streaming import gate

LOG = "\n".join(f"2026-01-01 00:00:{k % 60:02d} worker[{k}] retry" for k in range(900))


def test_specs_go_to_prompt_and_store(spark):
    specs = spark.createDataFrame([("r", k, f"part {k} " * 90, "FATAL" if k == 3 else None) for k in range(8)], "request_id string, pos long, text string, severity string")
    out = api.reduce_specs(specs, asked(spark, "unrelated words"), api.Options(max_tokens=400, keep=2), workspace_key="w", now=5.0)
    row = out.prompts.first()
    assert "part 3" in row.prompt and row.deferred >= 5
    assert store.manifest(out.store, 5.0).count() == out.store.count() > 0 and row.deferred >= out.store.count()
    assert out.metrics.filter("stage = 'assemble'").count() == 1


def test_blank_queries_take_the_lite_funnel(spark):
    found = spark.createDataFrame([("a", LOG, " "), ("b", "\n\n".join(f"block {k}" for k in range(9)), "block 7"), ("c", LOG, None)], "request_id string, text string, query string")
    got = {r.request_id: r for r in api.reduce_texts(found).collect()}
    assert got["a"].prompt == got["c"].prompt and got["a"].prompt.endswith("(x900)") and got["a"].deferred == 0
    assert got["b"].deferred == 4 and "block 7" in got["b"].prompt


def payload(tool, result, **args):
    return json.dumps({"toolName": tool, "toolArgs": args, "toolResult": {"resultType": "success", "textResultForLlm": result}})


def results(spark, rows):
    return spark.createDataFrame(rows, "event_id long, session string, at double, payload string")


def test_tool_results(spark):
    rows = [(1, "s", 1.0, payload("bash", LOG, command="kubectl logs x")), (2, "s", 2.0, payload("bash", "short", command="ls")), (3, "s", 3.0, payload("sql", LOG)), (4, "s", 4.0, payload("view", "y" * 40, path="f.log")), (5, "s", 5.0, "{}"), (6, "s", 6.0, payload("bash", "### in/0\n\nx")), (7, "s", 7.0, payload("view", "y" * 40, path="f.log"))]
    files = spark.createDataFrame([("f.log", LOG), ("g", "tiny")], "path string, text string")
    got = {r.event_id: r for r in api.tool_results(results(spark, rows), files=files).collect()}
    assert {k: (r.verdict, r.reason) for k, r in got.items()} == {1: ("fired", "per-call"), 2: ("under-threshold", ""), 3: ("skipped", "internal-bookkeeping"), 4: ("injection-only", ""), 5: ("passed", ""), 6: ("skipped", "already-funneled"), 7: ("under-threshold", "")}
    assert "tool=bash profile=k8s]\n### in/0" in got[1].replacement and got[1].replacement.endswith("(x900)")
    assert got[2].replacement is None and got[2].answer == "{}"
    assert got[4].file == gate.SHOWN and "(x900)" in got[4].replacement and got[4].replacement.endswith("\n--- requested slice below ---]\n\n" + "y" * 40)
    assert json.loads(got[4].answer)["modifiedResult"]["textResultForLlm"] == got[4].replacement
    assert got[7].file == gate.SHOWN_BEFORE and got[7].replacement is None
    assert {r.verdict for r in api.tool_results(results(spark, rows), disabled=True).collect()} == {"disabled"}


def test_tool_results_that_tie(spark):
    """Calls of one session at the same time, with as many tokens, even under the same id, are events of their own."""
    rows = [(1, "s", 1.0, payload("bash", "a" * 40, command="ls")), (1, "s", 1.0, payload("bash", "b" * 41, command="ls")), (2, "s", 1.0, payload("bash", "c" * 43, command="ls"))]
    got = api.tool_results(results(spark, rows)).collect()
    assert sorted((r.event_id, r.tokens) for r in got) == [(1, 10), (1, 10), (2, 10)] and sorted(r.total for r in got) == [10, 20, 30]


def test_tool_results_count_true_quarters(spark):
    """A result of fewer tokens than 4 characters, and one that shrinks by less than a token."""
    rows = [(1, "s", 1.0, payload("bash", "ab  ", command="ls")), (2, "t", 1.0, payload("bash", "x" * 300 + "  " * 20, command="ls"))]
    got = {r.event_id: r for r in api.tool_results(results(spark, rows), settings=gate.Settings(threshold=0)).collect()}
    assert got[1].total >= 0 and got[2].verdict == "fired" and f" → {len(got[2].replacement.split(chr(10), 1)[1]) // 4} tok" in got[2].replacement


def test_decision_log(spark, tmp_path):
    rows = spark.createDataFrame([("s", 0.0, "bash", 9000, 10)], "session string, at double, tool string, tokens long, cleaned long")
    api.log_decisions(gate.decided(rows), str(tmp_path / "log"), "off")
    assert not (tmp_path / "log").exists()
    api.log_decisions(gate.decided(rows), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).first().verdict == "fired"


def test_model_judge(spark):
    cases = spark.createDataFrame([("a", "ctx", "why")], "case_id string, context string, query string")
    assert api.judged_by(lambda p: f" {len(p)} " if "why" in p else "")(cases).select(F.col("answer")).first().answer.isdigit()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in.log").write_text(LOG.replace("\n", "\r\n") + "\n")
    assert main([str(tmp_path / "in.log"), "--report"]) == 0
    said = capsys.readouterr()
    assert said.out.startswith("### in/0\n\n2026-01-01") and "(x900)" in said.out and "TOTAL" in said.err
    assert main(["--evals", "--suite", "tier1", "--fail-on-regression"]) == 0 and "funneled accuracy: 2/2   regressions: 0" in capsys.readouterr().out
