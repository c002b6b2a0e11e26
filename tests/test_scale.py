"""Operators on logs, files and requests that are larger than a row or a task."""

import random
import uuid
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from promptsift.operators import budget, evals, logs, numbering, store
from promptsift.schema import ANNOTATIONS, as_chunks
from promptsift.sources import texts
from promptsift.streaming import deferred, gate


def test_numbered_in_any_way(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "a", "a", "b", "c", None]), rnd.randrange(1000), k) for k in range(3000)]
    frame = spark.createDataFrame(rows, "g string, v int, k int").repartition(5)
    want = {}
    for g in {r[0] for r in rows}:
        want |= {k: n for n, (_, k) in enumerate(sorted((v, k) for x, v, k in rows if x == g), 1)}
    for huge in (0, 800, 10_000):
        got = numbering.numbered(frame, ["g"], [F.col("v"), F.col("k")], huge=huge)
        assert got.columns == ["g", "v", "k", "place"] and {r.k: r.place for r in got.collect()} == want
    assert numbering.numbered(frame.filter("false"), ["g"], [F.col("v")]).count() == 0


def runs_by_hand(rows):
    """rows: (log, line_no, line)."""
    key = lambda r: (r[0] is not None, r[0] or "", "".join("#" if c.isdigit() else c for c in r[2] or ""))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    return [(g[0][0], g[0][1], g[0][2], len(g)) for g in (list(x) for _, x in groupby(ordered, key))]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_runs_of_any_dealing(spark, parts):
    rnd = random.Random(parts)
    rows, n = [], 0
    for log in ("one", "two", None, "three"):
        for _ in range(60):
            word, times = rnd.choice("ab"), rnd.choice([1, 1, 2, 300 if log == "one" else 3])
            rows += [(log, n + k, f"{word} {k % 10}") for k in range(times)]
            n += times + rnd.randrange(3)
    rows.append(("none", 0, None))
    given = list(rows)
    rnd.shuffle(given)
    lines = spark.createDataFrame(given, "request_id string, line_no long, line string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in logs.runs(lines).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got, key=str) == sorted(runs_by_hand(rows), key=str)
    assert logs.deduplicated(lines.filter("false")).count() == 0


def test_run_lengths_are_written(spark):
    lines = spark.createDataFrame([("l", k, f"tick {k}") for k in range(5)] + [("l", 5, "end")], "request_id string, line_no long, line string")
    assert sorted((r.first, r.text) for r in logs.deduplicated(lines).collect()) == [(0, "tick 0   (x5)"), (5, "end")]


FILES = {
    "plain": "one\n\ntwo\nlines\n\n\n\nthree\n",
    "leading": "\na\n\nb",
    "leads": "\n\n\na\n\nb\n\n",
    "windows": "a\r\n\r\nb\r\nc\r\n",
    "old": "a\r\rb\rc\r",
    "mixed": "a\r\n\rb\r\n\r\n\r\nc\n\r\nd\r",
    "blank": "\n\n\n",
    "space": " \n\n \t\n\nx\n",
    "json": '{"a": [1,\n 2]}\n\n2026-01-01 00:00:00 x\n\ndef f():\n  pass\n\n[1, 2\n',
    "empty": "",
    "words": "\n\n".join(f"é block {k}\n" + "x" * (k % 90) for k in range(80)),
    "one block": "\n".join(f"line {k}" for k in range(300)),
    "many feeds": "a" + "\n" * 500 + "b" + "\n" * 7,
}


@pytest.mark.parametrize("size", [1 << 27, 250])
def test_files_in_splits(spark, tmp_path, size):
    for name, text in FILES.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    want = texts.blocks(texts.read_texts(spark, str(tmp_path)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0 if size < 1000 else 4 << 20)
    try:
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        got = texts.read_blocks(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    name = lambda r: r.request_id.rsplit("/", 1)[1].replace("%20", " ")
    rows = lambda found: sorted((name(r), r.pos, r.text, r.kind, r.source, r.tier) for r in found)
    assert rows(got) == rows(want.collect()) and (size > 1000 or tasks > 20)


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def stored(spark, path, rows):
    """rows: (request, chunk, text, stored_at, seq)."""
    store.append(spark.createDataFrame([("w", r, c, t, "text", "s", 1, at, n) for r, c, t, at, n in rows], "workspace_key string, request_id string, chunk_id string, text string, kind string, source string, tokens long, stored_at double, seq long"), path)


def test_reads_are_pruned_by_key_and_time(spark, tmp_path):
    path = str(tmp_path / "s")
    stored(spark, path, [(f"r{k:03d}", f"c{j}", f"t{k}.{j}", 1000.0 * k + j, j) for k in range(100) for j in range(4)])
    wanted = spark.createDataFrame([("w", "r097", ["c3", "c0", "none", "c3"])], "workspace_key string, request_id string, ids array<string>")
    found = store.retrieve(store.load(spark, path), wanted, 100_000.0, 10_000.0)
    assert [(r.place, r.text) for r in found.orderBy("place").collect()] == [(0, "t97.3"), (1, "t97.0"), (3, "t97.3")]
    plan = plan_of(found)
    assert "GreaterThanOrEqual(stored_at" in plan and "EqualTo(request_id,r097)" in plan.replace("In(request_id, [r097])", "EqualTo(request_id,r097)") and "hour" in plan.split("PartitionFilters:")[1].split("\n")[0]
    assert "LeftSemi" in plan
    # no sort and no sort-based aggregate sees a text
    for node in plan.split("\n\n"):
        if ") Sort\n" in node or "SortAggregate" in node.split("\n")[0]:
            assert "text#" not in node
    listed = store.manifest(store.load(spark, path), 100_000.0, 10_000.0, wanted)
    assert [r.id for r in listed.orderBy("place").collect()] == ["c0", "c1", "c2", "c3"] and "text#" not in plan_of(listed)


def test_eviction_survives_a_failure_between_any_two_steps(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [(f"r{k}", "c", f"t{k}", 900.0 * k, 1) for k in range(20)] + [("r1", "c", "again", 16_000.0, 1)]
    stored(spark, path, rows)
    live = {"again"} | {f"t{k}" for k in range(20) if 18_000 - 900 * k <= 5_000}
    see = lambda: {r.text for r in store.current(store.load(spark, path)).collect()}
    old = store.load(spark, path)
    # a failure before the mark: nothing has happened; after it: readers see what stays, hours go with the next call
    store.set_mark(spark, path, 18_000.0, 5_000.0)
    assert see() == live
    assert store.evict(spark, path, 18_000.0, 5_000.0) == 0 and see() == live
    stored(spark, path, [("r50", "c", "t50", 18_000.0, 1)])
    hours = {p.name for p in tmp_path.glob("s/workspace_key=w/hour=*")}
    assert hours == {"hour=3", "hour=4", "hour=5"}
    assert {r.text for r in store.alive(old, 18_000.0, 5_000.0).collect()} >= live, "what was read before goes on"
    assert see() == live | {"t50"}
    # an earlier cut never brings anything back
    assert store.evict(spark, path, 18_000.0, 90_000.0) == 0 and see() == live | {"t50"}
    assert store.evict(spark, path, 99_000.0, 10.0) == len(live) + 1 and see() == set() and len(list(tmp_path.glob("s/_evicted*"))) == 1


def test_rows_written_twice_count_once(spark, tmp_path):
    path = str(tmp_path / "s")
    for _ in range(2):
        stored(spark, path, [("r", "c", "t", 5.0, 1), ("r", "d", "u", 5.0, 2)])
    held = store.load(spark, path)
    assert store.current(held).count() == 2 and store.manifest(held, 5.0).count() == 2
    wanted = spark.createDataFrame([("w", "r", ["c", "c"])], "workspace_key string, request_id string, ids array<string>")
    assert store.retrieve(held, wanted, 5.0).count() == 2


def test_large_requests_of_the_store_are_numbered_by_ranges(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    stored(spark, path, [(f"r{k % 2}", f"c{k:03d}", "t", float(k // 50), k) for k in range(300)])
    want = sorted(map(tuple, store.manifest(store.load(spark, path), 5.0).collect()))
    monkeypatch.setattr(numbering, "HUGE", 10)
    numbered = lambda *a, **b: numbering.numbered(*a, **{"huge": 10} | b)
    monkeypatch.setattr(store, "numbered", numbered)
    assert sorted(map(tuple, store.manifest(store.load(spark, path), 5.0).collect())) == want


CHUNK = "request_id string, pos long, text string, kind string, source string, tier int, " + ", ".join(f"{c} {t}" for c, t in ANNOTATIONS.items()) + ", at double"


def test_replayed_batches_leave_one_row_a_key(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [("w", f"r{k % 3}", f"c{k}", f"t{k}", "text", "s", 1, 4000.0 * (k % 2), k) for k in range(12)]
    frame = lambda some: spark.createDataFrame(some, "workspace_key string, request_id string, chunk_id string, text string, kind string, source string, tokens long, stored_at double, seq long")
    deferred.put_batch(frame(rows[:6]), path, "a-0")
    for _ in range(2):
        deferred.put_batch(frame(rows[6:]), path, "a-1")
    assert sorted(r.text for r in store.load(spark, path).collect()) == sorted(r[3] for r in rows)
    assert not [p for p in (tmp_path / "s").iterdir() if p.name.startswith("_")]
    deferred.put_batch(frame(rows[:6]).filter("false"), path, "a-0")
    assert store.load(spark, path).count() == 6


def test_stream_of_deferred_chunks(spark, tmp_path):
    path, none = str(tmp_path / "s"), [None] * len(ANNOTATIONS)
    for n, at in enumerate((100.0, 4000.0, 9000.0)):
        rows = [("r", k, f"t{k + n}", "text", "src", 3, *none, at) for k in range(3)] + [("r", 9, "live", "text", "src", 1, *none, at)]
        spark.createDataFrame(rows, CHUNK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(where, **more):
        writer = deferred.kept_stream(stream(), where, F.col("at"), "w", **more)
        writer.option("checkpointLocation", str(tmp_path / f"cp-{uuid.uuid4().hex}")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.text, r.stored_at) for r in store.current(store.load(spark, where)).collect())

    every = [("t0", 100.0), ("t1", 4000.0), ("t2", 9000.0), ("t3", 9000.0), ("t4", 9000.0)]
    assert run(path) == every
    # another run with the same name, its checkpoint lost, writes the same batches again
    assert run(path) == every and store.load(spark, path).count() == 9
    assert run(str(tmp_path / "expiring"), ttl=5000.0) == [e for e in every if e[1] >= 4000]
    assert not list((tmp_path / "expiring").glob("workspace_key=w/hour=0"))


def test_huge_requests_are_filled_as_small_ones(spark):
    rnd = random.Random(9)
    rows, want = [], []
    for request, sizes, room in (("tiny", (0, 1, 2, 5, 60, 99), 400), ("heads", (300, 500), 1450), ("none", (5,), 0), ("fits", (1, 2), 10**6), ("zeros", (0, 0, 3), 50), ("mixed", (0, 1, 3, 40, 90, 120, 700), 2000), ("late", (700,) * 9 + (1, 2, 7), 1499)):
        own = [(request, k, rnd.choice(sizes), rnd.choice([0.0, 0.5, 1.0]), room) for k in range(400)]
        rows += own
        want += budget.fill((r, p, t, m) for r, p, t, _, m in sorted(own, key=lambda x: (-x[3], x[1])))
    frame = spark.createDataFrame(rows, "request_id string, pos long, tokens long, relevance double, room long").repartition(4)
    assert sorted(map(tuple, budget.filled_by_blocks(frame, 50).collect())) == sorted(want)
    assert {v for _, _, v, _, _ in want} == {budget.KEEP, budget.HEAD, budget.DEFER}
    assert budget.filled_by_blocks(frame.filter("false")).count() == 0
    chunks = as_chunks(spark.createDataFrame([(r, p, "x" * 4 * t) for r, p, t, _, _ in rows], "request_id string, pos long, text string"))
    assert sorted(map(tuple, budget.filled(chunks, 900, huge=10).collect())) == sorted(map(tuple, budget.filled(chunks, 900).collect()))


def test_answers_of_lines_are_those_of_texts(spark):
    rnd = random.Random(3)
    texts = [("\n".join(" ".join(rnd.choice(["alpha", "beta", "gamma", "", "  ", "x"]) for _ in range(rnd.randrange(4))) for _ in range(rnd.randrange(1, 40)))) for _ in range(40)]
    texts += ["y" * 900, "\n\n  first\nsecond", "", "alpha", "a\n" * 600]
    cases = [(str(k), t, q) for k, t in enumerate(texts) for q in [rnd.choice(["alpha gamma", "zzz", "?", "beta x xx"])]]
    frame = spark.createDataFrame(cases, "case_id string, context string, query string")
    got = evals.answers_of_lines(evals.lines_of(frame).repartition(6), frame.select("case_id", "query")).collect()
    # the end of a last line isn't a line of its own
    want = {r.case_id: r.answer for r in evals.answers(frame).collect()}
    assert {r.case_id: r.answer.rstrip("\n") for r in got} == {k: v.rstrip("\n") for k, v in want.items()}


@pytest.fixture
def small_broadcasts(spark):
    """Joins of which adaptive execution broadcasts the small side, and whose other side it reads in a piece for each task that wrote it."""
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "2k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_folds_over_rows_that_a_join_has_dealt(spark, small_broadcasts):
    """Adaptive execution reads the shuffle of a join that turns out small in pieces; a fold's rows must not be parted by that."""
    rows = spark.sparkContext.parallelize([("r", k, "x" * (40 + k % 7 * 4)) for k in range(400)], 4).toDF("request_id string, pos long, text string")
    out = sorted(budget.filled(as_chunks(rows), 2000).collect(), key=lambda r: r.pos)
    want = [tuple(x) for x in budget.fill((("r", k, 10 + k % 7, 2000) for k in range(400)))]
    assert [tuple(r) for r in out] == want


def test_budget_over_rows_that_a_join_has_dealt(spark, small_broadcasts):
    rows = spark.sparkContext.parallelize([("r", k, "x" * (40 + k % 7 * 4)) for k in range(400)], 4).toDF("request_id string, pos long, text string")
    want = [(pos, place) for _, pos, verdict, _, place in budget.fill((("r", k, 10 + k % 7, 2000) for k in range(400))) if verdict != budget.KEEP]
    added = budget.budget(as_chunks(rows), 2000).filter("tier = 3").orderBy("pos").collect()
    assert [(r.pos, r.seq) for r in added] == want


def test_gate_over_events_that_a_join_has_dealt(spark, small_broadcasts):
    calls = spark.sparkContext.parallelize([("s", float(k), str(k), "bash", 10) for k in range(400)], 4).toDF("session string, at double, event_id string, tool string, tokens long")
    known = spark.sparkContext.parallelize([("s", 1)], 2).toDF("session string, n int")
    out = gate.decided(calls.join(known, "session"), gate.Settings(cumulative=0, ttl=1e9)).orderBy("at").collect()
    assert [r.total for r in out] == [10 * (k + 1) for k in range(400)]
