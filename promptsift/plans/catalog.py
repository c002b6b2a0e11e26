"""The registered queries: each applies one operator of the funnel to whole tables.

Their SQL is in ``catalog_sql``; columns have the same names and types in both.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptsift.functions import hooks, pinning, text, tools, vectors
from promptsift.operators import budget, evals, logs, lossless, ranking, relevance, sentences, store, summarize
from promptsift.operators.numbering import numbered
from promptsift.plans import api, catalog_sql, inputs, profiles
from promptsift.plans.funnel import Funnel, default_funnel, lite_funnel
from promptsift.schema import DEFERRED, is_live
from promptsift.shared import shared_dir
from promptsift.sources import payloads, texts
from promptsift.streaming import deferred, gate

CAP, KEEP, DIGITS = 4000, 5, 6
NOW, TTL = 1_000_000.0, 3600.0
JUDGED = "the session and of retry then"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return inputs.table(spark, d, "documents")


# scalar functions


def token_count(spark, d):
    return docs(spark, d).select("doc_id", text.token_count(F.col("text")).alias("tokens"))


def tokens_by_source(spark, d):
    return docs(spark, d).groupBy("source").agg(F.sum(text.token_count(F.col("text"))).alias("tokens"), F.count(F.lit(1)).alias("chunks"))


def normalize_text(spark, d):
    return inputs.noisy_texts(spark, d).select("doc_id", text.normalized(F.col("text")).alias("text"))


def normalize_idempotent(spark, d):
    once = inputs.noisy_texts(spark, d).select("doc_id", text.normalized(F.col("text")).alias("once"))
    return once.select("doc_id", (text.normalized(F.col("once")) == F.col("once")).alias("same"))


def template_keys(spark, d):
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), text.template_key(F.col("line")).alias("key"))


def template_keys_log(spark, d):
    return inputs.event_lines(spark, d).select("event_id", text.template_key(F.col("line")).alias("key"))


def term_list(spark, d):
    return docs(spark, d).select("doc_id", F.size(text.terms(F.col("text"))).cast("long").alias("n_terms"), F.array_join(F.array_sort(F.array_distinct(text.terms(F.col("text")))), " ").alias("terms"))


def sentence_list(spark, d):
    return docs(spark, d).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("place", "sentence")).select("doc_id", F.col("place").cast("long").alias("place"), "sentence")


def chunk_ids(spark, d):
    return docs(spark, d).select("doc_id", text.chunk_id(F.col("source"), F.col("text")).alias("chunk_id"))


def truncated_heads(spark, d):
    long = docs(spark, d).filter(text.token_count(F.col("text")) > 100)
    return long.select("doc_id", text.head_of(F.col("text"), F.col("source"), F.lit(100)).alias("head"))


def saved_ratio(spark, d):
    tokens = text.token_count(F.col("text"))
    return docs(spark, d).select("doc_id", F.round(text.ratio(tokens, tokens - F.floor(tokens / 3)), DIGITS).alias("ratio"))


def graders(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", text.contains_all(t, ["THE", "and"]).alias("has_all"), text.contains_all(t, ["The"], ignore_case=False).alias("has_cased"), text.matches(t, "th[a-z]+ the").alias("matched"))


# sources


def chunk_blocks(spark, d):
    tail = F.lit('\n\n\n{"a": [1, 2]}\n\n2026-01-01 00:00:00 started\n\n  \n\ndef run():\n  pass\n\n[not json\n\n[12:00:00] tick')
    rows = docs(spark, d).select(F.col("doc_id").cast("string").alias("request_id"), F.concat("text", tail).alias("text"))
    return texts.blocks(rows).select("request_id", "pos", "kind", "source", text.token_count(F.col("text")).alias("tokens"))


def pinned_severity(spark, d):
    return inputs.table(spark, d, "events").select("event_id", pinning.pinned_tier(F.col("props"), F.col("event_type"), F.lit("")).alias("tier"))


def pinned_query(spark, d):
    return docs(spark, d).select("doc_id", pinning.pinned_tier(F.col("text"), F.lit(None).cast("string"), F.lit("the and")).alias("tier"))


def pinned_patterns(spark, d):
    tier = pinning.pinned_tier(F.col("text"), F.lit(None).cast("string"), F.lit(" "), ["tok[e]n", "[unclosed", "### "])
    return docs(spark, d).select("doc_id", tier.alias("tier"))


def payload_fields(spark, d):
    args = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"command": "ls '), F.col("event_id").cast("string"), F.lit('"}'))).otherwise(F.concat(F.lit('"{\\"filename\\": \\"f'), F.col("user_id").cast("string"), F.lit('\\"}"')))
    payload = F.concat(F.lit('{"toolName": "'), F.col("event_type"), F.lit('", "toolArgs": '), args, F.lit(', "toolResult": {"resultType": "success", "textResultForLlm": "r'), F.col("event_id").cast("string"), F.lit('"}}'))
    return payloads.parsed(inputs.table(spark, d, "events").select("event_id", payload.alias("payload"))).select("event_id", "tool", "result_type", "result", "command", "path")


def crash_loop_dedup(spark, d):
    """Crash loops whose lines are of one template: what is left is a line and how often it came."""
    return inputs.crash_logs(spark, d).select("request_id", text.token_count(F.col("text")).alias("tokens"), text.deduplicated_lines(F.col("text")).alias("text"))


def ingested_specs(spark, d):
    """Documents as specs of their sources: pinned by severity, the query's words or a pattern."""
    severity = F.when(F.col("doc_id") % 10 == 0, "crit").when(F.col("doc_id") % 10 == 1, "info")
    specs = docs(spark, d).select(F.col("source").alias("request_id"), F.col("doc_id").alias("pos"), "text", severity.alias("severity"), F.col("lang").alias("source"))
    return texts.ingested(specs, "of the", ["tok[e]n"]).select("request_id", "pos", "tier", "kind", "source")


# lossless stages


def dedup_runs(spark, d):
    """Runs of equal templates in every document, whose lines are rows."""
    found = numbered(logs.runs(inputs.document_lines(spark, d)), ["request_id"], [F.col("first")], "run")
    return found.select(F.col("request_id").cast("long").alias("doc_id"), "run", "line", "n")


def log_runs(spark, d):
    """All events as the lines of one log, in order of time: its runs, by ranges."""
    return logs.runs(inputs.whole_log(spark, d)).select("first", "line", "n")


def log_deduplicated(spark, d):
    """The same log and every document, a log of its own each, as the lines that stay."""
    return logs.deduplicated(inputs.whole_log(spark, d).unionByName(inputs.document_lines(spark, d)))


def file_blocks(spark, d):
    """Blocks of files that hold each source's documents line by line, read in splits."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    inputs.source_files(spark, d, path)
    source = F.regexp_extract("request_id", "name=([^/]*)", 1)
    return texts.read_blocks(spark, path).select(source.alias("name"), "pos", "kind", "source", F.length("text").alias("chars"), F.sha1(F.encode("text", "UTF-8")).alias("digest"))


def dedup_text(spark, d):
    return docs(spark, d).select("doc_id", text.deduplicated_lines(F.col("text")).alias("text"))


def dedup_event_log(spark, d):
    return lossless.dedup(inputs.event_logs(spark, d)).select("request_id", "text")


def prune_props(spark, d):
    events = inputs.table(spark, d, "events").select(F.col("event_id").cast("string").alias("request_id"), F.lit(0).alias("pos"), F.col("props").alias("text"), F.lit("json").alias("kind"))
    return lossless.prune(inputs.as_chunks(events)).select("request_id", "text")


def prune_orders(spark, d):
    return lossless.prune(inputs.order_json(spark, d), {"uid"}).select("request_id", "text")


def prune_profile(spark, d):
    return lossless.prune(inputs.order_json(spark, d), profiles.profile("k8s")).select("request_id", "text")


def prune_by_profile(spark, d):
    """Each row by its own profile; rows without one by azure's."""
    return lossless.prune(inputs.profiled_json(spark, d), profiles.profile("azure"), profiles=profiles.PROFILES).select("request_id", "text")


def pod_states(spark, d):
    """Pods by the profile for them: what tells their state stays, the long fields go."""
    pruned = lossless.prune(inputs.pods(spark, d).withColumn("before", F.length("text")), profiles.profile("k8s"))
    at = lambda path: F.get_json_object("text", path)
    state = "$.status.containerStatuses[0]"
    return pruned.select(
        "request_id", at("$.metadata.name").alias("name"), at(f"{state}.restartCount").cast("long").alias("restarts"), at(f"{state}.state.waiting.reason").alias("reason"),
        F.coalesce(at("$.metadata.uid"), at("$.metadata.annotations"), at("$.metadata.managedFields")).isNull().alias("dropped"), (F.length("text") * 10 < F.col("before")).alias("small"),
    )


# ranking


def term_frequencies(spark, d):
    chunks = inputs.by_source(spark, d)
    return ranking.term_counts(chunks, ["request_id"]).groupBy("request_id", "term").agg(F.count(F.lit(1)).alias("docs"), F.sum("count").alias("n"))


def tfidf_scores(spark, d):
    chunks = inputs.by_source(spark, d)
    scores = ranking.query_scores(chunks, inputs.queries_of(chunks), ["request_id"])
    return scores.select("request_id", "pos", F.round("score", DIGITS).alias("score"))


def relevance_topk(spark, d):
    chunks = inputs.by_source(spark, d)
    out = relevance.relevance(chunks, inputs.queries_of(chunks), KEEP)
    return out.select("request_id", "pos", "tier", F.round("relevance", DIGITS).alias("relevance"))


def relevance_noop(spark, d):
    """Conversations of up to 6 turns stay as they are; longer ones are ranked."""
    chunks = inputs.conversations(spark, d)
    out = relevance.relevance(chunks, inputs.queries_of(chunks, "the and of"), 6)
    return out.select("request_id", "pos", "tier", F.round("relevance", DIGITS).alias("relevance"))


def _vectors(spark, d):
    """Every vector against the first of its label."""
    v = inputs.table(spark, d, "embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("asked"))
    return v.join(first, "label").select(F.col("label").cast("string").alias("request_id"), F.col("vec_id").alias("pos"), vectors.cosine(F.col("embedding"), F.col("asked")).alias("score"))


def embedding_cosine(spark, d):
    return _vectors(spark, d).select("request_id", "pos", F.round("score", DIGITS).alias("score"))


def embedding_topk(spark, d):
    return relevance.ranked(_vectors(spark, d), KEEP).select("request_id", "pos", "kept")


def centrality(spark, d):
    found = docs(spark, d).select("doc_id", sentences.sentence_scores(F.col("text"), F.lit(""))["central"].alias("central"))
    return found.select("doc_id", F.posexplode("central").alias("pos", "score")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.round("score", DIGITS).alias("score"))


def extractive_summary(spark, d):
    chunks = inputs.conversations(spark, d)
    found = summarize.extracted(chunks, inputs.queries_of(chunks, "the and of"))
    return found.select("request_id", "pos", "summary")


def summarize_stage(spark, d):
    chunks = inputs.conversations(spark, d)
    out = summarize.summarize(chunks, inputs.queries_of(chunks, "the and of"))
    return out.select("request_id", "pos", "tier", F.coalesce("summarized", F.lit(False)).alias("summarized"))


def _lengths(many):
    """Stands in for a service: a vector of a text's length and its words, a failure for texts in one word."""
    if any(" " not in t for t in many):
        raise OSError("down")
    return [[float(len(t)), float(len(t.split(" ")))] for t in many]


def embedder_topk(spark, d):
    """Relevance by an injected embedder; a call that fails gives vectors of zero similarity."""
    chunks = inputs.conversations(spark, d)
    embed = hooks.with_fallback(lambda many: _lengths(many), lambda many: [[0.0, 0.0] for _ in many])
    out = relevance.relevance(chunks, inputs.queries_of(chunks, "the and of"), 4, lambda many: [v for t in many for v in embed([t])])
    return out.select("request_id", "pos", "tier", F.round("relevance", DIGITS).alias("relevance"))


def model_summaries(spark, d):
    """Summaries by an injected model, which has none for texts whose last character is a digit or a full stop after an e."""
    chunks = inputs.conversations(spark, d)
    llm = hooks.safe_llm(lambda prompt: "" if prompt.endswith("e.") else prompt[-40:])
    out = summarize.summarize(chunks, inputs.queries_of(chunks, "the and of"), llm=llm)
    return out.select("request_id", "pos", "tier", "text")


def model_prompts(spark, d):
    query = F.concat(F.lit("it's\t"), F.when(F.col("doc_id") % 2 == 0, '"quoted"').otherwise("a\\b"))
    return docs(spark, d).select("doc_id", summarize.prompt_for(query, F.col("text")).alias("prompt"))


# budget and assembly


def budget_fill(spark, d):
    return budget.filled(inputs.by_source(spark, d), CAP).select("request_id", "pos", "verdict", "room", "place")


def budget_fill_all(spark, d):
    """All documents as one request, which many tasks fill."""
    chunks = inputs.by_source(spark, d).withColumn("request_id", F.lit("all"))
    return budget.filled(chunks, CAP, huge=0).select("request_id", "pos", "verdict", "room", "place")


def budget_stage(spark, d):
    out = budget.budget(inputs.by_source(spark, d), CAP)
    return out.select("request_id", "pos", "tier", "seq", "text", F.coalesce("truncated", F.lit(False)).alias("truncated"), "original_tokens", "kept_tokens")


def budget_overflow(spark, d):
    out = budget.budget(inputs.by_source(spark, d), 500)
    return out.groupBy("request_id").agg(F.bool_or(F.coalesce("critical_overflow", F.lit(False))).alias("overflow"))


def assemble_prompts(spark, d):
    return budget.assemble(inputs.conversations(spark, d)).select("request_id", "prompt", "deferred")


def _deferred_ids(chunks):
    """Each request's deferred ids in order, and how many different ones there are."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]), ",")
    return budget.deferred(chunks).groupBy("request_id").agg(ids.alias("deferred_ids"))


def deferred_footer(spark, d):
    chunks = inputs.conversations(spark, d).withColumn("tier", F.when(F.col("pos") % 2 == 1, F.lit(DEFERRED)).otherwise(F.col("tier")))
    entries = budget.manifest(chunks).groupBy("request_id").agg(F.count(F.lit(1)).alias("entries"))
    out = budget.assemble(chunks).join(_deferred_ids(chunks), "request_id", "left").join(entries, "request_id", "left")
    return out.select("request_id", "prompt", F.coalesce("deferred_ids", F.lit("")).alias("deferred_ids"), F.coalesce("entries", F.lit(0)).cast("long").alias("entries"))


def deferred_rows(spark, d):
    chunks = inputs.conversations(spark, d).withColumn("tier", F.when(F.col("pos") % 2 == 1, F.lit(DEFERRED)).otherwise(F.col("tier")))
    return budget.deferred(chunks)


# funnels


def funnel_lite(spark, d):
    chunks = inputs.event_logs(spark, d)
    return lite_funnel(CAP).run(chunks, inputs.queries_of(chunks)).select("request_id", "prompt", "deferred")


def funnel_custom(spark, d):
    """A funnel with a stage of the caller's own between those of the lite one."""
    chunks = inputs.event_logs(spark, d)
    lite = lite_funnel(CAP).stages
    own = Funnel((*lite[:2], ("upper", lambda chunks, queries: chunks.withColumn("text", F.upper("text"))), *lite[2:]))
    return own.run(chunks, inputs.queries_of(chunks)).select("request_id", "prompt", "deferred")


def funnel_sources(spark, d):
    """The whole funnel over the documents of each source."""
    chunks = inputs.by_source(spark, d)
    last = default_funnel(CAP, KEEP).steps(chunks, inputs.queries_of(chunks))[-1]
    out = budget.assemble(last).join(_deferred_ids(last), "request_id", "left")
    return out.select("request_id", "prompt", "deferred", F.coalesce("deferred_ids", F.lit("")).alias("deferred_ids"), "critical_overflow")


def funnel_metrics(spark, d):
    chunks = inputs.event_logs(spark, d)
    out = lite_funnel(CAP).metrics(chunks, inputs.queries_of(chunks))
    return out.select("request_id", "stage_no", "stage", "tokens_in", "tokens_out", "chunks_in", "chunks_out", "saved", F.round("ratio", DIGITS).alias("ratio"))


def live_sizes(spark, d):
    chunks = inputs.by_source(spark, d)
    return chunks.filter(is_live()).groupBy("request_id", "tier").agg(F.sum(text.token_count(F.col("text"))).alias("tokens"), F.count(F.lit(1)).alias("chunks"))


# the store


def _kept(spark, rows):
    """rows as a stored table, and its path."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    store.append(rows, path)
    return store.load(spark, path), path


def _store(spark, d):
    return _kept(spark, _store_rows(spark, d))[0]


def _store_rows(spark, d):
    """Turns as deferred chunks, stored at NOW less 600 seconds for each turn; some are stored twice."""
    chunks = inputs.conversations(spark, d).withColumn("tier", F.lit(DEFERRED))
    first = store.rows_of(chunks, F.lit(NOW) - F.col("pos") * 600, "w")
    again = store.rows_of(chunks.filter("pos % 3 = 0"), F.lit(NOW) - 60, "w")
    return first.unionByName(again)


def store_put(spark, d):
    return store.current(_store(spark, d)).select("request_id", "chunk_id", "kind", "source", "tokens", "stored_at")


def store_alive(spark, d):
    return store.alive(_store(spark, d), NOW, TTL).groupBy("request_id").agg(F.count(F.lit(1)).alias("n"))


def store_retrieve(spark, d):
    held = _store(spark, d)
    ids = held.groupBy("workspace_key", "request_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("ids"))
    wanted = ids.select("workspace_key", "request_id", F.concat(F.array(F.lit("none:0")), F.reverse("ids"), F.slice("ids", 1, 1)).alias("ids"))
    return store.retrieve(held, wanted, NOW, TTL).select("request_id", F.col("place").cast("long").alias("place"), "chunk_id", "text")


def store_manifest(spark, d):
    return store.manifest(_store(spark, d), NOW, TTL).groupBy("request_id").agg(F.count(F.lit(1)).alias("entries"), F.sum("tokens").alias("tokens"))


def store_evict(spark, d):
    return store.evicted(_store(spark, d), NOW, 1800.0)


def store_stream(spark, d):
    """Turns that a stream defers, in the store to which its batches go."""
    top = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    chunks = inputs.conversations(spark, d).withColumn("tier", F.lit(DEFERRED))
    chunks.repartition(3, "request_id").write.parquet(f"{top}/in")
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 2).parquet(f"{top}/in")
    writer = deferred.kept_stream(stream, f"{top}/store", F.lit(NOW) - F.col("pos") * 600, "w")
    writer.option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start().awaitTermination()
    return store.current(store.load(spark, f"{top}/store")).select("request_id", "chunk_id", "kind", "source", "tokens", "stored_at")


def store_after_eviction(spark, d):
    """What readers find of each request after an eviction, whatever time to live they have themselves."""
    _, path = _kept(spark, _store_rows(spark, d))
    store.evict(spark, path, NOW, 1800.0)
    return store.manifest(store.load(spark, path), NOW, 1e9).groupBy("request_id").agg(F.count(F.lit(1)).alias("entries"), F.sum("tokens").alias("tokens"), F.max("place").cast("long").alias("last"))


def store_workspaces(spark, d):
    """Two workspaces with the same requests, of which one was stored too long ago."""
    chunks = inputs.conversations(spark, d).withColumn("tier", F.lit(DEFERRED))
    both = store.rows_of(chunks, F.lit(NOW) - 10, "a").unionByName(store.rows_of(chunks.filter("pos < 2"), F.lit(NOW) - 20, "b")).unionByName(store.rows_of(chunks, F.lit(NOW) - 2 * TTL, "c"))
    return store.manifest(_kept(spark, both)[0], NOW, TTL).select("workspace_key", "request_id", F.col("place").cast("long").alias("place"), "id", "tokens")


# tool calls and sessions


def tool_tokens(spark, d):
    """The estimate that the gate compares with its limits."""
    return docs(spark, d).select("doc_id", F.floor(F.length("text") / 4).cast("long").alias("tokens"))


def gate_thresholds(spark, d):
    calls = inputs.tool_calls(spark, d)
    return calls.select("event_id", tools.threshold(F.col("tool")).cast("long").alias("threshold"), tools.is_view(F.col("tool")).alias("is_view"), tools.is_skipped(F.col("tool"), ["bash "]).alias("skipped"))


def gate_commands(spark, d):
    calls = inputs.tool_calls(spark, d)
    tool, command = F.lit("local.bash"), F.col("command")
    return calls.select("event_id", tools.is_noisy(command).alias("noisy"), tools.profile_of(command).alias("profile"), tools.is_rewritten(tool, command).alias("rewritten"), tools.rewritten(tool, command).alias("command"))


def gate_reduced(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("### a\n"), "text")).otherwise(F.concat(F.substring("text", 1, 150), F.lit("\n[promptsift: 3"), F.col("text")))
    return docs(spark, d).select("doc_id", tools.is_reduced(t).alias("reduced"))


def gate_sessions(spark, d):
    return _sessions(spark, d, 3600.0)


def gate_sessions_days(spark, d):
    return _sessions(spark, d, 3 * 86400.0)


def _sessions(spark, d, ttl):
    out = gate.decided(inputs.tool_calls(spark, d).withColumn("at", F.col("micros") / 1e6), gate.Settings(threshold=3000, cumulative=4000, ttl=ttl))
    return out.select("session", F.round("at", 3).alias("at"), "verdict", "reason", "total", "views", "nudged")


def gate_stream(spark, d):
    """The same as gate_sessions, as a stream of shuffled files and with an event that ends it."""
    top = f"{shared_dir(spark)}/gate-{uuid.uuid4().hex}"
    events = gate.as_events(inputs.tool_calls(spark, d).withColumn("at", F.col("micros") / 1e6))
    end = events.agg((F.coalesce(F.max("at"), F.lit(0.0)) + 1e8).alias("at")).withColumns({"session": F.lit(None).cast("string"), "tool": F.lit("sql"), "tokens": F.lit(0)})
    events.repartition(4, F.xxhash64("event_id")).write.parquet(f"{top}/in")
    # files are read in the order in which they were written
    gate.as_events(end).write.mode("append").parquet(f"{top}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{top}/in")
    decided = gate.decided_stream(stream, gate.Settings(threshold=3000, cumulative=4000), "400 days")
    decided.writeStream.format("parquet").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start(f"{top}/out").awaitTermination()
    out = spark.read.schema(decided.schema).parquet(f"{top}/out").filter("session IS NOT NULL")
    return out.select("session", F.round("at", 3).alias("at"), "verdict", "reason", "total", "views", "nudged")


def gate_views(spark, d):
    """Views of files: each file's summary comes once a session, where it is worth showing."""
    calls = inputs.tool_calls(spark, d)
    path = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")))
    summary = F.when(F.col("event_id") % 3 != 0, F.lit("s"))
    events = calls.select("session", (F.col("micros") / 1e6).alias("at"), "event_id", F.lit("view").alias("tool"), "tokens", "cleaned", path.alias("path"), summary.alias("summary"))
    out = gate.decided(events, gate.Settings(threshold=3000, cumulative=0, nudge_after=3, ttl=1e12))
    return out.select("session", F.col("event_id").cast("long").alias("event_id"), "verdict", "reason", "total", "views", "nudged", "file")


def gate_guards(spark, d):
    """Why results pass unseen."""
    calls = inputs.tool_calls(spark, d)
    result = F.when(F.col("event_id") % 6 == 0, "").when(F.col("event_id") % 6 == 1, "### in/0\n\nx").otherwise("x")
    kind = F.when(F.col("event_id") % 11 == 0, "failure").otherwise("success")
    return calls.select("event_id", tools.guard(F.col("tool"), kind, result, ["mcp:logs", " bash"]).alias("guard"))


def tool_answers(spark, d):
    """Every turn as a tool's result, said five times over: the decisions and what takes the results' place."""
    out = api.tool_results(inputs.tool_results(spark, d), api.Options(max_tokens=100), gate.Settings(threshold=150, cumulative=0, nudge_after=2))
    return out.select("event_id", "session", "verdict", "reason", "total", "nudged", "replacement", F.get_json_object("answer", "$.modifiedResult.textResultForLlm").alias("answered"))


def pre_tool_answers(spark, d):
    """What is said before a tool runs: the command rewritten among its other arguments, or a hint."""
    calls = inputs.tool_calls(spark, d)
    tool = F.when(F.col("event_id") % 9 == 0, "web_fetch").when(F.col("event_id") % 9 == 1, "view").when(F.col("event_id") % 9 == 2, "powershell").otherwise("mcp.acme.bash")
    args = F.concat(F.lit('{"timeout": '), F.col("event_id").cast("string"), F.lit(', "command": "'), F.col("command"), F.lit('", "env": {"A": [1, null, "x"]}}'))
    return calls.select("event_id", tools.allowed(tool, args, "why").alias("answer"))


# evaluation


def _contexts(spark, d):
    return docs(spark, d).select(F.col("doc_id").cast("string").alias("case_id"), F.col("text").alias("context"), F.lit(JUDGED).alias("query"))


def judge_lines(spark, d):
    return evals.best_lines(_contexts(spark, d)).select("case_id", F.col("idx").cast("long").alias("idx"), F.col("score").cast("long").alias("score"), F.col("place").cast("long").alias("place"))


def judge_answers(spark, d):
    return evals.answers(_contexts(spark, d))


def judge_line_answers(spark, d):
    """The same answers of contexts whose lines are rows."""
    contexts = _contexts(spark, d)
    return evals.answers_of_lines(evals.lines_of(contexts), contexts.select("case_id", "query"))


def _evaluated(spark, d):
    """Every document as a case, reduced by the lite funnel to 200 tokens."""
    contexts = _contexts(spark, d)
    prompts = api.reduce_alike(contexts.select(F.col("case_id").alias("request_id"), F.col("context").alias("text")), options=api.Options(max_tokens=200))
    after = prompts.select(F.col("request_id").alias("case_id"), F.col("prompt").alias("context"), F.lit(JUDGED).alias("query"))
    sizes = contexts.select("case_id", text.token_count(F.col("context")).alias("raw_tokens")).join(after.select("case_id", text.token_count(F.col("context")).alias("funneled_tokens")), "case_id", "left")
    return evals.compared(sizes, evals.answers(contexts), evals.answers(after), text.contains_all(F.col("answer"), ["the", "and"]))


def eval_suite(spark, d):
    return evals.suite(_evaluated(spark, d))


def eval_compression(spark, d):
    found = _evaluated(spark, d)
    return found.select("case_id", "raw_tokens", "funneled_tokens", F.round("compression", DIGITS).alias("compression"), F.col("delta").cast("long").alias("delta"))


def queries() -> dict:
    chosen = (
        funnel_sources, token_count, tokens_by_source, normalize_text, normalize_idempotent, template_keys, template_keys_log, term_list,
        sentence_list, chunk_ids, truncated_heads, saved_ratio, graders, chunk_blocks, pinned_severity, pinned_query, pinned_patterns,
        payload_fields, crash_loop_dedup, dedup_runs, dedup_text, dedup_event_log, prune_props, prune_orders, term_frequencies, tfidf_scores,
        relevance_topk, relevance_noop, embedding_cosine, embedding_topk, centrality, extractive_summary, summarize_stage, budget_fill,
        budget_stage, budget_overflow, assemble_prompts, deferred_footer, deferred_rows, funnel_custom, funnel_lite, funnel_metrics, live_sizes, store_put, store_alive,
        store_retrieve, store_manifest, store_evict, gate_thresholds, gate_commands, gate_reduced, gate_sessions, gate_sessions_days,
        gate_views, gate_guards, tool_answers, pre_tool_answers, judge_lines, judge_answers, eval_suite, eval_compression, ingested_specs,
        prune_profile, embedder_topk, model_summaries, model_prompts, tool_tokens, store_workspaces, store_after_eviction, log_runs, log_deduplicated, file_blocks, prune_by_profile, pod_states, budget_fill_all, gate_stream, store_stream, judge_line_answers,
    )
    return {f.__name__: f for f in chosen}


def oracle_sql() -> dict[str, str]:
    return catalog_sql.oracle_sql()
