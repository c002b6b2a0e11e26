"""What the registered queries reduce: chunks, logs, JSON and tool calls made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptsift.functions.pinning import CRITICAL, RELEVANT
from promptsift.schema import as_chunks
from promptsift.sources.fixtures import crash_line, pod_text

#: The question that the document requests ask.
QUERY = "the session and of retry"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, for work that takes longer than moving them.

    A table of fewer splits than the cluster has cores is dealt to all of them; larger ones are read in place.
    """
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores)


def by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each document source; a chunk's source is its language; toxic ones are pinned."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = texts(spark, sf_dir).join(labels, "doc_id", "left")
    tier = F.when(F.col("toxic") == 1, CRITICAL).otherwise(RELEVANT)
    return as_chunks(docs.select(F.col("source").alias("request_id"), F.col("doc_id").alias("pos"), "text", F.col("lang").alias("source"), tier.alias("tier")))


def queries_of(chunks: DataFrame, query: str = QUERY) -> DataFrame:
    return chunks.select("request_id").distinct().withColumn("query", F.lit(query))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each conversation; the first turn asks."""
    turns = table(spark, sf_dir, "conversations")
    return as_chunks(turns.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("pos"), "text", F.col("role").alias("source")))


def noisy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with terminal codes, carriage returns, blanks in runs and blank lines."""
    text = F.concat(F.lit("\x1b[31m"), F.replace(F.col("text"), F.lit(". "), F.lit(".   \t\n\n\n\n")), F.lit("\x1b[0m  \r\n tail\t \n"))
    return texts(spark, sf_dir).select("doc_id", text.alias("text"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log line for each event."""
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z svc["), F.col("user_id").cast("string"), F.lit("] "), F.upper("event_type"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", line.alias("line"))


def whole_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one log (request_id, line_no, line), in the order of their ids."""
    return event_lines(spark, sf_dir).select(F.lit("all").alias("request_id"), F.col("event_id").alias("line_no"), "line")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a log of its own."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("request_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def source_files(spark: SparkSession, sf_dir: str, path: str) -> None:
    """A text file for each source: its documents in order, their sentences parted by blank lines, each ended by a line feed."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit(".\n\n"))
    rows = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("name"), "doc_id", text.alias("value"))
    rows.repartition("name").sortWithinPartitions("name", "doc_id").select("name", "value").write.partitionBy("name").text(path)


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each user, its lines by kind of event and then time, so that there are runs."""
    lines = event_lines(spark, sf_dir).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_type", "ts", "event_id", "line"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda x: x["line"]), "\n")
    return as_chunks(lines.select(F.col("user_id").alias("request_id"), F.lit(0).alias("pos"), text.alias("text"), F.lit("log").alias("kind"), F.lit("events").alias("source")))


def crash_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crash loop for each user (request_id, text), with a line for each of the user's events."""
    lines = table(spark, sf_dir, "events").select("user_id", F.struct(F.col("event_id").alias("i"), crash_line(F.col("event_id")).alias("line")).alias("row"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda row: row["line"]), "\n")
    return lines.groupBy(F.col("user_id").cast("string").alias("request_id")).agg(F.concat(text, F.lit("\n")).alias("text"))


def pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pod for each customer, restarted as often as the customer's key has it."""
    key = F.col("c_custkey")
    text = pod_text(F.concat(F.lit("pod-"), key.cast("string")), key % 50)
    return as_chunks(table(spark, sf_dir, "customer").select(key.alias("request_id"), F.lit(0).alias("pos"), text.alias("text"), F.lit("json").alias("kind"), F.lit("pods").alias("source")))


def order_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object for each customer with orders: its key, an id to be denied, its orders' keys."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    text = F.concat(F.lit('{"custkey": '), F.col("o_custkey").cast("string"), F.lit(', "uid": "x", "orders": ['), F.array_join(F.transform("keys", lambda k: k.cast("string")), ", "), F.lit("]}"))
    return as_chunks(orders.select(F.col("o_custkey").alias("request_id"), F.lit(0).alias("pos"), text.alias("text"), F.lit("json").alias("kind"), F.lit("orders").alias("source")))


def profiled_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON object for each customer with orders, with a key that each profile denies, and the customer's own profile."""
    names = F.array(*(F.lit(n) for n in ("passthrough", "k8s", "postgres", "azure", "unheard of")))
    text = F.concat(F.lit('{"custkey": '), F.col("o_custkey").cast("string"), F.lit(', "uid": "x", "pid": 7, "etag": {"a": 1}, "orders": '), F.col("n").cast("string"), F.lit("}"))
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.col("o_custkey") % 6 < 5, F.get(names, (F.col("o_custkey") % 6).cast("int")))
    return as_chunks(orders.select(F.col("o_custkey").alias("request_id"), F.lit(0).alias("pos"), text.alias("text"), F.lit("json").alias("kind"), F.lit("orders").alias("source"), own.alias("profile")))


def tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads (event_id, session, at, payload): each turn five times over, as what a tool returned."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", "\n+", "\n").alias("text"))
    tool = F.when(F.col("turn") % 3 == 0, "view").when(F.col("turn") % 3 == 1, "bash").otherwise("sql")
    args = F.struct(F.when(F.col("turn") % 2 == 0, "ls").otherwise("kubectl get pods").alias("command"))
    result = F.struct(F.lit("success").alias("resultType"), F.repeat(F.concat(F.lit("2026-01-01 00:00:00 "), "text", F.lit("\n")), 5).alias("textResultForLlm"))
    payload = F.to_json(F.struct(tool.alias("toolName"), args.alias("toolArgs"), result.alias("toolResult")))
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), F.col("conv_id").cast("string").alias("session"), F.col("turn").cast("double").alias("at"), payload.alias("payload"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tool call for each event: its session is the user, its tool and command follow from the event."""
    kinds = table(spark, sf_dir, "events")
    tool = F.when(F.col("event_type") == "view", "view").when(F.col("event_type") == "signup", "bash").when(F.col("event_type") == "error", "mcp:logs").when(F.col("event_type") == "click", "read_file").otherwise("sql")
    command = F.when(F.col("event_id") % 5 == 0, "  kubectl get pods").when(F.col("event_id") % 5 == 1, "psql -c x").when(F.col("event_id") % 5 == 2, "ls -l").when(F.col("event_id") % 5 == 3, "aws s3 ls | promptsift --budget 9").otherwise("curl http://x")
    tokens = F.floor(F.col("value") * 10).cast("long")
    return kinds.select(
        "event_id", F.col("user_id").cast("string").alias("session"), F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts").cast("timestamp_ntz")).alias("micros"), tool.alias("tool"), command.alias("command"),
        tokens.alias("tokens"), F.when(F.col("event_id") % 7 != 0, F.floor(tokens / 10).cast("long")).alias("cleaned"),
    )
