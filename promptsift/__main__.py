"""``python -m promptsift [PATH]``: reduces files, or standard input, to prompts on standard output.

``--evals`` runs the built-in evaluation instead.
"""

from __future__ import annotations

import argparse
import sys
from itertools import groupby

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from promptsift.functions.hooks import hooks_from_env
from promptsift.operators import budget, evals
from promptsift.plans import api, suites
from promptsift.plans.funnel import report_of
from promptsift.plans.profiles import PROFILES
from promptsift.shared import saved, ship
from promptsift.sources import texts


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="promptsift", description="Reduce texts to prompts under a token budget.")
    p.add_argument("path", nargs="?", help="files to read; standard input if it is left out")
    p.add_argument("--query", default="", help="the question; without one only lossless stages run")
    p.add_argument("--budget", type=int, default=2000, help="tokens of a prompt")
    p.add_argument("--keep", type=int, default=5, help="chunks that relevance keeps")
    p.add_argument("--profile", default="passthrough", choices=sorted(PROFILES), help="JSON keys to drop")
    p.add_argument("--report", action="store_true", help="the stages' sizes, on standard error")
    p.add_argument("--evals", action="store_true", help="run the built-in evaluation")
    p.add_argument("--suite", default="tier1", choices=sorted(suites.SUITES), help="with --evals: which cases")
    p.add_argument("--fail-on-regression", action="store_true", help="with --evals: exit with 1 if an answer is lost")
    return p


def run_evals(spark: SparkSession, suite: str) -> tuple[str, int]:
    """A suite's report and its regressions."""
    found = saved(suites.results(spark, suite, suites.judge_from_env()))
    return evals.report(found), evals.suite(found).first()["regressions"]


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    if args.evals:
        table, lost = run_evals(spark, args.suite)
        print(table)
        if args.fail_on_regression and lost:
            print(f"\nFAIL: {lost} case(s) regressed under compression", file=sys.stderr)
            return 1
        return 0
    embedder, llm = hooks_from_env() if args.query.strip() else (None, None)
    options = api.Options(args.budget, args.keep, args.profile, embedder=embedder, llm=llm)
    if args.path:
        found = texts.read_texts(spark, args.path)
    else:
        found = spark.createDataFrame([("stdin", sys.stdin.read())], "request_id string, text string")
    # all requests in one run, and its steps measured
    asked = bool(args.query.strip())
    queries = found.select("request_id", F.lit(args.query).alias("query"))
    funnel = options.full() if asked else options.lite()
    steps = funnel.steps(texts.blocks(found), queries)
    prompts = saved(budget.assemble(steps[-1]))
    for row in prompts.orderBy("request_id").toLocalIterator():
        print(row.prompt)
    if args.report:
        metrics = funnel.metrics_of(steps, prompts).orderBy("request_id", "stage_no")
        for _, rows in groupby(metrics.toLocalIterator(), lambda r: r.request_id):
            print(report_of(list(rows)), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
