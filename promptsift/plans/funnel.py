"""Funnels: stages in a fixed order over the chunks of many requests.

A stage is a function of chunks and queries (request_id, query). The order isn't the
optimizer's to change; each stage is lazy, and Spark runs the chain as one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from promptsift.functions.hooks import Embedder, Llm
from promptsift.functions.text import ratio, token_count
from promptsift.operators import budget as b
from promptsift.operators import lossless
from promptsift.operators.relevance import relevance
from promptsift.operators.summarize import summarize
from promptsift.plans.profiles import PROFILES
from promptsift.schema import is_live
from promptsift.shared import saved

#: Stages that read a chunk and write it.
NARROW = ("normalize", "dedup", "prune")
Stage = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Funnel:
    """Named stages up to the budget; assembling follows.

    The later stages read their input several times (to count, to rank, to join back), so
    the chunks are saved before each of them: the plan stays small and no work is repeated.
    """

    stages: tuple[tuple[str, Stage], ...]

    def steps(self, chunks: DataFrame, queries: DataFrame) -> list[DataFrame]:
        """The chunks before the first stage and after each."""
        out = [chunks]
        for name, stage in self.stages:
            if name not in NARROW:
                out[-1] = saved(out[-1])
            out.append(stage(out[-1], queries))
        out[-1] = saved(out[-1])
        return out

    def run(self, chunks: DataFrame, queries: DataFrame) -> DataFrame:
        """One row with the prompt of each request."""
        return b.assemble(self.steps(chunks, queries)[-1])

    def metrics(self, chunks: DataFrame, queries: DataFrame) -> DataFrame:
        """Per request and stage: live tokens and chunks before and after, and what was saved."""
        steps = self.steps(chunks, queries)
        return self.metrics_of(steps, b.assemble(steps[-1]))

    def metrics_of(self, steps: list[DataFrame], assembled: DataFrame) -> DataFrame:
        """The metrics of steps that were run, and of their prompts."""
        prompts = assembled.select("request_id", token_count(F.col("prompt")).alias("tokens"), F.lit(1).cast("long").alias("chunks"))
        sizes = [*(measured(s) for s in steps), prompts]
        names = [*(name for name, _ in self.stages), "assemble"]
        rows = []
        for k, name in enumerate(names):
            before, after = (sizes[k + i].select("request_id", F.col("tokens").alias(f"tokens_{s}"), F.col("chunks").alias(f"chunks_{s}")) for i, s in enumerate(("in", "out")))
            rows.append(before.join(after, "request_id").withColumns({"stage_no": F.lit(k), "stage": F.lit(name)}))
        every = reduce(DataFrame.unionByName, rows)
        saved = {"saved": F.col("tokens_in") - F.col("tokens_out"), "ratio": ratio(F.col("tokens_in"), F.col("tokens_out"))}
        return every.withColumns(saved).select("request_id", "stage_no", "stage", "tokens_in", "tokens_out", "chunks_in", "chunks_out", "saved", "ratio")


def measured(chunks: DataFrame) -> DataFrame:
    """request_id, tokens, chunks of what is live."""
    live = is_live()
    return chunks.groupBy("request_id").agg(F.sum(F.when(live, token_count(F.col("text"))).otherwise(0)).alias("tokens"), F.count_if(live).alias("chunks"))


def _without_query(stage: Callable[[DataFrame], DataFrame]) -> Stage:
    return lambda chunks, _: stage(chunks)


def lite_funnel(max_tokens: int = b.MAX_TOKENS, denied: Iterable[str] = (), max_array: int = 10) -> Funnel:
    """Only what needs no query."""
    return Funnel((
        ("normalize", _without_query(lossless.normalize)),
        ("dedup", _without_query(lossless.dedup)),
        ("prune", _without_query(lambda c: lossless.prune(c, denied, max_array, PROFILES))),
        ("budget", _without_query(lambda c: b.budget(c, max_tokens))),
    ))


def default_funnel(max_tokens: int = b.MAX_TOKENS, keep: int = 5, embedder: Embedder | None = None, llm: Llm | None = None, denied: Iterable[str] = (), max_array: int = 10) -> Funnel:
    lite = lite_funnel(max_tokens, denied, max_array).stages
    ranked = (
        ("relevance", lambda c, q: relevance(c, q, keep, embedder)),
        ("summarize", lambda c, q: summarize(c, q, llm=llm)),
    )
    return Funnel((*lite[:3], *ranked, *lite[3:]))


#: The report's columns and their widths; the first is set left.
REPORT = (("stage", 14), ("tok_in", 8), ("tok_out", 8), ("saved", 8), ("ratio", 7), ("ch_in", 6), ("ch_out", 6))


def _row(cells: list[str]) -> str:
    return " ".join(c.rjust(w) if k else c.ljust(w) for k, (c, (_, w)) in enumerate(zip(cells, REPORT)))


def report(metrics: DataFrame) -> str:
    """The fixed-width table of one request's metrics."""
    return report_of(metrics.orderBy("stage_no").collect())


def report_of(rows: Sequence[Row]) -> str:
    """The same of the rows, in the stages' order."""
    head = _row([name for name, _ in REPORT])
    rule = "-" * len(head)
    body = [_row([r.stage, *map(str, (r.tokens_in, r.tokens_out, r.saved)), f"{r.ratio:.1%}", str(r.chunks_in), str(r.chunks_out)]) for r in rows]
    first, last = (rows[0].tokens_in, rows[-1].tokens_out) if rows else (0, 0)
    share = (first - last) / first if first else 0.0
    return "\n".join([head, rule, *body, rule, _row(["TOTAL", str(first), str(last), str(first - last), f"{share:.1%}"])])
