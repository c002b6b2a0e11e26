"""The session gate: which tool results are reduced, given what a session has seen so far.

State is per session: tokens passed on, views counted, the one nudge, and the files already
summarised. It expires after a time without events. What a result adds depends on its verdict
(a reduced one adds its reduced size), so the state is a fold and no running sum. The same
``step`` serves batches, streamed through sorted partitions, and Structured Streaming.

Events: event_id (breaks ties of time), session, at (seconds), tool, tokens, cleaned (tokens
after reduction; null: the funnel gave nothing), shrinks (whether that is shorter; null: told
by the tokens), path and summary (the file's reduction; null: not worth showing), guard (why
the result isn't looked at; see ``tools.guard``).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, MutableMapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from promptsift.functions import tools
from promptsift.shared import dealt

NOT_SHOWN = "(not dedupable)"
#: Sizes of files that are summarised, and of summaries that are worth it.
FILE_CHARS, SUMMARY_CHARS = (1500, 1_048_576), 500
#: What became of a viewed file's summary.
SHOWN, SHOWN_BEFORE, NOT_WORTH = "summary-computed", "summary-already-shown", "summary-skipped"
#: Columns of an event and what those that are missing hold.
EVENT = {"session": "string", "at": "double", "event_id": "string", "tool": "string", "tokens": "long", "cleaned": "long", "shrinks": "boolean", "path": "string", "summary": "string", "guard": "string"}
ORDER = ("session", "at", "tool", "tokens", "event_id")
DECISION = "event_id string, session string, at double, tool string, tokens long, verdict string, reason string, total long, views long, nudged boolean, file string"
#: What the state store holds of a session: its totals, its next timer, the files that it has seen, and events that the watermark hasn't passed.
TOTALS, TIMER, FILE, SUMMARY = "updated_at double, total long, views long, nudged boolean", "at long", "path string", "summary string"
#: Up to PACK events as JSON, so that a session costs a few rows of the state store in a batch, not one for each event.
HELD, PACK = "events string", 1000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Settings:
    threshold: int | None = None
    cumulative: int = 8000
    nudge_after: int = 4
    summaries: bool = True
    ttl: float = 3600.0
    skipped: tuple[str, ...] = ()

    def limit(self, tool: str) -> int:
        if self.threshold is not None:
            return self.threshold
        if tool in tools.SHELL_TOOLS:
            return tools.SHELL_LIMIT
        if tool in tools.VIEW_TOOLS:
            return tools.VIEW_LIMIT
        return tools.REMOTE_LIMIT if tool.startswith("mcp:") or "__" in tool else tools.OTHER_LIMIT


@dataclass
class Session:
    updated_at: float = float("-inf")
    total: int = 0
    views: int = 0
    nudged: bool = False
    summaries: MutableMapping[str, str] = field(default_factory=dict)

    def alive(self, at: float, ttl: float) -> Session:
        """This, or a new session in its place, whose summaries are gone."""
        if self.updated_at >= at - ttl:
            return self
        self.summaries.clear()
        return Session(summaries=self.summaries)


def step(state: Session, event: tuple, s: Settings) -> tuple[Session, tuple]:
    """The state after an event, and its row of DECISION. Summaries are kept in place, so that an event costs one of them."""
    session, at, event_id, tool, tokens, cleaned, shrinks, path, summary, guard = event
    if not guard and (tool in tools.SKIPPED_TOOLS or tool.startswith("todo_")):
        guard = tools.BOOKKEEPING
    if not guard and tool in s.skipped:
        guard = tools.LISTED
    now = state.alive(at, s.ttl)
    if guard:
        verdict, reason = (guard, "") if guard in (tools.DISABLED, tools.FAILED, tools.PASSED) else ("skipped", guard)
        return state, (event_id, session, at, tool, tokens, verdict, reason, now.total, now.views, False, "")
    nudged, file = False, ""
    if tool in tools.VIEW_TOOLS:
        now = Session(at, now.total, now.views + 1, now.nudged, now.summaries)
        if 0 < s.nudge_after <= now.views and not now.nudged:
            nudged = now.nudged = True
        if s.summaries and path:
            if path in now.summaries:
                file = SHOWN_BEFORE
            else:
                file = SHOWN if summary else NOT_WORTH
                now.summaries[path] = summary or NOT_SHOWN
    if tokens >= s.limit(tool):
        reason = "per-call"
    elif 0 < s.cumulative <= now.total + tokens:
        reason = "cumulative"
    else:
        reason = ""
    if not reason:
        verdict, added = ("injection-only" if nudged or file == SHOWN else "under-threshold"), tokens
    elif cleaned is None:
        verdict, added = "funnel-empty", None
    elif not (cleaned < tokens if shrinks is None else shrinks):
        verdict, added = "funnel-noop", None
    else:
        verdict, added = "fired", cleaned
    if added is not None:
        now = Session(at, now.total + added, now.views, now.nudged, now.summaries)
    return now, (event_id, session, at, tool, tokens, verdict, reason, now.total, now.views, nudged, file)


def as_events(df: DataFrame) -> DataFrame:
    """df with every column of an event."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in EVENT.items()))


_KINDS = {"string": pa.string(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in DECISION.split(", ")])


def decided(events: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The decision on every event of a batch; a session's events are streamed in order through one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, Session()
        for batch in batches:
            out = []
            for event in zip(*(c.to_pylist() for c in batch.columns)):
                if event[0] != last:
                    last, state = event[0], Session()
                state, row = step(state, event, settings)
                out.append(row)
            columns = list(zip(*out)) or [()] * len(_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types)], schema=_SCHEMA)

    return dealt(as_events(events), *ORDER).mapInArrow(run, DECISION)


class Files(MutableMapping):
    """A session's summaries, each a row of the state store that is only touched when it is asked for."""

    def __init__(self, state):
        self.state = state

    def __contains__(self, path: object) -> bool:
        return self.state.containsKey((path,))

    def __getitem__(self, path: str) -> str:
        return self.state.getValue((path,))[0]

    def __setitem__(self, path: str, summary: str) -> None:
        self.state.updateValue((path,), (summary,))

    def __delitem__(self, path: str) -> None:
        self.state.removeKey((path,))

    def __iter__(self) -> Iterator[str]:
        return (key[0] for key in self.state.keys())

    def __len__(self) -> int:
        return sum(1 for _ in self.state.keys())

    def clear(self) -> None:
        self.state.clear()


def _packed(events: list[tuple]) -> list[tuple[str]]:
    """Rows of HELD."""
    return [(json.dumps(events[k : k + PACK]),) for k in range(0, len(events), PACK)]


def _place(event: tuple) -> tuple:
    """Sorts a session's events as ORDER does: nulls first."""
    by_name = dict(zip(EVENT, event))
    return tuple((by_name[c] is not None, by_name[c]) for c in ORDER[1:])


class Sessions(StatefulProcessor):
    """The gate over the state store: events wait until the watermark has passed them and are then taken in order."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals, self.timer = handle.getValueState("totals", TOTALS), handle.getValueState("timer", TIMER)
        self.files, self.held = handle.getMapState("files", FILE, SUMMARY), handle.getListState("held", HELD)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        found = [tuple(r[c] for c in EVENT) for r in rows]
        self.held.appendList(_packed(found))
        self._wake_at(min(_due(e) for e in found))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.timer.exists() and self.timer.get()[0] == expiredTimerInfo.getExpiryTimeInMs():
            self.timer.clear()
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((e for (text,) in self.held.get() for e in json.loads(text)), key=_place) if self.held.exists() else []
        ready = [e for e in waiting if _due(e) <= now]
        totals = self.totals.get() if self.totals.exists() else (float("-inf"), 0, 0, False)
        state = Session(*totals, Files(self.files))
        rows = []
        for event in ready:
            state, row = step(state, event, self.settings)
            rows.append(Row(**dict(zip(_SCHEMA.names, row))))
        waiting = waiting[len(ready) :]
        if ready:
            self.held.put(_packed(waiting)) if waiting else self.held.clear()
        gone = int((state.updated_at + self.settings.ttl) * 1000) + 1 if state.updated_at > float("-inf") else now
        if not waiting and gone <= now:
            for each in (self.totals, self.files, self.held):
                each.clear()
        else:
            if ready and state.updated_at > float("-inf"):
                self.totals.update((state.updated_at, state.total, state.views, state.nudged))
            self._wake_at(min([_due(e) for e in waiting], default=max(gone, now + 1)))
        return iter(rows)

    def _wake_at(self, at: int) -> None:
        """One timer a session: the earliest of what there is to do."""
        if self.timer.exists():
            if (before := self.timer.get()[0]) <= at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.timer.update((at,))


def _due(event: tuple) -> int:
    """The watermark in milliseconds at which no earlier event can come any more."""
    return math.floor(event[1] * 1000) + 1


def decided_stream(events: DataFrame, settings: Settings = Settings(), late: str = "1 hour") -> DataFrame:
    """The same over a stream, with the sessions in the state store, whatever order events come in.

    An event is decided once the watermark, which is ``late`` behind the latest event, has passed
    it; what comes later than that is dropped. An event costs one row of files seen, not all of
    its session's. A session's rows go once the watermark is past their time to live.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    timed = as_events(events).withColumn("event_time", F.timestamp_seconds("at")).withWatermark("event_time", late)
    return timed.groupBy("session").transformWithState(Sessions(settings), DECISION, "append", "eventTime")


def worth_showing(file_chars: Column, summary: Column) -> Column:
    """The summary, or null if the file or the summary is of the wrong size."""
    size = F.length(summary)
    good = file_chars.between(*FILE_CHARS) & (size > 0) & (size < SUMMARY_CHARS) & (size * 10 < file_chars)
    return F.when(good, summary)


def injected(nudged: Column, views: Column, file: Column, path: Column, summary: Column) -> Column:
    """What is put before a result: the one nudge, the file's summary, or both with a blank line between; else empty."""
    nudge = F.when(nudged, F.concat(F.lit("[" + tools.WRAPPER + " tip: "), views.cast("string"), F.lit(tools.NUDGE)))
    shown = F.when(file == SHOWN, F.concat(F.lit("[" + tools.WRAPPER + " summary of "), path, F.lit(tools.SUMMARY_LEAD), summary, F.lit(tools.SUMMARY_END)))
    return F.concat_ws("\n\n", nudge, shown)


def notice(verdict: Column, tool: Column, profile: Column, tokens: Column, cleaned_tokens: Column, cleaned: Column, original: Column, injection: Column) -> Column:
    """The text that replaces a tool's result; null where the result stays."""
    heading = F.concat(F.lit("[" + tools.WRAPPER + ": "), tokens.cast("string"), F.lit(" → "), cleaned_tokens.cast("string"), F.lit(" tok | tool="), tool, F.lit(" profile="), profile, F.lit("]\n"))
    before = F.nullif(injection, F.lit(""))
    return F.when(verdict == "fired", F.concat_ws("\n\n", before, F.concat(heading, cleaned))).when(verdict == "injection-only", F.concat_ws("\n\n", before, original))


def answer(replacement: Column) -> Column:
    """What a hook says after a tool: the replaced result as JSON, or an empty object."""
    result = F.struct(F.struct(F.lit("success").alias("resultType"), replacement.alias("textResultForLlm")).alias("modifiedResult"))
    return F.when(replacement.isNotNull(), F.to_json(result)).otherwise("{}")
