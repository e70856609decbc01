"""The pace and the pauses of a whole service, whatever partitions its requests come from.

Requests are keyed by their service, whose state says when the next call may start, until when a limit closes
it, whether its quota is spent, and which requests wait. A timer opens it again; nothing is dropped while it is
closed. A spent quota is for good: what comes then is answered as it comes, in no order and without the state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Generator, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.sources.connectors import QuotaSpent, RateLimited

ANSWER = "service string, id string, value string, nth bigint, started_ms bigint, reply string, status string"
LINE = pa.schema([("id", pa.string()), ("value", pa.string()), ("at_ms", pa.int64())])
#: Requests of one entry of the line that waits, and those that are answered at once.
HELD, PART = 1_000, 10_000


class Gate(StatefulProcessor):
    """One service. Requests are called in the order in which they came; those of one batch in the order of their times and ids.

    Time is that of the events and their watermark, or with `by_clock` that of the machine.
    """

    def __init__(self, client: Callable[[], Callable[[str], str | None]], gap_ms: int, by_clock: bool):
        self.client, self.gap_ms, self.by_clock = client, gap_ms, by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "next_ms bigint, open_ms bigint, spent boolean, calls bigint, head bigint, first bigint, last bigint")
        # Entries go by the number of their first request; `head` is the first entry, `first` the first request in it that waits.
        self.waiting = handle.getMapState("waiting", "n bigint", "requests string")
        self.call = self.client()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self._state()
        parts = (pa.Table.from_pandas(part[LINE.names], schema=LINE, preserve_index=False) for part in rows)
        if state["spent"] and state["first"] == state["last"]:
            for part in parts:
                yield self._refused(key[0], state, part)
            return
        # Kept as Arrow, so a large batch takes little more than its bytes.
        line = pa.concat_tables(parts).sort_by([("at_ms", "ascending"), ("id", "ascending")])
        now = timerValues.getCurrentProcessingTimeInMs() if self.by_clock else max(0, line["at_ms"][-1].as_py())
        yield from self._called(key[0], state, now, line)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.by_clock else timerValues.getCurrentWatermarkInMs()
        yield from self._called(key[0], self._state(), max(now, expiredTimerInfo.getExpiryTimeInMs()), LINE.empty_table())

    def _state(self) -> dict:
        held = self.state.get() or (0, 0, False, 0, 0, 0, 0)
        return dict(zip(("next", "open", "spent", "calls", "head", "first", "last"), held))

    def _refused(self, service: str, s: dict, part: pa.Table) -> pd.DataFrame:
        """The answers of a service whose quota is spent."""
        found = part.to_pandas()
        start = np.maximum(found["at_ms"], max(s["next"], s["open"]))
        found = found.assign(service=service, nth=s["calls"], started_ms=start, reply=None, status="quota")
        return found[[x.split()[0] for x in ANSWER.split(", ")]]

    def _called(self, service: str, s: dict, now: int, line: pa.Table) -> Iterator[pd.DataFrame]:
        """The answers of requests whose turn has come, first of those that wait, then of `line`; a timer wakes the rest."""
        while s["first"] < s["last"]:
            held = pa.table(json.loads(self.waiting.getValue((s["head"],))[0]), schema=LINE)
            s["first"] += yield from self._answered(service, s, now, held.slice(s["first"] - s["head"]))
            if s["first"] < s["head"] + held.num_rows:
                break
            self.waiting.removeKey((s["head"],))
            s["head"] = s["first"]
        at = 0
        while s["first"] == s["last"] and at < line.num_rows:
            part = line.slice(at, PART)
            took = yield from self._answered(service, s, now, part)
            at += took
            if took < part.num_rows:
                break
        for begin in range(at, line.num_rows, HELD):
            part = line.slice(begin, HELD)
            self.waiting.updateValue((s["last"],), (json.dumps(part.to_pydict()),))
            s["last"] += part.num_rows
        self.state.update((s["next"], s["open"], s["spent"], s["calls"], s["head"], s["first"], s["last"]))

    def _answered(self, service: str, s: dict, now: int, part: pa.Table) -> Generator[pd.DataFrame, None, int]:
        """Calls for requests in line until one's turn has not come; how many were answered."""
        out = []
        requests = zip(*(part[n].to_pylist() for n in LINE.names)) if not s["spent"] else ()
        for ident, value, at in requests:
            status = None
            while status is None:
                start = max(at, s["next"], s["open"])
                if start > now:
                    break
                reply = None
                s["calls"], s["next"] = s["calls"] + 1, start + self.gap_ms
                try:
                    reply = self.call(value)
                    status = "ok" if reply else "empty"
                except QuotaSpent:
                    s["spent"], status = True, "quota"
                except RateLimited as limit:
                    s["open"] = start + int(limit.seconds * 1000)  # it stays the first in line
                except Exception:  # a service's own failure is a row's status
                    status = "failed"
            if status is None:
                self.handle.registerTimer(start)
                break
            out.append((service, ident, value, s["calls"], start, reply, status))
            if s["spent"]:
                break
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in ANSWER.split(", ")])
        if s["spent"] and len(out) < part.num_rows:
            yield self._refused(service, s, part.slice(len(out)))
            return part.num_rows
        return len(out)

    def close(self) -> None:
        pass


def through_gate(requests: DataFrame, client: Callable[[], Callable[[str], str | None]], gap_ms: int = 0, late: str = "0 seconds", by_clock: bool = False) -> DataFrame:
    """The answers (ANSWER) to a stream of requests (service, id, value, at timestamp); `nth` counts the service's calls so far.

    `client` is opened where a service is handled. A service has one pace, so its calls are one task's; services are spread. One
    with several keys comes as several services.
    """
    ready = requests.select("service", F.col("id").cast("string").alias("id"), "value", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    ready = ready.withColumn("at_ms", F.unix_millis("at"))
    processor = Gate(client, gap_ms, by_clock)
    return ready.groupBy("service").transformWithStateInPandas(processor, ANSWER, "Append", "ProcessingTime" if by_clock else "EventTime")
