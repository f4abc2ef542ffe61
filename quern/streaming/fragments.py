"""Log fragments of a stream put together as they come, with the fragments that wait for their end as state.

A source's fragments must come in order. Where a file's reassembly ends with the file, a stream's waits `patience` of
processing time after a source's last fragment, then gives out what waits, each fragment for itself and marked.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "source string, line long, log string, partials int, unfinished boolean"


def join(records: DataFrame, patience: str | None = "10 minutes") -> DataFrame:
    """records: source, line, part (P for a fragment that is not the last), log.

    With patience a query runs on for as long as fragments wait, also under a trigger that would end by itself; without,
    they wait in the state for the next run.
    """
    milliseconds = int(pd.Timedelta(patience).total_seconds() * 1000) if patience else 0
    timeout = GroupStateTimeout.ProcessingTimeTimeout if patience else GroupStateTimeout.NoTimeout

    def step(key, batches: Iterable[pd.DataFrame], state: GroupState):
        lines, logs = (list(x) for x in state.get) if state.exists else ([], [])
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"source": key[0], "line": lines, "log": logs, "partials": 0, "unfinished": True})
            return
        out = []
        rows = sorted(r for b in batches for r in zip(b["line"], b["part"], b["log"], strict=True))
        for line, part, log in rows:
            if part == "P":
                lines.append(line)
                logs.append(log or "")
            else:
                out.append((key[0], lines[0] if lines else line, "".join(logs) + (log or ""), len(lines), False))
                lines, logs = [], []
        if lines:
            state.update((lines, logs))
            if milliseconds:
                state.setTimeoutDuration(milliseconds)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["source", "line", "log", "partials", "unfinished"])

    kept = records.select("source", "line", "part", "log")
    return kept.groupBy("source").applyInPandasWithState(step, OUT, "lines array<long>, logs array<string>", "append", timeout)
