"""Anchored attempt windows over a stream, with per-key state that expires by itself."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from attestra.operators.limits import ATTEMPT_WINDOW_MS, MAX_ATTEMPTS

STATE = "start_ms bigint, used int"


def attempt_stream(
    events: DataFrame,
    key: str,
    key_type: str = "bigint",
    window_ms: int = ATTEMPT_WINDOW_MS,
    limit: int = MAX_ATTEMPTS,
    idle_ms: int = 4 * ATTEMPT_WINDOW_MS,
) -> DataFrame:
    """Verdict per attempt; events carry the key, ``event_id`` and ``ts_ms``.

    State is two numbers per key and is dropped after ``idle_ms`` of processing time without
    events. Rows arrive per key in pieces and are ordered within the piece. Start the query with a
    processing-time trigger: pending timeouts make Spark schedule batches without data.
    """
    output = f"{key} {key_type}, event_id bigint, ts_ms bigint, window_start_ms bigint, attempt int, allowed boolean"

    def step(
        name: tuple, pieces: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        batch = pd.concat(list(pieces)).sort_values(["ts_ms", "event_id"])
        rows = []
        for event_id, now in zip(batch["event_id"], batch["ts_ms"], strict=True):
            if start is None or now - start >= window_ms:
                start, used = int(now), 0
            ok = used < limit
            used += int(ok)
            rows.append((name[0], event_id, now, start, used if ok else used + 1, ok))
        state.update((start, used))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(
            rows, columns=[key, "event_id", "ts_ms", "window_start_ms", "attempt", "allowed"]
        )

    return events.groupBy(key).applyInPandasWithState(
        step, output, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout
    )


PENDING_STATE = "start_ms bigint, used int, pending_ms array<bigint>, pending_ids array<bigint>"


def ordered_attempt_stream(
    events: DataFrame,
    key: str,
    key_type: str = "bigint",
    window_ms: int = ATTEMPT_WINDOW_MS,
    limit: int = MAX_ATTEMPTS,
    lateness: str = "10 minutes",
) -> DataFrame:
    """``attempt_stream`` in event time: the verdicts of the batch operator, whatever the arrival.

    Rows wait in their key's state until the watermark, ``lateness`` behind the latest event, has
    passed them, and are judged in order of time and ``event_id``. Timers are event times, so a slow
    backfill neither restarts a count nor loses it; a key's state goes once its window has ended and
    nothing waits. Rows later than the watermark are dropped by the watermark's contract.
    """
    output = f"{key} {key_type}, event_id bigint, ts_ms bigint, window_start_ms bigint, attempt int, allowed boolean"

    def step(name: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used, times, ids = state.get if state.exists else (None, 0, [], [])
        waiting = list(zip(times, ids))
        if not state.hasTimedOut:
            for piece in pieces:
                waiting += zip(piece["ts_ms"].tolist(), piece["event_id"].tolist())
        waiting.sort()
        # Before the first watermark nothing is known to be complete.
        passed = state.getCurrentWatermarkMs()
        rows = []
        while waiting and waiting[0][0] < passed:
            now, event_id = waiting.pop(0)
            if start is None or now - start >= window_ms:
                start, used = now, 0
            ok = used < limit
            used += int(ok)
            rows.append((name[0], event_id, now, start, used if ok else used + 1, ok))
        if not waiting and (start is None or start + window_ms <= passed):
            state.remove()
        else:
            state.update((start, used, [t for t, _ in waiting], [i for _, i in waiting]))
            due = waiting[0][0] + 1 if waiting else start + window_ms
            state.setTimeoutTimestamp(max(due, passed + 1))
        if rows:
            yield pd.DataFrame(
                rows, columns=[key, "event_id", "ts_ms", "window_start_ms", "attempt", "allowed"]
            )

    timed = events.select(key, "event_id", "ts_ms", F.timestamp_millis("ts_ms").alias("event_time"))
    return timed.withWatermark("event_time", lateness).groupBy(key).applyInPandasWithState(
        step, output, PENDING_STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
