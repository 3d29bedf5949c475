"""Attempt windows, write limits, sessions and challenges over event logs.

Windows start at the first event of a key, not on the clock, so each decision depends on earlier
ones. Attempt windows compose pointers over time ranges (``anchored``). Write limits cut long scopes
where they must restart anyway (a gap of a whole window) and stream with constant state per scope;
validity look-backs are bounded and cut by time.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from attestra.operators.anchored import RANGE_WINDOWS, anchored_windows
from attestra.operators.topk import default_fanout, top_k

# Limits and lifetimes in milliseconds.
MINUTE_MS = 60_000
ATTEMPT_WINDOW_MS = 15 * MINUTE_MS
MAX_ATTEMPTS = 5
WRITE_WINDOW_MS = 5 * MINUTE_MS
MAX_CLIENT_WRITES = 20
MAX_SCOPE_WRITES = 60
MAX_LEDGER_ROWS = 5000
LINK_TTL_MS = 10 * MINUTE_MS
PASSKEY_TTL_MS = 5 * MINUTE_MS
IDLE_TIMEOUT_MS = 30 * MINUTE_MS
ABSOLUTE_TIMEOUT_MS = 8 * 60 * MINUTE_MS


def quiet_segments(events: DataFrame, key: str, gap_ms: int) -> DataFrame:
    """Add ``_segment``: start of the stretch without a pause of ``gap_ms`` an event belongs to.

    A window that started before such a pause has ended, so stretches are independent. Pauses are
    found per (key, time range); only range edges, one row each, are compared across ranges.
    """
    width = gap_ms * 64
    ranged = events.withColumn("_range", F.floor(F.col("ts_ms") / width))
    inside = Window.partitionBy(key, "_range").orderBy("ts_ms")
    edges = ranged.groupBy(key, "_range").agg(
        F.min("ts_ms").alias("_min"), F.max("ts_ms").alias("_max")
    )
    across = Window.partitionBy(key).orderBy("_range")
    starts = ranged.withColumn("_before", F.lag("ts_ms").over(inside)).filter(
        F.col("_before").isNotNull() & (F.col("ts_ms") - F.col("_before") >= gap_ms)
    )
    last_start = starts.groupBy(key, "_range").agg(F.max("ts_ms").alias("_last_start"))
    carried = (
        edges.join(last_start, [key, "_range"], "left")
        .withColumn("_previous", F.lag("_max").over(across))
        .withColumn(
            "_opens",
            F.when(
                F.col("_previous").isNull() | (F.col("_min") - F.col("_previous") >= gap_ms),
                F.col("_min"),
            ),
        )
        .withColumn("_open_or_last", F.coalesce("_last_start", "_opens"))
        .withColumn(
            "_inherited",
            F.last("_open_or_last", ignorenulls=True).over(
                across.rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .select(key, "_range", F.coalesce("_opens", "_inherited").alias("_carried"))
    )
    own = F.when(
        F.col("ts_ms") - F.lag("ts_ms").over(inside) >= gap_ms, F.col("ts_ms")
    )
    running = F.last("_own", ignorenulls=True).over(
        inside.rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        ranged.withColumn("_own", own)
        .withColumn("_running", running)
        .join(carried, [key, "_range"])
        .withColumn("_segment", F.coalesce("_running", "_carried"))
        .drop("_own", "_running", "_carried", "_range")
    )


def attempt_windows(
    events: DataFrame,
    key: str,
    window_ms: int = ATTEMPT_WINDOW_MS,
    limit: int = MAX_ATTEMPTS,
    order: tuple[str, ...] = (),
    range_windows: int = RANGE_WINDOWS,
) -> DataFrame:
    """Fixed windows anchored at a key's first event: start, attempt number and verdict.

    ``events`` carries the key and ``ts_ms``; ``order`` breaks ties of equal times.
    """
    return anchored_windows(events, key, window_ms, limit, order, range_windows)


def admitted(
    writes: Iterable[tuple[object, int]], window_ms: int, per_client: int, per_scope: int
) -> Iterator[bool]:
    """Verdicts for (client, time) in time order.

    Every quota - one per client, one for the scope itself - is an open window with an end and some
    room. All windows last equally long and enter at their first write, so the dictionary holds
    them in the order they end, and ended ones leave at its front: it never holds more than the
    quotas used within one window.
    """
    scope = object()
    open_windows: dict[object, list[int]] = {}
    for client, now in writes:
        while open_windows and next(iter(open_windows.values()))[0] <= now:
            del open_windows[next(iter(open_windows))]
        quotas = {client: per_client, scope: per_scope}
        fits = all(open_windows.get(q, (0, most))[1] > 0 for q, most in quotas.items())
        if fits:
            for q, most in quotas.items():
                open_windows.setdefault(q, [now + window_ms, most])[1] -= 1
        yield fits


def _write_limits(scope: str, client: str, window_ms: int, per_client: int, per_scope: int):
    def rows(batches: Iterator[pd.DataFrame], seen: deque) -> Iterator[tuple]:
        for batch in batches:
            seen.append(batch)
            yield from zip(batch[scope], batch["_segment"], batch[client], batch["ts_ms"], strict=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: deque = deque()
        verdicts: list[bool] = []
        for _, stretch in groupby(rows(batches, seen), key=lambda r: r[:2]):
            for verdict in admitted((r[2:] for r in stretch), window_ms, per_client, per_scope):
                verdicts.append(verdict)
                if len(seen) > 1 and len(verdicts) >= len(seen[0]):
                    yield from _with_verdicts(seen, verdicts)
        while seen:
            yield from _with_verdicts(seen, verdicts)

    return run


def _with_verdicts(seen: deque, verdicts: list[bool]) -> Iterator[pd.DataFrame]:
    batch = seen.popleft()
    own, verdicts[:] = verdicts[: len(batch)], verdicts[len(batch) :]
    yield batch.drop(columns=["_segment"]).assign(allowed=own)


def write_limits(
    events: DataFrame,
    scope: str,
    client: str,
    window_ms: int = WRITE_WINDOW_MS,
    per_client: int = MAX_CLIENT_WRITES,
    per_scope: int = MAX_SCOPE_WRITES,
    order: tuple[str, ...] = (),
) -> DataFrame:
    """Per-client and per-scope caps; a scope is one serving process with its own counters."""
    segmented = quiet_segments(events, scope, window_ms)
    ready = segmented.repartition(scope, "_segment").sortWithinPartitions(
        scope, "_segment", "ts_ms", *order
    )
    fields = [S.StructField(f.name, f.dataType) for f in events.schema.fields]
    fields.append(S.StructField("allowed", S.BooleanType()))
    return ready.select(*events.columns, "_segment").mapInPandas(
        _write_limits(scope, client, window_ms, per_client, per_scope), S.StructType(fields)
    )


def within_capacity(
    events: DataFrame, scope: str, order: list[str], capacity: int = MAX_LEDGER_ROWS
) -> DataFrame:
    """Rows a ledger still accepts: the first ``capacity`` of each scope."""
    # Large capacities are beyond the planner's own per-task cut, so a busy scope is split first.
    fanout = max(default_fanout(events), 16 if capacity > 1000 else 1)
    return top_k(
        events, [scope], [F.col(c).asc() for c in order], capacity, "row_in_scope", fanout
    )


def _latest_within(
    marks: DataFrame, events: DataFrame, key: str, lookback_ms: int
) -> DataFrame:
    """For each event the latest mark of its key at most ``lookback_ms`` old, as ``mark_ms``.

    Both sides are cut into time ranges one look-back long. A mark is copied into the next range,
    which is as far as it can be seen, so even one busy key spreads over its ranges.
    """
    def ranged(frame: DataFrame, kind: int) -> DataFrame:
        return frame.withColumn("_kind", F.lit(kind)).withColumn(
            "_range", F.floor(F.col("ts_ms") / lookback_ms)
        )

    seen = ranged(marks.select(key, "ts_ms"), 0)
    copies = seen.withColumn(
        "_range", F.explode(F.array(F.col("_range"), F.col("_range") + 1))
    ).withColumn("_mark", F.col("ts_ms"))
    asked = ranged(events, 1)
    mixed = asked.withColumn("_mark", F.lit(None).cast("bigint")).unionByName(
        copies, allowMissingColumns=True
    )
    before = Window.partitionBy(key, "_range").orderBy("ts_ms", "_kind").rowsBetween(
        Window.unboundedPreceding, 0
    )
    is_event = F.col("_kind") == 1
    latest = mixed.withColumn("mark_ms", F.last("_mark", ignorenulls=True).over(before))
    in_reach = F.col("ts_ms") - F.col("mark_ms") < lookback_ms
    return (
        latest.filter(is_event)
        .withColumn("mark_ms", F.when(in_reach, F.col("mark_ms")))
        .drop("_kind", "_range", "_mark")
    )


def session_validity(
    logins: DataFrame,
    requests: DataFrame,
    key: str,
    idle_ms: int = IDLE_TIMEOUT_MS,
    absolute_ms: int = ABSOLUTE_TIMEOUT_MS,
) -> DataFrame:
    """Whether each request falls into a live session of its key; use never extends a session."""
    alive = _latest_within(logins, requests, key, min(idle_ms, absolute_ms))
    return alive.withColumn("authorized", F.col("mark_ms").isNotNull()).withColumnRenamed(
        "mark_ms", "session_start_ms"
    )


def challenge_consumption(
    issued: DataFrame,
    consumed: DataFrame,
    key: str,
    ttl_ms: int = LINK_TTL_MS,
    order: tuple[str, ...] = (),
) -> DataFrame:
    """Whether each consumption meets an unexpired, unused challenge of its key.

    A challenge is used up by the first consumption after it, so a later one only succeeds if a
    newer challenge was issued in between. ``order`` breaks ties of equal times; without it all
    other columns do, so the winner never depends on the plan.
    """
    tie_breaks = order or tuple(c for c in consumed.columns if c not in (key, "ts_ms"))
    offered = _latest_within(issued, consumed, key, ttl_ms)
    # Consumptions without a challenge stand alone; they must not pile up in one group per key.
    challenge = F.coalesce("mark_ms", -F.col("ts_ms"))
    used = Window.partitionBy(key, challenge).orderBy("ts_ms", *tie_breaks)
    first = F.row_number().over(used) == 1
    return offered.withColumn(
        "accepted", F.col("mark_ms").isNotNull() & first
    ).withColumnRenamed("mark_ms", "issued_ms")


def expires_at(created_ms: Column, ttl_ms: int) -> Column:
    """Expiry moment; reaching it counts as expired."""
    return created_ms + F.lit(ttl_ms)
