"""Fixed windows that begin at an event: the first one at a key's first event, each next one at the
first event after the last has ended.

Which events begin windows depends on all before, yet a busy key is not one stream. Time is cut into
ranges. The next window after one that began at t begins at a place that depends on t alone, so every
range is turned, in parallel, into a table of pointers: from each event at which a window may begin as
the first of this range (one lies within a window's length of the range's begin) to the first such event
of a later range. Pointers are composed by doubling: after i rounds 2^i ranges are passed, so the rounds
grow with the logarithm of a key's ranges. What the chain reached fixes the window that is open where a
range begins; with it all ranges number their events independently, in order, with constant state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from attestra.session import cut_lineage

RANGE_WINDOWS = 256


def pointers(window_ms: int, width: int) -> Callable[[pa.Table], pa.Table]:
    """Entry pointers of one range of one key; ``copied`` marks times of the next range."""

    def run(held: pa.Table) -> pa.Table:
        held = held.sort_by("ts_ms").combine_chunks()
        times, counts = held["ts_ms"].to_numpy(), held["n"].to_numpy()
        n = int((~held["copied"].to_numpy(zero_copy_only=False)).sum())
        begin = held["_range"][0].as_py() * width
        beyond = held["beyond"][0].as_py()
        following = np.searchsorted(times, times[:n] + window_ms)
        last = np.where(following < n, following, np.arange(n))
        while True:
            further = last[last]
            if (further == last).all():
                break
            last = further
        entries = np.arange(min(n, int(np.searchsorted(times[:n], begin + window_ms)) + 1))
        final = last[entries]
        goal = following[final]
        reached = goal < len(times)
        to = [int(times[g]) if r else beyond for g, r in zip(goal.tolist(), reached.tolist())]
        total = np.cumsum(counts[:n])
        tail = total[n - 1] - total[final] + counts[final] if n else np.zeros(0, np.int64)
        return pa.table(
            {
                "k": held["k"].slice(0, len(entries)),
                "ts_ms": pa.array(times[entries]),
                "to_ms": pa.array(to, pa.int64()),
                "_range": held["_range"].slice(0, len(entries)),
                "last_ms": pa.array(times[final]),
                "tail": pa.array(tail, pa.int64()),
            }
        )

    return run


def numbered(window_ms: int, limit: int, columns: list[str]):
    """Numbers rows that arrive sorted by (key, range, time); only the open window is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, start, used = None, None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            times = batch.column("ts_ms").to_numpy(zero_copy_only=False)
            ranges = batch.column("_range").to_pylist()
            keys = batch.column("_k").to_pylist()
            begins, numbers = np.zeros(n, np.int64), np.zeros(n, np.int64)
            cuts = [0, *[i for i in range(1, n) if ranges[i] != ranges[i - 1] or keys[i] != keys[i - 1]], n]
            for low, high in zip(cuts, cuts[1:]):
                if (keys[low], ranges[low]) != current:
                    current = keys[low], ranges[low]
                    start, used = batch.column("carried")[low].as_py(), batch.column("carried_n")[low].as_py() or 0
                at = low
                while at < high:
                    if start is None or times[at] - start >= window_ms:
                        start, used = int(times[at]), 0
                    end = low + int(np.searchsorted(times[low:high], start + window_ms))
                    begins[at:end] = start
                    numbers[at:end] = used + 1 + np.arange(end - at)
                    used, at = used + end - at, end
            arrays = [batch.column(c) for c in columns]
            arrays += [pa.array(begins), pa.array(np.minimum(numbers, limit + 1).astype(np.int32)), pa.array(numbers <= limit)]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "window_start_ms", "attempt", "allowed"])

    return run


def _same(left: DataFrame, right: DataFrame) -> Column:
    """Equal keys and times; null is a key like any other."""
    return left["k"].eqNullSafe(right["other_k"])


def reached_entries(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(k, ts_ms): every entry the chain of each key passes, by pointer doubling."""
    reached = roots
    jumps = edges.filter("to_ms IS NOT NULL").select("k", "ts_ms", "to_ms")
    while True:
        hops = jumps.select(F.col("k").alias("other_k"), F.col("ts_ms").alias("from_ms"), "to_ms")
        met = reached.join(hops, _same(reached, hops) & (F.col("ts_ms") == F.col("from_ms")))
        fresh = cut_lineage(met.select("k", F.col("to_ms").alias("ts_ms")))
        if fresh.isEmpty():
            return reached
        reached = cut_lineage(reached.unionByName(fresh))
        doubled = jumps.join(
            hops.withColumnRenamed("to_ms", "end_ms"),
            jumps["k"].eqNullSafe(F.col("other_k")) & (jumps["to_ms"] == F.col("from_ms")),
        )
        jumps = cut_lineage(doubled.select("k", "ts_ms", F.col("end_ms").alias("to_ms")))


def open_windows(times: DataFrame, spans: DataFrame, window_ms: int, width: int) -> DataFrame:
    """(other_k, other_range, carried, carried_n): the window open where each range begins and the
    events it already holds."""
    early = F.col("ts_ms") - F.col("_range") * width < window_ms
    across = Window.partitionBy("k").orderBy("_range")
    ends = spans.select(F.col("k").alias("other_k"), F.col("_range").alias("other_range"), "beyond")
    copies = F.when(early, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    dealt = times.withColumn("copied", F.explode(copies)).withColumn(
        "_range", F.when(F.col("copied"), F.col("_range") - 1).otherwise(F.col("_range"))
    )
    meets = dealt["k"].eqNullSafe(ends["other_k"]) & (dealt["_range"] == ends["other_range"])
    kind = times.schema["k"].dataType.simpleString()
    edges = cut_lineage(
        dealt.join(ends, meets).select("k", "_range", "ts_ms", "n", "copied", "beyond")
        .groupBy("k", "_range")
        .applyInArrow(
            pointers(window_ms, width), f"k {kind}, ts_ms bigint, to_ms bigint, _range bigint, last_ms bigint, tail bigint"
        )
    )
    roots = spans.groupBy("k").agg(F.min("first").alias("ts_ms"))
    chain = reached_entries(edges, roots).select(F.col("k").alias("other_k"), F.col("ts_ms").alias("entry_ms"))
    passed = edges.join(chain, _same(edges, chain) & (F.col("ts_ms") == F.col("entry_ms"))).select(
        "other_k", F.col("_range").alias("other_range"), F.struct("last_ms", "tail").alias("open")
    )
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    return spans.join(
        passed, spans["k"].eqNullSafe(passed["other_k"]) & (spans["_range"] == passed["other_range"]), "left"
    ).withColumn("open", F.last("open", ignorenulls=True).over(earlier)).select(
        F.col("k").alias("other_k"), F.col("_range").alias("other_range"),
        F.col("open.last_ms").alias("carried"), F.col("open.tail").alias("carried_n"),
    )


def anchored_windows(
    events: DataFrame,
    key: str,
    window_ms: int,
    limit: int,
    order: tuple[str, ...] = (),
    range_windows: int = RANGE_WINDOWS,
) -> DataFrame:
    """``events`` with window_start_ms, attempt (``limit + 1`` at most) and allowed.

    A range's distinct times of one key are held by a task, its events stream.
    """
    width = window_ms * range_windows
    ranged = events.withColumn("_k", F.col(key)).withColumn("_range", F.floor(F.col("ts_ms") / width))
    times = ranged.groupBy(F.col("_k").alias("k"), "_range", "ts_ms").agg(F.count(F.lit(1)).alias("n"))
    early = F.col("ts_ms") - F.col("_range") * width < window_ms
    across = Window.partitionBy("k").orderBy("_range")
    spans = times.groupBy("k", "_range").agg(
        F.min("ts_ms").alias("first"), F.min(F.when(~early, F.col("ts_ms"))).alias("later")
    )
    # Where no copied time comes after a window's end, the next window begins at the first event
    # beyond the copied stretch.
    beside = F.lead("_range").over(across) == F.col("_range") + 1
    after_next = F.coalesce(F.lead("later").over(across), F.lead("first", 2).over(across))
    spans = cut_lineage(
        spans.withColumn("beyond", F.when(beside, after_next).otherwise(F.lead("first").over(across)))
        .withColumn("next_range", F.lead("_range").over(across))
    )
    if spans.filter("next_range IS NOT NULL").isEmpty():
        nothing = F.lit(None).cast("bigint")
        opened = spans.select(
            F.col("k").alias("other_k"), F.col("_range").alias("other_range"),
            nothing.alias("carried"), nothing.alias("carried_n"),
        )
    else:
        opened = open_windows(times, spans, window_ms, width)
    ready = ranged.join(
        opened, ranged["_k"].eqNullSafe(opened["other_k"]) & (ranged["_range"] == opened["other_range"])
    ).drop("other_k", "other_range")
    ready = ready.repartition("_k", "_range").sortWithinPartitions("_k", "_range", "ts_ms", *order)
    schema = S.StructType(list(events.schema)).add("window_start_ms", "long").add("attempt", "integer").add("allowed", "boolean")
    return ready.mapInArrow(numbered(window_ms, limit, events.columns), schema)
