import random

import pytest
from pyspark.sql import functions as F

from attestra.operators import limits
from tests import model


def events(spark, seed, n=400, keys=3, span=4000, hot=0.5):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 1, 2, 3, 40, 130]) if rng.random() < 0.9 else rng.randrange(span)
        rows.append((i, 0 if rng.random() < hot else rng.randrange(keys), rng.randrange(4), t))
    return rows, spark.createDataFrame(rows, "event_id int, k int, client int, ts_ms bigint")


@pytest.mark.parametrize("seed, ranges", [(0, 256), (1, 1), (2, 2), (3, 5)])
def test_attempt_windows(spark, seed, ranges):
    rows, frame = events(spark, seed)
    got = {r["event_id"]: r for r in limits.attempt_windows(
        frame, "k", window_ms=100, limit=3, order=("event_id",), range_windows=ranges).collect()}
    want = model.attempts([(k, t) for _, k, _, t in rows], 100, 3)
    assert [got[i]["allowed"] for i in range(len(rows))] == want
    assert all(g["attempt"] == 4 for g in got.values() if not g["allowed"])


def test_a_key_that_never_pauses_is_spread_over_ranges(spark):
    # Every millisecond but some, so the windows' phase is never lost; one key is null.
    times = [t for t in range(3000) if t % 7 and t % 11]
    rows = [(i, k, t) for i, (k, t) in enumerate([(k, t) for k in (None, 4) for t in times for _ in range(1 + t % 2)])]
    frame = spark.createDataFrame(rows, "event_id int, k int, ts_ms bigint").repartition(4)
    out = limits.attempt_windows(frame, "k", window_ms=20, limit=9, order=("event_id",), range_windows=4)
    got = {r["event_id"]: (r["window_start_ms"], r["attempt"], r["allowed"]) for r in out.collect()}
    start, used, before = None, 0, object()
    for i, k, t in rows:
        if k != before or t - start >= 20:
            before, start, used = k, t, 0
        used += 1
        assert got[i] == (start, min(used, 10), used <= 9), (i, k, t)
    # Small partitions would be merged into one.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    busy = out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(busy) > 1 and max(r["count"] for r in busy) < 0.6 * len(rows)
    assert limits.attempt_windows(frame.limit(0), "k").collect() == []


def test_the_sixth_attempt_is_refused_and_the_window_ends_inclusively(spark):
    frame = spark.createDataFrame(
        [(i, 1, i) for i in range(6)] + [(6, 1, limits.ATTEMPT_WINDOW_MS)],
        "event_id int, k int, ts_ms bigint")
    got = {r["event_id"]: r["allowed"] for r in limits.attempt_windows(frame, "k").collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False, 6: True}


@pytest.mark.parametrize("seed", range(3))
def test_write_limits(spark, seed):
    rows, frame = events(spark, seed)
    got = {r["event_id"]: r["allowed"] for r in limits.write_limits(
        frame, "k", "client", 100, 2, 4, order=("event_id",)).collect()}
    want = model.write_limits([(k, c, t) for _, k, c, t in rows], 100, 2, 4)
    assert [got[i] for i in range(len(rows))] == want


def test_admission_equals_the_model():
    rng, now, rows = random.Random(1), 0, []
    for _ in range(500):
        now += rng.randrange(4)
        rows.append((rng.randrange(40), now))
    want = model.write_limits([(0, c, t) for c, t in rows], 10, 2, 5)
    assert list(limits.admitted(rows, 10, 2, 5)) == want


def test_capacity(spark):
    rows, frame = events(spark, 1)
    for capacity in (5, 1500):
        got = limits.within_capacity(frame, "k", ["ts_ms", "event_id"], capacity)
        want = {}
        for _, k, _, _ in rows:
            want[k] = min(capacity, want.get(k, 0) + 1)
        assert got.count() == sum(want.values())


@pytest.mark.parametrize("seed", range(3))
def test_sessions(spark, seed):
    rows, frame = events(spark, seed, span=300)
    logins, asks = frame.filter("client = 0"), frame.filter("client <> 0")
    got = {r["event_id"]: r["authorized"] for r in limits.session_validity(
        logins, asks, "k", idle_ms=50, absolute_ms=400).collect()}
    for i, k, c, t in rows:
        if c:
            starts = [t2 for _, k2, c2, t2 in rows if k2 == k and c2 == 0 and t2 <= t]
            assert got[i] == bool(starts and t - max(starts) < 50), i


@pytest.mark.parametrize("seed", range(3))
def test_challenges(spark, seed):
    rows, frame = events(spark, seed, span=300)
    got = {r["event_id"]: r["accepted"] for r in limits.challenge_consumption(
        frame.filter("client = 0"), frame.filter("client = 1"), "k", ttl_ms=60).collect()}
    used = set()
    accepted = 0
    for i, k, c, t in rows:
        if c != 1:
            continue
        marks = [t2 for _, k2, c2, t2 in rows if k2 == k and c2 == 0 and t2 <= t]
        ok = bool(marks) and t - max(marks) < 60 and (k, max(marks)) not in used
        if ok:
            used.add((k, max(marks)))
        accepted += ok
    assert sum(got.values()) == accepted
