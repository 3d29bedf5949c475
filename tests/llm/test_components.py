import random
import uuid

import pytest

from attestra.llm.chosen_path import similar_groups
from attestra.llm.components import connected_components


def components_of(edges):
    group = {}

    def root(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((root(a), root(b)))
            group[high] = low
    return {x: root(x) for x in group}


@pytest.fixture()
def many_partitions(spark):
    """So many that the tasks of small results outnumber all others, as in a session that fixes them."""
    fixed = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in fixed}
    for key, value in fixed.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def tasks_of(spark, work):
    """What ``work`` returns and how many tasks it started."""
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, "counted")
    try:
        out = work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    infos = [tracker.getStageInfo(stage) for stage in stages]
    return out, sum(x.numCompletedTasks for x in infos if x is not None)


def shapes():
    rng = random.Random(3)
    path = list(range(1, 60))
    rng.shuffle(path)
    return {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(250)],
        "path": list(zip(path, path[1:])),
        "stars": [(x, x // 10 * 10) for x in range(100)] + [(30, 30)],
        "hubs": [(500, x) for x in range(80)] + [(x, 501) for x in range(60, 120)] + [(-3, 700)],
        "twice": [(1, 2), (2, 1), (1, 2), (4, 3), (None, 1), (5, None), (None, None), (7, 7)],
        "none": [],
    }


@pytest.mark.parametrize("name", shapes())
def test_components(spark, name):
    edges = shapes()[name]
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == sorted(components_of(edges).items())


def test_stars_take_no_round(spark, many_partitions):
    stars = spark.createDataFrame([(x, x // 10 * 10) for x in range(100)], "a long, b long")
    got, tasks = tasks_of(spark, lambda: connected_components(stars).collect())
    assert {tuple(x) for x in got} == {(x, x // 10 * 10) for x in range(100)}
    assert tasks < 10 * 40


def test_tasks_of_small_results(spark, many_partitions):
    """The driver's memory follows the number of tasks; the similarity join of a few hundred near
    copies, with large buckets down to the last level, took 5,511 before."""
    rng = random.Random(8)
    base = [rng.choice("abcdefgh") * rng.randrange(1, 9) + str(rng.randrange(99)) for _ in range(120)]
    rows = []
    for i in range(300):
        own = [f"w{rng.randrange(10**6)}" for _ in range(25)]
        rows.append((i, " ".join(base + own) if i % 3 else " ".join([*base[:60], str(i), *base[60:]])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, tasks = tasks_of(spark, lambda: similar_groups(docs).collect())
    assert len(got) == 300
    assert tasks < 100 * 40
