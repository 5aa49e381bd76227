"""What the driver has to keep of a query's plans and jobs: it grows with their number and size, not with rows."""

import random
import uuid

from chronopanel.llm import jaccard, mixing, sharding


def jobs_of(spark, action) -> int:
    """Jobs that an action starts; an exchange is one."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def longest_plan(spark, action) -> int:
    """Characters of the longest plan among an action's queries."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    ids = lambda: [store.executionsList().apply(i) for i in range(store.executionsList().size())]
    before = max((x.executionId() for x in ids()), default=-1)
    action()
    bus.waitUntilEmpty(30_000)
    return max(len(x.physicalPlanDescription()) for x in ids() if x.executionId() > before)


def test_mixing_has_no_plan_of_all_its_sums(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 9), "abcd"[i % 4]) for i in range(60)], "doc_id long, text string, source string")
    assert longest_plan(spark, lambda: mixing.mix(docs).count()) < 60_000  # 363,601 as one plan


def test_rounds_of_propagation_take_few_jobs(spark):
    rng = random.Random(3)
    nodes = spark.createDataFrame([(x,) for x in range(120)], "node long").localCheckpoint()
    links = spark.createDataFrame([(x, x - x % 6) for x in range(120) if x % 6] + [(rng.randrange(60), rng.randrange(60, 120)) for _ in range(20)], "a long, b long").localCheckpoint()
    few, more = (jobs_of(spark, lambda n=n: sharding.propagate(nodes, links, [32] * 4, rounds=n)) for n in (1, 3))
    assert (more - few) / 2 <= 15  # 18 before


def test_pointers_are_doubled_once(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").localCheckpoint()
    found = []
    assert jobs_of(spark, lambda: found.append(jaccard.components(edges).collect())) < 200  # 228 before
    assert {(r["v"], r["label"]) for r in found[0]} == {(i, 0) for i in range(41)}
