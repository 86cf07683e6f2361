"""Tasks of the near-duplicate join: the driver keeps a record of each."""

import random

from verdance.llm.components import components
from verdance.llm.ngram_join import _own


def _ran(spark, group, action):
    """Stages that ran, and their tasks."""
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        action()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    done = [x.numCompletedTasks for s in stages if (x := tracker.getStageInfo(s)) and x.numCompletedTasks]
    return len(done), sum(done)


def test_small_graphs_take_few_tasks(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 400, 2)], "a long, b long").repartition(40)
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, tasks = _ran(spark, "components", lambda: components(edges, "a", "b").count())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks < 400


def test_blocks_are_found_under_all_orders_at_once(spark):
    rng = random.Random(1)
    blocks = [(d, f"b{d % 7}") for d in range(40)]
    rows = [(w, rng.randrange(25), d, 9, 2) for w in range(3) for d in range(40) for _ in range(2)]
    rarest = spark.createDataFrame(rows, "ord int, token long, d1 long, n int, df long").distinct()
    met = {w: {f"b{b}" for b in range(7) for t in range(25) if len({d for o, token, d, *_ in rows if (o, token, d % 7) == (w, t, b)}) > 1} for w in range(3)}
    got = _own(rarest, spark.createDataFrame(blocks, "d1 long, block string"), [0, 1, 2])
    assert sorted(r.block for r in got.collect()) == sorted(met[0] & met[1] & met[2])
