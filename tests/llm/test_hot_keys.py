"""A component with a very large star is split over tasks, in every round."""

import pytest

from tessera.llm.common import connected_components, star_round

SPLIT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def splitting(spark):
    before = {k: spark.conf.get(k, None) for k in SPLIT}
    for k, v in SPLIT.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_star_is_split(splitting):
    star = splitting.range(1, 300_000).selectExpr("id u", "0L v")
    done = star_round(star)
    assert done.count() == 299_999
    plan = done.groupBy().count()
    plan.collect()
    assert "skew=true" in plan._jdf.queryExecution().executedPlan().toString()


def test_star_and_chain(splitting):
    links = [(i, 0) for i in range(1, 20_000)] + [(i, i + 1) for i in range(30_000, 30_040)] + [(None, 3), (7, 7)]
    edges = splitting.createDataFrame(links, "u long, v long")
    found = {r.node: r.root for r in connected_components(edges).collect()}
    assert found == {i: 0 for i in range(1, 20_000)} | {i: 30_000 for i in range(30_001, 30_041)}
