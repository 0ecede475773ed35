"""Joins with small sides."""

from logweave.functions.joins import salted, small
from logweave.session import ensure_checkpoint_dir


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_small_only_where_it_is(spark):
    side = spark.range(10).selectExpr("id as k")
    facts = spark.range(100).selectExpr("id % 20 as k", "id")
    assert "broadcast" in plan(facts.join(small(side, 10), "k")).lower()
    assert "strategy=broadcast" not in plan(facts.join(small(side, 9), "k")).lower()
    assert facts.join(small(side, 9), "k").count() == facts.join(small(side, 10), "k").count() == 50
    assert small(side.limit(0)).count() == 0


def test_salted_is_the_same_join(spark):
    facts = spark.createDataFrame([("hot", i) for i in range(200)] + [("cold", 900), ("alone", 901), (None, 902), ("hot", None)], "k string, i bigint")
    side = spark.createDataFrame([("hot", 1), ("cold", 2), ("other", 3), (None, 4)], "k string, v int")
    for how in ("left", "inner"):
        expected = sorted(map(str, facts.join(side, "k", how).collect()))
        assert sorted(map(str, salted(facts, side, ["k"], "i", 7, how).collect())) == expected
    assert salted(facts.limit(0), side, ["k"], "i").count() == 0


def test_checkpoint_folder(spark):
    assert ensure_checkpoint_dir(spark)
