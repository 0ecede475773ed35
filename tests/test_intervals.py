import random

from logweave.functions.prefix import ranked, running_sum
from logweave.operators.intervals import found_periods, periods_and_gaps

SCHEMA = "entity string, start_us bigint, end_us bigint, rank string, k string"


def brute(intervals):
    out = set()
    for entity in {e for e, *_ in intervals if e is not None}:
        own = sorted((s, t) for e, s, t in intervals if e == entity and s is not None and t is not None and s <= t)
        merged = []
        for s, t in own:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], t)
            else:
                merged.append([s, t])
        out |= {(entity, "period", s, t) for s, t in merged}
        out |= {(entity, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:], strict=False)}
    return out


def test_against_brute_force(spark):
    rng = random.Random(7)
    data = []
    for _ in range(900):
        start = rng.randrange(2000)
        data.append((rng.choice(["hot", "hot", "hot", "a", "b"]), start, start + rng.choice([0, 0, 1, 3, 20, -5])))
    data += data[:100] + [(None, 1, 2), ("c", None, 2), ("c", 1, None), ("d", 5, 5), ("e", 1, 2), ("e", 2, 3)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA)
    for width in (7, 10_000):
        assert {tuple(r) for r in periods_and_gaps(frame, width=width).collect()} == brute(data)


def test_empty_and_paths(spark):
    assert periods_and_gaps(spark.createDataFrame([], SCHEMA)).count() == 0
    schema = "source_path string, time_start timestamp, time_end timestamp, has_time boolean"
    rows = spark.sql("select * from values ('a/b', timestamp '2016-01-01', timestamp '2016-01-02', true), ('a\\\\b', timestamp '2016-01-02', timestamp '2016-01-03', true), ('a/b', timestamp '2017-01-01', timestamp '2017-01-02', false), (null, null, null, null) as t(source_path, time_start, time_end, has_time)")
    assert [r.kind for r in found_periods(rows).collect()] == ["period"]
    assert found_periods(spark.createDataFrame([], schema)).count() == 0


def test_ranks(spark):
    frame = spark.createDataFrame([("a", i * 3 % 50) for i in range(50)] + [("b", 1), ("b", 1)], "key string, v bigint")
    got = sorted((r.key, r.v, r["rank"]) for r in ranked(frame, ["key"], "v", 4).collect())
    assert got == [("a", i, i + 1) for i in range(50)] + [("b", 1, 1), ("b", 1, 2)]


def test_running_sums(spark):
    data = [("a", 5, 2), ("a", 1, None), ("a", 900, 3), ("a", -7, 1), ("b", 0, 4)]
    frame = spark.createDataFrame(data, "key string, at bigint, v bigint")
    assert sorted(tuple(r) for r in running_sum(frame, ["key"], "at", "v", 10).select("key", "at", "running").collect()) == [("a", -7, 1), ("a", 1, 1), ("a", 5, 3), ("a", 900, 6), ("b", 0, 4)]
