import random

import numpy as np
import pytest

from logweave.llm import nearest as module
from logweave.llm.nearest import found_matches, nearest

LEFT, RIGHT = "entity string, at_us bigint, left_id bigint, tick string", "entity string, at_us bigint, right_id bigint, tick string"


def brute(left, right, tolerance):
    out = []
    for e, t, i in left:
        near = sorted((abs(t - u), u, j) for f, u, j in right if e is not None and t is not None and f == e and u is not None and abs(t - u) <= tolerance)
        if near:
            out.append((i, near[0][2]))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(11)
    pick = lambda: rng.choice(["hot"] * 4 + ["a", "b", None])
    left = [(pick(), rng.choice([None] + [rng.randrange(5000) for _ in range(9)]), i) for i in range(500)] + [("a", 10, 900), ("a", 10, 900)]
    right = [(pick(), rng.choice([None] + [rng.randrange(5000) for _ in range(9)]), i) for i in range(300)]
    right += right[:50] + [("hot", 77, i) for i in range(400, 600)]
    frames = spark.createDataFrame([(*r, "x") for r in left], LEFT), spark.createDataFrame([(*r, "x") for r in right], RIGHT)
    for tick in (7, 60, 100_000):
        assert sorted(tuple(r) for r in nearest(*frames, tolerance_us=45, tick_us=tick).collect()) == brute(left, right, 45)
    assert nearest(frames[0].limit(0), frames[1]).count() == 0 and nearest(frames[0], frames[1].limit(0)).count() == 0


@pytest.mark.parametrize("dense", [3, 40])
def test_finer_ticks_against_brute_force(spark, monkeypatch, dense):
    """Ticks that are cut again and again, with records at a few points of a tick, in clusters and evenly spread."""
    monkeypatch.setattr(module, "DENSE", dense)
    monkeypatch.setattr(module, "PARTS", 8)
    rng = random.Random(dense)
    at = lambda: rng.choice([rng.randrange(4000), 1000 + rng.randrange(30), 2500 + rng.randrange(200)])
    left = [(rng.choice("ab"), at(), i) for i in range(400)]
    right = [(rng.choice("aab"), at(), i) for i in range(600)]
    frames = spark.createDataFrame([(*r, "x") for r in left], LEFT), spark.createDataFrame([(*r, "x") for r in right], RIGHT)
    assert sorted(tuple(r) for r in nearest(*frames, tolerance_us=90, tick_us=700).collect()) == brute(left, right, 90)


def test_a_hundred_thousand_times_in_one_tick(spark):
    rng = np.random.default_rng(4)
    start = 1_500_000_300_000_000 // module.TICK_US * module.TICK_US
    times = np.unique(np.concatenate([start + rng.integers(0, module.TICK_US, 60_000), start + 5_000_000 + rng.integers(0, 1_000_000, 40_000)]))
    asked = start + rng.integers(-module.TICK_US, 2 * module.TICK_US, 3_000)
    frame = lambda values, name: spark.createDataFrame([("hot", int(t), i) for i, t in enumerate(values)], f"entity string, at_us bigint, {name} bigint")
    got = {r.left_id: r.right_id for r in nearest(frame(asked, "left_id"), frame(times, "right_id").repartition(4)).collect()}
    place = np.clip(np.searchsorted(times, asked), 1, len(times) - 1)
    best = np.where(asked - times[place - 1] <= times[place] - asked, place - 1, place)
    expected = {i: int(b) for i, (b, t) in enumerate(zip(best, asked, strict=True)) if abs(int(times[b]) - int(t)) <= module.TOLERANCE_US}
    assert got == expected


def test_tables(spark):
    match = "array<struct<source_path string>>"
    incidents = spark.createDataFrame([(1, 5, "2016-01-01T10:00:00+01:00"), (2, 5, None), (3, 6, "2016-01-01T09:00:00Z"), (4, None, "2016-01-01T09:00:00Z"), (5, 7, "nonsense")], "incident_id bigint, ticket_id bigint, mapped_date string")
    tickets = spark.createDataFrame([(5, ["Unit"], ["krv 1"]), (5, ["Unit"], ["krv 1"]), (6, ["Unit"], ["XX-1"]), (7, [" Vehicle "], ["#KRV-1"]), (8, None, None)], "ticket_id bigint, headers array<string>, row_values array<string>")
    results = spark.createDataFrame([(9, "2016-01-01 08:45:00Z", None, [("KRV-1/x",)]), (8, "2016-01-01 09:15:00Z", None, [("KRV-1\\x",)]), (7, "2016-01-01 09:15:00Z", None, [("KRV-1/x",)]), (6, None, None, []), (5, "2016-01-01 09:00:00Z", None, [("XX-1/x",)])], f"result_id bigint, source_ts string, normalized_timestamp string, match_list {match}")
    units = spark.createDataFrame([("KRV-1",)], "unit_code string")
    assert [tuple(r) for r in found_matches(incidents, tickets, results, units).collect()] == [(1, 9)]
