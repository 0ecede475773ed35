import random
import re

from logweave.llm.runs import collapse_events, found_runs

RECORD = "array<struct<ts_start timestamp, ts_end timestamp, cnt bigint, text string>>"


def like(text):
    return re.sub(r"\s+", "", re.sub(r"0x[0-9a-f]+|\d+(?:\.\d+)?", "#", (text or "").lower()))


def brute(events):
    out, k = set(), 0
    while k < len(events):
        j = k
        while j + 1 < len(events) and events[j + 1][0] == events[k][0] and like(events[j + 1][2]) == like(events[k][2]):
            j += 1
        run = events[k : j + 1]
        starts = [e[4] if e[4] is not None else e[5] for e in run if e[4] is not None or e[5] is not None]
        ends = [e[5] if e[5] is not None else e[4] for e in run if e[4] is not None or e[5] is not None]
        out.add((events[k][0], events[k][1], len(run), sum(e[3] or 0 for e in run), min(starts, default=None), max(ends, default=None)))
        k = j + 1
    return out


def test_runs_across_partitions(spark):
    rng = random.Random(1)
    events = []
    for sequence in ("a", "hot", "z"):
        for at in range(3000 if sequence == "hot" else 40):
            text = rng.choice(["Fan 1", "fan  22", "FAN 0x1f"]) if rng.random() < 0.97 else rng.choice(["door", None, ""])
            events.append((sequence, at, text, rng.choice([1, 2, None]), rng.choice([None, at * 10]), rng.choice([None, at * 10 + 5])))
    frame = spark.createDataFrame([(*e, "clash") for e in rng.sample(events, len(events))], "sequence string, at bigint, text string, cnt bigint, start_us bigint, end_us bigint, key string")
    assert {tuple(r) for r in collapse_events(frame).collect()} == brute(events)
    one = spark.createDataFrame([("s", i, "same 1", 1, i, i) for i in range(500)], "sequence string, at bigint, text string, cnt bigint, start_us bigint, end_us bigint")
    assert [tuple(r) for r in collapse_events(one).collect()] == [("s", 0, 500, 500, 0, 499)]
    assert collapse_events(one.limit(0)).count() == 0


def test_arrays(spark):
    import datetime as dt

    t = lambda s: dt.datetime(2016, 1, 1, 0, 0, s)
    rows = [
        (1, [(t(1), t(2), 1, "Fan 1.5 on"), (t(3), None, 2, "fan 0xAF  ON"), (None, None, None, "FAN 7on"), (t(9), t(9), 1, "off"), (None, None, 1, "x"), (None, None, 1, "X ")]),
        (2, []), (3, None), (4, [(t(1), t(2), 1, "x")]), (5, [None, (None, None, 1, None)]), (None, [(t(1), t(1), 1, "a"), (t(2), t(2), 1, "b")]),
        (6, [(t(1), t(1), 1, "y" * 200_000)] * 2), (6, [(t(1), t(1), 1, "y" * 200_000)] * 2),
    ]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], f"id bigint, content_json {RECORD}, first_pos string")
    got = sorted(tuple(r) for r in found_runs(frame).collect())
    assert got == [(1, 0, 3, 3, 2000), (1, 4, 2, 2, -1), (5, 0, 2, 1, -1), (6, 0, 2, 2, 0), (6, 0, 2, 2, 0)]
    assert found_runs(frame.limit(0)).count() == 0
    for per_block in (1, 2, 5):
        assert sorted(tuple(r) for r in found_runs(frame, per_block).collect()) == got


def test_long_arrays_in_blocks(spark):
    """Runs that end, begin and go on at the ends of blocks, also over several of them, against a loop."""
    rng = random.Random(3)
    arrays = [[(None, None, rng.choice([1, 2, None]), rng.choice(["fan 1", "Fan 2"] * 6 + ["door", None])) for _ in range(rng.randrange(2, 60))] for _ in range(60)]
    arrays += [[(None, None, 1, "same 7")] * n for n in (64, 65, 128, 129, 1000)]
    frame = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], f"id bigint, content_json {RECORD}")
    events = lambda i: [(i, k, r[3], r[2], None, None) for k, r in enumerate(arrays[i])]
    expected = sorted((i, at, n, c, -1) for i in range(len(arrays)) for _, at, n, c, _, _ in brute(events(i)) if n > 1)
    for per_block in (3, 7, 64):
        assert sorted(tuple(r) for r in found_runs(frame, per_block).collect()) == expected
