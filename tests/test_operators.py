import random

import pytest
from pyspark.sql import functions as F

from logweave.functions.paths import path_anchor, path_date
from logweave.operators import catalog, dedup, matching, metrics, records, search, stats
from logweave.plans import metrics as plans
from logweave.plans import more
from logweave.sources import store


def test_similarity(spark):
    frame = spark.createDataFrame([("two words",), ("word",), ("",), (None,), ("WORD!",)], "t string")
    got = [round(r[0], 6) for r in frame.select(search.similarity(F.col("t"), "word")).collect()]
    assert got == [0.363636, 1.0, 0.0, 0.0, 1.0]
    assert frame.select(search.similarity(F.col("t"), "")).first()[0] == 0.0


def test_selector(spark):
    chunks = spark.sql(
        "select * from values (1L, 'a', 0, 'fan 100%', timestamp '2016-01-01', timestamp '2016-01-02', true), (2L, 'a', 1, 'FAN', null, null, false), (3L, 'b', 0, 'door', timestamp '2015-01-01', timestamp '2015-01-02', true), "
        "(4L, null, null, null, null, null, null) as t(id, source_path, chunk_id, content_text, time_start, time_end, has_time)"
    )
    ids = lambda **k: [r.id for r in search.record_selector(chunks, **k).collect()]
    assert ids(limit=12) == [3, 1, 4, 2] and ids() == [3]
    assert ids(exact_pattern="fan", limit=12) == [1, 2] and ids(exact_pattern="f%0", limit=2) == [1]
    assert ids(source_path="a", limit=12) == [1, 2] and ids(start_ts="2016-01-02", end_ts="2016-01-05", limit=12) == [1] and ids(end_ts="2015-12-31", limit=9) == [3]
    assert ids(similarity_pattern="fan", limit=12) == [2, 1] and ids(similarity_pattern="zzz", limit=3) == []
    with pytest.raises(ValueError, match="limit"):
        search.record_selector(chunks, limit=13)
    assert {(r.hit_id, r.id) for r in search.neighbours(chunks.where("id = 1"), chunks).collect()} == {(1, 1), (1, 2)}
    assert search.record_selector(chunks.limit(0), similarity_pattern="x").count() == 0


def test_upsert(spark, tmp_path):
    folder = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, source_path string, chunk_id int, loaded_at timestamp, content_text string")
    import datetime as dt

    assert store.read_state(spark, folder) is None
    store.upsert_chunks(spark, folder, frame([(1, "a", 0, dt.datetime(2016, 1, 1), "old"), (2, "a", 1, dt.datetime(2016, 1, 1), "keep"), (3, "a", 1, None, "undated")]))
    store.upsert_chunks(spark, folder, frame([(4, "a", 0, dt.datetime(2016, 1, 2), "new")]))
    assert sorted(r.content_text for r in store.read_state(spark, folder).collect()) == ["keep", "new"]
    samples = spark.createDataFrame([("i", "r1", [(1.5,), (None,)]), ("j", "r1", None)], "incident_id string, run string, usages array<struct<cost:double>>")
    store.append_samples(samples, str(tmp_path / "log"))
    store.append_samples(samples, str(tmp_path / "log"))
    assert [(r.n, r.total) for r in store.cost_totals(store.read_samples(spark, str(tmp_path / "log"))).collect()] == [(4, 3.0)]


def test_dedup_is_idempotent_and_keeps_counts(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice(["x", "y", None, ""]), rng.choice([None, 1, 3])) for _ in range(300)]
    frame = spark.createDataFrame(rows, "source_path string, text string, cnt bigint").withColumns({"ts_start": F.lit(None).cast("timestamp"), "ts_end": F.lit(None).cast("timestamp")})
    once = dedup.dedup_lines(frame).cache()
    assert once.agg(F.sum("cnt")).first()[0] == sum(1 if c is None else c for *_, c in rows)
    assert sorted(map(str, dedup.dedup_lines(once).collect())) == sorted(map(str, once.collect()))
    assert dedup.dedup_lines(frame.limit(0)).count() == 0


def test_packing_fold(spark):
    rng = random.Random(3)
    lists = [[rng.randrange(1, 60) for _ in range(rng.randrange(30))] for _ in range(50)] + [[], [500], [50, 50, 1], [100, 1, 99]]
    frame = spark.createDataFrame([(x,) for x in lists], "l array<int>")
    assert [r[0] for r in frame.select(dedup.packed_chunks(F.col("l"), 100)).collect()] == [dedup.pack_sequence(x, 100) for x in lists]


@pytest.mark.parametrize("size", [20, 50, 200])
def test_recursive_split(size):
    rng = random.Random(size)
    text = "".join(rng.choice(["word ", "longerword\t", "end.\n", "\n\n", "x" * 30]) for _ in range(80))
    found = dedup.recursive_split(text, size)
    assert all(0 < len(p) <= size and p == p.strip() for p in found)
    assert set("".join(text.split())) == set("".join("".join(found).split()))
    assert dedup.recursive_split("", size) == [] and dedup.recursive_split("a b", size) == ["a b"]


def test_line_times(spark):
    cases = [
        ("21-12-16 10:00:00.25 x", "short_yy-mm-dd", "2021-12-16 10:00:00.250000", "<time> x"), ("68-01-01T10:00:00", "short_yy-mm-dd", "2068-01-01 10:00:00", "<time>"), ("69-01-01 10:00:00", "short_yy-mm-dd", "1969-01-01 10:00:00", "<time>"),
        ("a Mon Mar 10 21:52:05 UTC 2025 b", "text_with_dow", "2025-03-10 21:52:05", "a <time> b"), ("Sun Mar 10 21:52:05 2025", "text_with_dow", "2025-03-10 21:52:05", "<time>"), ("Sep  1 2015, 17:47:02", "syslog_year_comma", "2015-09-01 17:47:02", "<time>"),
        ("Aug  1 2022 04:00:50", "syslog_with_year", "2022-08-01 04:00:50", "<time>"), ("Xyz 1 2022 04:00:50 x", "syslog_with_year", None, "<time> x"), ("Mar  7 21:52:05 up", "syslog_no_year+1970", "1970-03-07 21:52:05", "<time> up"), ("Feb 29 10:00:00", "syslog_missing_year", None, "<time>"),
        ("2025-03-11T08:18:47+02:00 x", "iso", "2025-03-11 06:18:47", "<time> x"), ("2025-03-11 08:18:47.5Z", "iso", "2025-03-11 08:18:47.500000", "<time>"), ("2025-03-11T08:18:47.1234567Z", "iso", "2025-03-11 08:18:47", "<time>.1234567Z"),
        ("2025-03-11 08:18:47 and 2025-03-11 08:18:48", "iso", "2025-03-11 08:18:47", "<time> and 2025-03-11 08:18:48"), ("2025-03-11", "date_only", "2025-03-11 00:00:00", "<time>"), ("25-03-11 x", "date_only", "2025-03-11 00:00:00", "<time> x"),
        ("12-34-56", "date_only", None, "<time>"), ("2025-13-11", "date_only", None, "<time>"), ("0000-01-01", "date_only", None, "<time>"), ("none", None, None, "none"),
    ]
    frame = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)] + [(99, None), (98, " \r\n\t")], "i int, line string")
    read = frame.select("i", F.explode(records.parsed_lines(F.col("line"), F.lit(None).cast("int"))).alias("r")).select("i", "r.*").collect()
    assert {r.i: (r.parser, str(r.ts) if r.ts else None, r.text) for r in read} == {i: c[1:] for i, c in enumerate(cases)}
    anchored = frame.where("i in (8, 9)").select(F.explode(records.parsed_lines(F.col("line"), F.lit(2016))).alias("r")).select("r.*").collect()
    assert [(r.parser, str(r.ts)) for r in anchored] == [("syslog_no_year+anchor", "2016-03-07 21:52:05"), ("syslog_missing_year", "None")]


def test_path_anchors(spark):
    cases = [
        ("a/2016-01-02T03_04_05/x", 1001, "2016-01-02 03:04:05"), ("a\\2016-01-02_03_04_05\\2015-01-01T00_00_00", 1002, "2015-01-01 00:00:00"), ("a/1.2.70/3.4.71", 102, "1971-04-03 00:00:00"), ("1.2.70", 100, "2070-02-01 00:00:00"), ("a/1.2.70/3.4.1971", 152, "1971-04-03 00:00:00"), ("u/5.6.71", 101, "1971-06-05 00:00:00"),
        ("a/07.03.25_22.14", 801, "2025-03-07 22:14:00"), ("hmi_131122_0628\\log", 750, "2022-11-13 06:28:00"), ("a/17 Jan 23/b", 671, "2023-01-17 00:00:00"), ("a/x 7  SEPTEMBER 23", 671, "2023-09-07 00:00:00"), ("a/17 Jan 2023", None, None),
        ("x_010216/y_020316", 651, "2016-03-02 00:00:00"), ("x_710126_y/z", None, None), ("a/run 10.3.2025 x/b", 151, "2025-03-10 00:00:00"), ("a//run-10-3-25b", 101, "2025-03-10 00:00:00"), ("a/30.2.2016/x", None, None), ("a/1.2.20161", None, None),
        ("a/2016-13-02T03_04_05 1.2.16", None, None), ("x_310216/1.2.16", 101, "2016-02-01 00:00:00"), ("", None, None), (None, None, None), ("1.2.16/1.3.16", 101, "2016-03-01 00:00:00"),
    ]
    found = spark.createDataFrame([(p,) for p, *_ in cases], "p string").select(path_anchor(F.col("p")).alias("a")).collect()
    assert [(r.a.score, str(r.a["at"])) if r.a else (None, None) for r in found] == [c[1:] for c in cases]
    assert [(d[0], str(d[1])) if d else (None, None) for d in map(path_date, (c[0] for c in cases))] == [c[1:] for c in cases]


def test_assembly_against_a_loop(spark):
    """Both forms of the assembly, with and without a window, against a state machine line by line."""
    import datetime as dt

    rng = random.Random(9)
    first, last = dt.datetime(2016, 1, 8), dt.datetime(2016, 1, 20)
    texts, plain, windowed, unanchored = [], {}, {}, {}
    for key in range(120):
        anchor = rng.choice([None, dt.datetime(2016, 1, 5), dt.datetime(2016, 1, 10, 3)])
        written = [rng.choice(["", "  ", "body", "other 12", f"2016-01-{rng.randrange(1, 28):02d} 10:00:00 x", "2016-02-31 10:00:00 bad"]) for _ in range(rng.randrange(14))]
        texts.append((key, rng.choice(["\n", "\r\n", "\r"]).join(written), anchor, 1))
        current = inside = None
        for n, line in enumerate(x.strip() for x in written):
            if not line:
                continue
            timed = line.startswith("2016-01")
            ts = dt.datetime.strptime(line[:19], "%Y-%m-%d %H:%M:%S") if timed else None
            text = "<time>" + line[19:] if line.startswith("2016") else line
            if timed:
                current, inside = (key, n), first <= ts <= last
                plain[current] = unanchored[current] = [ts, text]
                if inside:
                    windowed[current] = [ts, text]
            elif current is None:
                plain[key, n], unanchored[key, n] = [anchor, text], [None, text]
                if anchor is None:
                    windowed[key, n] = [None, text]
                elif first <= anchor <= last:
                    head = next((k for k in windowed if k[0] == key), None)
                    windowed[head or (key, n)] = [anchor, windowed[head][1] + "\n" + text if head else text]
            else:
                plain[current] = unanchored[current] = [plain[current][0], plain[current][1] + "\n" + text]
                if inside:
                    windowed[current] = [windowed[current][0], windowed[current][1] + "\n" + text]
    frame = spark.createDataFrame(texts + [(900, None, None, 1), (901, "", first, 1)], "id int, body string, anchor timestamp, ts int")
    of = lambda rows: {(r.id, r.line_no): [r.ts, r.text] for r in rows.collect()}
    window = F.lit("2016-01-08").cast("timestamp"), F.lit("2016-01-20").cast("timestamp")
    assert of(records.assemble_texts(frame, "id", "body", "anchor")) == plain
    assert of(records.assemble_texts(frame, "id", "body", "anchor", *window)) == windowed
    assert of(records.assemble_texts(frame, "id", "body", "anchor", *window, static=False)) == {k: v for k, v in windowed.items() if v[0] is not None}
    lines = frame.select("id", F.explode(records.parsed_lines(F.col("body"), F.lit(2016))).alias("r")).select("id", "r.*")
    assert of(records.assemble(lines, "id")) == unanchored
    assert records.assemble_texts(frame.limit(0), "id", "body", "anchor").count() == 0


def test_windows(spark):
    rng = random.Random(5)
    day = matching.DAY_US
    points = [(rng.choice(["u", "v", None]), i, rng.choice([None, rng.randrange(9 * day)])) for i in range(60)]
    recs = [(rng.choice(["u", "v", "w", None]), i, rng.choice([None, rng.randrange(9 * day)])) for i in range(400)]
    p, r = spark.createDataFrame(points, "unit string, point_id bigint, at_us bigint"), spark.createDataFrame(recs, "unit string, record_id bigint, at_us bigint")
    brute = {(i, j) for u, i, t in points for v, j, s in recs if u and u == v and t is not None and s is not None and t - day <= s <= t + day // 2}
    known = p.where("at_us is not null")
    assert {(x.point_id, x.record_id) for x in matching.window_join(known, r.where("at_us is not null"), day, day // 2).collect()} == brute
    assert {x.point_id: x.n for x in matching.window_counts(p, r, day, day // 2).collect()} == {i: sum(a == i for a, _ in brute) for _, i, _ in points}


def test_rows_that_quote_lines(spark):
    cell = lambda c, v: (c, "h", v)
    rows = [
        (1, 1, 1, ["d1", "d1"], [cell("A", "Fan  FROZE at 3"), cell("B", None), cell("C", "door open | fan froze at 3")]), (2, 1, 2, ["d1", "d2"], [cell("A", "door"), cell("B", "open")]), (3, 2, 1, None, [cell("A", "fan froze at 3")]), (4, 2, 2, ["d2"], None),
    ]
    lines = [(7, "d1", "<time> - fan froze at 3"), (7, "d1", "door open"), (7, "d1", "door | open"), (7, "d1", "<time> - fan froze at 3"), (8, "d2", "door open"), (8, "d2", "oor"), (9, "d1", "fan froze at 4"), (9, None, "door open"), (9, "d1", None)]
    r = spark.createDataFrame(rows, "ticket_id int, sheet_id int, row_no int, matched_dates array<string>, cells array<struct<col_letter string, header_name string, cell_value string>>")
    n = spark.createDataFrame(lines, "result_id int, matched_date string, line string")
    got = {(x.result_id, x.ticket_id): (x.score, x.matched_cells) for x in matching.score_rows(n, r).collect()}
    assert got == {(7, 1): (2, {"A": 1, "C": 2}), (7, 2): (1, {})}
    shapes = {(x.result_id, x.ticket_id): x.score for x in matching.score_rows(n, r, shapes=True).collect()}
    assert shapes == {(7, 1): 2, (7, 2): 1, (9, 1): 1}
    assert matching.score_rows(n.limit(0), r).count() == 0 and matching.score_rows(n, r.limit(0)).count() == 0


def test_signed_rank():
    assert stats.signed_rank([1, 2, 3, 4, 5]) == (0.0, 0.0625)
    assert stats.signed_rank([]) == (0.0, 1.0) and stats.signed_rank([0, 0]) == (0.0, 1.0)
    statistic, p = stats.signed_rank([1, -2, 3, -4, 5, 6, 7, -8, 9, 10])
    assert statistic == 14 and abs(p - 0.193359375) < 1e-9
    statistic, p = stats.signed_rank([1, 1, -1, 2, 0, 3])
    assert statistic == 2 and 0 < p < 1


def test_metrics(spark):
    assert [metrics.porter_stem(w) for w in ("caresses", "ponies", "cats", "agreed", "plastered", "motoring", "hopping", "happy", "relational", "rational", "electrical", "hopefulness", "adjustment", "controll", "rate", "sky", "is")] == [
        "caress", "poni", "cat", "agre", "plaster", "motor", "hop", "happi", "relat", "ration", "electr", "hope", "adjust", "control", "rate", "sky", "is",
    ]
    assert metrics.common_subsequence("a b c d".split(), "b x d a".split()) == 2
    assert metrics.consume_words("a b c", ["b", "a c"]) == (3, 5, 2, 3)  # removing b glues its neighbours
    assert metrics.consume_words("x a y a z", ["a"]) == (6, 9, 4, 5) and metrics.consume_words("", ["a"]) == (0, 0, 0, 0)
    assert metrics.generated_recall([], ["x"]) == (0.0, 0.0, 0.0) and metrics.generated_recall(["ab cd", ""], ["ab"]) == (0.5, 0.5, 1.0)
    assert metrics.generated_recall(["a a b"], ["a"])[1] == 2 / 3 and metrics.generated_recall(["door"], ["Door"]) == (0.0, 0.0, 0.0)
    assert metrics.generated_recall(["a b c"], ["", "b c", "a"]) == (2 / 3, 2 / 3, 1.0)  # nothing is read behind a hit
    pairs = spark.createDataFrame([(1, "a b c", "a b d"), (2, "", "x"), (3, None, None)], "id int, target string, predicted string")
    assert {r.id: (round(r.precision, 3), round(r.recall, 3)) for r in metrics.rouge_l(pairs).collect()} == {1: (0.667, 0.667), 2: (0.0, 0.0), 3: (0.0, 0.0)}
    got = {r.id: r.recall for r in metrics.ngram_overlap(pairs.where("id < 3"), 2).collect()}
    assert got == {1: 0.5, 2: 0.0}
    lists = spark.createDataFrame([(1, ["abcd", "xy"], ["bc", "b"], ["q"])], "id int, target array<string>, predicted array<string>, asked array<string>")
    assert metrics.containment(lists).first().chars == 2
    lines = metrics.presence(lists.withColumn("got", F.array(F.lit("abcd and xy"))).withColumn("said", F.array(F.lit("xy"))), ("asked", "got", "said"))
    row = metrics.grounded(lines, ("got", "said"), "asked").first()
    assert (row.n_lines, row.got_lines, row.said_lines, row.said_chars) == (2, 2, 1, 2)


def test_small_statistics(spark):
    values = spark.createDataFrame([(x,) for x in (1, 1, 2, 5, None)], "v bigint")
    assert {r.bin: r.n for r in stats.histogram(values, "v", 4).collect()} == {1: 2, 2: 1, 4: 1}
    assert {r.value: (r.cdf, r.ccdf) for r in stats.distribution(values, "v", 2.0).collect()} == {1: (0.5, 1.0), 2: (0.75, 0.5), 5: (1.0, 0.25)}
    assert stats.histogram(values.limit(0), "v", 4).count() == 0 and stats.distribution(values.where("v is null"), "v").count() == 0
    same = spark.createDataFrame([("k", 3), ("k", 3)], "k string, v bigint")
    assert {r.scaled for r in stats.min_max(same, ["k"], "v").collect()} == {0.5}
    ranks = spark.createDataFrame([("k", 1), ("k", 2), ("k", 2), ("k", 3)], "k string, v int")
    assert sorted(r.avg_rank for r in search.averaged_ranks(ranks, ["k"], "v").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_catalogue_helpers(spark):
    names = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "n bigint, name string")
    assert [r.unique for r in catalog.unique_names(names, "name", "n").orderBy("key").collect()] == ["a", "1-a", "b", "2-a"]
    listing = spark.createDataFrame([("f", x) for x in ("a", "h1", "h2", "k", "h3")], "folder string, name string")
    assert sorted((r.first_name, r.n) for r in catalog.collapse_siblings(listing, "h").collect()) == [("a", 1), ("h1", 3)]
    days = catalog.dated_folders(spark.createDataFrame([("x/2016-01-02T03/y",), ("2016-02-30",), (None,)], "p string"), "p")
    assert [str(r.day) for r in days.collect()] == ["2016-01-02"]
    sizes = spark.createDataFrame([(0,), (1024,), (1 << 30,), (None,)], "n bigint").select(catalog.human_size(F.col("n"))).collect()
    assert [r[0] for r in sizes][:3] == ["0.00 B", "1.00 KB", "1.00 GB"]
    dec = catalog.decide_files(spark.createDataFrame([("a.log",), ("b.js",), ("c",)], "p string"), "p", {"log": True, "js": False})
    assert [r.wanted for r in dec.collect()] == [True, False, None]
    files = spark.createDataFrame([("A.LOG", bytearray(b"hello")), ("b.txt", bytearray(b"x")), ("c.log", bytearray(b""))], "path string, content binary")
    assert {r.path: r.head for r in catalog.peek(files, ".log", 2).collect()} == {"A.LOG": "he", "c.log": ""}


def test_build(spark):
    from logweave.operators import build

    rng = random.Random(8)
    texts = [f"event {i} " + "x" * rng.randrange(80) for i in range(40)] + ["y" * 500, "", None]
    recs = [(rng.choice("uv"), rng.choice("ab"), rng.choice([None] + [rng.randrange(4 * matching.DAY_US) for _ in range(9)]), rng.choice(texts), rng.choice([1, 3, None])) for _ in range(3000)]
    incidents = [("u", 1, 2 * matching.DAY_US), ("v", 2, matching.DAY_US // 2), ("w", 3, 5), (None, 4, 5), ("u", 5, None)]
    records_frame = spark.createDataFrame(recs, "unit string, source_path string, ts_us bigint, text string, cnt bigint")
    incident_frame = spark.createDataFrame(incidents, "unit string, incident_id bigint, at_us bigint")
    inside = [(i, s, t, x, c or 1) for u, i, at in incidents for v, s, t, x, c in recs if u and u == v and at is not None and t is not None and abs(at - t) <= matching.DAY_US]
    lines = build.deduplicated(build.window_records(incident_frame, records_frame)).cache()
    assert lines.agg(F.sum("cnt")).first()[0] == sum(c for *_, c in inside)
    for block in (7, 5000):
        chunks = build.packed(lines, 300, block).cache()
        assert max(r.n_chars for r in chunks.collect()) <= 300
        joined = {}
        for r in sorted(chunks.collect(), key=lambda r: (r.incident_id, r.source_path, r.chunk_id)):
            seen = joined.setdefault((r.incident_id, r.source_path), [[], []])
            seen[0].append(r.chunk_id)
            seen[1] += r.content
        for (incident, source), (ids, content) in joined.items():
            assert ids == list(range(len(ids)))
            assert sum(len(c.text) for c in content) == sum(len(x or "") for x in {x for i, s, _, x, _ in inside if (i, s) == (incident, source)})
            assert [c.ts_end for c in content] == sorted(c.ts_end for c in content)
    assert build.build(incident_frame.limit(0), records_frame).count() == 0


def test_longest_contained_against_all_pairs(spark):
    rng = random.Random(12)
    word = lambda: rng.choice(["a", "b", "cc", "d1", "fan", ""])
    texts = [(i, " ".join(word() for _ in range(rng.randrange(12)))) for i in range(200)] + [(900, None)]
    lines = [" ".join(word() for _ in range(rng.randrange(1, 7))) for _ in range(150)] + ["n b cc", "x y z", None, "", "an", "c", " ", "n c", "d1 fan a", "an a", "zz"]
    got = {r.id: r.covered for r in metrics.longest_contained(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    brute = {i: max(len(x) for x in lines if x and x in t) for i, t in texts if t and any(x and x in t for x in lines)}
    assert got == brute
    assert metrics.longest_contained(spark.createDataFrame([], "id int, text string"), spark.createDataFrame([("a b c",)], "line string")).count() == 0


def test_stemmed_overlap(spark):
    pairs = spark.createDataFrame([(1, "The doors were closing, doors closed", "a door closes"), (2, None, "x"), (3, "same same", "same")], "id int, target string, predicted string")
    assert {r.id: (round(r.precision, 3), round(r.recall, 3)) for r in metrics.ngram_overlap(pairs, 1, stem=True).collect()} == {1: (0.667, 0.333), 2: (0.0, 0.0), 3: (1.0, 0.5)}
    assert {r.id: r.precision for r in metrics.ngram_overlap(pairs, 2, stem=True).collect()} == {1: 0.5, 2: 0.0, 3: 0.0}
    assert {r.id: r.precision for r in metrics.ngram_overlap(pairs, 1).collect()} == {1: 0.0, 2: 0.0, 3: 1.0}


def test_every_reference_text_is_scored(spark, tmp_path):
    """Also those whose transcript is of another day, and those that have none."""
    rows = [(1, "fan hot", "rca", "U1", "2016-01-05 10:00:00"), (2, "door open", "rca", "U1", "2016-01-06 10:00:00"), (3, "no time", "rca", "U1", None), (4, "no unit", "rca", None, "2016-01-05 10:00:00"), (5, "alone", "rca", "U2", "2016-01-05 10:00:00")]
    rows += [(6, "assistant: fan hot", "transcript", "U1", "2016-01-09 10:00:00"), (7, "user: x\nassistant: open", "transcript", "U1", "2016-01-09 11:00:00"), (8, None, "rca", "U1", "2016-01-05 10:00:00")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, doc_kind string, unit_code string, written_at string")
    frame.withColumn("written_at", F.to_timestamp("written_at")).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.id: r.recall for r in plans.rouge_l(spark, str(tmp_path)).collect()} == {1: 1.0, 2: 0.5, 3: 0.0, 4: 0.0, 5: 0.0}
    assert {r.id for r in more.text_recall(spark, str(tmp_path)).collect()} == {1, 2, 3, 4, 5}
