from datetime import datetime, timezone

import pytest

from logweave.functions.paths import path_year
from logweave.functions.timescan import as_written, scan
from logweave.operators.timestamps import DAY_FIRST, MISTAKE, expectation_maximisation, found_instants, instant, normalise_times, readings


def us(*at):
    return int(datetime(*at, tzinfo=timezone.utc).timestamp() * 1_000_000)


def read(value, year=None, zone=None, sheets=False):
    found = [r for r in readings(value, year, sheets) if r[0] not in DAY_FIRST]
    if len(found) != 1:
        return None
    return found[0][1] if found[0][1] is not None else instant(found[0][2], found[0][3], zone)[0]


STOCKHOLM = "Europe/Stockholm"


@pytest.mark.parametrize(
    ("value", "year", "expected"),
    [
        ("2018-08-17T17:46:45-03:30", None, us(2018, 8, 17, 21, 16, 45)), ("2018-08-17 17:46:45 +0545", None, us(2018, 8, 17, 12, 1, 45)), ("2018-05-15T21:22:35.6Z", None, us(2018, 5, 15, 21, 22, 35, 600000)),
        ("2017-05-05 18:32:46.6637929 CEST", None, us(2017, 5, 5, 16, 32, 46, 663792)), ("16-07-03T04:32:20", None, us(2016, 7, 3, 2, 32, 20)), (" Jul  3 04:32:20\t", 2016, us(2016, 7, 3, 2, 32, 20)),
        ("Feb 29 10:00:00", 2017, None), ("Jul 3 04:32:20", None, None), ("Wed Aug 9 17:17:38 2017", None, us(2017, 8, 9, 15, 17, 38)), ("Thu Feb 16 23:47:12 UTC 2017", None, us(2017, 2, 16, 23, 47, 12)),
        ("20181028T015710Z", None, us(2018, 10, 28, 1, 57, 10)), ("12 Jun 2022 12:03:23 AM", None, us(2022, 6, 11, 22, 3, 23)), ("26.02.2022 09:28:53", None, us(2022, 2, 26, 8, 28, 53)), ("13/01/2016 21:05:55", None, us(2016, 1, 13, 20, 5, 55)),
        ("01/02/2016 21:05", None, us(2016, 2, 1, 20, 5)), ("2016/01/27 11:01", None, us(2016, 1, 27, 10, 1)), ("19.01.16 kl 19.19", None, us(2016, 1, 19, 18, 19)), ("26-Jan-2016 1:24 pm", None, us(2016, 1, 26, 12, 24)),
        ("1455783900", None, us(2016, 2, 18, 8, 25)), ("1455783900123", None, us(2016, 2, 18, 8, 25, 0, 123000)), ("1455783900123456", None, us(2016, 2, 18, 8, 25, 0, 123456)), ("0x56c57fdc", None, us(2016, 2, 18, 8, 25)),
        ("0", None, None), ("0xffffffff", None, None), ("4294967295", None, None), ("", None, None), (None, None, None), ("n/a", None, None), ("2019-13-04 08:00:00", None, None), ("31.11.2020 07:12:09", None, None), ("42384.5", None, None),
        ("2021-03-28 02:30:00", None, None), ("2017-10-29 02:21:21", None, us(2017, 10, 29, 0, 21, 21)), ("2017-10-29 02:21:21 CET", None, us(2017, 10, 29, 1, 21, 21)), ("2017-07-01 02:21:21 EST", None, None),
    ],
)
def test_values(value, year, expected):
    assert read(value, year, STOCKHOLM) == expected


def test_sheet_numbers():
    assert read("42384.0625", zone="UTC", sheets=True) == us(2016, 1, 15, 1, 30)
    assert read("42384", zone="Asia/Kolkata", sheets=True) == us(2016, 1, 14, 18, 30)


def test_expectation_maximisation_learns_and_marks(spark):
    both, day, month = ("dot:DMY", "dot:MDY"), ("dot:DMY",), ("dot:MDY",)
    assert expectation_maximisation([(both, 80), (day, 20)], frozenset())[0]["dot:DMY"] > 0.9
    assert 0.4 < expectation_maximisation([(both, 80), (day, 10), (month, 10)], frozenset())[0]["dot:DMY"] < 0.6
    # a convention holds against a few mistakes, but not against a source that shows another habit
    held = expectation_maximisation([(both, 40), (day, 57), (month, 3)], DAY_FIRST)
    assert held[0]["dot:DMY"] > 0.99 and held[2][MISTAKE] > 0.9
    other = expectation_maximisation([(both, 400), (month, 600)], DAY_FIRST)
    assert other[0]["dot:MDY"] > 0.9 and other[1]["dot:MDY"] > 0.9
    torn = expectation_maximisation([(both, 40), (day, 40), (month, 20)], DAY_FIRST)
    assert max(torn[0].values()) < 0.9
    assert expectation_maximisation([], DAY_FIRST) == []
    schema = "origin string, rec_id bigint, source string, unit string, path string, value string, sheets boolean"
    data = [("x", i, "s", "U", None, v, False) for i, v in enumerate(["03.04.2016 10:00", "25.04.2016 10:00"] + ["25.04.2016 10:00"] * 40)]
    data += [("x", 100, "t", "U", None, "03.04.2016 10:00", False), ("x", 101, "v", "?", None, "2016-04-23 10:00", False), ("x", None, None, None, None, None, None)]
    zones = spark.createDataFrame([("U", "UTC")], "unit string, zone_name string")
    got = {r.rec_id: (r.status, r.utc_us) for r in normalise_times(spark.createDataFrame(data, schema), zones, unusual=frozenset()).collect()}
    assert got[0] == ("resolved", us(2016, 4, 3, 10)) and got[1][0] == "resolved"
    assert got[100] == ("ambiguous", None) and got[101] == ("no zone", None) and got[None] == ("unreadable", None)


def test_posteriors_differ_by_source(spark):
    """The same value is read as its source writes its dates, under the production conventions."""
    schema = "origin string, rec_id bigint, source string, unit string, path string, value string, sheets boolean"
    day, month, torn = ["25/04/2016 10:00"] * 60, ["04/25/2016 10:00"] * 200, ["25/04/2016 10:00"] * 60 + ["04/25/2016 10:00"] * 40
    data = [("x", i if i else n, source, "U", None, v, False) for n, (source, rest) in enumerate((("day", day), ("month", month), ("torn", torn)), 1) for i, v in ((0, "03/04/2016 10:00"), *((1000 * n + k, v) for k, v in enumerate(rest)))]
    data.append(("x", 9, "day", "U", None, "04/25/2016 10:00", False))
    found = normalise_times(spark.createDataFrame(data, schema), spark.createDataFrame([("U", "UTC")], "unit string, zone_name string")).collect()
    got = {r.rec_id: (r.status, r.format, r.utc_us) for r in found}
    assert len(found) == len(data)
    assert got[1] == ("resolved", "slash:DMY", us(2016, 4, 3, 10)) and got[2] == ("resolved", "slash:MDY", us(2016, 3, 4, 10))
    assert got[3][0] == "ambiguous" and got[9][0] == "mistake" and got[2000] == ("resolved", "slash:MDY", us(2016, 4, 25, 10))


def test_tables(spark):
    staged = spark.createDataFrame([(1, "KRV-1/1.2.16/a", "Jan 2 03:04:05", "x"), (1, "KRV-1/1.2.16/a", "Jan 2 03:04:05", "x"), (2, None, None, None), (3, "LAB/1.2.16/a", "2016-01-01 00:00:00", None), (4, "LAB/a", "1455783900", None)], "stage_id bigint, source_path string, time_start string, status string")
    tickets = spark.createDataFrame([(7, 1, [" unit ", "Reported at"], ["#krv_1", "05/01/2016 21:05:55"])] * 2 + [(8, 1, ["Unit"], ["KRV 1", "x"]), (9, None, None, None), (10, 2, ["Vehicle", "Time of report"], ["KRV-1"])], "ticket_id bigint, sheet_id int, headers array<string>, row_values array<string>")
    units = spark.createDataFrame([("KRV-1", STOCKHOLM, "a"), (None, None, None)], "unit_code string, zone_name string, fleet string")
    got = sorted(tuple(r) for r in found_instants(staged, tickets, units).collect())
    assert got == [("staged", 1, us(2016, 1, 2, 2, 4, 5)), ("staged", 1, us(2016, 1, 2, 2, 4, 5)), ("staged", 4, us(2016, 2, 18, 8, 25)), ("ticket", 7, us(2016, 1, 5, 20, 5, 55))]
    assert found_instants(staged.limit(0), tickets.limit(0), units.limit(0)).count() == 0


def test_without_source(spark):
    """A value whose path or sheet is null has its instant where it needs no more than itself and its unit."""
    staged = spark.createDataFrame([(1, None, "1455783900", "x"), (2, None, "2016-01-01 00:00:00+01:00", "x"), (3, None, "2016-01-01 00:00:00", "x")], "stage_id bigint, source_path string, time_start string, status string")
    tickets = spark.createDataFrame([(7, None, ["Unit", "Reported at"], ["KRV-1", "05/01/2016 21:05:55"])], "ticket_id bigint, sheet_id int, headers array<string>, row_values array<string>")
    units = spark.createDataFrame([("KRV-1", STOCKHOLM, "a")], "unit_code string, zone_name string, fleet string")
    got = sorted(tuple(r) for r in found_instants(staged, tickets, units).collect())
    assert got == [("staged", 1, us(2016, 2, 18, 8, 25)), ("staged", 2, us(2015, 12, 31, 23)), ("ticket", 7, us(2016, 1, 5, 20, 5, 55))]


def test_paths_and_automaton():
    assert [path_year(p) for p in ("U/2018-01-04T10_28_44/x", "U\\download_280316_0559\\x", "U/fetch_061024/x", "U/19 August 20/x", "U/9-99-16/x", "U/x", None, "U/1-9-2017/x")] == [2018, 2016, 2024, 2020, None, None, None, 2017]
    assert scan("2016-01-05T10:27:565") is None
    assert as_written(scan("2016-01-05 10:27:56 INFO x"), None) == "2016-01-05 10:27:56"
