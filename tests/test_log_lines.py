import pytest

from logweave.operators.log_lines import entries, found_entries, level, parse_entries

CHUNK = "id bigint, source_path string, content_json array<struct<ts_start timestamp, ts_end timestamp, cnt bigint, text string>>, text string, entry_no string"


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("[2016/01/13 10:37:45] (I) traction.inv :: memory pool reached", ("2016-01-13 10:37:45", "INFO", "traction.inv", "memory pool reached")),
        ("2016-01-08 14:09:01.761 [INFO ] brake.unit - Queue full", ("2016-01-08 14:09:01", "INFO", "brake.unit", "Queue full")),
        ("2016-01-08 14:09:01.761 [\x1b[33mWARN\x1b[0m] brake.unit - Queue full", ("2016-01-08 14:09:01", "WARN", "brake.unit", "Queue full")),
        ("INFO  2016-01-06 13:11:25,979 sand.disp:162 - Smoke sensor", ("2016-01-06 13:11:25", "INFO", "sand.disp", "Smoke sensor")),
        ("Jan 16 13:35:40 moa255a watchdog.sup[1087]: <error> front panel", ("2016-01-16 13:35:40", "ERROR", "watchdog.sup", "front panel")),
        ("Jan  7 00:26:45 krv117a net.gateway[6792]: front panel", ("2016-01-07 00:26:45", "", "net.gateway", "front panel")),
        ("<54>Jan 16 2016, 13:37:49 watchdog.sup: sand valve", ("2016-01-16 13:37:49", "INFO", "watchdog.sup", "sand valve")),
        ('ts=2016-01-05T10:27:47Z comp=pis.audio lvl=warning tid=3 msg="Record \\"a\\" ok"', ("2016-01-05 10:27:47", "WARN", "pis.audio", 'Record "a" ok')),
        ("2016-01-13 21:17:06 UTC battery.mon\tNOTICE\tbattery string", ("2016-01-13 21:17:06", "INFO", "battery.mon", "battery string")),
        ("Tue Jan 19 17:06:11 UTC 2016 CRITICAL panto.arm: ring port", ("2016-01-19 17:06:11", "FATAL", "panto.arm", "ring port")),
        ("Tue Jan 19 17:06:11 2016 TRACE panto.arm: ring port", ("2016-01-19 17:06:11", "DEBUG", "panto.arm", "ring port")),
        ('{"message": "a: \\u00e9", "time": "2016-01-23T23:22:50.983+00:00", "module": "odo.fuse", "severity": "DEBUG"}', ("2016-01-23 23:22:50", "DEBUG", "odo.fuse", "a: é")),
        ("07.01.2016 16:03:37;Debug;bogie.mon;uplink frame", ("2016-01-07 16:03:37", "DEBUG", "bogie.mon", "uplink frame")),
        ("07.01.2016 16:03:37;Debug;;uplink frame", ("2016-01-07 16:03:37", "DEBUG", "", "uplink frame")),
        ("16-01-14T17:53:05.947|F||radio bearer", ("2016-01-14 17:53:05", "FATAL", "", "radio bearer")),
        ("1453261435669 W/mmi.touch: Configuration block", ("2016-01-20 03:43:55", "WARN", "mmi.touch", "Configuration block")),
        ('<entry t="2016-01-05T10:27:56Z" l="I" c="pis.audio">a &lt; b</entry>', ("2016-01-05 10:27:56", "INFO", "pis.audio", "a < b")),
        ("Time : 2016-01-12 02:35:36.341\nLevel : TRACE\nSource : panto.arm\nText : flush cycle", ("2016-01-12 02:35:36", "DEBUG", "panto.arm", "flush cycle")),
        ("at: 2016-01-12 02:35:36\nmsg: flush cycle", ("2016-01-12 02:35:36", "", "", "flush cycle")),
        ("2016-01-12 02:35:36 - com.foo - INFO - a - b", ("2016-01-12 02:35:36", "INFO", "com.foo", "a - b")), ("2016-01-12 02:35:36 - WARNING - com.foo - a", ("2016-01-12 02:35:36", "WARN", "com.foo", "a")),
        ("2016-01-12 02:35:36,123 [main] INFO com.foo.Bar - m", ("2016-01-12 02:35:36", "INFO", "com.foo.Bar", "m")), ("2016-01-12 02:35:36 INFO [main] com.foo.Bar - m", ("2016-01-12 02:35:36", "INFO", "com.foo.Bar", "m")),
        ("2016-01-12 02:35:36.123  INFO 1234 --- [  main] c.f.Bar   : m", ("2016-01-12 02:35:36", "INFO", "c.f.Bar", "m")), ("I0112 02:35:36.123 99 file.cc:12] m: n", ("2016-01-12 02:35:36", "INFO", "file.cc", "m: n")),
        ('1.2.3.4 - bob [10/Oct/2015:13:55:36 -0700] "GET / HTTP/1.0" 200 7', ("2015-10-10 13:55:36", "", "", '"GET / HTTP/1.0" 200 7')), ("01-12 02:35:36.123  1234  5678 E Tag: m", ("2016-01-12 02:35:36", "ERROR", "Tag", "m")),
        (f"2016-01-12 02:35:36 [<{'y' * 300}>] [ERROR] Comp: m", ("2016-01-12 02:35:36", "ERROR", "Comp", "m")), ("2016-01-12 02:35:36 [ERROR] [Comp] m", ("2016-01-12 02:35:36", "ERROR", "Comp", "m")),
        ("[2016-01-12 02:35:36] [main/WARN]: m", ("2016-01-12 02:35:36", "WARN", "main", "m")), ("2016-01-12 02:35:36 [note] m (no component)", ("2016-01-12 02:35:36", "INFO", "", "m (no component)")),
        ("<34>1 2016-01-12T02:35:36.003Z host su 7 ID47 - m", ("2016-01-12 02:35:36", "FATAL", "su", "m")), ('<165>1 2016-01-12T02:35:36Z host - - - [x@1 a="b \\] c"] m', ("2016-01-12 02:35:36", "INFO", "", "m")),
        ('2016-01-12 02:35:36 pid=12 level=warn logger=a.b msg="x y"', ("2016-01-12 02:35:36", "WARN", "a.b", "x y")),
    ],
)
def test_layouts(line, expected):
    assert [e[2:] for e in entries(line, 2016)] == [expected]


@pytest.mark.parametrize("line", ["", "  last good frame 2016-01-13 00:35:00 on port 1", "ERROR recovered by fan", "warning level kept by fan", "\tat veh.a.b(C.java:1)", "{", "Time: 2016-01-12 02:35:36", "2016-13-40 10:00:00 [INFO] a.b - x", "[INFO] x"])
def test_no_entries(line):
    assert list(entries(line, 2016)) == []


def test_continuations_and_line_ends():
    text = "head\r\n2016-01-08 14:09:01 [WARN] a.b - x\r\n\r\n  more\rCaused by: y\n2016-01-08 14:09:02 [INFO] a.b - z"
    assert [e[:2] for e in entries(text, None)] == [(1, 3), (2, 1)]


def test_levels():
    assert [level(x) for x in ("Emerg", "n", "3", "7", "hello", "")] == ["FATAL", "INFO", "ERROR", "DEBUG", None, None]


def test_table(spark):
    long = "2016-01-08 14:09:01 [WARN] a.b - " + "x" * 300_000
    raw = lambda text: [(None, None, 1, text)]
    data = [
        (1, "U/1.1.16/a", raw(long), "clash", "clash"), (1, "U/1.1.16/a", raw(long), None, None), (2, None, raw("Jan 16 13:35:40 h a.b[1]: m"), "", ""), (3, "U", None, "", ""), (4, "U", [], "", ""),
        (5, "U", raw(None), "", ""), (6, "U", raw(""), "", ""), (None, "U", raw(long), "", ""), (7, "U", raw("a") * 2, "", ""),
    ]
    found = found_entries(spark.createDataFrame(data, CHUNK)).collect()
    assert sorted((r.id or 0, r.logged_at, r.msg_head) for r in found if r.logged_at) == [(0, "2016-01-08 14:09:01", "x" * 12), (1, "2016-01-08 14:09:01", "x" * 12), (1, "2016-01-08 14:09:01", "x" * 12)]
    assert [r.logged_at for r in found if r.id == 2] == [None]  # no year anywhere
    assert found_entries(spark.createDataFrame([], CHUNK)).count() == 0
    assert parse_entries(spark.createDataFrame([], "id bigint, source_path string, text string")).count() == 0
