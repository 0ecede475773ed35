import datetime as dt
import gzip
import io
import json
import struct
import tarfile
import zipfile

from pyspark.sql import functions as F

from logweave import agent
from logweave.operators import catalog
from logweave.sources import binary, files, unpack, xlsx
from logweave.streaming import live

BOOK = {
    "xl/workbook.xml": '<workbook xmlns="m" xmlns:r="r"><sheets><sheet name="North" sheetId="1"/><sheet name="Empty" sheetId="2"/></sheets></workbook>',
    "xl/sharedStrings.xml": '<sst xmlns="m"><si><t>Unit</t></si><si><r><t>Reported </t></r><r><t>at</t></r></si><si><t>KRV-1</t></si><si><t>1/5/2016 10:00</t></si></sst>',
    "xl/styles.xml": '<styleSheet xmlns="m"><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="22"/></cellXfs></styleSheet>',
    "xl/worksheets/sheet1.xml": '<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
    '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2" s="2"><v>42374.5</v></c><c r="AA2"><v>7</v></c></row><row r="3"><c r="B3" t="s"><v>3</v></c><c r="A3"><v></v></c></row><row r="4"><c r="A4" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>',
}


def book():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in BOOK.items():
            z.writestr(name, text)
    return out.getvalue()


def test_workbook(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(book())
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    cells = xlsx.read_cells(spark, str(tmp_path)).cache()
    got = {(r.row_no, r.col_letter): (r.cell_value, r.cell_time) for r in cells.where("sheet_id = 1").collect()}
    assert got[2, "B"] == ("2016-01-05 12:00:00", dt.datetime(2016, 1, 5, 12)) and got[3, "B"][1] == dt.datetime(2016, 1, 5, 10) and got[4, "A"][0] == "x"
    assert cells.where("sheet_id = 0").count() == 1
    assert xlsx.date_positions(cells).count() == 2
    row = xlsx.ticket_rows(cells).where("row_no = 2").first()
    assert row.headers == ["Unit", "Reported at"] and row.row_values == ["KRV-1", "2016-01-05 12:00:00"]


def test_written_dates():
    at = dt.datetime
    assert [xlsx.written_date(t) for t in ("8/18/2025 3:04 PM", " 29-Mar-21 ", "8/9/2025", "8/9/25 07:08:09", "31-Dec-2020 23:59")] == [at(2025, 8, 18, 15, 4), at(2021, 3, 29), at(2025, 8, 9), at(2025, 8, 9, 7, 8, 9), at(2020, 12, 31, 23, 59)]
    assert [xlsx.written_date(t) for t in ("18/8/2025", "2025-08-18", "1.2.2016", "", "8/18/2025 x", "x" * 50, "8/18/2025" + " " * 60 + "1:02:03 PM")] == [None] * 7


def test_workbook_of_1904(spark, tmp_path):
    source = zipfile.ZipFile(io.BytesIO(book()))
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as out:
        for name in source.namelist():
            out.writestr(name, source.read(name).replace(b"<sheets>", b'<workbookPr date1904="1"/><sheets>'))
    cells = xlsx.read_cells(spark, str(tmp_path)).where("sheet_id = 1 and cell_time is not null").collect()
    assert dt.datetime(2020, 1, 6, 12) in {r.cell_time for r in cells}


def test_unpack(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a/b.log", "deep")
        z.writestr("../evil", "x")
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("in.zip")
        info.size = len(inner.getvalue())
        t.addfile(info, io.BytesIO(inner.getvalue()))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    (tmp_path / "x.tar.gz").write_bytes(tar.getvalue())
    (tmp_path / "y.log.gz").write_bytes(gzip.compress(b"plain"))
    (tmp_path / "z.zip").write_bytes(b"broken")
    (tmp_path / "w.txt").write_bytes(b"text")
    found = unpack.unpacked_files(spark, str(tmp_path)).cache()
    got = {r.inner_path: (bytes(r.content), r.status) for r in found.collect()}
    assert got["x.tar.gz!/in.zip!/a/b.log"] == (b"deep", "file") and got["y.log.gz!/y.log"] == (b"plain", "file") and got["w.txt"] == (b"text", "file")
    assert got["x.tar.gz!/in.zip!/../evil"][1] == got["x.tar.gz!/link"][1] == "refused" and got["z.zip"][1] == "broken"
    assert {r.status: r.n for r in unpack.manifest(found).collect()} == {"file": 3, "refused": 2, "broken": 1}


def test_large_and_damaged_members():
    """A large or damaged member takes nothing from the others."""
    out, inner = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("first.log", "intact")
        with z.open("big.log", "w", force_zip64=True) as f:
            for _ in range(257):
                f.write(bytes(1 << 20))
        z.writestr("last.log", "intact")
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("bad.log", "damaged")
        z.writestr("good.log", "intact")
    data = out.getvalue().replace(b"damaged", b"damagex")
    sizes, status = {}, {}
    for path, part, content, state in unpack.members("x.zip", data):
        sizes[path], status[path] = sizes.get(path, 0) + len(content), state
        assert len(content) <= unpack.PART and (part > 0) == (path in sizes and sizes[path] > len(content))
    assert sizes == {"x.zip!/in.zip!/first.log": 6, "x.zip!/in.zip!/big.log": 257 << 20, "x.zip!/in.zip!/last.log": 6, "x.zip!/bad.log": 0, "x.zip!/good.log": 6}
    assert [p for p, s in status.items() if s != "file"] == ["x.zip!/bad.log"]


def test_cut_archive():
    """What stands before the cut stays."""
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        for name in ("a.log", "b.log"):
            info = tarfile.TarInfo(name)
            info.size = 2000
            t.addfile(info, io.BytesIO(b"x" * 2000))
    got = list(unpack.members("x.tar", tar.getvalue()[:3500]))
    assert got[0] == ("x.tar!/a.log", 0, b"x" * 2000, "file") and got[-1][3] == "broken"


def test_binary_events(spark, tmp_path):
    def record(seconds, event, module):
        return struct.pack(">IB", seconds, 0) + struct.pack("<HHHH", event, module, 3, 4) + b"\0" * 3 + struct.pack("<II", 0xDEADBEEF, 1) + b"\0\0" + struct.pack("<I", 255) + b"\0\0"

    (tmp_path / "e.bin").write_bytes(b"h" * 11 + record(1451606400, 65535, 2) + record(0, 1, 1) + record(0xFFFFFFFF, 1, 1) + record(1451606401, 7, 8) + b"cut")
    (tmp_path / "empty.bin").write_bytes(b"")
    got = binary.read_binary_events(spark, str(tmp_path)).orderBy("rec_no").collect()
    assert [(r.rec_no, r.event_id, r.module, r.flags, r.subcode, r.arg1, r.arg2, r.arg3) for r in got] == [(0, 65535, 2, 3, 4, "0xdeadbeef", "0x00000001", "0x000000ff"), (3, 7, 8, 3, 4, "0xdeadbeef", "0x00000001", "0x000000ff")]
    assert binary.read_binary_events(spark, str(tmp_path), first="2016-01-01 00:00:01", last="2016-01-01 00:00:01").count() == 1


def test_text_and_window(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.log").write_bytes(b"static\r\n2016-01-05 10:00:00 one\rmore\n\n2016-01-09 10:00:00 two\n\xff")
    (tmp_path / "b.bin").write_bytes(b"\0")
    assert files.scan_files(spark, str(tmp_path)).count() == 2 and files.scan_files(spark, str(tmp_path), ignored=("b.bin",)).count() == 1
    assert files.text_lines(spark, str(tmp_path), kinds=("log",)).count() == 6
    found = files.windowed_records(spark, str(tmp_path / "sub"), "2016-01-05", "2016-01-06").orderBy("line_no").collect()
    assert [r.text for r in found] == ["static", "<time> one\nmore"]
    frame = files.windowed_records(spark, str(tmp_path / "sub"), "2016-01-05", "2016-01-06")
    files.write_plain(frame, str(tmp_path / "plain"))
    assert "2016-01-05T10:00:00: <time> one" in {r.value for r in spark.read.text(str(tmp_path / "plain")).collect()}
    files.write_windowed(frame.withColumn("incident_ts", F.lit("t1")), str(tmp_path / "win"))
    assert spark.read.parquet(str(tmp_path / "win")).count() == 2
    # binary files of the window are dispatched to their own reader, the date of the path is that of lines without one
    event = struct.pack(">IB", 1451988000, 0) + struct.pack("<HHHH", 7, 8, 3, 4) + b"\0" * 19
    both = tmp_path / "both" / "2016-01-05T09_00_00"
    both.mkdir(parents=True)
    (both / "e.bin").write_bytes(b"h" * 11 + event + event[:4] + b"\0" * 28)
    (both / "a.log").write_bytes(b"head\nlines\n2016-01-05 10:00:00 one\n")
    found = files.windowed_records(spark, str(tmp_path / "both"), "2016-01-05", "2016-01-06").collect()
    assert sorted((str(r.ts), r.n_lines, r.text) for r in found if "log" in r.path) == [("2016-01-05 09:00:00", 2, "head\nlines"), ("2016-01-05 10:00:00", 1, "<time> one")]
    assert {json.loads(r.text)["event_id"] for r in found if "bin" in r.path} == {0, 7}
    assert files.windowed_records(spark, str(tmp_path / "both"), "2016-01-05", "2016-01-06", kinds=("log",)).count() == 2


def test_chunk_files(spark, tmp_path):
    good = {"source": "a/b", "chunk_id": 0, "content": [{"ts_start": "2016-01-05T10:00:00Z", "text": "x\u0001y"}, {"text": "z"}]}
    (tmp_path / "c.json").write_text("\n".join([json.dumps(good), "{broken", json.dumps({"source": "a"}), json.dumps({**good, "content": []})]))
    rows, broken = files.read_chunks(spark, str(tmp_path))
    row = rows.first()
    assert row.content_text == "a/b\nx y\nz" and row.has_time and row.content_json[1].cnt == 1
    assert broken.count() == 3
    files.write_chunks(rows, str(tmp_path / "out"))
    assert files.read_chunks(spark, str(tmp_path / "out"))[0].first().content_text == row.content_text


def test_incident_files(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"2016-01-05T10:00:00+01:00": {"matched_date": "2016-01-05"}, "x": {}}))
    (tmp_path / "c.json").write_text(json.dumps({"x": {"files": ["a"]}}))
    got = {r.source_ts: r.files for r in files.read_incidents(spark, str(tmp_path / "i.json"), str(tmp_path / "c.json")).collect()}
    assert got == {"2016-01-05T10:00:00+01:00": None, "x": {"files": ["a"]}}
    assert [(r.at, r.n) for r in files.timestamp_keys(spark, str(tmp_path / "i.json")).collect()] == [(dt.datetime(2016, 1, 5, 9), 1)]


def test_catalogue(spark):
    names = ["a.log", "a.log.1", "a.LOG.gz", "a.tar.gz", "noext", "a.bin.old", "", None, "a.b.c"]
    frame = spark.createDataFrame([(n,) for n in names], "p string")
    got = {r.p: (r.e, r.k) for r in frame.select("p", catalog.extension(F.col("p")).alias("e"), catalog.file_kind(F.col("p")).alias("k")).collect()}
    assert got == {"a.log": ("log", "log"), "a.log.1": ("log", "log"), "a.LOG.gz": ("log.gz", "log"), "a.tar.gz": ("gz", "unk"), "noext": ("none", "unk"), "a.bin.old": ("bin", "bin"), "": ("none", "none"), None: (None, None), "a.b.c": ("c", "unk")}
    heads = spark.createDataFrame([(b"text\n",), (b"a\0b",), (b"\x01\x02\x03abc",), (b"",)], "h binary")
    assert [r[0] for r in heads.select(catalog.looks_binary(F.col("h"))).collect()] == [False, True, True, False]


def test_agent(spark):
    chunks = spark.sql("select 1L id, 'a' source_path, 0 chunk_id, 'fan stalled' content_text, timestamp '2016-01-01' time_start, timestamp '2016-01-02' time_end, true has_time union all select 2, 'b', 1, 'door', null, null, false")
    replies = iter([{"content": "", "calls": [{"id": "1", "arguments": '{"exact_pattern": "fan", "limit": 3}'}, {"id": "2", "arguments": '{"limit": 99}'}, {"id": "3", "arguments": "{bad"}]}, {"content": "done"}])
    answer, talk = agent.gather(lambda m: next(replies), chunks, "s", "q")
    assert answer == "done" and talk.retrieved == [(0, "a", 0)]
    assert sum("error" in m["content"] for m in talk.messages if m["role"] == "tool") == 2
    endless = lambda m: {"content": "final"} if "final answer" in m[-1]["content"] else {"content": "", "calls": [{"id": "1", "arguments": "{}"}]}
    answer, talk = agent.gather(endless, chunks, "s", "q", rounds=3, summarise=lambda m: {"content": "sum"}, keep=1)
    assert answer == "final" and talk.summary == "sum" and len(talk.retrieved) == 3


def test_streaming(spark, tmp_path):
    schema = "ts timestamp, event_type string, user_id bigint, source_path string, chunk_id int, loaded_at timestamp"
    rows = [(f"2016-01-01T10:{m:02d}:00Z", "e", 1, "a", m % 2, f"2016-01-01T10:{m:02d}:00Z") for m in range(4)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(dict(zip(("ts", "event_type", "user_id", "source_path", "chunk_id", "loaded_at"), r, strict=True))) for r in rows))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    for name, frame, mode in (("counts", live.event_counts(stream), "complete"), ("loads", live.first_loads(stream), "append"), ("sessions", live.activity_sessions(stream, "user_id"), "complete")):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert spark.table("counts").first().n == 4 and spark.table("loads").count() == 2 and spark.table("sessions").first().n == 4
