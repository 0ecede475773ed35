"""Spreadsheet workbooks: cells, date cells and rows, read with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Number formats of dates, and written dates.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_WRITTEN = (
    "%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y %I:%M %p", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %H:%M", "%m/%d/%Y", "%m/%d/%y %I:%M:%S %p", "%m/%d/%y %I:%M %p", "%m/%d/%y %H:%M:%S", "%m/%d/%y %H:%M", "%m/%d/%y",
    "%d-%b-%Y %H:%M:%S", "%d-%b-%Y %H:%M", "%d-%b-%Y", "%d-%b-%y %H:%M:%S", "%d-%b-%y %H:%M", "%d-%b-%y",
)
_LOOKS_WRITTEN = re.compile(r"(?i)(?:\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}-[a-z]{3}-\d{2,4})(?:\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:am|pm)?)?")
_LONGEST_WRITTEN = 40
#: Days are counted from here, or from the second date in workbooks that say so.
_EPOCH, _EPOCH_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(reference: str) -> str:
    return re.match(r"[A-Z]+", reference).group()


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format is a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {int(e.get("numFmtId")) for e in root.iter() if _local(e.tag) == "numFmt" and re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", e.get("formatCode", "").lower()))}
    styles = set()
    for group in root:
        if _local(group.tag) == "cellXfs":
            styles = {i for i, e in enumerate(group) if int(e.get("numFmtId", 0)) in _DATE_FORMATS | own}
    return styles


def written_date(text: str) -> datetime | None:
    """A date as tickets write it, month first with slashes or day first with a month name; None for any other text."""
    text = text.strip()
    if len(text) > _LONGEST_WRITTEN or not _LOOKS_WRITTEN.fullmatch(text):
        return None
    for form in _WRITTEN:
        try:
            return datetime.strptime(text, form)
        except ValueError:
            continue
    return None


def workbook_cells(data: bytes) -> Iterator[tuple[int, str, int, str, str, datetime | None]]:
    """(sheet_id from 1, sheet_name, row_no, col_letter, value, time of a date cell) of every filled cell."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as stream:  # item by item, whatever its size
                for _, item in ElementTree.iterparse(stream):
                    if _local(item.tag) == "si":
                        shared.append("".join(e.text or "" for e in item.iter() if _local(e.tag) == "t"))
                        item.clear()
        dates = _date_styles(book)
        described = ElementTree.fromstring(book.read("xl/workbook.xml"))
        names = [e.get("name") for e in described.iter() if _local(e.tag) == "sheet"]
        epoch = _EPOCH_1904 if any(_local(e.tag) == "workbookPr" and e.get("date1904") in ("1", "true") for e in described.iter()) else _EPOCH
        for sheet_id, name in enumerate(names, 1):
            part = f"xl/worksheets/sheet{sheet_id}.xml"
            if part not in book.namelist():
                continue
            with book.open(part) as stream:
                for _, cell in ElementTree.iterparse(stream):
                    if _local(cell.tag) != "c":
                        continue
                    kind = cell.get("t", "n")
                    value = "".join(e.text or "" for e in cell.iter() if _local(e.tag) in ("v", "t"))
                    reference = cell.get("r", "A0")
                    time = None
                    if kind == "s" and value:
                        value = shared[int(value)]
                    elif kind == "n" and value and int(cell.get("s", 0)) in dates:
                        time = epoch + timedelta(seconds=round(float(value) * 86400))
                        value = time.isoformat(sep=" ")
                    if value != "":
                        column = _column(reference)
                        yield sheet_id, name, int(reference[len(column) :] or 0), column, value, time or written_date(value)
                    cell.clear()


def read_cells(spark: SparkSession, root: str) -> DataFrame:
    """Cells of all workbooks below ``root``: path, sheet_id, sheet_name, row_no, col_letter, cell_value, cell_time.

    A file that is no workbook gives one row with sheet_id 0 and the reason
    as its value.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(root).select("path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "sheet_id", "sheet_name", "row_no", "col_letter", "cell_value", "cell_time"]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(path, *cell) for cell in workbook_cells(content)]
                except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as error:
                    rows = [(path, 0, "", 0, "", str(error), None)]
                frame = pd.DataFrame(rows, columns=columns)
                frame["cell_time"] = pd.to_datetime(frame["cell_time"])
                yield frame

    return files.mapInPandas(read, "path string, sheet_id int, sheet_name string, row_no int, col_letter string, cell_value string, cell_time timestamp")


def date_positions(cells: DataFrame) -> DataFrame:
    """Where each date-like cell stands: at (a second), path, sheet_id, sheet_name, row_no, col_letter."""
    return cells.where("cell_time is not null").select(F.date_trunc("second", "cell_time").alias("at"), "path", "sheet_id", "sheet_name", "row_no", "col_letter")


def ticket_rows(cells: DataFrame, header_row: int = 1) -> DataFrame:
    """Rows below the header: headers, row_values and cells in column order; columns behind the last header are dropped."""
    place = F.struct(F.length("col_letter").alias("n"), F.col("col_letter").alias("c"))
    headers = cells.where(F.col("row_no") == header_row).select("path", "sheet_id", "col_letter", F.col("cell_value").alias("header_name"))
    keys = ["path", "sheet_id", "sheet_name", "row_no"]
    body = cells.where(F.col("row_no") > header_row).join(headers, ["path", "sheet_id", "col_letter"]).select(*keys, place.alias("place"), "col_letter", "header_name", "cell_value")
    grouped = body.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "col_letter", "header_name", "cell_value"))).alias("x"))
    return grouped.select(
        *keys, F.transform("x", lambda c: c["header_name"]).alias("headers"), F.transform("x", lambda c: c["cell_value"]).alias("row_values"),
        F.transform("x", lambda c: F.struct(c["col_letter"].alias("col_letter"), c["header_name"].alias("header_name"), c["cell_value"].alias("cell_value"))).alias("cells"),
    )
