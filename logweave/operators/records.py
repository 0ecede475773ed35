"""Line times and record assembly as expressions.

These follow the parser list of the log extractor: the first parser whose
pattern occurs in a line wins, even if its value is no valid time.  The time
is taken out of the line and leaves the mark ``<time>``, so that lines which
differ only in their time become equal.  For whole logs of mixed layouts see
``log_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.prefix import running_sum

#: Lines of one file that are sorted together.
LINES_PER_BLOCK = 20_000

# Parser ids in order of precedence, their patterns, and what the groups hold: y year of four or two digits,
# b month name, m month, d day, t clock, z zone.
_MON = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_DOW = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
_NAME = "([A-Z][a-z]{2})"
_CLOCK = r"(\d{2}:\d{2}:\d{2})"
_FINE_CLOCK = r"(\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)"
LINE_PARSERS = (
    ("short_yy-mm-dd", rf"\b(\d{{2}})-(\d{{2}})-(\d{{2}})[ T]{_FINE_CLOCK}\b", "ymdt"),
    ("text_with_dow", rf"\b{_DOW}\s+{_MON}\s+(\d{{1,2}})\s+{_CLOCK}(?:\s+UTC)?\s+(\d{{4}})\b", "bdty"),
    ("syslog_year_comma", rf"\b{_NAME}\s+(\d{{1,2}})\s+(\d{{4}}),\s+{_CLOCK}\b", "bdyt"),
    ("syslog_with_year", rf"\b{_NAME}\s+(\d{{1,2}})\s+(\d{{4}})\s+{_CLOCK}\b", "bdyt"),
    ("syslog_missing_year", rf"\b{_MON}\s+(\d{{1,2}})\s+{_CLOCK}\b", "bdt"),
    ("iso", rf"\b(\d{{4}})-(\d{{2}})-(\d{{2}})[ T]{_FINE_CLOCK}(Z|[+-]\d{{2}}:\d{{2}})?\b", "ymdtz"),
    ("date_only", r"\b(\d{4}|\d{2})-(\d{2})-(\d{2})\b", "ymd"),
)
_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
#: Two-digit years below this one belong to the present century.
SHORT_YEAR_PIVOT = 69
#: The year of a line without any.
UNKNOWN_YEAR = 1970


def line_parser(line: Column) -> Column:
    """Place in ``LINE_PARSERS`` of the first parser whose pattern occurs in a line, null without one."""
    out = F.lit(None).cast("int")
    for place, (_, pattern, _) in reversed(list(enumerate(LINE_PARSERS))):
        out = F.when(line.rlike(pattern), F.lit(place)).otherwise(out)
    return out


def line_fields(line: Column, parser: Column) -> Column:
    """[year, month, day, clock, zone] as written at the first value of the parser of a line; what it lacks is empty."""
    out = F.lit(None).cast("string")
    for place, (_, pattern, groups) in enumerate(LINE_PARSERS):
        group = {f: f"${i + 1}" for i, f in enumerate(groups)}
        month = group.get("m") or group["b"]
        template = "|".join((group.get("y", ""), month, group["d"], group.get("t", ""), group.get("z", "")))
        out = F.when(parser == place, F.regexp_replace(line, f"(?s)^.*?{pattern}.*$", template)).otherwise(out)
    return F.split(out, r"\|")


def line_time(fields: Column, year: Column) -> Column:
    """UTC instant of the fields of a line; ``year`` is that of the path, ``UNKNOWN_YEAR`` if null.

    Fractions of up to six digits and offsets count; a time without an offset
    is UTC.  Without a year, the 29th of February is no valid date.  Null
    where the value is impossible.
    """
    written, month, day, clock, zone = (fields[i] for i in range(5))
    short = F.when(F.length(written) == 2, written.try_cast("int"))
    own = F.when(written == "", F.coalesce(year, F.lit(UNKNOWN_YEAR)).cast("string")).when(short.isNull(), written).otherwise((short + F.when(short < SHORT_YEAR_PIVOT, 2000).otherwise(1900)).cast("string"))
    number = F.coalesce(month.try_cast("int"), F.floor((F.instr(F.lit(_MONTHS), month) + 2) / 3).cast("int")).cast("string")
    filled = lambda c, other: F.when(c == "", other).otherwise(c)
    value = F.try_to_timestamp(F.concat(F.lpad(own, 4, "0"), F.lit("-"), F.lpad(number, 2, "0"), F.lit("-"), F.lpad(day, 2, "0"), F.lit(" "), filled(clock, "00:00:00"), filled(zone, "Z")))
    leap = (written == "") & (month == "Feb") & (day == "29")
    return F.when(~leap & (own != "0000"), value)


def normal_line(line: Column, parser: Column) -> Column:
    """The line with ``<time>`` in place of the first value of its parser."""
    out = line
    for place, (_, pattern, _) in enumerate(LINE_PARSERS):
        out = F.when(parser == place, F.regexp_replace(line, f"(?s)^(.*?){_uncaptured(pattern)}", "$1<time>")).otherwise(out)
    return out


def _uncaptured(pattern: str) -> str:
    return pattern.replace("(?:", "\0").replace("(", "(?:").replace("\0", "(?:")


def parser_name(parser: Column, ts: Column, year: Column) -> Column:
    """Id of a parser; a valid time without a year says where the year is from."""
    name = F.get(F.array(*[F.lit(n) for n, *_ in LINE_PARSERS]), parser)
    source = F.when(year.isNotNull(), "syslog_no_year+anchor").otherwise("syslog_no_year+1970")
    return F.when((name == "syslog_missing_year") & ts.isNotNull(), source).otherwise(name)


def stripped(line: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def read_lines(numbered: Column, year: Column) -> Column:
    """Structs (line_no, line) as structs (line_no, parser, ts, text): parser id, instant, and the line with its time taken out.

    Step by step inside array functions, so that no step is evaluated twice.
    """
    number = lambda x: x["line_no"].alias("line_no")
    placed = F.transform(numbered, lambda x: F.struct(number(x), x["line"].alias("line"), line_parser(x["line"]).alias("parser")))
    fields = F.transform(placed, lambda x: F.struct(number(x), x["parser"].alias("parser"), line_fields(x["line"], x["parser"]).alias("fields"), normal_line(x["line"], x["parser"]).alias("text")))
    timed = F.transform(fields, lambda x: F.struct(number(x), x["parser"].alias("parser"), line_time(x["fields"], year).alias("ts"), x["text"].alias("text")))
    return F.transform(timed, lambda x: F.struct(number(x), parser_name(x["parser"], x["ts"], year).alias("parser"), x["ts"].alias("ts"), x["text"].alias("text")))


def parsed_lines(text: Column, year: Column) -> Column:
    """``read_lines`` of the stripped lines of a text that aren't blank, line ends of all kinds; null for a null text."""
    numbered = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x, i: F.struct(i.alias("line_no"), stripped(x).alias("line")))
    return read_lines(F.filter(numbered, lambda x: x["line"] != ""), year)


def assemble_texts(rows: DataFrame, key: str, text: str, anchor: str, first: Column | None = None, last: Column | None = None, static: bool = True) -> DataFrame:
    """Records of whole texts: (key, line_no, ts, n_lines, text), each text read within its row, without a shuffle.

    A timed line opens a record, untimed ones join it.  Lines before the first
    time take the time of the path (``anchor``, may be null) and form one
    record each.  With a window, both ends included, records outside it are
    left out with their untimed lines; lines before the first time are then
    records of their own without an anchor (none if not ``static``), one
    record at an anchor inside the window, and none at one outside.  Null,
    empty and blank texts give no record, repeated rows repeated ones.
    """
    span = lambda ls, ts: F.struct(ls[0]["line_no"].alias("line_no"), ts.alias("ts"), F.size(ls).alias("n_lines"), F.array_join(F.transform(ls, lambda x: x["text"]), "\n").alias("text"))
    at = F.col("__anchor")
    read = rows.select(F.col(key).alias("__key"), F.col(anchor).alias("__anchor"), parsed_lines(F.col(text), F.year(anchor)).alias("ls"))
    opens = F.filter(F.transform("ls", lambda x, i: F.when(x["ts"].isNotNull(), i + 1)), lambda p: p.isNotNull())
    cut = read.withColumn("opens", opens)
    bodies = F.transform("opens", lambda p, i: F.slice("ls", p, F.coalesce(F.get("opens", i + 1), F.size("ls") + 1) - p))
    body = F.transform(bodies, lambda ls: span(ls, ls[0]["ts"]))
    head = F.slice("ls", F.lit(1), F.coalesce(F.get("opens", F.lit(0)) - 1, F.size("ls")))
    none = F.slice(body, F.lit(1), F.lit(0))
    own = F.transform(head, lambda x: span(F.array(x), at))
    if first is None or last is None:
        records = F.concat(own, body)
    else:
        inside = lambda ts: ts.between(first, last)
        kept = F.when(at.isNull(), own if static else none).when(inside(at) & (F.size(head) > 0), F.array(span(head, at))).otherwise(none)
        records = F.concat(kept, F.filter(body, lambda r: inside(r["ts"])))
    return cut.select(F.col("__key").alias(key), F.explode(records).alias("r")).select(key, "r.line_no", "r.ts", "r.n_lines", "r.text")


def assemble(timed: DataFrame, key: str, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """Records of a table of lines (key, line_no, ts, text), where one key may hold any number of them.

    As ``assemble_texts`` without anchors; openings are counted in blocks of
    lines, so that a long text is spread over many tasks.
    """
    counted = running_sum(timed.withColumn("__timed", F.col("ts").isNotNull().cast("int")), [key], "line_no", "__timed", LINES_PER_BLOCK, name="opened")
    grouped = counted.withColumn("group", F.when(F.col("opened") == 0, -F.col("line_no") - 1).otherwise(F.col("opened")))
    records = grouped.groupBy(key, "group").agg(
        F.min("line_no").alias("line_no"), F.max("ts").alias("ts"), F.count("*").alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"),
    )
    if first is not None and last is not None:
        records = records.where(F.col("ts").isNull() | F.col("ts").between(first, last))
    return records.select(key, "line_no", "ts", "n_lines", "text")


def record_text(start: Column, end: Column, cnt: Column, text: Column) -> Column:
    """A record as a line of text: its time or span, how often, and its text."""
    at = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    several = F.concat(cnt.cast("string"), F.lit(" times between "), at(start), F.lit(" and "), at(end), F.lit(" "), text)
    return F.when((cnt > 1) & start.isNotNull() & end.isNotNull(), several).when(start.isNotNull(), F.concat(at(start), F.lit(" "), text)).otherwise(text)
