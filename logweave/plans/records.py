"""Line time, path anchor and record assembly queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.paths import path_anchor as anchor_of
from logweave.operators import records
from logweave.operators.log_lines import raw_chunks
from logweave.session import table


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw texts with the date of their path: id, text, anchor."""
    return raw_chunks(table(spark, sf_dir, "log_chunks")).select("id", "source_path", "text", anchor_of(F.col("source_path"))["at"].alias("anchor"))


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("id", F.explode(records.parsed_lines(F.col("text"), F.year("anchor"))).alias("r")).select("id", "r.*")


def line_time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _timed(spark, sf_dir)
    return found.select("id", F.col("line_no").cast("bigint").alias("line_no"), F.coalesce("parser", F.lit("")).alias("parser"), F.unix_micros("ts").alias("at_us"), F.md5("text").alias("text_md5"))


def parser_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per parser: lines with a time, first and last time, and the lines of each year."""
    seen = _timed(spark, sf_dir).where("ts is not null").withColumn("y", F.year("ts").cast("bigint"))
    return seen.groupBy("parser", "y").agg(F.count("*").alias("n"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"))


def path_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "staged_chunks").select("source_path").distinct()
    anchored = paths.select("source_path", anchor_of(F.col("source_path")).alias("a"))
    return anchored.select("source_path", F.col("a.score").alias("score"), F.date_format("a.at", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("a.part").alias("part"))


def _records(found: DataFrame) -> DataFrame:
    return found.select("id", F.col("line_no").cast("bigint").alias("line_no"), F.unix_micros("ts").alias("at_us"), F.col("n_lines").cast("bigint").alias("n_lines"), F.md5("text").alias("text_md5"))


def record_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(records.assemble_texts(_raw(spark, sf_dir), "id", "text", "anchor"))


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = F.lit("2016-01-10 00:00:00").cast("timestamp"), F.lit("2016-01-20 00:00:00").cast("timestamp")
    return _records(records.assemble_texts(_raw(spark, sf_dir), "id", "text", "anchor", first, last))


def record_assembly_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of raw chunks in a window."""
    return _windowed(spark, sf_dir).where("at_us is not null")


def header_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of raw chunks in a window with those of lines before the first time."""
    return _windowed(spark, sf_dir)


QUERIES = {
    "line_time_parse": line_time_parse, "parser_stats": parser_stats, "path_anchor": path_anchor, "record_assembly": record_assembly, "record_assembly_windowed": record_assembly_windowed, "header_records": header_records,
}

# The SQL is written from the survey's description of the parsers, not from the tables of the operators.
_SEGMENTS = r"""segs as (select source_path, unnest(list_filter(string_split_regex(source_path, '[/\\]'), lambda x: x <> '')) as seg, generate_subscripts(list_filter(string_split_regex(source_path, '[/\\]'), lambda x: x <> ''), 1) - 1 as place from paths),
read as (select *, case
  when regexp_matches(seg, '\d{4}-\d{2}-\d{2}T\d{2}_\d{2}_\d{2}') then [1000, 0] when regexp_matches(seg, '\d{4}-\d{2}-\d{2}_\d{2}_\d{2}_\d{2}') then [900, 1]
  when regexp_matches(seg, '\d{2}\.\d{2}\.\d{2}_\d{2}\.\d{2}') then [800, 2] when regexp_matches(seg, '_\d{6}_\d{4}$') then [750, 3]
  when regexp_matches(seg, '(?i)\d{1,2}\s+(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?(ember)?|oct(ober)?|nov(ember)?|dec(ember)?)\s+\d{2}(\D|$)') then [670, 4]
  when regexp_matches(seg, '_\d{6}$') then [650, 5] when regexp_matches(seg, '\d{1,2}[.-]\d{1,2}[.-]\d{4}(\D|$)') then [150, 6] when regexp_matches(seg, '\d{1,2}[.-]\d{1,2}[.-]\d{2}(\D|$)') then [100, 7] end as kind from segs),
cut as (select *, case kind[2]
  when 0 then regexp_extract(seg, '(\d{4})-(\d{2})-(\d{2})T(\d{2})_(\d{2})_(\d{2})', ['y', 'm', 'd', 'h', 'i', 's']) when 1 then regexp_extract(seg, '(\d{4})-(\d{2})-(\d{2})_(\d{2})_(\d{2})_(\d{2})', ['y', 'm', 'd', 'h', 'i', 's'])
  when 2 then regexp_extract(seg, '(\d{2})\.(\d{2})\.(\d{2})_(\d{2})\.(\d{2})()', ['d', 'm', 'y', 'h', 'i', 's']) when 3 then regexp_extract(seg, '_(\d{2})(\d{2})(\d{2})_(\d{2})(\d{2})()$', ['d', 'm', 'y', 'h', 'i', 's'])
  when 4 then regexp_extract(seg, '(?i)(\d{1,2})\s+((?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))[a-z]*\s+(\d{2})()()()(?:\D|$)', ['d', 'm', 'y', 'h', 'i', 's'])
  when 5 then regexp_extract(seg, '_(\d{2})(\d{2})(\d{2})()()()$', ['d', 'm', 'y', 'h', 'i', 's'])
  when 6 then regexp_extract(seg, '(\d{1,2})[.-](\d{1,2})[.-](\d{4})()()()(?:\D|$)', ['d', 'm', 'y', 'h', 'i', 's']) when 7 then regexp_extract(seg, '(\d{1,2})[.-](\d{1,2})[.-](\d{2})()()()(?:\D|$)', ['d', 'm', 'y', 'h', 'i', 's']) end as p from read where kind is not null),
dated as (select source_path, seg, place, kind[1] + place as score,
  try_strptime(case when length(p.y) = 4 then p.y when p.y <= '70' then '20' || p.y else '19' || p.y end || '-' || case kind[2] when 4 then cast((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(p.m)) + 2) // 3 as varchar) else p.m end || '-' || p.d
    || ' ' || lpad(p.h, 2, '0') || ':' || lpad(p.i, 2, '0') || ':' || lpad(p.s, 2, '0'), '%Y-%m-%d %H:%M:%S') as day from cut),
anchors as (select source_path, arg_max(struct_pack(score := score, day := day, part := seg), score * 1000 - place) as a from dated where day is not null group by source_path)"""

_MONTH = "cast((instr('JanFebMarAprMayJunJulAugSepOctNovDec', {b}) + 2) // 3 as varchar)"
_CENTURY = "case when length({y}) = 4 then {y} when try_cast({y} as int) < 69 then '20' || {y} else '19' || {y} end"


def _stamp(day: str, clock: str) -> str:
    return f"try_cast({day} || ' ' || {clock} || '+00' as timestamptz)"


_M = _MONTH.format(b="g.b")
_TIMES = rf"""raw as (select id, source_path, content_json[1].text as text from log_chunks where len(content_json) = 1 and content_json[1].ts_start is null),
paths as (select distinct source_path from raw where source_path is not null), {_SEGMENTS},
anchored as (select id, text, a.day as anchor from raw left join anchors using (source_path)),
l0 as (select id, anchor, unnest(string_split_regex(text, '\r\n|\r|\n')) as line, generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) - 1 as line_no from anchored),
l1 as (select id, anchor, line_no, regexp_replace(line, '^\s+|\s+$', '', 'g') as line from l0),
l as (select *, case
  when regexp_matches(line, '\b\d\d-\d\d-\d\d[ T]\d\d:\d\d:\d\d(\.\d{{1,6}})?\b') then 1
  when regexp_matches(line, '\b(Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{{1,2}}\s+\d\d:\d\d:\d\d(\s+UTC)?\s+\d{{4}}\b') then 2
  when regexp_matches(line, '\b[A-Z][a-z][a-z]\s+\d{{1,2}}\s+\d{{4}},\s+\d\d:\d\d:\d\d\b') then 3 when regexp_matches(line, '\b[A-Z][a-z][a-z]\s+\d{{1,2}}\s+\d{{4}}\s+\d\d:\d\d:\d\d\b') then 4
  when regexp_matches(line, '\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{{1,2}}\s+\d\d:\d\d:\d\d\b') then 5
  when regexp_matches(line, '\b\d{{4}}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(\.\d{{1,6}})?(Z|[+-]\d\d:\d\d)?\b') then 6 when regexp_matches(line, '\b(\d{{4}}|\d\d)-\d\d-\d\d\b') then 7 end as k from l1 where line <> ''),
x as (select *, case k
  when 1 then regexp_extract(line, '\b(\d\d)-(\d\d)-(\d\d)[ T](\d\d:\d\d:\d\d(?:\.\d{{1,6}})?)()()\b', ['y', 'm', 'd', 't', 'b', 'z'])
  when 2 then regexp_extract(line, '\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+()(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{{1,2}})\s+(\d\d:\d\d:\d\d)(?:\s+UTC)?\s+(\d{{4}})()\b', ['m', 'b', 'd', 't', 'y', 'z'])
  when 3 then regexp_extract(line, '\b([A-Z][a-z][a-z])\s+(\d{{1,2}})\s+(\d{{4}}),\s+(\d\d:\d\d:\d\d)()()\b', ['b', 'd', 'y', 't', 'm', 'z'])
  when 4 then regexp_extract(line, '\b([A-Z][a-z][a-z])\s+(\d{{1,2}})\s+(\d{{4}})\s+(\d\d:\d\d:\d\d)()()\b', ['b', 'd', 'y', 't', 'm', 'z'])
  when 5 then regexp_extract(line, '\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{{1,2}})\s+(\d\d:\d\d:\d\d)()()()\b', ['b', 'd', 't', 'm', 'y', 'z'])
  when 6 then regexp_extract(line, '\b(\d{{4}})-(\d\d)-(\d\d)[ T](\d\d:\d\d:\d\d(?:\.\d{{1,6}})?)(Z|[+-]\d\d:\d\d)?()\b', ['y', 'm', 'd', 't', 'z', 'b'])
  when 7 then regexp_extract(line, '\b(\d{{4}}|\d\d)-(\d\d)-(\d\d)()()()\b', ['y', 'm', 'd', 't', 'b', 'z']) end as g from l),
t as (select id, line_no, anchor, k, case k
  when 1 then {_stamp(_CENTURY.format(y="g.y") + " || '-' || g.m || '-' || g.d", "g.t")}
  when 5 then case when not (g.b = 'Feb' and g.d = '29') then {_stamp(f"coalesce(year(anchor), 1970) || '-' || {_M} || '-' || g.d", "g.t")} end
  when 6 then try_cast(g.y || '-' || g.m || '-' || g.d || ' ' || g.t || case when coalesce(g.z, '') in ('', 'Z') then '+00' else g.z end as timestamptz)
  when 7 then {_stamp(_CENTURY.format(y="g.y") + " || '-' || g.m || '-' || g.d", "'00:00:00'")}
  else {_stamp(f"g.y || '-' || {_M} || '-' || g.d", "g.t")} end as ts,
  case k when 1 then regexp_replace(line, '\b\d\d-\d\d-\d\d[ T]\d\d:\d\d:\d\d(\.\d{{1,6}})?\b', '<time>')
  when 2 then regexp_replace(line, '\b(Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{{1,2}}\s+\d\d:\d\d:\d\d(\s+UTC)?\s+\d{{4}}\b', '<time>')
  when 3 then regexp_replace(line, '\b[A-Z][a-z][a-z]\s+\d{{1,2}}\s+\d{{4}},\s+\d\d:\d\d:\d\d\b', '<time>') when 4 then regexp_replace(line, '\b[A-Z][a-z][a-z]\s+\d{{1,2}}\s+\d{{4}}\s+\d\d:\d\d:\d\d\b', '<time>')
  when 5 then regexp_replace(line, '\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{{1,2}}\s+\d\d:\d\d:\d\d\b', '<time>')
  when 6 then regexp_replace(line, '\b\d{{4}}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(\.\d{{1,6}})?(Z|[+-]\d\d:\d\d)?\b', '<time>') when 7 then regexp_replace(line, '\b(\d{{4}}|\d\d)-\d\d-\d\d\b', '<time>') else line end as text from x),
p as (select *, case when k = 5 and ts is not null and anchor is not null then 'syslog_no_year+anchor' when k = 5 and ts is not null then 'syslog_no_year+1970'
  else coalesce(['short_yy-mm-dd', 'text_with_dow', 'syslog_year_comma', 'syslog_with_year', 'syslog_missing_year', 'iso', 'date_only'][k], '') end as parser from t)"""

_OPENED = _TIMES + ", o as (select *, sum(case when ts is not null then 1 else 0 end) over (partition by id order by line_no rows unbounded preceding) as opened from p)"
_UTC_ANCHOR = "anchor at time zone 'UTC'"
#: Records of raw chunks as the table g (id, line_no, moment, n_lines, text).
RECORDS_SQL = f"""{_OPENED}, g as (select id, case when opened = 0 then -line_no - 1 else opened end as grp, min(line_no) as line_no, max(case when opened = 0 then {_UTC_ANCHOR} else ts end) as moment, count(*) as n_lines,
  string_agg(text, chr(10) order by line_no) as text from o group by 1, 2)"""
_WINDOW = _OPENED + f""", h as (select *, {_UTC_ANCHOR} between timestamptz '2016-01-10 00:00:00+00' and timestamptz '2016-01-20 00:00:00+00' as inside from o),
g as (select id, case when opened = 0 and anchor is null then -line_no - 1 else opened end as grp, min(line_no) as line_no, max(case when opened = 0 then {_UTC_ANCHOR} else ts end) as moment, count(*) as n_lines, string_agg(text, chr(10) order by line_no) as text
  from h where opened > 0 or anchor is null or inside group by 1, 2),
w as (select id, line_no, epoch_us(moment) as at_us, n_lines, md5(text) as text_md5 from g where moment is null or moment between timestamptz '2016-01-10 00:00:00+00' and timestamptz '2016-01-20 00:00:00+00')"""

SQL = {
    "line_time_parse": f"with {_TIMES} select id, line_no, parser, epoch_us(ts) as at_us, md5(text) as text_md5 from p",
    "parser_stats": f"with {_TIMES} select parser, year(ts at time zone 'UTC') as y, count(*) as n, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us from p where ts is not null group by 1, 2",
    "path_anchor": f"with paths as (select distinct source_path from staged_chunks), {_SEGMENTS} select source_path, cast(a.score as int) as score, strftime(a.day, '%Y-%m-%d %H:%M:%S') as at, a.part as part from paths left join anchors using (source_path) where source_path is not null union all select null, null, null, null from paths where source_path is null",
    "record_assembly": f"with {RECORDS_SQL} select id, line_no, epoch_us(moment) as at_us, n_lines, md5(text) as text_md5 from g",
    "record_assembly_windowed": f"with {_WINDOW} select * from w where at_us is not null",
    "header_records": f"with {_WINDOW} select * from w",
}
