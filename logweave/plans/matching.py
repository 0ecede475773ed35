"""Incident, ticket and match queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.paths import cell_under, path_unit, same_path
from logweave.operators import build
from logweave.operators import matching as m
from logweave.operators.timestamps import TIME_HEADERS, ticket_unit
from logweave.session import table

_ANALYSIS = ("Analysis", "Finding of developer")


def _tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket rows, each once."""
    return table(spark, sf_dir, "ticket_rows").dropDuplicates(["ticket_id", "sheet_id", "row_no"])


def date_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds that occur both as a match result and as an incident."""
    left = table(spark, sf_dir, "match_results").select(F.unix_seconds(m.utc_second(F.col("source_ts"))).alias("second"), "result_id").where("second is not null")
    right = table(spark, sf_dir, "incidents").select(F.unix_seconds(m.utc_second(F.col("mapped_date"))).alias("second"), "incident_id").where("second is not null")
    left = left.groupBy("second").agg(F.count("*").alias("n_results"))
    right = right.groupBy("second").agg(F.count("*").alias("n_incidents"))
    return left.join(right, "second")


def date_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose date is among the dates of any ticket."""
    dates = table(spark, sf_dir, "ticket_rows").select(F.explode("matched_dates").alias("matched_date")).distinct()
    return table(spark, sf_dir, "match_results").join(dates, "matched_date", "left_semi").select("result_id", "matched_date")


def row_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticket rows per matched date."""
    rows = _tickets(spark, sf_dir).select("ticket_id", "sheet_id", F.explode("matched_dates").alias("matched_date"))
    return rows.groupBy("matched_date").agg(F.count_distinct("ticket_id").alias("n_tickets"), F.count_distinct("sheet_id").alias("n_sheets"))


def _scored(spark: SparkSession, sf_dir: str, shapes: bool = False) -> DataFrame:
    """Result and ticket row of one date with the source lines that the row quotes: score and hits per column."""
    lines = table(spark, sf_dir, "match_results").select("result_id", "matched_date", F.explode("match_list").alias("x")).select("result_id", "matched_date", F.explode("x.matched_source_lines").alias("line"))
    rows = _tickets(spark, sf_dir).select("ticket_id", "sheet_id", "row_no", "matched_dates", "cells")
    return m.score_rows(lines, rows, shapes)


def best_row_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.best_rows(_scored(spark, sf_dir), ["result_id"], keep_ties=False).select("result_id", "ticket_id", "score", F.to_json("matched_cells").alias("matched_cells"))


def best_row_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.best_rows(_scored(spark, sf_dir), ["result_id"]).select("result_id", "ticket_id", "score")


def best_row_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``best_row_match`` with lines and cells compared without their numbers."""
    return m.best_rows(_scored(spark, sf_dir, shapes=True), ["result_id"], keep_ties=False).select("result_id", "ticket_id", "score", F.to_json("matched_cells").alias("matched_cells"))


def match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "match_results")
    return results.agg(
        F.count("*").alias("n_results"), F.count_if(F.size("match_list") > 0).alias("n_matched"), F.count_if("had_date_overlap").alias("n_overlap"), F.count_if(F.size("match_list") > 1).alias("n_several")
    )


def unmatched_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents whose mapped time stands in no cell of their ticket."""
    rows = _tickets(spark, sf_dir).select("ticket_id", "row_values")
    bare = F.translate(F.substring("mapped_date", 1, 19), "T", " ")
    joined = table(spark, sf_dir, "incidents").where("mapped_date is not null").join(rows, "ticket_id")
    return joined.where(~F.exists("row_values", lambda v: F.coalesce(F.contains(v, bare), F.lit(False)))).select("incident_id", "ticket_id")


def value_at_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit key and report time of every ticket, found by their headers."""
    row = F.col("headers"), F.col("row_values")
    return _tickets(spark, sf_dir).select("ticket_id", ticket_unit(*row).alias("unit"), cell_under(*row, TIME_HEADERS).alias("reported"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    tickets = _tickets(spark, sf_dir).select("ticket_id", ticket_unit(F.col("headers"), F.col("row_values")).alias("unit"))
    at = F.unix_micros(F.try_to_timestamp(F.col("mapped_date")))
    return table(spark, sf_dir, "incidents").join(tickets, "ticket_id").select("unit", F.col("incident_id").alias("point_id"), at.alias("at_us"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.regexp_replace(path_unit(F.col("source_path")), "-", "")
    return table(spark, sf_dir, "log_chunks").where("has_time and time_start is not null").select(unit.alias("unit"), F.col("id").alias("record_id"), F.unix_micros("time_start").alias("at_us"))


def incident_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the unit of each incident that start within a day of it."""
    counts = m.window_counts(_points(spark, sf_dir), _chunks(spark, sf_dir), m.DAY_US, m.DAY_US)
    return counts.select(F.col("point_id").alias("incident_id"), "n")


def incident_window_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the unit of each incident that start within the hour before it."""
    found = m.window_join(_points(spark, sf_dir).where("at_us is not null"), _chunks(spark, sf_dir), 3_600_000_000, 600_000_000)
    return found.select(F.col("point_id").alias("incident_id"), F.col("record_id").alias("id"))


def marker_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per severity of a marker: events and distinct days."""
    markers = [("emergency", 1), ("lost sync", 2), ("stalled", 3)]
    records = table(spark, sf_dir, "log_chunks").select(F.explode("content_json").alias("r")).select("r.ts_start", F.lower("r.text").alias("text")).where("ts_start is not null")
    hits = records.select("ts_start", F.explode(F.filter(F.array(*[F.when(F.contains("text", F.lit(name)), F.struct(F.lit(name).alias("marker"), F.lit(rank).alias("severity"))) for name, rank in markers]), lambda x: x.isNotNull())).alias("h"))
    return hits.groupBy("h.marker", "h.severity").agg(F.count("*").alias("n_events"), F.count_distinct(F.to_date("ts_start")).alias("n_days"))


def line_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of the source lines of all matches."""
    lines = table(spark, sf_dir, "match_results").select("result_id", F.explode("match_list").alias("x")).select("result_id", F.explode("x.matched_source_lines").alias("raw"))
    return lines.select("result_id", F.explode(m.line_variants(F.col("raw"))).alias("variant")).distinct()


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated records from the hour before to ten minutes after every incident."""
    unit = F.regexp_replace(path_unit(F.col("source_path")), "-", "")
    records = table(spark, sf_dir, "log_chunks").select(unit.alias("unit"), same_path(F.col("source_path")).alias("source_path"), F.explode("content_json").alias("r"))
    records = records.select("unit", "source_path", F.unix_micros("r.ts_start").alias("ts_us"), F.col("r.text").alias("text"), F.col("r.cnt").alias("cnt"))
    incidents = _points(spark, sf_dir).select("unit", F.col("point_id").alias("incident_id"), "at_us")
    return build.deduplicated(build.window_records(incidents, records, 3_600_000_000, 600_000_000))


def incident_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence build: chunks of the records around every incident."""
    return build.packed(_evidence(spark, sf_dir)).select("incident_id", "source_path", "chunk_id", "n_records", "n_chars")


def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the evidence of each incident amounts to before packing."""
    return _evidence(spark, sf_dir).groupBy("incident_id").agg(F.count("*").alias("n_texts"), F.sum("cnt").alias("n_events"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def dates_in_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of match results that are also dates of tickets."""
    tickets = table(spark, sf_dir, "ticket_rows").select(F.explode("matched_dates").alias("day"))
    return table(spark, sf_dir, "match_results").select(F.col("matched_date").alias("day")).intersect(tickets)


def dates_in_either(spark: SparkSession, sf_dir: str) -> DataFrame:
    tickets = table(spark, sf_dir, "ticket_rows").select(F.explode("matched_dates").alias("day"))
    return table(spark, sf_dir, "match_results").select(F.col("matched_date").alias("day")).unionByName(tickets).distinct()


QUERIES = {
    "incident_chunks": incident_chunks, "evidence_lines": evidence_lines, "dates_in_both": dates_in_both, "dates_in_either": dates_in_either,
    "date_exact_match": date_exact_match, "date_overlap": date_overlap, "row_by_date": row_by_date, "best_row_match": best_row_match, "best_row_ties": best_row_ties, "best_row_shapes": best_row_shapes, "match_stats": match_stats,
    "unmatched_tickets": unmatched_tickets, "value_at_header": value_at_header, "incident_window_counts": incident_window_counts, "incident_window_join": incident_window_join,
    "marker_events": marker_events, "line_variants": line_variants,
}

_NORMAL = r"lower(trim(regexp_replace({x}, '\s+', ' ', 'g')))"


_TICKETS = "tk as (select distinct on (ticket_id, sheet_id, row_no) * from ticket_rows)"
_UNIT = f"""cells as (select ticket_id, unnest(list_zip(headers, row_values)) as c, unnest(range(0, len(headers))) as place from tk),
units as (select ticket_id, nullif(regexp_replace(upper(arg_min(c[2], place)), '[^A-Z0-9]', '', 'g'), '') as unit from cells where lower(trim(c[1])) in ('vehicle', 'unit', 'train set') and trim(c[2]) <> '' group by 1)"""
_POINTS = f"{_TICKETS}, {_UNIT}, pts as (select unit, incident_id, epoch_us(cast(mapped_date as timestamptz)) as at from incidents i join tk using (ticket_id) left join units using (ticket_id))"
_CHUNKS = r"ch as (select replace(regexp_extract(source_path, '^[^/\\]*'), '-', '') as unit, id, epoch_us(time_start) as at from log_chunks where has_time and time_start is not null)"
_STRIPPED = r"trim(regexp_replace(regexp_replace(trim({x}), '^(?i)<time>\s*', ''), '^\s*[-:|]\s*', ''))"


def _scored_sql(shapes: bool = False) -> str:
    def seen(x: str) -> str:
        return f"regexp_replace({x}, '0x[0-9a-f]+|[0-9]+(\\.[0-9]+)?', '#', 'g')" if shapes else x

    return f"""{_TICKETS},
ml as (select result_id, matched_date, unnest(match_list) as x from match_results),
raw as (select distinct result_id, matched_date, unnest(x.matched_source_lines) as r from ml),
v as (select distinct result_id, matched_date, r, {seen("w")} as w from (select result_id, matched_date, r, unnest([{_NORMAL.format(x="r")}, {_NORMAL.format(x=_STRIPPED.format(x="r"))}]) as w from raw) where length(w) >= 4),
td as (select distinct ticket_id, sheet_id, row_no, unnest(matched_dates) as matched_date, cells from tk),
tc as (select ticket_id, sheet_id, row_no, matched_date, list_filter(list_transform(list_filter(cells, lambda c: c.cell_value is not null), lambda c: [c.col_letter, {seen(_NORMAL.format(x="c.cell_value"))}]), lambda c: c[2] <> '') as cs from td),
tb as (select *, array_to_string(list_transform(cs, lambda c: c[2]), ' | ') as blob from tc),
h as (select result_id, ticket_id, sheet_id, row_no, r, list_distinct(flatten(list(list_transform(list_filter(cs, lambda c: contains(c[2], w)), lambda c: c[1])))) as cols from v join tb using (matched_date) where contains(blob, w) group by 1, 2, 3, 4, 5),
s as (select result_id, ticket_id, sheet_id, row_no, count(*) as score from h group by 1, 2, 3, 4),
hc as (select result_id, ticket_id, sheet_id, row_no, col, count(*) as n from (select *, unnest(cols) as col from h) where col is not null group by 1, 2, 3, 4, 5),
sc as (select s.*, coalesce(j, '{{}}') as matched_cells from s left join (select result_id, ticket_id, sheet_id, row_no, '{{' || string_agg('"' || col || '":' || n, ',' order by col) || '}}' as j from hc group by 1, 2, 3, 4) using (result_id, ticket_id, sheet_id, row_no))"""


_EVIDENCE = """r as (select replace(regexp_extract(source_path, '^[^/\\\\]*'), '-', '') as unit, replace(source_path, '\\', '/') as source_path, unnest(content_json) as e from log_chunks),
w as (select incident_id, source_path, epoch_us(e.ts_start) as ts, e.text as text, e.cnt as cnt from pts join r on pts.unit = r.unit and epoch_us(e.ts_start) between pts.at - 3600000000 and pts.at + 600000000),
d as (select incident_id, source_path, text, min(ts) as a, max(ts) as b, sum(coalesce(cnt, 1)) as c from w group by 1, 2, 3)"""

SQL = {
    "evidence_lines": f"with {_POINTS}, {_EVIDENCE} select incident_id, count(*) as n_texts, cast(sum(c) as bigint) as n_events, min(a) as first_us, max(b) as last_us from d group by incident_id",
    "dates_in_both": "select distinct matched_date as day from match_results where matched_date in (select unnest(matched_dates) from ticket_rows)",
    "dates_in_either": "select matched_date as day from match_results union select unnest(matched_dates) from ticket_rows",
    "date_exact_match": """
with a as (select cast(epoch(date_trunc('second', cast(source_ts as timestamptz))) as bigint) as second, count(*) as n_results from match_results where source_ts is not null group by 1),
b as (select cast(epoch(date_trunc('second', cast(mapped_date as timestamptz))) as bigint) as second, count(*) as n_incidents from incidents where mapped_date is not null group by 1)
select second, n_results, n_incidents from a join b using (second)""",
    "date_overlap": "select result_id, matched_date from match_results where matched_date in (select unnest(matched_dates) from ticket_rows)",
    "row_by_date": f"with {_TICKETS}, d as (select ticket_id, sheet_id, unnest(matched_dates) as matched_date from tk) select matched_date, count(distinct ticket_id) as n_tickets, count(distinct sheet_id) as n_sheets from d group by 1",
    "best_row_match": f"with {_scored_sql()} select result_id, ticket_id, score, matched_cells from (select *, row_number() over (partition by result_id order by score desc, sheet_id, row_no, ticket_id) as place from sc) where place = 1",
    "best_row_shapes": f"with {_scored_sql(shapes=True)} select result_id, ticket_id, score, matched_cells from (select *, row_number() over (partition by result_id order by score desc, sheet_id, row_no, ticket_id) as place from sc) where place = 1",
    "best_row_ties": f"with {_scored_sql()} select result_id, ticket_id, score from (select *, rank() over (partition by result_id order by score desc) as place from s) where place = 1",
    "match_stats": "select count(*) as n_results, count(*) filter (len(match_list) > 0) as n_matched, count(*) filter (had_date_overlap) as n_overlap, count(*) filter (len(match_list) > 1) as n_several from match_results",
    "unmatched_tickets": f"""with {_TICKETS} select incident_id, ticket_id from incidents join tk using (ticket_id) where mapped_date is not null
and len(list_filter(row_values, lambda v: coalesce(contains(v, replace(left(mapped_date, 19), 'T', ' ')), false))) = 0""",
    "value_at_header": f"""with {_TICKETS}, {_UNIT}, times as (select ticket_id, arg_min(c[2], place) as reported from cells where lower(trim(c[1])) in ('reported at', 'time of report') and trim(c[2]) <> '' group by 1)
select tk.ticket_id, unit, reported from tk left join units using (ticket_id) left join times using (ticket_id)""",
    "incident_window_counts": f"with {_POINTS}, {_CHUNKS} select incident_id, count(ch.id) as n from pts left join ch on pts.unit = ch.unit and ch.at between pts.at - 86400000000 and pts.at + 86400000000 group by 1",
    "incident_window_join": f"with {_POINTS}, {_CHUNKS} select incident_id, id from pts join ch on pts.unit = ch.unit and ch.at between pts.at - 3600000000 and pts.at + 600000000",
    "marker_events": """
with r as (select unnest(content_json) as e from log_chunks), t as (select e.ts_start as ts, lower(e.text) as text from r where e.ts_start is not null),
mk as (select * from (values ('emergency', 1), ('lost sync', 2), ('stalled', 3)) as v(marker, severity))
select marker, severity, count(*) as n_events, count(distinct cast(ts as date)) as n_days from t join mk on contains(text, marker) group by 1, 2""",
    "line_variants": f"""with ml as (select result_id, unnest(match_list) as x from match_results), raw as (select result_id, unnest(x.matched_source_lines) as r from ml),
v as (select distinct result_id, unnest([{_NORMAL.format(x="r")}, {_NORMAL.format(x=_STRIPPED.format(x="r"))}]) as variant from raw) select result_id, variant from v where length(variant) >= 4""",
}
