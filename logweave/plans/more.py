"""Queries of the remaining reference operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions.paths import path_unit, same_path
from logweave.operators import catalog, metrics, records
from logweave.plans.metrics import texts
from logweave.session import ship, table


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for all staged files in one folder."""
    files = table(spark, sf_dir, "staged_chunks").where("source_path is not null").select("stage_id", F.substring_index(same_path(F.col("source_path")), "/", -1).alias("name"))
    return catalog.unique_names(files, "name", "stage_id").select(F.col("key").alias("stage_id"), "unique")


def collapsed_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders below each unit, runs of door logs as one line."""
    path = same_path(F.col("source_path"))
    listing = table(spark, sf_dir, "staged_chunks").where("source_path is not null").select(F.substring_index(path, "/", 1).alias("folder"), F.split(path, "/")[2].alias("name")).where("name is not null").distinct()
    return catalog.collapse_siblings(listing, "-log-")


def incident_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated folders per year and month."""
    days = catalog.dated_folders(table(spark, sf_dir, "staged_chunks").select(F.regexp_replace("source_path", "_", "T").alias("path")), "path")
    return days.groupBy(F.year("day").cast("bigint").alias("y"), F.month("day").cast("bigint").alias("m")).agg(F.count("*").alias("n"))


def wanted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = catalog.decide_files(table(spark, sf_dir, "staged_chunks").select("stage_id", same_path(F.col("source_path")).alias("path")), "path", {"log": True, "txt": True, "js": False})
    return files.groupBy("wanted").agg(F.count("*").alias("n"))


def marker_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per second of a marker event: number of sources and of lines."""
    found = table(spark, sf_dir, "log_chunks").select("source_path", F.explode("content_json").alias("r")).where(F.contains("r.text", F.lit("interlock")) & F.col("r.ts_start").isNotNull())
    return found.groupBy(F.unix_seconds("r.ts_start").alias("second")).agg(F.count_distinct("source_path").alias("n_sources"), F.count("*").alias("n_lines"))


def event_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts of events, numbers aside."""
    found = table(spark, sf_dir, "log_chunks").select(F.explode("content_json").alias("r")).where("r.ts_start is not null").select(F.regexp_replace("r.text", "[0-9]+", "0").alias("text"))
    return found.groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"))


def retrieval_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks about an emergency per unit against the twelve earliest chunks that hold ``interlock``."""
    chunks = table(spark, sf_dir, "log_chunks").select(path_unit(F.col("source_path")).alias("id"), F.col("id").alias("chunk"), "content_text", "time_start")
    relevant = chunks.where(F.contains("content_text", F.lit("EMERGENCY")))
    hits = chunks.where(F.contains("content_text", F.lit("interlock")))
    # top-k per unit: each partition keeps its own first rows before the shuffle
    first = hits.select("id", F.struct(F.col("time_start").isNull().alias("undated"), "time_start", "chunk").alias("place"))
    retrieved = first.withColumn("no", F.row_number().over(W.partitionBy("id").orderBy("place"))).where("no <= 12").select("id", "place.chunk")
    return metrics.retrieval(relevant, retrieved)


def text_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.text_recall(texts(ship(spark), sf_dir))


def keyword_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.keyword_counts(table(spark, sf_dir, "documents"), "text", ("emergency", "restart", "reset"))


def length_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.density(table(spark, sf_dir, "documents").select(F.length("text").alias("n")), "n", 0.0, 3000.0, 16, 200.0)
    return rows.select("x", F.round("density", 9).alias("density"))


def record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of chunks as lines of text."""
    rows = table(spark, sf_dir, "log_chunks").select("id", F.posexplode("content_json").alias("pos", "r"))
    return rows.select("id", "pos", F.md5(records.record_text(F.col("r.ts_start"), F.col("r.ts_end"), F.col("r.cnt"), F.col("r.text"))).alias("line_md5"))


def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each match result, and their mean over all results with any."""
    sizes = table(spark, sf_dir, "match_results").select("had_date_overlap", F.size(F.array_distinct(F.transform("match_list", lambda x: F.translate(x["source_path"], "\\", "/")))).alias("n"))
    return sizes.where("n > 0").groupBy("had_date_overlap").agg(F.count("*").alias("n_results"), F.round(F.avg("n"), 6).alias("mean_sources"))


def log_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line lengths of documents per kind in bins of powers of two."""
    lines = table(spark, sf_dir, "documents").select("doc_kind", F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.select("doc_kind", F.length(F.bin(F.length("line"))).cast("bigint").alias("bin")).groupBy("doc_kind", "bin").agg(F.count("*").alias("n"))


QUERIES = {
    "unique_names": unique_names, "collapsed_listing": collapsed_listing, "incident_days": incident_days, "wanted_files": wanted_files, "marker_grouped": marker_grouped, "event_texts": event_texts,
    "retrieval_quality": retrieval_quality, "text_recall": text_recall, "keyword_presence": keyword_presence, "length_density": length_density, "record_texts": record_texts,
    "source_coverage": source_coverage, "log_bins": log_bins,
}

_PATH = r"replace(source_path, '\', '/')"

SQL = {
    "unique_names": f"""with f as (select stage_id, string_split({_PATH}, '/')[-1] as name from staged_chunks where source_path is not null), n as (select *, row_number() over (partition by name order by stage_id) - 1 as place from f)
select stage_id, case when place = 0 then name else place || '-' || name end as "unique" from n""",
    "collapsed_listing": f"""with l as (select distinct string_split({_PATH}, '/')[1] as folder, string_split({_PATH}, '/')[3] as name from staged_chunks where source_path is not null and len(string_split({_PATH}, '/')) > 2),
n as (select *, contains(name, '-log-') as m, row_number() over (partition by folder order by name) as i from l),
r as (select *, case when m then i - row_number() over (partition by folder, m order by name) else -i end as run, not m and coalesce(lag(m) over (partition by folder order by name), false) as ends from n)
select folder, min(name) as first_name, count(*) as n from r where not ends group by folder, m, run""",
    "incident_days": r"""with f as (select distinct unnest(string_split_regex(replace(source_path, '_', 'T'), '[/\\]')) as folder from staged_chunks where source_path is not null),
d as (select try_strptime(string_split(folder, 'T')[1], '%Y-%m-%d') as day from f where regexp_matches(string_split(folder, 'T')[1], '^\d{4}-\d{2}-\d{2}$'))
select year(day) as y, month(day) as m, count(*) as n from d where day is not null group by 1, 2""",
    "wanted_files": r"""with f as (select string_split(regexp_extract(source_path, '[^/\\]*$'), '.')[2:] as own from staged_chunks),
e as (select own, list_transform(own, lambda x: lower(x)) as low from f),
x as (select case when own is null then null when len(low) = 0 then 'none' when list_contains(low, 'log') then case when low[-1] = 'gz' then 'log.gz' else 'log' end
  else coalesce(list_filter(low, lambda v: v not in ('bkp', 'old', '0', '1', '2', '3', '4', '5', '6', '7', '8'))[-1], low[-1]) end as ext from e)
select case ext when 'log' then true when 'txt' then true when 'js' then false end as wanted, count(*) as n from x group by 1""",
    "marker_grouped": """with r as (select source_path, unnest(content_json) as e from log_chunks) select cast(floor(epoch(e.ts_start)) as bigint) as second, count(distinct source_path) as n_sources, count(*) as n_lines
from r where contains(e.text, 'interlock') and e.ts_start is not null group by 1""",
    "event_texts": "with r as (select unnest(content_json) as e from log_chunks) select md5(regexp_replace(e.text, '[0-9]+', '0', 'g')) as text_md5, count(*) as n from r where e.ts_start is not null group by 1",
    "retrieval_quality": r"""with c as (select regexp_extract(source_path, '^[^/\\]*') as unit, id, content_text, time_start from log_chunks),
a as (select unit, id from c where contains(content_text, 'EMERGENCY')),
b as (select unit, id from (select unit, id, row_number() over (partition by unit order by time_start nulls last, id) as no from c where contains(content_text, 'interlock')) where no <= 12),
f as (select coalesce(a.unit, b.unit) as id, a.id as r, b.id as g from a full join b on a.unit = b.unit and a.id = b.id)
select id, count(r) as n_relevant, count(g) as n_retrieved, round(coalesce(count(*) filter (r is not null and g is not null) / nullif(count(r), 0), 0), 6) as recall,
round(coalesce(count(*) filter (r is not null and g is not null) / nullif(count(g), 0), 0), 6) as precision from f group by id""",
    "keyword_presence": "select count(*) filter (contains(lower(text), 'emergency')) as emergency, count(*) filter (contains(lower(text), 'restart')) as restart, count(*) filter (contains(lower(text), 'reset')) as reset from documents",
    "length_density": """with c as (select length(text)::double as v, count(*) as n from documents where text is not null group by 1), t as (select sum(n) as total from c), g as (select unnest(range(0, 16)) * 200.0::double as x)
select x, round(sum(n * exp(0 - pow((x - v) / 200, 2) / 2) / (total * 200 * sqrt(2 * pi()))), 9) as density from c, g, t group by x""",
    "record_texts": """with r as (select id, unnest(content_json) as e, unnest(range(0, len(content_json))) as pos from log_chunks),
t as (select id, pos, e.cnt as c, e.text as x, strftime(e.ts_start at time zone 'UTC', '%Y-%m-%dT%H:%M:%S') as s, strftime(e.ts_end at time zone 'UTC', '%Y-%m-%dT%H:%M:%S') as n from r)
select id, cast(pos as int) as pos, md5(case when c > 1 and s is not null and n is not null then c || ' times between ' || s || ' and ' || n || ' ' || x when s is not null then s || ' ' || x else x end) as line_md5 from t""",
    "source_coverage": r"""with s as (select had_date_overlap, len(list_distinct(list_transform(match_list, lambda x: replace(x.source_path, '\', '/')))) as n from match_results)
select had_date_overlap, count(*) as n_results, round(avg(n), 6) as mean_sources from s where n > 0 group by 1""",
    "log_bins": """with l as (select doc_kind, unnest(string_split(text, chr(10))) as line from documents where text is not null)
select doc_kind, cast(floor(log2(length(line))) as bigint) + 1 as bin, count(*) as n from l where line <> '' group by 1, 2""",
}
