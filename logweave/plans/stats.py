"""Counts, distributions and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.operators import stats
from logweave.operators.matching import utc_second
from logweave.session import ship, table


def counts_year_month_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by year, month and day with all subtotals."""
    days = table(spark, sf_dir, "log_chunks").where("time_start is not null").select(F.year("time_start").cast("bigint").alias("y"), F.month("time_start").cast("bigint").alias("m"), F.dayofmonth("time_start").cast("bigint").alias("d"))
    return days.rollup("y", "m", "d").agg(F.count("*").alias("n"))


def month_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("bigint").alias("y"), F.month("o_orderdate").cast("bigint").alias("m"))
    return orders.groupBy("y", "m").agg(F.count("*").alias("n"))


def null_month_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by year and month, undated ones under 1970-1."""
    chunks = table(spark, sf_dir, "log_chunks")
    return chunks.groupBy(F.coalesce(F.year("time_start"), F.lit(1970)).cast("bigint").alias("y"), F.coalesce(F.month("time_start"), F.lit(1)).cast("bigint").alias("m")).agg(F.count("*").alias("n"))


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line")).select(F.length("line").alias("length"))


def histogram_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(_lengths(spark, sf_dir), "length", 30)


def histogram_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram_outlier(_lengths(spark, sf_dir), "length", 10.0, 300.0)


def ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.distribution(_lengths(spark, sf_dir).select(F.col("length").cast("bigint").alias("length")), "length")


def daily_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type, days without events included."""
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type")
    first, last = events.agg(F.min("day"), F.max("day")).first()
    counts = events.groupBy("day", "event_type").agg(F.count("*").alias("n"))
    frame = events.select("event_type").distinct().withColumn("day", F.explode(F.sequence(F.lit(first), F.lit(last))))
    joined = frame.join(counts, ["day", "event_type"], "left")
    return joined.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", F.coalesce("n", F.lit(0)).alias("n"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years as runs, suppliers as samples, mean quantity as value."""
    items = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("run"), F.col("l_suppkey").alias("sample"), "l_quantity")
    return items.groupBy("run", "sample").agg(F.avg("l_quantity").alias("value"))


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.run_statistics(_runs(spark, sf_dir).withColumn("value", F.round("value", 6)))


def run_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.overall_statistics(_runs(spark, sf_dir))


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median, population variance, sample deviation and extremes of a metric."""
    items = table(spark, sf_dir, "lineitem")
    return items.groupBy("l_returnflag").agg(
        F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.median("l_quantity"), 4).alias("median"), F.round(F.var_pop("l_quantity"), 4).alias("variation"),
        F.round(F.coalesce(F.stddev_samp("l_quantity"), F.lit(0.0)), 6).alias("deviation"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"),
    )


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")
    means = items.groupBy("l_suppkey", "l_returnflag").agg(F.round(F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))), 4).alias("before"), F.round(F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))), 4).alias("after"))
    return means.where("before is not null and after is not null").withColumnRenamed("l_returnflag", "group")


def improved_unchanged_worsened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.compare(_pairs(spark, sf_dir))


def wilcoxon_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.signed_rank_by_group(_pairs(ship(spark), sf_dir))


def micro_macro_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of returned items: over all items, and as the mean over orders."""
    items = table(spark, sf_dir, "lineitem")
    per = items.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("achieved"), F.count("*").alias("target"))
    return per.agg(F.round(F.sum("achieved") / F.sum("target"), 9).alias("micro"), F.round(F.avg(F.col("achieved") / F.col("target")), 9).alias("macro"), F.count_if(F.col("achieved") == 0).alias("n_zero"))


def minmax_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.min_max(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size").select("p_partkey", "scaled")


def time_diff_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours between the matched date and the source time of match results, and whether that time is a bare date."""
    seconds = F.unix_seconds(utc_second(F.col("source_ts"))) - F.unix_seconds(F.to_timestamp("matched_date"))
    results = table(spark, sf_dir, "match_results").where("matched_date is not null")
    return results.select("result_id", F.round(seconds / 3600, 6).alias("hours"), (F.length("source_ts") <= 10).alias("date_only"))


def split_mod5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth incident, in the order of ids, is for validation."""
    # the order number is the number of smaller ids, summed over id blocks
    incidents = table(spark, sf_dir, "incidents").select("incident_id", F.floor(F.col("incident_id") / 10_000).alias("block"))
    blocks = incidents.groupBy("block").agg(F.count("*").alias("n"))
    before = blocks.select("block", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy("block").orderBy("incident_id")) - 1 + F.col("before")
    return incidents.join(before, "block").select("incident_id", (F.pmod(place, F.lit(5)) == 0).alias("validation"))


def control_char_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = F.trim(F.regexp_replace("text", "[\\x00-\\x1f\\x7f]+", " "))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(clean).alias("clean_md5"))


def json_prop_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


QUERIES = {
    "counts_year_month_day": counts_year_month_day, "month_rollup": month_rollup, "null_month_bucket": null_month_bucket, "histogram_fixed": histogram_fixed, "histogram_outlier": histogram_outlier,
    "ecdf": ecdf, "daily_bins": daily_bins, "run_stats": run_stats, "run_overall": run_overall, "metric_summary": metric_summary, "improved_unchanged_worsened": improved_unchanged_worsened,
    "wilcoxon_paired": wilcoxon_paired, "micro_macro_recall": micro_macro_recall, "minmax_normalise": minmax_normalise, "time_diff_hours": time_diff_hours, "split_mod5": split_mod5,
    "control_char_clean": control_char_clean, "json_prop_extract": json_prop_extract,
}

_LEN = "l as (select unnest(string_split(text, chr(10))) as line from documents where text is not null), v as (select length(line) as length from l)"
_RUN = "r as (select year(l_shipdate) as run, l_suppkey as sample, avg(l_quantity) as value from lineitem group by 1, 2)"
_PAIR = """p as (select l_suppkey, l_returnflag, round(avg(l_quantity) filter (l_linestatus = 'F'), 4) as before, round(avg(l_quantity) filter (l_linestatus = 'O'), 4) as after from lineitem group by 1, 2)"""

SQL = {
    "counts_year_month_day": "select year(time_start) as y, month(time_start) as m, day(time_start) as d, count(*) as n from log_chunks where time_start is not null group by rollup (1, 2, 3)",
    "month_rollup": "select year(o_orderdate) as y, month(o_orderdate) as m, count(*) as n from orders group by 1, 2",
    "null_month_bucket": "select coalesce(year(time_start), 1970) as y, coalesce(month(time_start), 1) as m, count(*) as n from log_chunks group by 1, 2",
    "histogram_fixed": f"with {_LEN}, e as (select min(length)::double as low, max(length)::double as high from v) select least(cast(floor((length - low) * 30 / (high - low)) as bigint) + 1, 30) as bin, count(*) as n from v, e group by 1",
    "histogram_outlier": f"with {_LEN} select case when length > 300 then -1 else cast(floor(length / 10.0) as bigint) end as bin, count(*) as n from v group by 1",
    "ecdf": f"""with {_LEN}, c as (select length as value, count(*) as n from v group by 1)
select value, round(sum(n) over (order by value) / sum(n) over (), 9) as cdf, round((sum(n) over () - sum(n) over (order by value) + n) / sum(n) over (), 9) as ccdf from c""",
    "daily_bins": """
with d as (select cast(unnest(generate_series(min(cast(ts as date)), max(cast(ts as date)), interval 1 day)) as date) as day from events), k as (select distinct event_type from events),
c as (select cast(ts as date) as day, event_type, count(*) as n from events group by 1, 2)
select strftime(d.day, '%Y-%m-%d') as day, k.event_type, coalesce(n, 0) as n from d cross join k left join c on c.day = d.day and c.event_type = k.event_type""",
    "run_stats": f"""with {_RUN}, q as (select sample, round(value, 6) as value from r) select sample, count(*) as n, round(avg(value), 6) as mean, round(coalesce(var_samp(value), 0), 6) as variance,
round(coalesce(stddev_samp(value), 0), 6) as deviation, min(value) as least, max(value) as most from q group by sample""",
    "run_overall": f"""with {_RUN}, s as (select sample, avg(value) as mean, coalesce(var_samp(value), 0) as variance from r group by 1)
select count(*) as n_samples, round(avg(mean), 6) as mean, round(var_samp(mean), 6) as variance_of_means, round(avg(variance), 6) as variance_within from s""",
    "metric_summary": "select l_returnflag, round(avg(l_extendedprice), 4) as mean, round(median(l_quantity), 4) as median, round(var_pop(l_quantity), 4) as variation, round(coalesce(stddev_samp(l_quantity), 0), 6) as deviation, min(l_quantity) as least, max(l_quantity) as most from lineitem group by 1",
    "improved_unchanged_worsened": f"""with {_PAIR} select l_returnflag as "group", count(*) filter (after > before) as improved, count(*) filter (after = before) as unchanged, count(*) filter (after < before) as worsened,
round(avg(after - before), 6) as mean_change from p where before is not null and after is not null group by 1""",
    "micro_macro_recall": """with o as (select l_orderkey, count(*) filter (l_returnflag = 'R') as a, count(*) as t from lineitem group by 1)
select round(sum(a) / sum(t), 9) as micro, round(avg(a / t), 9) as macro, count(*) filter (a = 0) as n_zero from o""",
    "minmax_normalise": "with e as (select p_brand, min(p_size) as low, max(p_size) as high from part group by 1) select p_partkey, round(case when high = low then 0.5 else (p_size - low) / (high - low) end, 9) as scaled from part join e using (p_brand)",
    "time_diff_hours": """select result_id, round((cast(epoch(date_trunc('second', cast(source_ts as timestamptz))) as bigint) - cast(epoch(cast(matched_date as timestamp)) as bigint)) / 3600, 6) as hours, length(source_ts) <= 10 as date_only
from match_results where matched_date is not null""",
    "split_mod5": "select incident_id, (row_number() over (order by incident_id) - 1) % 5 = 0 as validation from incidents",
    "control_char_clean": r"select doc_id, md5(trim(regexp_replace(text, '[\x00-\x1f\x7f]+', ' ', 'g'), ' ')) as clean_md5 from documents where text is not null",
    "json_prop_extract": "select cast(json_extract_string(props, '$.k') as bigint) as k, count(*) as n from events group by 1",
}
