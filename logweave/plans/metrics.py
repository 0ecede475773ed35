"""Metric queries: reference texts against agent transcripts of the same unit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.prefix import ranked
from logweave.operators import metrics as m
from logweave.operators.log_lines import is_raw
from logweave.session import ship, table


def _turns(text: Column, role: str) -> Column:
    """Lines that one role said in a transcript, without the role's name."""
    said = F.filter(F.split(text, "\n"), lambda x: x.startswith(role + ": "))
    return F.transform(said, lambda x: F.substring(x, len(role) + 3, 1_000_000_000))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every root-cause text with the transcript of its unit: (id, target, transcript).

    The n-th text of a unit meets the n-th transcript of the same unit, both
    numbered by time.  A text without a transcript, a unit or a time has an
    empty one.
    """
    documents = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", "doc_kind", "unit_code", F.unix_micros("written_at").alias("at_us"))
    placeable = F.col("unit_code").isNotNull() & F.col("at_us").isNotNull()
    placed = lambda kind: ranked(documents.where((F.col("doc_kind") == kind) & placeable), ["unit_code"], "at_us", 86_400_000_000, ("doc_id",))
    target = placed("rca").select("unit_code", "rank", F.col("doc_id").alias("id"), F.col("text").alias("target"))
    spoken = placed("transcript").select("unit_code", "rank", F.col("text").alias("transcript"))
    pairs = target.join(spoken, ["unit_code", "rank"], "left").select("id", "target", F.coalesce("transcript", F.lit("")).alias("transcript"))
    return pairs.unionByName(documents.where((F.col("doc_kind") == "rca") & ~placeable).select(F.col("doc_id").alias("id"), F.col("text").alias("target"), F.lit("").alias("transcript")))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every root-cause text with what the assistant said in its transcript: (id, target, predicted)."""
    return _samples(spark, sf_dir).select("id", "target", F.array_join(_turns(F.col("transcript"), "assistant"), "\n").alias("predicted"))


def target_line_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of root-cause texts that occur as event texts in the chunk store."""
    documents = table(spark, sf_dir, "documents").where("doc_kind = 'rca' and text is not null")
    targets = documents.select(F.col("doc_id").alias("id"), m.metric_lines(F.col("text")).alias("lines"))
    evidence = table(spark, sf_dir, "log_chunks").select(F.explode("content_json").alias("r")).select(F.trim("r.text").alias("line"))
    return m.line_coverage(targets, evidence)


def target_subline_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of root-cause texts that contain a line of an event text of the chunk store, and how much of them the longest covers."""
    documents = table(spark, sf_dir, "documents").where("doc_kind = 'rca' and text is not null")
    lines = documents.select(F.col("doc_id"), F.posexplode(m.metric_lines(F.col("text"))).alias("line_no", "text")).withColumn("id", F.struct("doc_id", "line_no"))
    chunks = table(spark, sf_dir, "log_chunks").where(~F.coalesce(is_raw(), F.lit(False)))
    events = chunks.select(F.explode("content_json").alias("r")).select(F.explode(F.split("r.text", "\n")).alias("line")).select(F.trim("line").alias("line"))
    return m.longest_contained(lines, events).select("id.doc_id", F.col("id.line_no").alias("line_no"), "covered")


def token_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.token_overlap(texts(spark, sf_dir))


def longest_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = texts(spark, sf_dir).select("id", m.metric_lines(F.col("target")).alias("target"), m.metric_lines(F.col("predicted")).alias("predicted"))
    return m.containment(pairs)


def _presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = [_turns(F.col("transcript"), role).alias(name) for role, name in (("user", "asked"), ("tool", "retrieved"), ("assistant", "answered"))]
    return m.presence(_samples(spark, sf_dir).select("id", m.metric_lines(F.col("target")).alias("target"), *stages), ("asked", "retrieved", "answered"))


def presence_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per line of the reference the stages that hold it."""
    return _presence(spark, sf_dir).select("id", F.col("line_no").cast("bigint").alias("line_no"), F.md5("line").alias("line_md5"), "asked", "retrieved", "answered")


def grounded_per_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.grounded(_presence(spark, sf_dir), ("retrieved", "answered"), "asked")


def grounded_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall over all samples of what was retrieved, and of what was retrieved and answered."""
    per = m.grounded(_presence(spark, sf_dir), ("retrieved", "answered"), "asked")
    part = lambda a, b: F.round(F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0)), 9)
    return per.agg(part("retrieved_lines", "n_lines").alias("retrieved"), part("answered_lines", "n_lines").alias("answered"), part("answered_chars", "n_chars").alias("answered_chars"), F.count("*").alias("n_samples"))


def rouge_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.ngram_overlap(texts(spark, sf_dir), 1)


def rouge_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.ngram_overlap(texts(spark, sf_dir), 2)


def rouge_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.ngram_overlap(texts(spark, sf_dir), 3)


def rouge_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-1, 2 and 3 of stems."""
    pairs = texts(ship(spark), sf_dir)
    return reduce(DataFrame.unionByName, [m.ngram_overlap(pairs, n, stem=True).withColumn("n", F.lit(n)) for n in (1, 2, 3)])


def rouge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and sample variance of ROUGE-1 and 2 over all reference texts."""
    pairs = texts(spark, sf_dir)
    scores = reduce(DataFrame.unionByName, [m.ngram_overlap(pairs, n).withColumn("n", F.lit(n)) for n in (1, 2)])
    long = scores.select("n", F.explode(F.create_map(*[x for c in ("precision", "recall", "f1") for x in (F.lit(c), F.col(c))])).alias("metric", "value"))
    return long.groupBy("n", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.round(F.coalesce(F.var_samp("value"), F.lit(0.0)), 6).alias("variance"), F.count("*").alias("n_samples"))


def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.rouge_l(texts(ship(spark), sf_dir))


def assistant_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the assistant of more than four characters."""
    documents = table(spark, sf_dir, "documents").where("doc_kind = 'transcript' and text is not null")
    said = documents.select("doc_id", F.posexplode(_turns(F.col("text"), "assistant")).alias("no", "message"))
    return said.where(F.length("message") > 4).select("doc_id", "no", F.md5("message").alias("message_md5"))


QUERIES = {
    "target_line_coverage": target_line_coverage, "target_subline_coverage": target_subline_coverage, "token_precision_recall": token_precision_recall, "longest_containment": longest_containment, "presence_matrix": presence_matrix,
    "grounded_per_sample": grounded_per_sample, "grounded_chain": grounded_chain, "rouge_1": rouge_1, "rouge_2": rouge_2, "rouge_3": rouge_3, "rouge_l": rouge_l, "rouge_stemmed": rouge_stemmed, "rouge_summary": rouge_summary, "assistant_messages": assistant_messages,
}

_SAMPLES = """docs as (select * from documents where text is not null and doc_kind in ('rca', 'transcript')),
numbered as (select *, row_number() over (partition by doc_kind, unit_code order by written_at, doc_id) as place from docs where unit_code is not null and written_at is not null),
placed as (select d.doc_id, d.text, n.unit_code, n.place from docs d left join numbered n using (doc_id) where d.doc_kind = 'rca'),
samples as (select r.doc_id as id, r.text as target, coalesce(t.text, '') as transcript from placed r left join (select * from numbered where doc_kind = 'transcript') t on r.unit_code = t.unit_code and r.place = t.place)"""


def _said(role: str, text: str = "transcript") -> str:
    return f"list_transform(list_filter(string_split({text}, chr(10)), lambda x: starts_with(x, '{role}: ')), lambda x: substring(x, {len(role) + 3}))"


_LINES = r"""list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(regexp_replace(trim(regexp_replace(regexp_replace(x, '^.*<time>', ''), '^\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}:\d{{2}}(\.\d+)?([+-]\d{{2}}:\d{{2}}|Z)', ''), ' '), '^-+\s*', ''), ' ')), lambda x: x <> '' and x <> '```')"""
_TEXTS = _SAMPLES + f", texts as (select id, target, array_to_string({_said('assistant')}, chr(10)) as predicted from samples)"
_PRESENCE = _SAMPLES + f""", listed as (select id, {_said('user')} as a, {_said('tool')} as r, {_said('assistant')} as s, {_LINES.format(t='target')} as ls from samples),
rows as (select id, a, r, s, unnest(ls) as line, unnest(range(0, len(ls))) as line_no from listed),
presence as (select id, line, line_no, len(list_filter(a, lambda x: contains(x, line))) > 0 as asked, len(list_filter(r, lambda x: contains(x, line))) > 0 as retrieved, len(list_filter(s, lambda x: contains(x, line))) > 0 as answered from rows)"""
_GROUNDED = _PRESENCE + """, per as (select id, count(*) as n_lines, cast(coalesce(sum(length(line)) filter (not asked), 0) as bigint) as n_chars, count(*) filter (not asked and retrieved) as retrieved_lines,
cast(coalesce(sum(length(line)) filter (not asked and retrieved), 0) as bigint) as retrieved_chars, count(*) filter (not asked and retrieved and answered) as answered_lines,
cast(coalesce(sum(length(line)) filter (not asked and retrieved and answered), 0) as bigint) as answered_chars from presence group by id)"""
#: Lower case with full case mapping, which DuckDB lacks for this letter.
_LOW = "lower(replace({t}, 'İ', 'i' || chr(775)))"
_TOKENS = r"list_distinct(list_filter(string_split_regex(" + _LOW + r", '[^a-z0-9äöüßå]+'), lambda w: w <> ''))"


def _rouge(n: int) -> str:
    words = "list_filter(string_split_regex(" + _LOW + ", '[^a-z0-9]+'), lambda w: w <> '')"
    return _TEXTS + f""", w as (select id, {words.format(t='target')} as t, {words.format(t='predicted')} as p from texts),
g as (select id, list_transform(range(1, greatest(len(t) - {n} + 2, 1)), lambda i: array_to_string(t[i:i + {n - 1}], ' ')) as t, list_transform(range(1, greatest(len(p) - {n} + 2, 1)), lambda i: array_to_string(p[i:i + {n - 1}], ' ')) as p from w),
tc as (select id, gram, count(*) as c from (select id, unnest(t) as gram from g) group by 1, 2), pc as (select id, gram, count(*) as c from (select id, unnest(p) as gram from g) group by 1, 2),
s as (select id, sum(least(tc.c, pc.c)) as s from tc join pc using (id, gram) group by id),
v as (select g.id, coalesce(coalesce(s, 0) / nullif(len(p), 0), 0) as precision, coalesce(coalesce(s, 0) / nullif(len(t), 0), 0) as recall from g left join s using (id))
select id, round(precision, 6) as precision, round(recall, 6) as recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) as f1 from v"""


SQL = {
    "target_line_coverage": f"""with t as (select doc_id as id, unnest(list_distinct({_LINES.format(t='text')})) as line from documents where doc_kind = 'rca' and text is not null),
r as (select unnest(content_json) as e from log_chunks), k as (select distinct trim(e.text, ' ') as line from r)
select id, count(*) as n_lines, count(k.line) as n_found, cast(sum(length(t.line)) as bigint) as n_chars, cast(coalesce(sum(length(k.line)), 0) as bigint) as chars_found from t left join k on t.line = k.line group by id""",
    "target_subline_coverage": f"""with d as (select doc_id, {_LINES.format(t='text')} as ls from documents where doc_kind = 'rca' and text is not null),
t as (select doc_id, unnest(ls) as text, unnest(range(0, len(ls))) as line_no from d), r as (select unnest(content_json) as e from log_chunks where not coalesce(len(content_json) = 1 and content_json[1].ts_start is null, false)), q as (select unnest(string_split(e.text, chr(10))) as x from r),
k as (select distinct trim(x, ' ') as line from q where trim(x, ' ') <> '')
select doc_id, cast(line_no as int) as line_no, cast(max(length(line)) as int) as covered from t join k on contains(text, line) group by 1, 2""",
    "token_precision_recall": f"""with {_TEXTS}, k as (select id, {_TOKENS.format(t='target')} as t, {_TOKENS.format(t='predicted')} as p from texts)
select id, round(coalesce(len(list_intersect(t, p)) / nullif(len(p), 0), 0), 6) as precision, round(coalesce(len(list_intersect(t, p)) / nullif(len(t), 0), 0), 6) as recall from k""",
    "longest_containment": f"""with {_TEXTS}, l as (select id, {_LINES.format(t='target')} as t, {_LINES.format(t='predicted')} as p from texts),
u as (select id, unnest(t) as line, unnest(range(0, len(t))) as no from l), v as (select id, unnest(p) as said from l),
c as (select u.id, u.no, max(length(said)) as covered from u join v on u.id = v.id and contains(line, said) group by 1, 2),
s as (select id, sum(covered) as chars, count(*) filter (covered > 0) as lines from c group by id)
select l.id, cast(coalesce(chars, 0) as int) as chars, round(coalesce(coalesce(chars, 0) / nullif(coalesce(list_sum(list_transform(t, lambda x: length(x))), 0), 0), 0), 6) as chars_recall,
round(coalesce(coalesce(chars, 0) / nullif(coalesce(list_sum(list_transform(p, lambda x: length(x))), 0), 0), 0), 6) as chars_precision, cast(coalesce(lines, 0) as int) as lines, round(coalesce(coalesce(lines, 0) / nullif(len(t), 0), 0), 6) as lines_recall
from l left join s using (id)""",
    "presence_matrix": f"with {_PRESENCE} select id, line_no, md5(line) as line_md5, asked, retrieved, answered from presence",
    "grounded_per_sample": f"with {_GROUNDED} select * from per",
    "grounded_chain": f"""with {_GROUNDED} select round(coalesce(sum(retrieved_lines) / nullif(sum(n_lines), 0), 0), 9) as retrieved, round(coalesce(sum(answered_lines) / nullif(sum(n_lines), 0), 0), 9) as answered,
round(coalesce(sum(answered_chars) / nullif(sum(n_chars), 0), 0), 9) as answered_chars, count(*) as n_samples from per""",
    "rouge_summary": "select n, metric, round(avg(v), 6) as mean, round(median(v), 6) as median, round(coalesce(var_samp(v), 0), 6) as variance, count(*) as n_samples from (unpivot (select 1 as n, precision, recall, f1 from (with " + _rouge(1) + ") union all select 2, precision, recall, f1 from (with " + _rouge(2) + ")) on precision, recall, f1 into name metric value v) group by 1, 2",
    "rouge_1": "with " + _rouge(1), "rouge_2": "with " + _rouge(2), "rouge_3": "with " + _rouge(3),
    "assistant_messages": f"""with s as (select doc_id, {_said('assistant', 'text')} as said from documents where doc_kind = 'transcript' and text is not null),
m as (select doc_id, unnest(said) as message, unnest(range(0, len(said))) as no from s) select doc_id, cast(no as int) as no, md5(message) as message_md5 from m where length(message) > 4""",
}
