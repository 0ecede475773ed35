"""Catalogue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions.paths import same_path
from logweave.operators import catalog
from logweave.session import table


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "staged_chunks").select(same_path(F.col("source_path")).alias("path"), "n_bytes")


def ext_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.extension_stats(_files(spark, sf_dir), "path", "n_bytes")


def suffix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinations of suffixes, most frequent first."""
    return _files(spark, sf_dir).select(F.array_join(catalog.suffixes(F.col("path")), ".").alias("combination")).groupBy("combination").agg(F.count("*").alias("n"))


def distinct_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select(F.explode(catalog.suffixes(F.col("path"))).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("n"))


def ext_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and the alphabetically first five examples of each extension."""
    files = _files(spark, sf_dir).select(catalog.extension(F.col("path")).alias("ext"), "path")
    place = F.row_number().over(W.partitionBy("ext").orderBy("path"))
    few = files.distinct().withColumn("place", place).where("place <= 5").groupBy("ext").agg(F.array_join(F.array_sort(F.collect_list("path")), " ").alias("examples"))
    return files.groupBy("ext").agg(F.count("*").alias("n_files")).join(few, "ext")


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select(catalog.file_kind(catalog.file_name(F.col("path"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def archive_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose suffixes may hide an archive."""
    wanted = F.array(*[F.lit(s) for s in ("7z", "gz", "zip", "bkp", "old", "0", "1", "2", "3", "4", "5")])
    files = _files(spark, sf_dir).select("path").distinct()
    return files.where(F.arrays_overlap(catalog.suffixes(F.col("path")), wanted)).select("path", catalog.archive_folder(F.col("path")).alias("folder"))


def human_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = table(spark, sf_dir, "staged_chunks")
    return staged.select("stage_id", catalog.human_size(F.col("n_bytes")).alias("size"))


def folder_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.folders(_files(spark, sf_dir), "path")


def folder_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.dot_lines(catalog.folders(_files(spark, sf_dir), "path"))


def incident_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes below the first three path segments."""
    files = _files(spark, sf_dir)
    return files.select(F.substring_index("path", "/", 3).alias("root"), "n_bytes").groupBy("root").agg(F.count("*").alias("n_files"), F.sum("n_bytes").alias("n_bytes"))


def binary_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose first 4,096 bytes do not look like text."""
    documents = table(spark, sf_dir, "documents").where("text is not null")
    return documents.select("doc_id", catalog.looks_binary(F.substring(F.col("text").cast("binary"), 1, 4096)).alias("looks_binary"))


QUERIES = {
    "ext_catalog": ext_catalog, "suffix_counts": suffix_counts, "distinct_suffix": distinct_suffix, "ext_examples": ext_examples, "file_kinds": file_kinds,
    "archive_candidates": archive_candidates, "human_sizes": human_sizes, "folder_tree": folder_tree, "folder_dot": folder_dot, "incident_roots": incident_roots, "binary_sniff": binary_sniff,
}

_F = r"f as (select replace(source_path, '\', '/') as path, n_bytes from staged_chunks where source_path is not null)"
_NAME = r"regexp_extract(path, '([^/]*)$', 1)"
_EXT = f"""case when len(string_split({_NAME}, '.')) = 1 then 'none'
  when list_contains(string_split(lower({_NAME}), '.')[2:], 'log') then case when lower(path) like '%.gz' then 'log.gz' else 'log' end
  when len(list_filter(string_split(lower({_NAME}), '.')[2:], lambda s: not list_contains(['bkp','old','0','1','2','3','4','5','6','7','8'], s))) > 0
  then list_filter(string_split(lower({_NAME}), '.')[2:], lambda s: not list_contains(['bkp','old','0','1','2','3','4','5','6','7','8'], s))[-1]
  else string_split(lower({_NAME}), '.')[-1] end"""
_KIND = r"""coalesce(list_filter(string_split(regexp_replace(lower({n}), '\.(bkp|old|[0-8])', '', 'g'), '.'), lambda p: list_contains(['log','bin','txt','none','status','unk','xml','js'], p))[1], 'unk')"""
_TREE = f"""{_F}, p as (select string_split(path, '/') as parts, {_KIND.format(n="string_split(path, '/')[-1]")} as kind from f),
a as (select parts, kind, unnest(range(1, len(parts))) as level from p where len(parts) > 1),
t as (select level, array_to_string(parts[1:level], '/') as folder, array_to_string(list_sort(list_distinct(list(kind))), ',') as kinds, count(*) as n_files from a group by 1, 2)"""

SQL = {
    "ext_catalog": f"with {_F}, e as (select {_EXT} as ext, n_bytes from f) select ext, count(*) as n_files, cast(sum(n_bytes) as bigint) as n_bytes from e group by ext union all select '*', count(*), cast(sum(n_bytes) as bigint) from e",
    "suffix_counts": f"with {_F} select array_to_string(string_split({_NAME}, '.')[2:], '.') as combination, count(*) as n from f group by 1",
    "distinct_suffix": f"with {_F}, s as (select unnest(string_split({_NAME}, '.')[2:]) as suffix from f) select suffix, count(*) as n from s group by 1",
    "ext_examples": f"with {_F}, x as (select {_EXT} as ext, path from f), d as (select ext, path, row_number() over (partition by ext order by path) as place from (select distinct * from x)) select ext, n_files, examples from (select ext, count(*) as n_files from x group by 1) join (select ext, string_agg(path, ' ' order by path) as examples from d where place <= 5 group by 1) using (ext)",
    "binary_sniff": """with h as (select doc_id, encode(text) as b from documents where text is not null), x as (select doc_id, least(octet_length(b), 4096) as n, regexp_replace(hex(b[1:4096]), '(..)', '\\1 ', 'g') as p from h)
select doc_id, n > 0 and (starts_with(p, '00 ') or contains(p, ' 00 ') or len(regexp_extract_all(p, '(?:0[1-8]|0[EF]|1[0-9A-F]|7F) ')) > n * 0.2) as looks_binary from x""",
    "file_kinds": f"with {_F} select {_KIND.format(n=_NAME)} as kind, count(*) as n from f group by 1",
    "archive_candidates": f"""with {_F} select distinct path, regexp_replace({_NAME}, '\\.[^.]*$', '') || '-' || left(sha1(lower(path)), 10) as folder from f
where len(list_intersect(string_split({_NAME}, '.')[2:], ['7z','gz','zip','bkp','old','0','1','2','3','4','5'])) > 0""",
    "human_sizes": "select stage_id, case when n_bytes < 1024 then printf('%.2f B', n_bytes::double) when n_bytes < 1048576 then printf('%.2f KB', round(n_bytes::double / 1024, 2)) when n_bytes < 1073741824 then printf('%.2f MB', round(n_bytes::double / 1048576, 2)) else printf('%.2f GB', n_bytes / 1073741824.0) end as size from staged_chunks",
    "folder_tree": f"with {_TREE} select cast(level as int) as level, folder, kinds, n_files from t",
    "folder_dot": f"""with {_TREE} select '"' || folder || '" [label="' || string_split(folder, '/')[-1] || '\\n' || kinds || '"];' as line from t
union all select '"' || regexp_extract(folder, '^(.*)/[^/]*$', 1) || '" -> "' || folder || '";' from t where level > 1""",
    "incident_roots": f"with {_F} select array_to_string(string_split(path, '/')[1:3], '/') as root, count(*) as n_files, cast(sum(n_bytes) as bigint) as n_bytes from f group by 1",
}
