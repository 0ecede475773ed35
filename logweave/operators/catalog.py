"""File catalogue: kinds, extensions, archives, folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions.prefix import ranked

# File kinds, rotation endings and archive endings.
KINDS = ("log", "bin", "txt", "none", "status", "unk", "xml", "js")
ROTATIONS = ("bkp", "old", "0", "1", "2", "3", "4", "5", "6", "7", "8")
ARCHIVES = ("zip", "tar", "tgz", "gz", "bz2", "xz", "7z")
UNITS = ("B", "KB", "MB", "GB", "TB")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def suffixes(path: Column) -> Column:
    """The dotted parts of a file name behind its first."""
    parts = F.split(file_name(path), "\\.")
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def extension(path: Column) -> Column:
    """Last suffix in lower case; a rotated log counts as its log: ``log`` or ``log.gz``; none gives ``none``."""
    own = F.transform(suffixes(path), lambda s: F.lower(s))
    plain = F.filter(own, lambda s: ~s.isin(*ROTATIONS))
    last = F.try_element_at(own, F.lit(-1))
    rotated = F.array_contains(own, "log")
    packed = F.when(last == "gz", "log.gz").otherwise("log")
    return F.when(F.size(own) == 0, "none").when(rotated, packed).when(F.size(plain) > 0, F.element_at(plain, -1)).otherwise(last)


def file_kind(name: Column, ignored: tuple[str, ...] = ()) -> Column:
    """Kind of a file by its first dotted part that is a known kind; ``unk`` if none is, null if it is ignored or null."""
    base = F.regexp_replace(F.lower(name), r"\.(bkp|old|[0-8])", "")
    known = F.filter(F.split(base, "\\."), lambda p: p.isin(*KINDS))
    kind = F.when(base.isNull(), F.lit(None).cast("string")).when(base == "", "none").when(F.size(known) > 0, F.get(known, F.lit(0))).otherwise("unk")
    for part in ignored:
        kind = F.when(F.contains(name, F.lit(part)), F.lit(None)).otherwise(kind)
    return kind


def is_archive(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(ARCHIVES) + r")$")


def human_size(n_bytes: Column) -> Column:
    """Size in the largest unit of 1,024 that leaves at least one, two decimals."""
    size = n_bytes.cast("double")
    out = F.format_string("%.2f TB", size / 1024.0**4)
    for power in (3, 2, 1, 0):
        out = F.when(size < 1024.0 ** (power + 1), F.format_string(f"%.2f {UNITS[power]}", size / 1024.0**power)).otherwise(out)
    return out


def archive_folder(path: Column) -> Column:
    """Name of the folder that an archive is unpacked into: stem and ten digits of its hash."""
    return F.concat(safe_name(F.regexp_replace(file_name(path), r"\.[^.]*$", "")), F.lit("-"), F.left(F.sha1(F.lower(path)), F.lit(10)))


def safe_name(name: Column) -> Column:
    """A folder name without characters that file systems refuse."""
    clean = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]+', "_")
    clean = F.regexp_replace(clean, r"[. ]+$", "")
    return F.when(clean == "", "_").otherwise(clean)


def extension_stats(files: DataFrame, path: str, n_bytes: str) -> DataFrame:
    """Per extension: files, bytes; a row ``*`` with the totals."""
    grouped = files.select(extension(F.col(path)).alias("ext"), F.col(n_bytes).alias("n")).rollup("ext").agg(F.count("*").alias("n_files"), F.sum("n").alias("n_bytes"), F.grouping("ext").alias("whole"))
    return grouped.select(F.when(F.col("whole") == 1, "*").otherwise(F.col("ext")).alias("ext"), "n_files", "n_bytes")


def folders(paths: DataFrame, path: str) -> DataFrame:
    """Every ancestor folder of every file with the kinds of files below it: level, folder, kinds, n_files.

    Paths encode their ancestry, so no recursion is needed; partial
    aggregation keeps a folder with a third of all files out of one task.
    """
    parts = F.split(F.col(path), r"[/\\]")
    levels = paths.select(parts.alias("parts"), file_kind(F.element_at(parts, -1)).alias("kind")).where(F.size("parts") > 1)
    ancestors = levels.select("parts", "kind", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("level"))
    named = ancestors.select("level", F.array_join(F.slice("parts", F.lit(1), F.col("level")), "/").alias("folder"), "kind")
    return named.groupBy("level", "folder").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.count("*").alias("n_files"))


def folder_links(tree: DataFrame) -> DataFrame:
    """Child to parent: (child, parent); the parent is the longest folder one level up."""
    child = tree.where("level > 1").select(F.col("folder").alias("child"), F.regexp_extract("folder", r"^(.*)/[^/]*$", 1).alias("parent"))
    return child.join(tree.select(F.col("folder").alias("parent")), "parent").select("child", "parent")


def dot_lines(tree: DataFrame) -> DataFrame:
    """Lines of a Graphviz text of a folder tree, ordered by ``n``; the whole is their concatenation."""
    nodes = tree.select(F.concat(F.lit('"'), "folder", F.lit('" [label="'), F.element_at(F.split("folder", "/"), -1), F.lit("\\n"), "kinds", F.lit('"];')).alias("line"))
    edges = folder_links(tree).select(F.concat(F.lit('"'), "parent", F.lit('" -> "'), "child", F.lit('";')).alias("line"))
    return nodes.unionByName(edges)


def looks_binary(head: Column) -> Column:
    """Whether the first bytes of a file are no text: a NUL, or more than a fifth control characters."""
    as_hex = F.hex(head)
    pairs = F.regexp_replace(as_hex, "(..)", "$1 ")
    controls = F.regexp_count(pairs, F.lit(r"(?:0[1-8]|0[EF]|1[0-9A-F]|7F) "))
    n = F.length(head)
    return F.when(n == 0, F.lit(False)).otherwise(F.regexp_like(pairs, F.lit(r"(^| )00 ")) | (controls > n * 0.2))


def unique_names(files: DataFrame, name: str, order: str) -> DataFrame:
    """``unique`` names: the first bearer keeps its name, the n-th more is called ``n-name``.

    Bearers of one name are numbered by ``order``, a number column; a name
    with a third of all files is spread over blocks of that order.
    """
    slim = files.select(F.col(name).alias("name"), F.col(order).alias("key"))
    numbered = ranked(slim, ["name"], "key", 100_000)
    more = F.col("rank") - 1
    return numbered.select("key", F.when(more == 0, F.col("name")).otherwise(F.concat(more.cast("string"), F.lit("-"), "name")).alias("unique"))


def collapse_siblings(listing: DataFrame, marked: str) -> DataFrame:
    """Sorted listings (folder, name) with runs of names that hold ``marked`` as one line: (folder, first_name, n).

    The sibling that ends a run is not listed.
    """
    order = W.partitionBy("folder").orderBy("name")
    is_marked = F.contains("name", F.lit(marked))
    numbered = listing.select("folder", "name", is_marked.alias("m"), F.row_number().over(order).alias("n"))
    placed = numbered.withColumn("ends", ~F.col("m") & F.coalesce(F.lag("m").over(order), F.lit(False)))
    run = F.when(F.col("m"), F.col("n") - F.row_number().over(W.partitionBy("folder", "m").orderBy("name"))).otherwise(-F.col("n"))
    return placed.withColumn("run", run).where("not ends").groupBy("folder", "m", "run").agg(F.min("name").alias("first_name"), F.count("*").alias("n")).select("folder", "first_name", "n")


def dated_folders(paths: DataFrame, path: str) -> DataFrame:
    """Folders whose name is a date, or begins with one before a ``T``: (folder, day); impossible dates are left out."""
    names = paths.select(F.explode(F.split(F.col(path), r"[/\\]")).alias("folder")).distinct()
    day = F.split("folder", "T")[0]
    return names.where(F.regexp_like(day, F.lit(r"^\d{4}-\d{2}-\d{2}$"))).select("folder", F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date").alias("day")).where("day is not null")


def decide_files(files: DataFrame, path: str, rules: dict[str, bool], default: bool | None = None) -> DataFrame:
    """``wanted`` by extension: the rule of the extension, else the default; null counts as a miss."""
    decided = F.lit(default).cast("boolean")
    for ext, wanted in rules.items():
        decided = F.when(extension(F.col(path)) == ext, F.lit(wanted)).otherwise(decided)
    return files.withColumn("wanted", decided)


def peek(files: DataFrame, suffix: str, n: int) -> DataFrame:
    """The first ``n`` bytes as text of files (path, content) with a suffix; empty files give an empty text."""
    ending = files.where(F.lower("path").endswith(suffix.lower()))
    return ending.select("path", F.make_valid_utf8(F.substring("content", 1, n).cast("string")).alias("head"))
