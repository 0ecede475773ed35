"""Retrieval and text metrics: coverage, token overlap, containment, n-gram recall, grounded chains."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.functions.joins import salted
from logweave.session import ensure_checkpoint_dir


def metric_lines(text: Column) -> Column:
    """Lines of a text as metrics compare them: behind the last time mark, stripped, without leading dashes; blank ones and fences dropped."""
    def tidy(line: Column) -> Column:
        behind = F.regexp_replace(line, r"^.*<time>", "")
        behind = F.regexp_replace(behind, r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?([+-]\d{2}:\d{2}|Z)", "")
        return F.trim(F.regexp_replace(F.trim(behind), r"^-+\s*", ""))

    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), tidy), lambda x: (x != "") & (x != "```"))


def tokens(text: Column) -> Column:
    """Distinct lower-case words in order, those with a letter or digit."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9äöüßå]+"), lambda w: w != ""))


def line_coverage(targets: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per target (id, lines): its distinct lines and characters, and how many occur among the lines of ``evidence`` (line).

    Lines meet in an equi-join after both sides are made distinct.
    """
    wanted = targets.select("id", F.explode(F.array_distinct("lines")).alias("line"))
    known = evidence.select("line").distinct().withColumn("found", F.lit(True))
    joined = wanted.join(known, "line", "left")
    return joined.groupBy("id").agg(
        F.count("*").alias("n_lines"), F.count("found").alias("n_found"), F.sum(F.length("line")).alias("n_chars"), F.coalesce(F.sum(F.when(F.col("found"), F.length("line"))), F.lit(0)).alias("chars_found")
    )


def token_overlap(pairs: DataFrame) -> DataFrame:
    """Token precision and recall of (id, target, predicted) texts; 0 where nothing could be hit."""
    both = pairs.select("id", tokens(F.col("target")).alias("t"), tokens(F.col("predicted")).alias("p"))
    hit = F.size(F.array_intersect("t", "p"))
    return both.select("id", F.round(F.coalesce(F.try_divide(hit, F.size("p")), F.lit(0.0)), 6).alias("precision"), F.round(F.coalesce(F.try_divide(hit, F.size("t")), F.lit(0.0)), 6).alias("recall"))


def containment(pairs: DataFrame) -> DataFrame:
    """Per (id, target, predicted) lists of lines: characters and lines of the target covered by the longest predicted line inside each."""
    longest = F.transform("target", lambda line: F.coalesce(F.array_max(F.transform(F.filter("predicted", lambda p: F.contains(line, p)), lambda p: F.length(p))), F.lit(0)))
    total = lambda lines: F.aggregate(F.transform(lines, lambda x: F.length(x)), F.lit(0), lambda a, b: a + b)
    rows = pairs.select("id", longest.alias("covered"), total(F.col("target")).alias("target_chars"), total(F.col("predicted")).alias("predicted_chars"), F.size("target").alias("n_target"), F.size("predicted").alias("n_predicted"))
    chars = F.aggregate("covered", F.lit(0), lambda a, b: a + b)
    hits = F.size(F.filter("covered", lambda x: x > 0))
    part = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return rows.select("id", chars.alias("chars"), part(chars, F.col("target_chars")).alias("chars_recall"), part(chars, F.col("predicted_chars")).alias("chars_precision"), hits.alias("lines"), part(hits, F.col("n_target")).alias("lines_recall"))


def presence(samples: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """Per target line whether each stage (a list of lines) holds it: (id, line_no, line, stage flags)."""
    flags = [F.exists(s, lambda x: F.contains(x, F.col("line"))).alias(s) for s in stages]
    rows = samples.select("id", *stages, F.posexplode("target").alias("line_no", "line"))
    return rows.select("id", "line_no", "line", *flags)


def grounded(lines: DataFrame, stages: tuple[str, ...], leak: str | None = None) -> DataFrame:
    """Per sample the lines and characters that reached each stage through all earlier ones.

    Lines that the stage ``leak`` (the question) already holds count nowhere
    as reached; the number of lines keeps them, the number of characters
    does not.
    """
    open_line = ~F.col(leak) if leak else F.lit(True)
    chain = open_line
    sums = [F.count("*").alias("n_lines"), F.coalesce(F.sum(F.when(open_line, F.length("line"))), F.lit(0)).alias("n_chars")]
    for stage in stages:
        chain = chain & F.col(stage)
        sums += [F.count_if(chain).alias(f"{stage}_lines"), F.coalesce(F.sum(F.when(chain, F.length("line"))), F.lit(0)).alias(f"{stage}_chars")]
    return lines.groupBy("id").agg(*sums)


def _grams(words: Column, n: int) -> Column:
    """Runs of ``n`` words in order, joined by blanks.

    The list is zipped with itself shifted; a slice per run would evaluate
    the list anew for every run.
    """
    out = words
    for shift in range(1, n):
        left = F.greatest(F.size(words) - shift, F.lit(0))
        out = F.zip_with(F.slice(out, F.lit(1), left), F.slice(words, F.lit(shift + 1), left), lambda x, y: F.concat(x, F.lit(" "), y))
    return out


def text_words(text: Column) -> Column:
    """Lower-case words of letters and digits, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Stems of lists of words; words of up to three letters stay."""
    return words.map(lambda ws: None if ws is None else [_stem(w) if len(w) > 3 else w for w in ws])


def ngram_overlap(pairs: DataFrame, n: int, stem: bool = False) -> DataFrame:
    """N-gram precision, recall and F1 of (id, target, predicted) texts by multiset overlap, of words or of their stems.

    Null texts count as empty; an undefined ratio is 0.
    """
    words = lambda c: stems(text_words(F.coalesce(F.col(c), F.lit("")))) if stem else text_words(F.coalesce(F.col(c), F.lit("")))
    read = pairs.select("id", words("target").alias("target"), words("predicted").alias("predicted"))
    side = lambda c: read.select("id", F.explode(_grams(F.col(c), n)).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias(c))
    t, p = side("target"), side("predicted")
    shared = t.join(p, ["id", "gram"]).groupBy("id").agg(F.sum(F.least("target", "predicted")).alias("shared"))
    size = lambda c: F.greatest(F.size(c) - (n - 1), F.lit(0))
    sizes = read.select("id", size("target").alias("nt"), size("predicted").alias("np")).join(shared, "id", "left").select("id", "nt", "np", F.coalesce("shared", F.lit(0)).alias("s"))
    precision, recall = F.coalesce(F.try_divide("s", "np"), F.lit(0.0)), F.coalesce(F.try_divide("s", "nt"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return sizes.select("id", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; one vector row of the table at a time."""
    if not a or not b:
        return 0
    codes = {w: i for i, w in enumerate(dict.fromkeys(a + b))}
    other = np.array([codes[w] for w in b])
    row = np.zeros(len(b) + 1, np.int64)
    for word in a:
        grown = np.maximum(row[1:], np.where(other == codes[word], row[:-1] + 1, 0))
        row[1:] = np.maximum.accumulate(grown)
    return int(row[-1])


_WORD = re.compile(r"[a-z0-9]+")


def rouge_l(pairs: DataFrame, stem: bool = False) -> DataFrame:
    """Precision, recall and F1 by the longest common subsequence of words of (id, target, predicted)."""
    kind = dict(pairs.dtypes)["id"]

    def words(text: str | None) -> list[str]:
        found = _WORD.findall((text or "").lower())
        return [_stem(w) if len(w) > 3 else w for w in found] if stem else found

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, target, predicted in batch.itertuples(index=False):
                t, p = words(target), words(predicted)
                shared = common_subsequence(t, p)
                precision, recall = (shared / len(p) if p else 0.0), (shared / len(t) if t else 0.0)
                rows.append((key, precision, recall, 2 * precision * recall / (precision + recall) if shared else 0.0))
            yield pd.DataFrame(rows, columns=["id", "precision", "recall", "f1"])

    return pairs.select("id", "target", "predicted").mapInPandas(score, f"id {kind}, precision double, recall double, f1 double")


# The suffix rules of Porter's paper of 1980.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
          ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """Letters of a word as c (consonant) and v (vowel)."""
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replace(word: str, rules: tuple[tuple[str, str], ...]) -> str:
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if _measure(stem) > 0 else word
    return word


def porter_stem(word: str) -> str:
    """The stem of a lower-case English word."""
    if len(word) <= 2:
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in _shape(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _STEP2), _STEP3)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t")):
                word = stem
            break
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or _measure(stem) == 1 and not _short(stem):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@lru_cache(maxsize=100_000)
def _stem(word: str) -> str:
    return porter_stem(word)


def retrieval(relevant: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Recall and precision of retrieved chunks (id, chunk) against relevant ones; repeated chunks count once."""
    both = relevant.select("id", "chunk").distinct().withColumn("r", F.lit(1)).join(retrieved.select("id", "chunk").distinct().withColumn("g", F.lit(1)), ["id", "chunk"], "full")
    hit = F.count_if(F.col("r").isNotNull() & F.col("g").isNotNull())
    part = lambda n: F.round(F.coalesce(F.try_divide(hit, F.count(n)), F.lit(0.0)), 6)
    return both.groupBy("id").agg(F.count("r").alias("n_relevant"), F.count("g").alias("n_retrieved"), part("r").alias("recall"), part("g").alias("precision"))


def consume_words(target: str, lines: list[str]) -> tuple[int, int, int, int]:
    """Characters and words of a target that the lines use up, each with how many there are: (chars, all chars, words, all words).

    Each word of each line, in order, removes every `` word `` with both its
    blanks from the target: neighbours of a removed word grow together and
    are no longer found.  Words are what blanks and line ends part.
    """
    count = lambda text: sum(1 for w in text.replace("\n", " ").split(" ") if w)
    rest = target
    for line in lines:
        for word in line.split(" "):
            rest = rest.replace(f" {word} ", "")
    return len(target) - len(rest), len(target), count(target) - count(rest), count(target)


def generated_recall(reference: list[str], generated: list[str]) -> tuple[float, float, float]:
    """Recall of characters, words and lines of a reference in generated lines.

    Generated lines are read in order for each reference line: a word counts
    wherever it stands in the reference line, and the first generated line
    that is part of the reference line is a hit and the last one read.  Words
    are compared as they are, letter case included.  Blank lines count on
    neither side; without a reference all are 0.
    """
    said = [line.strip() for line in generated if line.strip()]
    first: dict[str, int] = {}
    for place, line in enumerate(said):
        for word in line.split(" "):
            first.setdefault(word, place)
    lines = [line.strip() for line in reference if line.strip()]
    chars = words = hits = all_chars = all_words = 0
    for line in lines:
        hit = next((place for place, s in enumerate(said) if s in line), None)
        hits += hit is not None
        for word in line.split(" "):
            if not word:
                continue
            all_words += 1
            all_chars += len(word)
            place = first.get(word)
            if place is not None and (hit is None or place <= hit):
                words += 1
                chars += len(word)
    return (chars / all_chars if all_chars else 0.0), (words / all_words if all_words else 0.0), (hits / len(lines) if lines else 0.0)


def text_recall(pairs: DataFrame) -> DataFrame:
    """``consume_words`` and ``generated_recall`` of (id, target, predicted) texts."""
    kind = dict(pairs.dtypes)["id"]
    columns = ["id", "used_chars", "chars", "used_words", "words", "char_recall", "word_recall", "line_recall"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, target, predicted in batch.itertuples(index=False):
                t, p = (target or "").split("\n"), (predicted or "").split("\n")
                rows.append((key, *consume_words(target or "", p), *generated_recall(t, p)))
            yield pd.DataFrame(rows, columns=columns)

    return pairs.select("id", "target", "predicted").mapInPandas(
        score, f"id {kind}, used_chars bigint, chars bigint, used_words bigint, words bigint, char_recall double, word_recall double, line_recall double"
    )


def keyword_counts(texts: DataFrame, text: str, keywords: tuple[str, ...]) -> DataFrame:
    """Texts that hold each keyword, letter case ignored: one row."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return texts.agg(*[F.count_if(F.contains(low, F.lit(k.lower()))).alias(k) for k in keywords])


def density(values: DataFrame, column: str, low: float, high: float, points: int, width: float) -> DataFrame:
    """Gaussian kernel density on an even grid: (x, density).

    Values are counted first; each distinct value is exploded to the grid, so
    the cost follows the distinct values.
    """
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    total = values.where(F.col(column).isNotNull()).count()
    step = (high - low) / (points - 1)
    grid = counts.select("v", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low) + i * F.lit(step))).alias("x"))
    weight = F.exp(-F.pow((F.col("x") - F.col("v")) / F.lit(width), F.lit(2)) / 2) / F.lit(max(total, 1) * width * (2 * np.pi) ** 0.5)
    return grid.groupBy("x").agg(F.sum(F.col("n") * weight).alias("density"))


def _characters(word: Column, n: int) -> Column:
    """Runs of one to ``n`` characters of a word, in time that follows its length."""
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(word, F.lit(f"(?s)(?=(.{{{k}}}))"), 1) for k in range(1, n + 1)])))


def _inner_words(line: Column, n: int) -> Column:
    """Runs of ``n`` words, or of all if fewer, of a line without its first and last word, which a longer text may continue."""
    words = F.split(line, " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    out = _grams(inner, n)
    for k in range(n - 1, 0, -1):
        out = F.when(F.size(inner) <= k, _grams(inner, k)).otherwise(out)
    return F.array_distinct(out)


def _all_words(text: Column, n: int) -> Column:
    """Runs of one to ``n`` words of a text."""
    words = F.split(text, " ")
    return F.array_distinct(F.flatten(F.array(*[_grams(words, k) for k in range(1, n + 1)])))


def _rarest(own: DataFrame, held: DataFrame, keys: list[str], holder: str) -> DataFrame:
    """Per row of ``own`` (keys, n_own, gram) the gram that the fewest of ``held`` (holder, gram) have; none where one of its grams is not held at all."""
    counts = held.groupBy("gram").agg(F.count(holder).alias("n_held"))
    found = own.join(counts, "gram").groupBy(*keys).agg(F.count("*").alias("n_found"), F.max("n_own").alias("n_own"), F.min(F.struct("n_held", "gram")).alias("least"))
    return found.where(F.col("n_found") >= F.col("n_own")).select(*keys, F.col("least.gram").alias("gram"))


def containments(texts: DataFrame, lines: DataFrame, n: int = 3, also: tuple[str, ...] = ()) -> DataFrame:
    """Every pair of a text (id, text) and a line (line) that is part of it: (id, line), each once; of equal ``also`` columns only.

    A substring join without comparing all pairs.  A line of three words or
    more can only be part of a text that holds all its inner runs of words:
    it is looked up by the run that the fewest texts hold.  A shorter line
    can only be part of a text one of whose words holds the line's longest
    word: that is looked up among the distinct words by its rarest run of
    characters.  Only pairs found so are compared character by character.
    Ids, hashes and words are shuffled, neither texts nor lines; these meet
    their candidates at the end, by id and hash.  Null and empty lines are part of nothing,
    null texts hold nothing.
    """
    ensure_checkpoint_dir(texts.sparkSession)
    keys = list(also)
    held = texts.select("id", *keys, "text").where("text is not null")
    known = lines.select(*keys, "line").where("line is not null and line <> ''").distinct().withColumn("hash", F.md5("line"))
    if keys:  # what shares no key with the other side is left out first
        held, known = held.join(known.select(keys).distinct(), keys, "left_semi"), known.join(held.select(keys).distinct(), keys, "left_semi")
    several = F.size(F.split("line", " ")) > 2
    # lines of three words or more
    own = known.where(several).select(*keys, "hash", _inner_words(F.col("line"), n).alias("own"))
    own = own.select(*keys, "hash", F.size("own").alias("n_own"), F.explode(F.transform("own", lambda g: F.xxhash64(*keys, g))).alias("gram"))
    grams = held.select("id", F.explode(F.transform(_all_words(F.col("text"), n), lambda g: F.xxhash64(*keys, g))).alias("gram"))
    grams = grams.join(own.select("gram").distinct(), "gram", "left_semi").checkpoint()  # only runs that some line has
    candidates = salted(grams, _rarest(own, grams, [*keys, "hash"], "id"), ["gram"], "id", how="inner").select("id", *keys, "hash")
    # lines of one or two words, by their longest word
    longest = F.reduce(F.split("line", " "), F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    short = known.where(~several).select(*keys, "hash", longest.alias("part"))
    if short.limit(1).count():
        words = held.select("id", *keys, F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
        of_words = words.select("word").distinct().select("word", F.md5("word").alias("word_hash"))
        runs = of_words.select("word_hash", F.explode(_characters(F.col("word"), n)).alias("gram"))
        parts = short.select("part").distinct().where("part <> ''")
        own_runs = F.array_distinct(F.regexp_extract_all("part", F.lit(f"(?s)(?=(.{{{n}}}))"), 1))
        own = parts.select(F.md5("part").alias("part_hash"), F.when(F.length("part") < n, F.array("part")).otherwise(own_runs).alias("own"))
        own = own.select("part_hash", F.size("own").alias("n_own"), F.explode("own").alias("gram"))
        runs = runs.join(own.select("gram").distinct(), "gram", "left_semi")
        pairs = salted(runs, _rarest(own, runs, ["part_hash"], "word_hash"), ["gram"], "word_hash", how="inner").select("part_hash", "word_hash")
        pairs = pairs.join(of_words, "word_hash").join(parts.withColumn("part_hash", F.md5("part")), "part_hash").where(F.contains("word", F.col("part"))).select("part", "word")
        of_lines = short.join(pairs, "part").select(*keys, "hash", "word")
        # a line of blanks alone may stand in any text that holds blanks
        blank = short.where("part = ''").select(*keys, "hash", F.lit("").alias("word"))
        spaced = held.where(F.contains("text", F.lit(" "))).select("id", *keys, F.lit("").alias("word"))
        candidates = candidates.unionByName(words.where("word <> ''").unionByName(spaced).join(of_lines.unionByName(blank), [*keys, "word"]).select("id", *keys, "hash"))
    return candidates.distinct().join(known, [*keys, "hash"]).join(held, ["id", *keys]).where(F.contains("text", F.col("line"))).select("id", *keys, "line")


def longest_contained(texts: DataFrame, lines: DataFrame, n: int = 3) -> DataFrame:
    """Per text (id, text) the length of the longest of all ``lines`` (line) that is part of it: (id, covered); a text that contains none has no row."""
    return containments(texts, lines, n).groupBy("id").agg(F.max(F.length("line")).alias("covered"))
