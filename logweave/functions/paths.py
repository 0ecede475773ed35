"""Vehicle units and dates in source paths."""

from __future__ import annotations

import re
from datetime import datetime
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.functions.timescan import MONTHS, notation_pattern

#: How a path segment writes its date (see ``notation_pattern``), how far that is trusted, and its name.
PATH_NOTATIONS = (
    ("YYYY-MM-DDThh_mm_ss", 1000, "path_iso_T"), ("YYYY-MM-DD_hh_mm_ss", 900, "path_iso_us"), ("DD.MM.YY_hh.mm", 800, "path_ddmmyy_dot"), ("_DDMMYY_hhmm$", 750, "path_ddmmyy_hhmm"),
    ("?D *b YY!", 670, "path_textual_dmy"), ("_DDMMYY$", 650, "path_trailing_ddmmyy"), ("?D~?M~YYYY!", 150, "path_date_only_loose_yyyy"), ("?D~?M~YY!", 100, "path_date_only_loose"),
)
#: Short years up to this one belong to the present century.
LAST_SHORT_YEAR = 70

_READERS = tuple((*notation_pattern(notation), trust, name) for notation, trust, name in PATH_NOTATIONS)
_COMPILED = tuple((re.compile(pattern), fields, trust) for pattern, fields, trust, _ in _READERS)


@lru_cache(maxsize=100_000)
def path_date(path: str | None) -> tuple[int, datetime] | None:
    """(score, time) of the most trusted date in a path, None where it has no valid one.

    The score is the trust in the notation plus the place of the segment: of
    equal trust the later segment counts.  In one segment only the most
    trusted notation that occurs is read, even if its date is impossible.
    """
    best = None
    for place, segment in enumerate(s for s in re.split(r"[/\\]", path or "") if s):
        for pattern, fields, trust in _COMPILED:
            found = pattern.search(segment)
            if found is None:
                continue
            part = dict(zip(fields, found.groups(), strict=True))
            year = int(part["Y"])
            if len(part["Y"]) == 2:
                year += 2000 if year <= LAST_SHORT_YEAR else 1900
            month = MONTHS[part["b"][:3].lower()] if "b" in part else int(part["M"])
            try:
                at = datetime(year, month, int(part["D"]), *(int(part.get(f, 0)) for f in "hms"))
            except ValueError:
                break
            if best is None or trust + place > best[0]:
                best = (trust + place, at)
            break
    return best


def path_year(path: str | None) -> int | None:
    """The year of the date in a path, None where it has no valid date."""
    found = path_date(path)
    return found and found[1].year


def _segment_date(segment: Column, place: Column) -> Column:
    """``path_date`` of one segment as a struct; null where no notation occurs."""
    read = []
    for pattern, fields, trust, name in _READERS:
        part = {f: F.regexp_extract(segment, pattern, i + 1) for i, f in enumerate(fields)}
        year = part["Y"].cast("int")
        if "YYYY" not in PATH_NOTATIONS[len(read)][0]:
            year = year + F.when(year <= LAST_SHORT_YEAR, 2000).otherwise(1900)
        month = F.floor((F.instr(F.lit("".join(MONTHS)), F.lower(F.left(part["b"], F.lit(3)))) + 2) / 3).cast("int") if "b" in part else part["M"].cast("int")
        clock = [part[f].cast("int") if f in part else F.lit(0) for f in "hms"]
        at = F.try_make_timestamp(year, month, part["D"].cast("int"), *clock, F.lit("UTC"))
        read.append(F.when(segment.rlike(pattern), F.struct((F.lit(trust) + place).alias("score"), (-place).alias("order"), at.alias("at"), F.lit(name).alias("source"), segment.alias("part"))))
    return F.coalesce(*read)


def path_anchor(path: Column) -> Column:
    """``path_date`` as an expression: struct (score, order, at, source, part), null without a valid date; order only breaks ties."""
    segments = F.filter(F.split(path, r"[/\\\\]"), lambda s: s != "")
    return F.array_max(F.filter(F.transform(segments, _segment_date), lambda x: x["at"].isNotNull()))


def same_path(path: Column) -> Column:
    """Both separators spell one path."""
    return F.translate(path, "\\", "/")


def unit_key(text: Column) -> Column:
    """Letters and digits of a unit code, upper case; null where none is left."""
    key = F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))
    return F.when(key != "", key)


def path_unit(path: Column) -> Column:
    """The vehicle unit: the first segment of a path."""
    return F.regexp_extract(path, r"^([^/\\]*)", 1)


def cell_under(headers: Column, values: Column, names: tuple[str, ...]) -> Column:
    """The first non-blank cell under a header of ``names`` (padding and case ignored).

    Null where no such header stands or the row is cut before it.
    """
    wanted = F.array(*[F.lit(n.lower()) for n in names])
    pairs = F.arrays_zip(headers.alias("h"), values.alias("v"))
    fitting = F.filter(
        pairs,
        lambda p: F.array_contains(wanted, F.lower(F.trim(p["h"]))) & p["v"].isNotNull() & (F.trim(p["v"]) != ""),
    )
    return F.when(F.size(fitting) > 0, fitting[0]["v"])
