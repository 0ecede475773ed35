"""Mixed timestamp notations and zones into one UTC instant.

A value may be read in several ways (day or month first, year first or last,
Unix or spreadsheet number), or be a mistake.  Per source, expectation-
maximisation estimates how often each format and mistakes occur: every value
shares its count among its valid readings in proportion to the present
weights (E step), the shares and the prior give new weights (M step).  The
stated conventions are the prior: an unusual format stays in the mixture and
wins in a source that shows enough of it.  Posteriors choose a reading; where
none is clear the value is marked ``ambiguous`` instead of being guessed.

Scale: values are read once, inside Arrow batches; EM runs on counts per
(source, set of valid formats).  There are few such sets however many rows
there are, and they are pre-aggregated before the shuffle, so a source with a
third of all rows weighs no more than any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.batches import record_batch
from logweave.functions.joins import salted, small
from logweave.functions.paths import cell_under, path_unit, path_year, unit_key
from logweave.functions.timescan import possible, scan
from logweave.session import ensure_checkpoint_dir

#: Formats that the stated conventions make unusual.  Hyphenated and
#: year-first dates run year, month, day; dotted and slashed ones day first.
DAY_FIRST = frozenset(
    {
        "hyphen:YDM", "hyphen:DMY", "hyphen:MDY", "slash:YDM", "slash:MDY", "slash:YMD2", "dot:MDY", "dot:YMD2", "dot:YDM",
    }
)

#: Headers of ticket sheets.
UNIT_HEADERS = ("Vehicle", "Unit", "Train set")
TIME_HEADERS = ("Reported at", "Time of report")

_NUMERIC = re.compile(r"(\d{1,4})([-./])(\d{1,2})\2(\d{1,4})(?=[ T])")
_BARE = re.compile(r"[+-]?\d+(?:[.,]\d+)?$")
_HEX = re.compile(r"0[xX]([0-9a-fA-F]+)$")
_KINDS = {"-": "hyphen", ".": "dot", "/": "slash"}
_EPOCH = datetime(1970, 1, 1)
_SHEET_EPOCH = datetime(1899, 12, 30)
#: The prior counts as much as the values of a source and this many more; what shares of it a usual format, an unusual
#: one and mistakes have; how likely a mistake looks like a date that only unusual formats read.
PRIOR_VALUES, USUAL, UNUSUAL, MISTAKES, MISTAKE_LOOKS_VALID = 50, 0.01, 0.0001, 0.05, 0.5
MISTAKE = ""
_SECONDS_AT = ((10**8, 10**11, 1), (10**11, 10**14, 10**3), (10**14, 10**17, 10**6), (10**17, 10**20, 10**9))


def _orders(first: str, second: str, third: str, kind: str) -> Iterator[tuple[str, int, int, int]]:
    """Every valid reading of three numbers as a date: (format, year, month, day)."""
    a, b, c = int(first), int(second), int(third)
    if len(first) == 4:
        if possible(a, b, c):
            yield f"{kind}:YMD", a, b, c
        if possible(a, c, b):
            yield f"{kind}:YDM", a, c, b
        return
    if len(first) > 2 or len(third) == 3:
        return
    year = c if len(third) == 4 else 2000 + c
    if possible(year, b, a):
        yield f"{kind}:DMY", year, b, a
    if possible(year, a, b):
        yield f"{kind}:MDY", year, a, b
    if len(first) == 2 and len(third) == 2 and possible(2000 + a, b, c):
        yield ("hyphen:YMD" if kind == "hyphen" else f"{kind}:YMD2"), 2000 + a, b, c


def _number(text: str, sheets: bool) -> tuple | None:
    """A bare number by its magnitude: Unix time, or spreadsheet days where sheets are read."""
    whole, _, part = text.lstrip("+").replace(",", ".").partition(".")
    if text.startswith("-"):
        return None
    value = int(whole)
    if value == 0 or (value + 1) & value == 0 and value.bit_length() in (32, 64):
        return None
    for low, high, scale in _SECONDS_AT:
        if low <= value < high:
            micros = value * 10**6 // scale + (int((part + "000000")[:6]) * 1 if scale == 1 and part else 0)
            return "unix", micros, None
    if sheets and 10_000 <= value < 100_000:
        fraction = int((part + "0" * 15)[:15]) if part else 0
        micros = value * 86_400_000_000 + (fraction * 86_400_000_000 + 5 * 10**14) // 10**15
        return "serial", None, _SHEET_EPOCH + timedelta(microseconds=micros)
    return None


def readings(value: str | None, year: int | None, sheets: bool = False) -> list[tuple]:
    """Every valid reading of a value: (format, Unix microseconds or None, wall time or None, zone as written)."""
    text = (value or "").strip()
    if not text:
        return []
    if _BARE.match(text):
        found = _number(text, sheets)
        return [(*found, "")] if found else []
    hexadecimal = _HEX.match(text)
    if hexadecimal:
        found = _number(str(int(hexadecimal.group(1), 16)), False)
        return [(*found, "")] if found else []
    numeric = _NUMERIC.match(text)
    if numeric is None:
        written = scan(text)
        if written is None or written.end != len(text) or written.number is not None:
            return []
        y = written.year or year
        if y is None or not possible(y, written.month, written.day):
            return []
        dates = [("named" if written.year else "no year", y, written.month, written.day)]
    else:
        first, mark, second, third = numeric.groups()
        dates = list(_orders(first, second, third, _KINDS[mark]))
        # the automaton reads the rest after any fitting date
        written = scan("2000-01-01" + text[numeric.end() :]) or scan("01.01.00" + text[numeric.end() :])
        if written is None or written.end != len(text) - numeric.end() + (8 if written.notation.startswith("?D.") else 10):
            return []
    micro = int((written.fraction + "000000")[:6]) if written.fraction else 0
    return [(name, None, datetime(y, m, d, written.hour, written.minute, written.second, micro), written.zone) for name, y, m, d in dates]


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


def instant(wall: datetime, written: str, zone_name: str | None) -> tuple[int | None, str]:
    """UTC microseconds of a wall time and how it was resolved.

    A written offset counts; an abbreviation must be one of the zone at that
    time; of a wall time that occurs twice the earlier instant counts unless
    the abbreviation says otherwise; one that never occurs has no instant.
    """
    micros = (wall - _EPOCH) // timedelta(microseconds=1)
    if written in ("Z", "UTC"):
        return micros, "offset"
    if written[:1] in "+-" and written:
        digits = written[1:].replace(":", "")
        shift = int(digits[:2]) * 3600 + int(digits[2:4]) * 60
        return micros - (shift if written[0] == "+" else -shift) * 1_000_000, "offset"
    zone = _zone(zone_name) if zone_name else None
    if zone is None:
        return None, "no zone"
    shifts = [(wall.replace(tzinfo=zone, fold=fold).utcoffset(), wall.replace(tzinfo=zone, fold=fold).tzname()) for fold in (0, 1)]
    fitting = []
    for shift, name in shifts:
        at = wall - shift
        if at.replace(tzinfo=ZoneInfo("UTC")).astimezone(zone).replace(tzinfo=None) == wall:
            fitting.append((micros - shift // timedelta(microseconds=1), name))
    if not fitting:
        return None, "never occurs"
    if written:
        named = [at for at, name in fitting if name == written]
        return (min(named), "abbreviation") if named else (None, "foreign abbreviation")
    return min(at for at, _ in fitting), "zone" if len({at for at, _ in fitting}) == 1 else "earlier of two"


def expectation_maximisation(counts: list[tuple[tuple[str, ...], int]], unusual: frozenset[str], rounds: int = 200) -> list[dict[str, float]]:
    """Posteriors of the formats of one source, and of ``MISTAKE``, for each set of valid formats.

    ``counts``: how many values have just this set of valid formats.  A value
    that a usual format reads is no mistake.  Weights start from the prior;
    its pseudo-counts keep every format possible, so that one value never
    decides alone against another.
    """
    sets = [tuple(names) + (() if set(names) - unusual else (MISTAKE,)) for names, _ in counts]
    prior = {f: MISTAKES if f == MISTAKE else UNUSUAL if f in unusual else USUAL for names in sets for f in names}
    looks = {f: MISTAKE_LOOKS_VALID if f == MISTAKE else 1.0 for f in prior}
    strength = PRIOR_VALUES + sum(n for _, n in counts)

    def posteriors(weights: dict[str, float]) -> list[dict[str, float]]:
        joint = [{f: weights[f] * looks[f] for f in names} for names in sets]
        return [{f: p / sum(j.values()) for f, p in j.items()} for j in joint]

    weights = dict(prior)
    for _ in range(rounds):
        shares = {f: strength * p for f, p in prior.items()}
        for (_, n), posterior in zip(counts, posteriors(weights), strict=True):
            for f, p in posterior.items():
                shares[f] += n * p
        whole = sum(shares.values())
        updated = {f: s / whole for f, s in shares.items()}
        moved = max((abs(updated[f] - weights[f]) for f in weights), default=0.0)
        weights = updated
        if moved < 1e-9:
            break
    return posteriors(weights)


_READING = pa.struct([("format", pa.string()), ("utc_us", pa.int64()), ("wall_us", pa.int64()), ("zone", pa.string())])
_READ = pa.schema([("origin", pa.string()), ("rec_id", pa.int64()), ("source", pa.string()), ("unit", pa.string()), ("formats", pa.string()), ("readings", pa.list_(_READING))])
_RESOLVED = pa.schema([("origin", pa.string()), ("rec_id", pa.int64()), ("utc_us", pa.int64()), ("format", pa.string()), ("posterior", pa.float64()), ("status", pa.string())])


def normalise_times(values: DataFrame, zones: DataFrame, unusual: frozenset[str] = DAY_FIRST, clear: float = 0.9) -> DataFrame:
    """One row per value with its instant, or with the reason why it has none.

    ``values``: origin, rec_id, source (the group that shares format habits),
    unit (key of the zone), path (may give a missing year), value, sheets
    (whether spreadsheet numbers occur).  ``zones``: unit, zone_name, one row
    per unit.  Result: origin, rec_id, utc_us, format, posterior, status;
    status is ``resolved``, ``ambiguous`` (no reading has a posterior of
    ``clear``), ``mistake``, ``unreadable``, or what ``instant`` says.  Null,
    blank and unusable values are ``unreadable``; repeated rows stay
    repeated; values without a source are one source.
    """
    ensure_checkpoint_dir(values.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            origin, key, source, unit, path, value, sheets = (batch.column(i).to_pylist() for i in range(7))
            found = [readings(v, path_year(p), bool(s)) for v, p, s in zip(value, path, sheets, strict=True)]
            formats = ["|".join(sorted({r[0] for r in rs})) for rs in found]
            told = [[(name, at, None if wall is None else (wall - _EPOCH) // timedelta(microseconds=1), zone) for name, at, wall, zone in rs] for rs in found]
            columns = (origin, key, source, unit, formats, [[dict(zip(("format", "utc_us", "wall_us", "zone"), r, strict=True)) for r in rs] for rs in told])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _READ, strict=True)], schema=_READ)

    source = F.coalesce("source", F.lit("")).alias("source")
    read_values = values.select("origin", "rec_id", source, "unit", "path", "value", "sheets").mapInArrow(
        read, "origin string, rec_id bigint, source string, unit string, formats string, readings array<struct<format: string, utc_us: bigint, wall_us: bigint, zone: string>>"
    )
    read_values = read_values.checkpoint()  # read once, used for the counts and the choice
    counts = read_values.where("formats <> ''").groupBy("source", "formats").agg(F.count("*").alias("n"))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        sets = [tuple(f.split("|")) for f in group["formats"]]
        found = expectation_maximisation(list(zip(sets, group["n"].tolist(), strict=True)), unusual)
        best = [max(p.items(), key=lambda x: (x[1], x[0])) for p in found]
        return pd.DataFrame({"source": group["source"], "formats": group["formats"], "format": [b[0] for b in best], "posterior": [b[1] for b in best]})

    chosen = counts.groupBy("source").applyInPandas(choose, "source string, formats string, format string, posterior double")
    merged = salted(read_values, chosen, ["source", "formats"], "rec_id").join(small(zones.select("unit", "zone_name")), "unit", "left")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for origin, key, told, fmt, posterior, zone in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if fmt is None:
                    out.append((origin, key, None, None, None, "unreadable"))
                elif fmt == MISTAKE or posterior < clear:
                    out.append((origin, key, None, fmt or None, posterior, "ambiguous" if posterior < clear else "mistake"))
                else:
                    reading = next(r for r in told if r["format"] == fmt)
                    at, how = reading["utc_us"], "resolved"
                    if at is None:
                        at, how = instant(_EPOCH + timedelta(microseconds=reading["wall_us"]), reading["zone"], zone)
                    out.append((origin, key, at, fmt, posterior, "resolved" if at is not None else how))
            yield record_batch(out, _RESOLVED)

    return merged.select("origin", "rec_id", "readings", "format", "posterior", "zone_name").mapInArrow(
        resolve, "origin string, rec_id bigint, utc_us bigint, format string, posterior double, status string"
    )


def unit_zones(units: DataFrame) -> DataFrame:
    """unit (key), zone_name of the vehicle table; one row per key."""
    return units.select(unit_key(F.col("unit_code")).alias("unit"), "zone_name").where("unit is not null").dropDuplicates(["unit"])


def staged_times(staged: DataFrame) -> DataFrame:
    unit = unit_key(path_unit(F.col("source_path")))
    return staged.select(
        F.lit("staged").alias("origin"), F.col("stage_id").alias("rec_id"), unit.alias("source"), unit.alias("unit"),
        F.col("source_path").alias("path"), F.col("time_start").alias("value"), F.lit(False).alias("sheets"),
    )


def ticket_unit(headers: Column, values: Column) -> Column:
    """The key of the unit that a ticket row names."""
    return unit_key(cell_under(headers, values, UNIT_HEADERS))


def ticket_times(tickets: DataFrame) -> DataFrame:
    """Report times of ticket rows; a ticket row that is repeated counts once."""
    row = F.col("headers"), F.col("row_values")
    return (
        tickets.select(
            F.lit("ticket").alias("origin"), F.col("ticket_id").alias("rec_id"), F.concat(F.lit("sheet "), F.col("sheet_id").cast("string")).alias("source"),
            ticket_unit(*row).alias("unit"), F.lit(None).cast("string").alias("path"), cell_under(*row, TIME_HEADERS).alias("value"), F.lit(True).alias("sheets"),
        )
        .where("value is not null")
        .dropDuplicates(["rec_id", "source", "unit", "value"])
    )


def found_instants(staged: DataFrame, tickets: DataFrame, units: DataFrame) -> DataFrame:
    values = staged_times(staged).unionByName(ticket_times(tickets))
    return normalise_times(values, unit_zones(units)).where("status = 'resolved'").select("origin", "rec_id", "utc_us")
