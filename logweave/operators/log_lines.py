"""Semi-structured log lines into fields.

A deterministic state machine reads the head of every line character by
character.  Its states tokenise delimiters, brackets, quotes and times
(``timescan``); the order of the tokens selects a grammar, which assigns
time, level, component and message.  A line that no grammar accepts is a
continuation of the entry above it; lookahead states decide whether a
``key: value`` line opens an entry of several lines.

The work is done per chunk inside Arrow batches: no shuffle, no state beyond
one chunk, so a chunk of any size costs time in proportion to its text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.batches import ROWS_PER_BATCH, record_batch
from logweave.functions.paths import path_year
from logweave.functions.timescan import Written, as_written, scan, scan_head

# Level words, letters and syslog numbers.
_DEBUG, _INFO, _WARN, _ERROR, _FATAL = "DEBUG", "INFO", "WARN", "ERROR", "FATAL"
LEVELS = {
    "debug": _DEBUG, "trace": _DEBUG, "verbose": _DEBUG, "dbg": _DEBUG, "d": _DEBUG, "t": _DEBUG, "v": _DEBUG,
    "info": _INFO, "information": _INFO, "informational": _INFO, "notice": _INFO, "note": _INFO, "i": _INFO, "n": _INFO,
    "warn": _WARN, "warning": _WARN, "w": _WARN,
    "err": _ERROR, "error": _ERROR, "severe": _ERROR, "e": _ERROR,
    "fatal": _FATAL, "critical": _FATAL, "crit": _FATAL, "emergency": _FATAL, "emerg": _FATAL, "alert": _FATAL, "panic": _FATAL, "f": _FATAL, "c": _FATAL,
}
SYSLOG = (_FATAL, _FATAL, _FATAL, _ERROR, _WARN, _INFO, _INFO, _DEBUG)

# What the names of named fields stand for.
ROLES = {
    **dict.fromkeys(("time", "at", "ts", "t", "timestamp", "when", "date", "datetime", "logged", "stamp"), "time"),
    **dict.fromkeys(("level", "severity", "class", "lvl", "sev", "l", "priority", "prio", "loglevel"), "level"),
    **dict.fromkeys(("component", "source", "task", "module", "comp", "c", "logger", "unit", "origin", "process", "program", "subsystem", "facility", "app"), "component"),
    **dict.fromkeys(("message", "msg", "text", "m", "event", "detail", "what"), "message"),
}

ENTRY_SCHEMA = pa.schema(
    [("id", pa.int64()), ("entry_no", pa.int32()), ("n_lines", pa.int32()), ("logged_at", pa.string()), ("severity", pa.string()), ("component", pa.string()), ("message", pa.string())]
)

_LINE_END = re.compile(r"\r\n|\r|\n")
_BRACKETS = {"[": "]", "(": ")", "<": ">"}
_NAME = re.compile(r"[A-Za-z_][\w.\-]*")
_COLOUR = re.compile("\x1b\\[[0-9;]*[A-Za-z]")
_PLACE = re.compile(r"(?:\[\d+\]|:\d+|\(\d+\)|#\d+)+$")


def level(word: str) -> str | None:
    """The severity of a level word, letter or syslog number, else None."""
    word = word.strip()
    if word.isdigit():
        return SYSLOG[int(word) % 8] if len(word) <= 3 else None
    return LEVELS.get(word.lower())


def _component(word: str) -> str:
    """Without process ids and line numbers."""
    return _PLACE.sub("", word.strip())


def _quoted(line: str, at: int) -> tuple[str, int] | None:
    """The text of a quoted value that opens at ``at``, and where it ends."""
    quote, out, i = line[at], [], at + 1
    while i < len(line):
        c = line[i]
        if c == "\\" and i + 1 < len(line):
            out.append(c + line[i + 1])
            i += 2
            continue
        if c == quote:
            body = "".join(out)
            if "\\" in body:
                try:
                    body = json.loads(f'"{body}"')
                except ValueError:
                    pass
            return body, i + 1
        out.append(c)
        i += 1
    return None


def _named(line: str, at: int) -> tuple[dict[str, str], int]:
    """Fields ``name=value`` or ``"name": value`` from ``at`` on, by role; the first of a role counts."""
    fields: dict[str, str] = {}
    i, n = at, len(line)
    while i < n:
        while i < n and line[i] in " \t,":
            i += 1
        if i >= n:
            break
        if line[i] == '"':
            read = _quoted(line, i)
            if read is None:
                break
            name, i = read
        else:
            word = _NAME.match(line, i)
            if word is None:
                break
            name, i = word.group(), word.end()
        while i < n and line[i] in " \t":
            i += 1
        if i >= n or line[i] not in "=:":
            break
        i += 1
        while i < n and line[i] in " \t":
            i += 1
        if i < n and line[i] in "\"'":
            read = _quoted(line, i)
            if read is None:  # cut inside its quotes
                value, i = line[i + 1 :], n
            else:
                value, i = read
        else:
            start = i
            while i < n and line[i] not in " \t,}>":
                i += 1
            value = line[start:i]
        role = ROLES.get(name.lower())
        if role:
            fields.setdefault(role, value)
    return fields, i


def _from_fields(fields: dict[str, str], year: int | None) -> tuple | None:
    at = scan(fields.get("time", "").strip())
    if at is None:
        return None
    return as_written(at, year), level(fields.get("level", "")) or "", _component(fields.get("component", "")), fields.get("message", "")


def _object(line: str, year: int | None) -> tuple | None:
    """Grammar ``{"name": value, ...}`` on one line."""
    fields, _ = _named(line, 1)
    return _from_fields(fields, year) if "time" in fields else None


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _element(line: str, year: int | None) -> tuple | None:
    """Grammar ``<name attribute="value" ...>message</name>``."""
    name = _NAME.match(line, 1)
    if name is None:
        return None
    fields, end = _named(line, name.end())
    if "time" not in fields:
        return None
    if line[end : end + 1] == ">":
        body = line[end + 1 :]
        close = body.rfind("</")
        fields["message"] = body[:close] if close >= 0 else body
    for written, meant in _ENTITIES:
        fields = {k: v.replace(written, meant) for k, v in fields.items()}
    return _from_fields(fields, year)


def _assigned(line: str, year: int | None) -> tuple | None:
    """Grammar ``name=value name=value ...``."""
    name = _NAME.match(line)
    if name is None or line[name.end() : name.end() + 1] != "=" or ROLES.get(name.group().lower()) is None:
        return None
    fields, _ = _named(line, 0)
    return _from_fields(fields, year) if "time" in fields else None


class _Head:
    """The head of a positional line as tokens, read from left to right."""

    __slots__ = ("line", "at")

    def __init__(self, line: str) -> None:
        self.line, self.at = line, 0

    def blanks(self) -> str:
        start = self.at
        while self.at < len(self.line) and self.line[self.at] in " \t":
            self.at += 1
        return self.line[start : self.at]

    def peek(self) -> str:
        return self.line[self.at : self.at + 1]

    def bracket(self) -> str | None:
        """The content of a bracket that opens here."""
        close = _BRACKETS.get(self.peek())
        if close is None:
            return None
        end = self.line.find(close, self.at + 1)
        if end < 0:
            return None
        content = self.line[self.at + 1 : end]
        self.at = end + 1
        return content

    def cell(self, delimiter: str) -> str | None:
        end = self.line.find(delimiter, self.at)
        if end < 0:
            return None
        content = self.line[self.at : end]
        self.at = end + 1
        return content

    def name(self) -> str | None:
        found = _NAME.match(self.line, self.at)
        if found is None:
            return None
        self.at = found.end()
        return found.group()

    def mark(self) -> str:
        """A delimiter between component and message: ``:``, ``::``, ``-``, ``--`` or ``>``."""
        start = self.at
        while self.at < len(self.line) and self.line[self.at] in ":->":
            self.at += 1
        return self.line[start : self.at]

    def rest(self) -> str:
        return self.line[self.at :].strip()


_LINE_NUMBER = re.compile(r":\d+(?!\S)")
_VERSION = re.compile(r"\d{1,2} ")
_PLAIN_NUMBERS = re.compile(r"(?:\d+[ \t]+|-{2,}[ \t]+)+")
_STRUCTURED = re.compile(r"(\S+) (\S+) (\S+) (\S+) (?:-|(?:\[(?:[^\]\\]|\\.)*\])+)(?: |$)")


def _time_in_bracket(head: _Head) -> Written | None:
    """The time that fills a bracket opening here."""
    inner = head.bracket()
    return scan(inner.strip()) if inner else None


def _time(head: _Head) -> Written | None:
    """A time here, bare or in a bracket; the head then stands behind it."""
    if head.peek() in ("[", "("):
        return _time_in_bracket(head)
    written = scan(head.line, head.at)
    if written is not None:
        head.at = written.end
    return written


def _opening(head: _Head) -> tuple[Written, str] | None:
    """``[<number>] [level] time``: the time and a severity, which may be empty."""
    severity = ""
    if head.peek() == "<":
        number = head.bracket()
        if number is None or not number.isdigit() or len(number) > 3:
            return None
        severity = SYSLOG[int(number) % 8]
        head.blanks()
        version = _VERSION.match(head.line, head.at)
        if version and scan(head.line, version.end()) is not None:
            head.at = version.end()
    start = head.at
    written = _time(head)
    if written is None:
        head.at = start
        word = head.bracket() if head.peek() in ("[", "(") else head.name()
        found = level(word) if word and len(word.strip()) > 1 and not word.strip().isdigit() else None
        if found is None:
            return None
        severity = found
        head.mark()
        if not head.blanks():
            return None
        written = _time(head)
    if written is None or head.peek().isalnum() or head.peek() == "_":
        return None
    return written, severity


def _in_cells(head: _Head, severity: str) -> tuple[str, str, str] | None:
    """``|level|component|message`` or the same with ``;``."""
    mark = head.peek()
    head.at += 1
    first = head.cell(mark)
    second = head.cell(mark) if first is not None else None
    if second is None:
        return None
    if level(first) is None and level(second) is not None:
        first, second = second, first
    return level(first) or severity, _component(second), head.rest()


def _in_tabs(head: _Head) -> tuple[str, str, str] | None:
    """``component TAB level TAB message`` in either order."""
    cells = head.line[head.at :].split("\t", 2)
    if len(cells) == 3:
        for one, other in ((0, 1), (1, 0)):
            if level(cells[one]) is not None and " " not in cells[other].strip():
                return level(cells[one]), _component(cells[other]), cells[2].strip()
    return None


def _level_in_bracket(head: _Head) -> str | None:
    """The severity in a bracket here; without one the head stays."""
    start = head.at
    inner = head.bracket()
    found = level(inner) if inner is not None and not inner.strip().isdigit() else None
    if found is None:
        head.at = start
    else:
        head.blanks()
    return found


def _named_component(head: _Head) -> str:
    """``[host] component[number]: `` with any mark; without a mark there is none and the head stays."""
    begin = head.at
    for _ in range(2):
        start = head.at
        word = head.name()
        if word is None:
            break
        while head.peek() in ("[", "(") and head.bracket() is not None:
            pass
        number = _LINE_NUMBER.match(head.line, head.at)
        if number:
            head.at = number.end()
        place = head.at
        gap = head.blanks()
        mark = head.mark()
        if mark and (head.peek() in ("", " ", "\t") or not gap):
            return _component(head.line[start:place])
        if mark or not gap or "." in word:  # a host is one plain word
            break
    head.at = begin
    return ""


def _in_dashes(head: _Head) -> tuple[str, str, str] | None:
    """``- component - level - message`` with component and level in either order, or without component."""
    if not head.line.startswith("- ", head.at):
        return None
    cells = head.line[head.at + 2 :].split(" - ", 2)
    for one, other in ((0, 1), (1, 0)):
        if len(cells) == 3 and level(cells[one]) is not None and " " not in cells[other].strip():
            return level(cells[one]), _component(cells[other]), cells[2].strip()
    if len(cells) > 1 and level(cells[0]) is not None:
        return level(cells[0]), "", " - ".join(cells[1:]).strip()
    return None


def _in_names(head: _Head, severity: str) -> tuple[str, str, str] | None:
    """``name=value`` fields behind the time, one of them the message."""
    name = _NAME.match(head.line, head.at)
    if name is None or head.line[name.end() : name.end() + 1] != "=":
        return None
    fields, _ = _named(head.line, head.at)
    if "message" not in fields:
        return None
    return level(fields.get("level", "")) or severity, _component(fields.get("component", "")), fields["message"]


def _structured(head: _Head, severity: str) -> tuple[str, str, str] | None:
    """``host component process message-id structured-data message``; ``-`` stands for what is missing."""
    found = _STRUCTURED.match(head.line, head.at)
    if found is None:
        return None
    component = found.group(2)
    return severity, "" if component == "-" else _component(component), head.line[found.end() :].strip()


def _level_word(head: _Head) -> str | None:
    """The severity of a level word here, with its mark; without one the head stays."""
    start = head.at
    word = head.name()
    found = level(word) if word and len(word) > 1 and head.peek() in (" ", "\t", ":") else None
    if found is None:
        head.at = start
        return None
    head.mark()
    head.blanks()
    return found


def _threaded(head: _Head) -> tuple[str, str] | None:
    """``[thread] level``, ``[thread/level]`` or ``[thread] [level]``: severity and thread; otherwise the head stays."""
    start = head.at
    inner = head.bracket() if head.peek() in ("[", "(") else None
    if inner is None:
        head.at = start
        return None
    before, slash, last = inner.rpartition("/")
    if slash and level(last) is not None and len(last) > 1:
        head.mark()
        head.blanks()
        return level(last), before
    head.blanks()
    found = _level_in_bracket(head) or _level_word(head)
    if found is None:
        head.at = start
        return None
    return found, inner


def _aside(head: _Head) -> tuple[str, str]:
    """What stands between level and component, numbers, dashes and a thread in brackets: component and thread.

    Without a component behind it the head stays, unless a bracket holds a
    single name: that is the component.
    """
    start = head.at
    numbers = _PLAIN_NUMBERS.match(head.line, head.at)
    if numbers:
        head.at = numbers.end()
    inner = head.bracket() if head.peek() in ("[", "(") else None
    if inner is None and not numbers:
        return "", ""
    head.blanks()
    behind = head.at
    component = _named_component(head)
    if component:
        return component, inner or ""
    if inner and _NAME.fullmatch(_component(inner)):
        head.at = behind
        return _component(inner), ""
    head.at = start
    return "", ""


def _positional(line: str, year: int | None) -> tuple | None:
    """Grammars of lines whose fields stand in a fixed order.

    The opening is followed by one of: cells parted by ``|`` or ``;``; cells
    parted by tabs; cells parted by dashes; ``name=value`` fields; the fields
    of structured syslog; a thread in brackets with a level; a level in
    brackets, ``letter/`` or a level word, then host, component and mark, then
    perhaps a level in brackets.
    """
    head = _Head(_COLOUR.sub("", line) if "\x1b" in line else line)
    opened = _opening(head)
    if opened is None:
        return _lettered(head, year) or _access(head)
    written, severity = opened
    logged = as_written(written, year)
    if head.peek() in ("|", ";"):
        found = _in_cells(head, severity)
        return None if found is None else (logged, *found)
    head.blanks()
    found = _in_tabs(head) if "\t" in head.line[head.at :] else None
    found = found or _in_dashes(head) or _in_names(head, severity)
    if found is None and severity and head.line[0] == "<" and _VERSION.match(head.line, head.line.find(">") + 1):
        found = _structured(head, severity)
    if found is not None:
        return (logged, *found)
    thread = ""
    in_bracket = _level_in_bracket(head)
    threaded = None if in_bracket else _threaded(head)
    if threaded:
        severity, thread = threaded
    else:
        severity = in_bracket or severity
        start = head.at
        word = head.name()
        if word and head.peek() == "/" and level(word) is not None:
            severity = level(word)
            head.at += 1
        elif word and not severity and len(word) > 1 and level(word) is not None and head.peek() in (" ", "\t", ":"):
            severity = level(word)
            head.mark()
            head.blanks()
        else:
            head.at = start
    component = _named_component(head)
    if not component and severity:
        component, _ = _aside(head)
    if not component and thread and _NAME.fullmatch(_component(thread)):
        component = _component(thread)
    if not component:
        head.mark()
    head.blanks()
    bracketed = _level_in_bracket(head)
    return logged, severity or bracketed or "", component, head.rest()


_LETTER_FIRST = frozenset("DVIWEF")


def _lettered(head: _Head, year: int | None) -> tuple | None:
    """``Lmmdd time number file:line] message`` and ``mm-dd time number number L component: message``, L a level letter."""
    head.at = 0
    letter = head.line[:1] if head.line[:1] in _LETTER_FIRST else ""
    written = scan_head(head.line, len(letter))
    if written is None or written.notation[0] != "M" or bool(letter) == ("-" in written.notation):
        return None
    head.at = written.end
    head.blanks()
    numbers = _PLAIN_NUMBERS.match(head.line, head.at)
    if numbers:
        head.at = numbers.end()
    if letter:
        place = head.cell("]")
        if place is None or " " in place:
            return None
        return as_written(written, year), level(letter), _component(place), head.rest()
    letter = head.peek()
    head.at += 1
    if letter not in _LETTER_FIRST or not head.blanks():
        return None
    return as_written(written, year), level(letter), _named_component(head), head.rest()


_ACCESS = re.compile(r"\S+ \S+ \S+ \[")


def _access(head: _Head) -> tuple | None:
    """``host identity user [time] "request" status size``: neither level nor component, all behind the time is the message."""
    found = _ACCESS.match(head.line)
    written = scan_head(head.line, found.end()) if found else None
    if written is None or written.year is None or head.line[written.end : written.end + 1] != "]":
        return None
    head.at = written.end + 1
    return as_written(written, None), "", "", head.rest()


_LABEL = re.compile(r"([A-Za-z][A-Za-z _]{0,15}?)[ \t]*[:=][ \t]*")


def _label(line: str) -> tuple[str, str] | None:
    """Role and value of a line ``name: value``."""
    found = _LABEL.match(line)
    role = ROLES.get(found.group(1).lower()) if found else None
    return (role, line[found.end() :]) if role else None


def _block(lines: list[str], at: int, year: int | None) -> tuple[tuple, int] | None:
    """Grammar of an entry of several ``name: value`` lines that opens at ``at``.

    Lookahead: the first line must hold a time and the next one another
    named field; fields follow until a role repeats or another line comes.
    """
    first = _label(lines[at])
    if first is None or first[0] != "time" or scan(first[1].strip()) is None:
        return None
    fields, end = {"time": first[1]}, at + 1
    while end < len(lines):
        more = _label(lines[end]) if lines[end][:1].isalpha() else None
        if more is None or more[0] in fields:
            break
        fields[more[0]] = more[1]
        end += 1
    if end == at + 1:
        return None
    return _from_fields(fields, year), end


def entry(lines: list[str], at: int, year: int | None) -> tuple[tuple, int] | None:
    """Fields of the entry that opens at line ``at`` and the line after its head, else None."""
    line = lines[at]
    c = line[:1]
    if not c or c in " \t":
        return None
    if c == "{":
        fields = _object(line, year)
    elif c == "<" and line[1:2].isalpha():
        fields = _element(line, year)
    else:
        fields = _positional(line, year)
        if fields is None and c.isalpha():
            fields = _assigned(line, year)
            if fields is None:
                block = _block(lines, at, year)
                if block is not None:
                    return block
    return (fields, at + 1) if fields is not None else None


def entries(text: str, year: int | None) -> Iterator[tuple]:
    """(entry_no, n_lines, logged_at, severity, component, message) of a raw text."""
    lines = _LINE_END.split(text)
    current, n_lines, number, at = None, 0, 0, 0
    while at < len(lines):
        opened = entry(lines, at, year)
        if opened is None:
            if current is not None and lines[at].strip():
                n_lines += 1
            at += 1
            continue
        if current is not None:
            yield (number, n_lines, *current)
        current, end = opened
        number += 1
        n_lines = sum(1 for line in lines[at:end] if line.strip())
        at = end
    if current is not None:
        yield (number, n_lines, *current)


def is_raw() -> Column:
    """Whether content_json of a chunk is one single record without ts_start."""
    return (F.size("content_json") == 1) & F.col("content_json")[0]["ts_start"].isNull()


def raw_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks that hold raw log text: (id, source_path, text)."""
    return chunks.where(is_raw()).select("id", "source_path", F.col("content_json")[0]["text"].alias("text"))


def parse_entries(raw: DataFrame, message: Column | None = None) -> DataFrame:
    """One row per log entry of ``raw`` (id, source_path, text).

    A null, empty or layout-less text gives no row; lines before the first
    entry belong to none; repeated rows give repeated entries.  Further
    columns of the input, whatever their names, are not read.  ``message``
    may shorten the message; the column is called ``message``.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, path, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                if len(rows) >= ROWS_PER_BATCH:
                    yield record_batch(rows, ENTRY_SCHEMA)
                    rows = []
                if text.is_valid:
                    year = path_year(path.as_py())
                    rows.extend((key.as_py(), *row) for row in entries(text.as_py(), year))
            yield record_batch(rows, ENTRY_SCHEMA)

    found = raw.select("id", "source_path", "text").mapInArrow(
        parse, "id bigint, entry_no int, n_lines int, logged_at string, severity string, component string, message string"
    )
    return found if message is None else found.withColumn("message", message)


def found_entries(chunks: DataFrame) -> DataFrame:
    """Entries of all raw chunks with the first 12 characters of their messages."""
    return parse_entries(raw_chunks(chunks)).select(
        "id", "entry_no", "n_lines", "logged_at", "severity", "component", F.substring("message", 1, 12).alias("msg_head")
    )
