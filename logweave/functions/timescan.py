"""A deterministic character automaton that recognises written times.

Every notation is one line of ``NOTATIONS``.  The lines are compiled into a
single trie over character classes (digit, letter, or the character itself),
so that a text is read once, character by character, whatever the number of
notations; the deepest accepting state wins.
"""

from __future__ import annotations

import re
from datetime import date

# Month names and the way notations are written.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}

#: Y year, M month, D day, h hour, m minute, s second: digits of that field.
#: b month name, w weekday, z zone: letters.  ``?D`` is a day of one or two
#: digits, the first perhaps a blank; ``?h`` an hour of one or two digits;
#: ``*b`` a month name of three to nine letters; ``*z`` a zone of two to five
#: letters.  Other characters stand for themselves.
NOTATIONS = (
    "YYYY-MM-DD hh:mm:ss", "YYYY-MM-DDThh:mm:ss", "YYYY-MM-DD hh:mm", "YYYY-MM-DDThh:mm",
    "YYYY/MM/DD hh:mm:ss", "YYYY/MM/DD hh:mm", "YYYYMMDDThhmmss",
    "YY-MM-DD hh:mm:ss", "YY-MM-DDThh:mm:ss", "YY-MM-DD hh:mm", "YY-MM-DDThh:mm",
    "?D.?M.YYYY hh:mm:ss", "?D.?M.YYYY hh:mm", "?D.?M.YY hh:mm:ss", "?D.?M.YY hh:mm",
    "?D.?M.YY kl hh.mm", "?D.?M.YYYY kl hh.mm",
    "?D/?M/YYYY hh:mm:ss", "?D/?M/YYYY hh:mm", "?D/?M/YY hh:mm:ss", "?D/?M/YY hh:mm",
    "bbb ?D hh:mm:ss", "bbb ?D YYYY hh:mm:ss", "bbb ?D YYYY, hh:mm:ss",
    "www bbb ?D hh:mm:ss YYYY", "www bbb ?D hh:mm:ss *z YYYY", "www bbb ?D hh:mm:ss",
    "?D *b YYYY ?h:mm:ss", "?D *b YYYY, ?h:mm:ss", "?D *b YYYY ?h:mm", "?D *b YYYY, ?h:mm",
    "?D-*b-YYYY ?h:mm:ss", "?D-*b-YYYY ?h:mm", "www, ?D *b YYYY hh:mm:ss",
)

#: Times that only the heads of log lines hold: month and day without a year, and the time of access logs.
HEAD_NOTATIONS = ("MMDD hh:mm:ss", "MM-DD hh:mm:ss", "?D/bbb/YYYY:hh:mm:ss")

#: Full month names.
FULL_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "sept")

_DIGIT, _LETTER = "\0", "\1"
_FIELDS = "YMDhmsbwz"


def _expand(notation: str) -> list[str]:
    out = [""]
    i = 0
    while i < len(notation):
        c = notation[i]
        if c == "?":
            field = notation[i + 1]
            kinds = [field, field * 2] + ([" D"] if field == "D" else [])
            i += 2
        elif c == "*":
            field = notation[i + 1]
            low, high = (3, 9) if field == "b" else (2, 5)
            kinds = [field * n for n in range(low, high + 1)]
            i += 2
        else:
            kinds = [c]
            i += 1
        out = [a + b for a in out for b in kinds]
    return out


def _compile(notations: tuple[str, ...]) -> dict:
    root: dict = {}
    for rank, notation in enumerate(notations):
        for written in _expand(notation):
            node, spans, start = root, {}, 0
            for pos, c in enumerate(written):
                if c in _FIELDS:
                    field = c
                    if pos == 0 or written[pos - 1] != c:
                        start = pos
                    spans[field] = (start, pos + 1)
                    key = _LETTER if c in "bwz" else _DIGIT
                else:
                    key = c
                node = node.setdefault(key, {})
            node.setdefault("accept", (rank, tuple(spans.items()), notation))
    return root


_TRIE = _compile(NOTATIONS)
_HEAD_TRIE = _compile(HEAD_NOTATIONS)


class Written:
    """One recognised time, its fields as written."""

    __slots__ = ("end", "notation", "year", "month", "day", "hour", "minute", "second", "fraction", "zone", "number")

    def __init__(self) -> None:
        self.year = self.month = self.day = self.number = None
        self.hour = self.minute = self.second = 0
        self.fraction, self.zone, self.notation = "", "", ""


def scan_head(text: str, at: int = 0) -> Written | None:
    """``scan`` for ``HEAD_NOTATIONS`` alone."""
    return scan(text, at, _HEAD_TRIE)


def scan(text: str, at: int = 0, trie: dict = _TRIE) -> Written | None:
    """The longest written time that begins at ``at``, or None.

    The automaton stops at the first character without a transition.  After
    an accepting state the tail states read a fraction, AM or PM and a zone.
    Bare numbers of 10, 13, 16 or 19 digits are Unix times.  Impossible dates
    and times are not recognised.
    """
    node, i, n, best = trie, at, len(text), None
    while i < n:
        c = text[i]
        step = node.get(c)
        if step is None:
            if "0" <= c <= "9":
                step = node.get(_DIGIT)
            elif "A" <= c <= "Z" or "a" <= c <= "z":
                step = node.get(_LETTER)
            if step is None:
                break
        node = step
        i += 1
        if "accept" in node:
            best = (i, node["accept"])
    if best is None:
        return _number(text, at) if trie is _TRIE else None
    end, (_, spans, notation) = best
    if end < n and "0" <= text[end] <= "9" and notation[-1] in "YDhms":
        return None
    found = Written()
    found.notation = notation
    for field, (a, b) in spans:
        part = text[at + a : at + b]
        if field == "Y":
            found.year = int(part) + (2000 if len(part) == 2 else 0)
        elif field == "M":
            found.month = int(part)
        elif field == "D":
            found.day = int(part)
        elif field == "h":
            found.hour = int(part)
        elif field == "m":
            found.minute = int(part)
        elif field == "s":
            found.second = int(part)
        elif field == "b":
            name = part.lower()
            found.month = MONTHS.get(name[:3]) if len(name) == 3 or _full_month(name) else None
        elif field == "z":
            found.zone = part
    found.end = end
    _tail(text, found)
    if not possible(found.year or 2000, found.month, found.day) or found.hour > 23 or found.minute > 59 or found.second > 59:
        return None
    return found


def _full_month(name: str) -> bool:
    return name in FULL_MONTHS


def notation_pattern(notation: str) -> tuple[str, str]:
    """A notation as a regular expression with one group a field, and its fields in the order of the groups.

    Beside the letters of ``NOTATIONS``: ``~`` is a dot or a hyphen, a blank
    any white space, ``$`` the end and ``!`` a place without a digit behind.
    """
    months = "|".join(sorted({n[:3] for n in FULL_MONTHS} | set(FULL_MONTHS), key=lambda n: (-len(n), n)))
    signs = {"~": "[.-]", " ": r"\s+", "$": "$", "!": r"(?!\d)"}
    pattern, fields, at = "", "", 0
    while at < len(notation):
        if notation.startswith("*b", at):
            pattern, fields, at = f"{pattern}(?i:({months}))", fields + "b", at + 2
        elif notation[at] == "?":
            pattern, fields, at = pattern + r"(\d{1,2})", fields + notation[at + 1], at + 2
        elif notation[at] in _FIELDS:
            n = len(notation) - at - len(notation[at:].lstrip(notation[at]))
            pattern, fields, at = f"{pattern}(\\d{{{n}}})", fields + notation[at], at + n
        else:
            pattern, at = pattern + signs.get(notation[at], re.escape(notation[at])), at + 1
    return pattern, fields


def possible(year: int, month: int | None, day: int | None) -> bool:
    if month is None or day is None or not 1 <= month <= 12 or not 1 <= day <= 31:
        return False
    if day <= 28:
        return True
    try:
        date(year, month, day)
    except ValueError:
        return False
    return True


_TAIL = re.compile(r"(?:[.,](\d+))?(?: ?([AaPp])\.?[Mm]\b\.?)?(?:(Z)(?![A-Za-z0-9])| ?([+-]\d\d:?\d\d)(?!\d)| (?!INFO|WARN|ERR|DEBUG|TRACE|FATAL|CRIT|NOTE|ALERT|PANIC)([A-Z]{3,5})(?=\s|$))?")


def _tail(text: str, found: Written) -> None:
    tail = _TAIL.match(text, found.end)
    fraction, half, zulu, offset, zone = tail.groups()
    found.fraction = fraction or ""
    if half:
        if not 1 <= found.hour <= 12:
            found.month = None
            return
        found.hour = found.hour % 12 + (12 if half in "pP" else 0)
    if zulu or offset:
        found.zone = zulu or offset
    elif zone and not found.zone:
        found.zone = zone
    found.end = tail.end()


def _number(text: str, at: int) -> Written | None:
    end = at
    while end < len(text) and "0" <= text[end] <= "9":
        end += 1
    if end - at not in (10, 13, 16, 19):
        return None
    found = Written()
    found.end, found.notation = end, "unix"
    found.number = int(text[at:end])
    seconds = found.number // 10 ** (end - at - 10)
    days, rest = divmod(seconds, 86400)
    day = date.fromordinal(719163 + days)
    found.year, found.month, found.day = day.year, day.month, day.day
    found.hour, found.minute, found.second = rest // 3600, rest // 60 % 60, rest % 60
    return found


def as_written(found: Written, year: int | None) -> str | None:
    """``yyyy-MM-dd HH:mm:ss`` of a time; a missing year is ``year``."""
    y = found.year or year
    if y is None or not possible(y, found.month, found.day):
        return None
    return f"{y:04d}-{found.month:02d}-{found.day:02d} {found.hour:02d}:{found.minute:02d}:{found.second:02d}"
