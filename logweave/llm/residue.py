"""Template residue and error-page text.

Lines are normalised and counted by host (the ``source`` of a document); a
line that recurs in a host is boilerplate and is subtracted.  What remains of
a document decides: an unfilled field or filler anywhere excludes it, an
error or script notice excludes it if nothing else remains.  Evidence itself
is never boilerplate, however often it recurs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.batches import ROWS_PER_BATCH, record_batch
from logweave.functions.joins import small
from logweave.session import ensure_checkpoint_dir

#: So many ids of excluded documents are broadcast (16 MB), no more.
MOST_BROADCAST = 1_000_000

#: A line is boilerplate of a host where it stands in so many different texts, however many the host has.
LEAST_TEXTS = 3

# Names of scripts and words of notices, in English, German and Swedish.
SCRIPT_WORDS = frozenset("javascript ecmascript js script scripts scripting noscript jscript".split())
REQUIRE_WORDS = frozenset(
    """enable enabled disabled require requires required activate activated allow need needed needs must on off without support supports rely relies
    aktivieren aktiviert benötigt erforderlich einschalten deaktiviert krävs slå aktivera behöver kräver avstängt noscript turned switched switch""".split()
)
ERROR_WORDS = frozenset(
    """error errors fehler fel forbidden unauthorized denied unavailable timeout gone expired refused failed broken unable limited maintenance wrong unfortunately
    removed moved permission login reached verweigert gefunden aufgetreten existiert hittas hittades behörighet saknar nekad serverfel checking exist exists load
    gateway requests request http status nothing found missing overloaded conflict exception oväntat upstream""".split()
)
NOTICE_WORDS = (
    SCRIPT_WORDS
    | REQUIRE_WORDS
    | ERROR_WORDS
    | frozenset(
        """a an the this that these your you we our us i it its is are was were be been has have had do does did don't doesn't didn't can can't cannot could couldn't may
    will won't would to of in on at by for from or and but so if then not no never longer please sorry oops kindly again later soon back go return try retry refresh reload
    wait sign log continue proceed contact administrator admin support webmaster check address link url page pages site website web server service app application
    viewer view chart report reports record records file files document dashboard screen browser settings options client side client-side active java ecma script
    enabled show shown display displayed see open run work works start home turn turned switch switched before after while moment minutes seconds minute second in
    few problem problems persists quote code bad internal method allowed large too many temporarily handle looking something someone some features content here
    detected connection database store render session time-out timed time out rate requested require access required down up version visit visitor human verify cookies
    loading happens nothing store data entity media type acceptable payment proxy precondition unsupported unprocessable not implemented
    der die das ein eine dieser diese dieses sie ihr ihre ihren ist nicht kein keine bitte versuchen es später erneut um den dem zu anzuzeigen anzeigen seite bericht zugriff
    interner angeforderte angeforderten datei konnte wurde werden nochmals zurück gehen neu laden adresse prüfen und oder für mit im browser
    du denna detta sida sidan vy för att visa inte kunde på och igen om en stund försök adressen kontrollera ladda behörig rapport gå tillbaka senare ett internt har inträffat
    filen finns logga in session utgått tjänsten är otillgänglig begärda
    order used properly correctly its which that who how those as were would should might very just now only also more most other all each both own same than because during into through about out off over under
    process automatic automatically accessing access encountered complete completed completing isn't aren't wasn't weren't hasn't haven't shouldn't come comes got get gets make sure need needs allow allows contain contains
    nginx apache tomcat iis cloudflare lighttpd jetty httpd misconfiguration resource resources module portal form gallery dashboard map player widget
    viewing site's log logs use using keep signed desk rights reserved all persist quoted reference ref id there map existed ever here nothing yet stopped responding response responded unexpected exception occurred upstream answer time available unavailable any oväntat inträffade while went""".split()
    )
)

# How unfilled fields are marked: what opens and closes them, and what stands between.
_NAME = r"[^\W\d_][\w .'-]*"
#: What template languages hold between their marks: a name, then perhaps filters, arguments or a condition.
_HELD = r"[^{}%<>\n]*[^\W\d_][^{}%<>\n]*"
_ASKS = r"(?:insert|enter|add|fill in|type|your|describe|specify|choose|select|bitte|fyll i|ange|skriv|hier)"
_ASKS_LAST = r"(?:here|eintragen|einfügen|einsetzen|ergänzen|angeben|ausfüllen|här)"
#: Each pattern with the characters without which it cannot occur.
MARKS = tuple(
    (needle, re.compile(p))
    for needle, p in (
        ("{{", rf"(?<!\$)\{{\{{(?![^{{}}\n]*\":){_HELD}\}}\}}"), ("{%", rf"\{{%{_HELD}%\}}"), ("<%", rf"<%{_HELD}%>"), ("#{", rf"#\{{\s*{_NAME}\s*\}}"), ("<<", rf"<<\s*{_NAME}\s*>>"), ("[[", r"\[\[\s*[^\W\d_]\w+\s*\]\]"),
        ("@@", r"(?<!@)@@[A-Za-z]\w{2,}@@"), ("$$", r"(?<!\$)\$\$[A-Za-z]\w{2,}\$\$"), ("__", r"(?<!\w)__[A-Z][A-Z_]+[A-Z]__(?!\w)"), ("%", r"(?<![\w%])%[A-Za-z][A-Za-z_]{2,}%(?!\w)"),
        ("[", rf"(?i)\[\s*{_ASKS}\s[A-Za-zÀ-ÿ_ ]{{2,}}\]"), ("<", rf"(?i)<\s*{_ASKS}\s[A-Za-zÀ-ÿ_ ]{{2,}}>"), ("[", rf"(?i)\[[A-Za-zÀ-ÿ_ ]+\s{_ASKS_LAST}\s*\]"),
    )
)
_UPPER_MARK = re.compile(r"(?<![\w\]])\[([A-Z]{3,}(?:[ _][A-Z]{3,}){0,3})\](?![\w(\[])")
#: What letters and forms ask for; a bracket that ends with one of them, or begins with one before ``of``, is a field.
_ASKED = r"(?:name|surname|nachname|vorname|namn|efternamn|förnamn|date|datum|address|adresse|adress|street|city|ort|stadt|code|plz|phone|telefon|e-?mail|company|firma|företag|title|titel|position|signature|unterschrift|recipient|empfänger|sender|client|customer|kunde|kund|author|amount|betrag|belopp|number|nummer)"
_LETTER_MARK = re.compile(rf"(?<![\w\]])\[((?i:(?:[^\W\d_]+[ -]){{0,3}}{_ASKED}|{_ASKED} of(?: [^\W\d_]+){{1,4}}))\](?![\w(\[])")
_BRACE_MARK = re.compile(r"(?<![\w$#{\"'%])\{([A-Za-z][a-z]+(?:_[a-z]+)*|[A-Z]+(?:_[A-Z]+)*)\}(?![}\w\"'])")
_DOLLAR_MARK = re.compile(r"(?<![\"'=/\w:])\$\{([A-Za-z]\w{2,}|[A-Za-z]\w*(?:\.[A-Za-z]\w*)+)\}(?![\"'/\w])")
_BRACKETED = re.compile(r"\[([^\[\]\n]*)\]")
_ASKABLE = re.compile(r"[^\d.:/=,;\"'(){}<>]{3,}$")
_LEVEL = re.compile(r"(?i)(?:info|warn|warning|err|error|debug|trace|notice|fatal|critical|crit|emergency|alert|time)\s*")
#: Sentences that speak about a field instead of holding an unfilled one.
_SPEAKS_OF = re.compile(r"(?i)(?=.*\b(?:template|exporter|importer|placeholder|platshållare|platzhalter|vorlage|mall(?:en)?)\b).*(?:\bfill|replac|resolv|\bcorrect|\bwork|erset|fyll|gefüllt|\bfix|\bleft\b|instead)")

# Filler text.
LATIN = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud
    exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur
    excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum""".split()
)
LATIN_SURE = frozenset(w for w in LATIN if len(w) > 4) - {"labore"} | {"amet", "elit"}
_SUBJECT = r"[A-Za-zÀ-ÿ_ ]{2,}"
#: What filler stands for, and what it calls itself.
_TEXT = r"(?:text|content|description|title|subtitle|headline|heading|summary|message|paragraph|copy|caption|introduction|conclusion|abstract|details)"
_SELF = r"(?:dummy|sample|placeholder|filler|example|blind)"
_MASH = r"(?:asdf|qwert[yz]|test|text|bla|blah|foo|abc|xyz|dummy|lorem)"
#: Each pattern with characters (lower case) of which it holds one at least wherever it matches.
FILLERS = tuple(
    (needles, re.compile(p))
    for needles, p in (
        (("todo",), rf"(?i)todo\b:?\s*(?:write|add|fill|describe|insert)\s+{_SUBJECT}"), ((" here",), rf"(?i)your {_SUBJECT} (?:description|text|content|summary) (?:will appear|goes|comes) here"), ((" goes here",), rf"(?i){_SUBJECT} (?:text|description|content) goes here"),
        (("this is ",), rf"(?i)this is (?:a )?placeholder (?:copy|text|content)(?: for {_SUBJECT})?"), ((" to be ",), rf"(?i)(?:description|text|summary|details?) (?:of|for|on) {_SUBJECT} to be (?:added|written|completed|filled in|supplied)"),
        (("hier ",), rf"(?i)hier (?:steht|kommt|folgt) (?:später |noch )?(?:der |ein |die )?(?:text|beschreibung)(?: (?:zu|zur|zum|für) {_SUBJECT})?"), (("här ",), rf"(?i)här (?:kommer|står|skrivs|fylls)(?: (?:senare|snart))? (?:en )?(?:text|texten|beskrivning)(?:en)?(?: (?:om|till|för|in) {_SUBJECT})?"),
        (("insert ",), rf"(?i)insert (?:your )?{_SUBJECT} (?:text )?(?:in this box|here|below)"), (("text",), rf"(?i)(?:{_SUBJECT}:\s*)?(?:dummy|sample|placeholder|filler|blind) ?text"), ((" this text", " this paragraph"), rf"(?i)(?:replace|overwrite) this (?:text|paragraph)(?: with {_SUBJECT})?"),
        (("text", "platzhalter", "exempel"), rf"(?i)(?:blindtext|platzhaltertext|platzhalter|exempeltext|platshållartext|exempel)(?: (?:für|för|zu|om|till))? {_SUBJECT}(?:, (?:bitte ersetzen|byt ut|ersätt))?"), (("coming soon", "kommer snart", "folgt", "kommt bald"), rf"(?i){_SUBJECT}\s*[-–:]\s*(?:coming soon|kommer snart|folgt|kommt bald)"),
        (("sample ", "example ", "dummy ", "placeholder "), rf"(?i)(?:sample|example|dummy|placeholder) {_SUBJECT} (?:text|entry|content)(?:\s*[-–,:]\s*(?:replace|remove|change|overwrite)(?: {_SUBJECT})?)?"), (("text",), rf"(?i)(?:(?:lead|first|second|third|fourth|next|last|more) text,?\s*(?:and )?){{2,}}(?:for {_SUBJECT})?"),
        (("test ", "dummy ", "sample "), rf"(?i)(?:test|dummy|sample) (?:entry|record|row|text) (?:for|of) {_SUBJECT}(?:, (?:ignore|please ignore|do not use))?"), (("fill ", "fyll i", "ausfüllen"), rf"(?i)(?:fill (?:me |this )?in|fyll i|ausfüllen|bitte ausfüllen)\s*:\s*{_SUBJECT}"), (("text",), rf"(?i)texte?n? (?:om|för|till|zu) {_SUBJECT} (?:kommer|skrivs|står|folgt|kommt)(?: (?:här|hier|snart|senare|später))+"),
        (("text", "bla", "xyz"), r"(?i)(?:(?:text|blah|bla|xyz)[,.;\s]*){3,}"), (("tbd", "tba", "to be ", "coming soon", "xxx", "text"), rf"(?i)(?:{_SUBJECT}:\s*)?(?:tbd|tba|to be (?:added|written|completed|filled in|determined)|coming soon|xxx+|blindtext|platshållartext|exempeltext)"), ((" here",), rf"(?i)type (?:your )?{_SUBJECT} here"), (("click here to ",), rf"(?i)click here to (?:add|edit|enter) {_SUBJECT}"),
        (("add ", "insert ", "enter ", "type ", "write ", "put ", "place ", "paste "), rf"(?i)(?:please )?(?:add|insert|enter|type|write|put|place|paste) (?:[a-zà-ÿ]+ ){{0,3}}{_TEXT}(?: (?:here|below|in this box|about {_SUBJECT}))*"), (("write ",), rf"(?i)write something (?:about|on) {_SUBJECT}"),
        ((" here",), rf"(?i)(?:(?:your|the|some|more) )?(?:[a-zà-ÿ]+ )?{_TEXT} (?:(?:goes|comes|belongs|will appear|should go) )?here"), (("placeholder", "sample", "dummy", "filler", "example"), rf"(?i)(?:this|the following|that)(?: {_TEXT})? is (?:only |just |merely )?(?:an? |some )?{_SELF}(?: {_TEXT}| entry)?(?: {_SUBJECT})?"),
        (("placeholder", "sample", "dummy", "filler", "example"), rf"(?i){_SELF} (?:{_TEXT}|entry|record|row)(?:\s*[-–,:.]\s*(?:(?:please|to be|must be|will be) )?(?:replace|delete|remove|ignore|overwrite|change)d?(?: {_SUBJECT})?)?"), (("click ", "tap "), rf"(?i)(?:click|tap|double-click)(?: here)? to (?:add|edit|enter|insert) (?:{_TEXT}|{_SUBJECT})"),
        (("asdf", "qwert", "test", "text", "bla", "foo", "abc", "xyz", "dummy", "lorem"), rf"(?i)({_MASH})(?:[\s,.;/-]+\1){{2,}}"), ((" to follow", " soon", "folgt", "kommer"), rf"(?i)(?:{_TEXT}|inhalt|beschreibung|innehåll|beskrivning)(?: is| will be| are)? (?:to follow|(?:coming|available) soon|folgt(?: in kürze| später| noch)?|kommer(?: snart| senare)?)"),
        (("platzhaltertext", "blindtext", "platshållartext", "exempeltext", "fülltext", "utfyllnadstext"), r"(?i)(?:platzhaltertext|blindtext|platshållartext|exempeltext|fülltext|utfyllnadstext)"), (("tbd", "tba", "to be "), rf"(?i)(?:{_SUBJECT}[:\s–-]+)?(?:tbd|tba)?[\s–-]*to be (?:added|written|completed|filled in|determined|announced|supplied)(?: {_SUBJECT})?"),
        (("lägg ", "skriv", "infoga", "fyll i"), r"(?i)(?:lägg till|skriv|infoga|fyll i) (?:din |en |ett )?(?:text|texten|beskrivning|rubrik|innehåll)(?: här)?"), (("här ",), r"(?i)här (?:ska|skall) (?:det )?(?:stå|komma) (?:en )?(?:text|beskrivning)"), (("text", "beschreibung", "inhalt", "titel"), r"(?i)(?:hier )?(?:bitte )?(?:text|beschreibung|inhalt|titel) (?:hier )?(?:einfügen|eingeben|eintragen|ergänzen)"),
        (("lorem ipsum",), r"(?i)lorem ipsum(?: dolor)?"),
    )
)
FILLER_NEEDLES = tuple(dict.fromkeys(n for needles, _ in FILLERS for n in needles))
_BY_NEEDLE = {n: tuple(i for i, (needles, _) in enumerate(FILLERS) if n in needles) for n in FILLER_NEEDLES}

_TAG = re.compile(r"(?i)</?(?:html|head|title|body|h[1-6]|p|br|div|span|a|ul|li|b|i|center|hr|noscript)(?:\s[^<>]*)?/?>")
_SPECIAL = re.compile(r"<\|[a-z_]+\|>|</?s>|\x1b\[[0-9;]*m|={6,}")
_INVISIBLE = re.compile("[\u200b-\u200f\u202a-\u202e\u2060\ufeff\x00-\x08\x0b-\x1f\x7f]")
_LINES = re.compile(r"\r\n|[\r\n\u2028\u2029\x85]")
_PIECE = re.compile(r"(?<=[.!?])\s+|\.{3}\s*|:\s+|\s[-–—|>/]\s|\s{2,}|\t|[()\[\]]")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_STATUS = re.compile(r"(?i)(?:http(?:/\d(?:\.\d)?)?|status|error|code|fehler|fel|err|nr|no)?[\s:.#-]*(?:code)?[\s:.#-]*\b[45]\d\d\b[\s.!:]*$")
_NUMBERS = re.compile(r"\d+")
_MIXED = re.compile(r"\b(?=\w*\d)\w+\b")
#: Words that are no evidence on their own.
_ALONE = frozenset("error errors fehler fel http status gateway load request requests exist exists unfortunately unable login nothing failed checking expired removed moved limited existiert saknar".split())
#: Words that are evidence only beside a qualifier, and words that are plain evidence.
_WEAK = frozenset("error errors fehler fel http status gateway load request requests exist exists nothing".split())
_QUALIFIERS = frozenset("bad too many internal interner internt unexpected timeout time-out out here not".split())
_PLAIN = frozenset("denied forbidden unauthorized unavailable refused unable permission verweigert existiert hittas hittades behörighet exception login".split())
#: Something of the web that is not there: one word of each list.
_NEGATIONS = frozenset("not no cannot can't couldn't isn't wasn't aren't doesn't longer nicht kein keine keinen inte ingen never".split())
_REACHED = frozenset("available found exist exists reach reached reachable displayed loaded open opened authorized allowed verfügbar gefunden erreichbar gefunden berechtigt tillgänglig tillgängligt hittas hittades hitta behörig".split())
_OF_THE_WEB = frozenset("page pages site website server url address link content document documents resource application app service portal view viewer seite seiten inhalt dienst anwendung adresse sida sidan sidor webbplats webbplatsen innehåll tjänsten tjänst adressen".split())
#: Who says something reports on it.
_SAYING = frozenset("said says asked complained reported told wrote stated mentioned noticed informed sagte meldete berichtete sade berättade frågade anmälde".split())
#: Only lines with one of these words, or a number like a status, can be evidence.
_EVIDENCE_KEYS = SCRIPT_WORDS | ERROR_WORDS | _REACHED
_LETTERS = re.compile(r"[^\W\d_]+")
_STATUS_NUMBER = re.compile(r"(?<!\d)[45]\d\d(?!\d)")
_CODE_LIKE = re.compile(r"[{};=<>\\]|[A-Za-z]\.[A-Za-z]|\d\d:\d\d")
_CODE_LINE = re.compile(r"[{};=\\]|%[sd]|\w_\w")
_FOOT = re.compile(r"(?i)[a-z]+/\d+(?:\.\d+)*|(?:request id|ref|reference|id|trace id)\b[.: ]*[0-9a-f-]{4,}|page \d+ of \d+")


_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def clean(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "<" in text or "\x1b" in text or "======" in text:
        text = _SPECIAL.sub("", text)
    return _INVISIBLE.sub("", text)


def lines_of(text: str) -> list[str]:
    """Lines of a text without tags, as they are counted and judged."""
    if "<" in text:
        text = _TAG.sub("\n", text)
    return [x for x in map(str.strip, _LINES.split(text)) if x]


def normal(line: str) -> str:
    """What makes lines alike: no case, no numbers, single blanks."""
    return " ".join(_NUMBERS.sub("0", line.lower()).split())


def holds_field(text: str) -> bool:
    """Whether a text holds an unfilled field."""
    found = []
    # most brackets of logs and code hold digits, levels or dotted names: only others are looked at
    bracketed = "[" in text and any(_ASKABLE.match(x) and not _LEVEL.fullmatch(x) for x in set(_BRACKETED.findall(text)))
    for needle, pattern in MARKS:
        if needle in text and (needle != "[" or bracketed):
            found += pattern.finditer(text)
    if bracketed:
        found += [m for p in (_UPPER_MARK, _LETTER_MARK) for m in p.finditer(text) if not _LEVEL.fullmatch(m.group(1))]
    if "{" in text:  # a variable that the text itself assigns is code
        found += [m for p in (_BRACE_MARK, _DOLLAR_MARK) for m in p.finditer(text) if not re.search(rf"(?m)^\s*(?:export\s+)?{re.escape(m.group(1))}=", text)]
    for mark in found:
        start = max(text.rfind("\n", 0, mark.start()), text.rfind(". ", 0, mark.start())) + 1
        ends = [e for e in (text.find("\n", mark.end()), text.find(". ", mark.end())) if e >= 0]
        if not _SPEAKS_OF.search(text[start : min(ends, default=len(text))]):
            return True
    return False


def folded(text: str) -> str:
    """Lower case as the patterns know it: each letter i is one."""
    return text.lower() if text.isascii() else text.replace("İ", "i").replace("ı", "i").lower()


_FRAME = re.compile(r"(?i)^(?:x{3,}[\s:-]+)+(?=\S*[^\Wx_])|(?:[\s:-]+x{3,})+$")


def _bare(part: str) -> list[str]:
    """A sentence without marks around it, and also without crosses around it."""
    part = part.strip(" .!?…:;\"'»«*#-")
    return [part, _FRAME.sub("", part).strip(" .!?…:;\"'»«*#-[]")] if part[:1] in "xX" or part[-1:] in "xX" else [part]


def is_filler(line: str, needles: tuple[str, ...] = FILLER_NEEDLES, latin: bool = True) -> bool:
    """Whether a line is filler: filler Latin, or a sentence that only stands for one to come.

    ``needles`` are those that may occur in the line, ``latin`` says whether
    filler Latin may.
    """
    if latin:
        words = [w.lower() for w in _WORD.findall(line)]
        known = [w for w in words if w in LATIN]
        sure = {w for w in known if w in LATIN_SURE}
        if len(known) >= 4 and len(sure) >= 2 and 2 * len(known) >= len(words) or len(known) >= 8 and len(sure) >= 4:
            return True
    low = folded(line)
    possible = sorted({i for n in needles if n in low for i in _BY_NEEDLE[n]})
    if not possible:
        return False
    parts = [p for x in dict.fromkeys((line, *_SENTENCE.split(line))) for p in _bare(x)]
    return any(FILLERS[i][1].fullmatch(part) for part in parts for i in possible)


def judge(line: str) -> str:
    """``script`` or ``error`` evidence, ``advice``, a short ``fragment``, or ``content``."""
    if _CODE_LINE.search(line):
        return "content"
    kinds = set()
    for piece in _PIECE.split(line):
        piece = (piece or "").strip(" .!?…:;,\"'*#-")
        if piece:
            kinds.add(_judge_piece(piece, line))
    for kind in ("content", "script", "error", "advice"):
        if kind in kinds:
            return kind
    return "fragment"


def _judge_piece(piece: str, line: str) -> str:
    if _FOOT.fullmatch(piece):
        return "fragment"
    if _STATUS.match(piece):
        return "error"
    rest = re.sub(r"(?i)^(?:http(?:/\d(?:\.\d)?)?|status|error|code|fehler|fel|err)?[\s:.#-]*\b[45]\d\d\b", "", piece)
    numbered = rest != piece
    rest = _MIXED.sub(" ", rest)
    if _CODE_LIKE.search(piece):
        return "content"
    words = [w.lower().replace("’", "'") for w in _WORD.findall(rest)]
    known = [w for w in words if w in NOTICE_WORDS]
    strange = len(words) - len(known)
    held = set(words)
    joined = rest.lower()
    script = held & SCRIPT_WORDS or "java script" in joined or "client-side script" in joined or "active script" in joined
    errors = held & ERROR_WORDS
    absent = held & _NEGATIONS and held & _REACHED and held & _OF_THE_WEB
    if held & _SAYING:
        return "content"
    if words and strange == 0:
        if script and held & REQUIRE_WORDS:
            return "script"
        if numbered or absent or errors and (len(words) > 1 or errors - _ALONE) and (errors - _WEAK or held & _QUALIFIERS):
            return "error"
        if len(words) > 1:
            return "advice"
    elif len(known) >= 3:
        # nouns may be any, one in a short piece, more in a long one or where the reader is spoken to
        spoken_to = held & {"please", "your", "you", "bitte", "ihr", "ihrem", "ihren", "sie", "din", "du", "vänligen"}
        few = strange <= 1 + len(words) // 8
        if script and held & REQUIRE_WORDS and strange <= (2 + len(words) // 6 if spoken_to else 1):
            return "script"
        if few and (numbered or errors & _PLAIN or absent or errors and ("sorry" in held or errors - _WEAK and len(known) >= 6)):
            return "error"
    ended = line.rstrip().endswith((".", "!", "?", "。", ";"))
    return "fragment" if len(words) <= 6 and len(piece) <= 60 and not (ended and len(words) > 3) else "content"


#: All ASCII characters that are no letters as blanks.
_TO_BLANKS = {c: " " for c in range(128) if not chr(c).isalpha()}


def _letter_runs(low: str) -> set[str]:
    return set(low.translate(_TO_BLANKS).split()) if low.isascii() else set(_LETTERS.findall(low))


def examine(tidy: str, lines: list[str]) -> tuple[str, list[str]]:
    """``field``, ``filler`` or nothing for a whole text, and the kinds of its lines."""
    kinds = ["line"] * len(lines)
    if holds_field(tidy):
        return "field", kinds
    low = folded(tidy)
    held = _letter_runs(low)
    evidence = tuple(held & _EVIDENCE_KEYS)
    needles = tuple([n for n in FILLER_NEEDLES if n in low])
    latin = tuple(held & LATIN_SURE)
    numbered = _STATUS_NUMBER.search(tidy) is not None
    if not (needles or latin or evidence or numbered):
        return "", kinds
    lows = [folded(line) for line in lines]
    if needles or latin:
        for line, small in zip(lines, lows, strict=True):
            in_latin = _holds(small, latin)
            if (in_latin or _holds(small, needles)) and is_filler(line, needles, in_latin):
                return "filler", kinds
    if evidence or numbered:
        for line, small in zip(lines, lows, strict=True):
            if (_holds(small, evidence) or numbered and _STATUS_NUMBER.search(line)) and judge(line) in ("script", "error"):
                return "", [judge(x) for x in lines]
    return "", kinds


def _holds(low: str, words: tuple[str, ...]) -> bool:
    for w in words:  # noqa: SIM110
        if w in low:
            return True
    return False


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("host", pa.int64()), ("text_hash", pa.int64()), ("line_hash", pa.int64()), ("kind", pa.string())])


def _hash(value: str) -> int:
    return xxhash.xxh64_intdigest(value) - (1 << 63)


def judged_lines(documents: DataFrame) -> DataFrame:
    """Lines of all documents: doc_id, host, text_hash, line_hash, kind.

    kind is ``field`` or ``filler``, what ``judge`` says for lines of texts
    that hold error or script evidence, else ``line``: such lines are only
    counted.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, host, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not text or not text.strip():
                    continue
                if len(rows) >= ROWS_PER_BATCH:
                    yield record_batch(rows, _SCHEMA)
                    rows = []
                host = _hash(host or "")
                tidy = clean(text)
                lines = lines_of(tidy)
                whole, kinds = examine(tidy, lines)
                text_hash = _hash(tidy)
                seen = set()
                for line, kind in zip(lines, kinds, strict=True):
                    line_hash = _hash(f"{host}\n{normal(line)}")
                    if line_hash in seen and kind == "line":
                        continue
                    seen.add(line_hash)
                    rows.append((key, host, text_hash, line_hash, kind))
                if whole:
                    rows.append((key, host, text_hash, None, whole))
            yield record_batch(rows, _SCHEMA)

    slim = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")
    return slim.mapInArrow(read, "doc_id bigint, host bigint, text_hash bigint, line_hash bigint, kind string")


def excluded_documents(documents: DataFrame) -> DataFrame:
    """(doc_id, reason) of documents without real content; reason: field, filler or notice.

    A text of null, nothing or blanks holds no residue and is no case; copies
    of a text count once for the boilerplate but are judged each; a null
    source is a host of its own.  Lines are counted over all documents, by
    partial aggregation on (host, line).
    """
    ensure_checkpoint_dir(documents.sparkSession)
    lines = judged_lines(documents).checkpoint()  # read once, used three times
    certain = lines.where("kind in ('field', 'filler')").select("doc_id", F.col("kind").alias("reason"))
    counted = lines.where("line_hash is not null").select("host", "text_hash", "line_hash").distinct()
    by_line = counted.groupBy("host", "line_hash").agg(F.count("*").alias("n_texts")).where(F.col("n_texts") >= LEAST_TEXTS)
    recurrent = by_line.select("line_hash", F.lit(True).alias("boilerplate"))
    candidates = lines.where("kind not in ('field', 'filler', 'line')").select("doc_id", "line_hash", "kind")
    residual = candidates.join(recurrent, "line_hash", "left")
    notice = (
        residual.groupBy("doc_id")
        .agg(
            F.max(F.col("kind").isin("error", "script")).alias("evidence"),
            F.max((F.col("kind") == "content") & F.col("boilerplate").isNull()).alias("content"),
        )
        .where("evidence and not content")
        .select("doc_id", F.lit("notice").alias("reason"))
    )
    return certain.unionByName(notice)


def found_residue(documents: DataFrame) -> DataFrame:
    return excluded_documents(documents).select("doc_id").distinct()


def remaining_corpus(documents: DataFrame) -> DataFrame:
    """The documents that are not excluded, all their columns.

    Where the excluded ids are few enough to be broadcast the texts stay where
    they are; beyond that both sides meet by id.
    """
    found = found_residue(documents).where("doc_id is not null").checkpoint()
    return documents.join(small(found, MOST_BROADCAST), "doc_id", "left_anti")
