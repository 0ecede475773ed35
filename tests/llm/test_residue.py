import sys
from pathlib import Path

import pytest

from logweave.llm import residue as r

sys.path.insert(0, str(Path(__file__).parent))

from residue_cases import CASES, NOT_CASES  # noqa: E402

SCHEMA = "doc_id bigint, text string, source string, host string, kind string"


@pytest.mark.parametrize("text", ["Unit: {{unit}}", "a ${DriverName} b", "<<ROOT_CAUSE>>", "see %TICKET% now", "[Insert depot here]", "[your unit]", "<enter unit>", "<fyll i unit>", "[bitte depot eintragen]", "{% unit %}", "<%= unit %>", "#{unit}", "{root_cause}", "__UNIT__", "@@RootCause@@", "$$unit$$", "[REPORT DATE]", "{{ user|upper }}", "a ${user.name} b", "Dear [Customer Name], we", "{{" + "u" * 200 + "}}", "[Insert " + "very " * 40 + "long name]", "{{#if urgent}}x{{/if}}", "[[name]]", "[Name of Engineer]"])
def test_unfilled(text):
    assert r.holds_field(text)


@pytest.mark.parametrize(
    "text",
    ["Template field [UNIT] was filled correctly by the importer on 4 tickets.", "The exporter replaces {{unit}} with the vehicle number, and that worked here.", "A=1\nB=${A}/x", 'test -d "${A}/x"', "<time> [brake.unit] x", "[INFO] x", "<item name='a'>", "__init__", "10 % of 20 %", '{"unit": 1}', "${{ matrix.os }}", "[Door Control] ok", "[see name](x)", "[1.2] x", "if [[ -d x ]]"],
)
def test_filled(text):
    assert not r.holds_field(text)


@pytest.mark.parametrize("line", ["Lorem ipsum dolor sit amet elit ut", "TODO: write depot", "Your unit description will appear here...", "Hier steht später der Text zu Unit", "unit: dummy text", "Blindtext für unit, bitte ersetzen", "Sample unit text - replace before release.", "unit - coming soon"])
def test_filler(line):
    assert r.is_filler(line)


@pytest.mark.parametrize("line", ["The word lorem in the old page title was a leftover and has been corrected.", "The dummy text on page 4 of the panel was removed with release 3.", "Sample labels go into tray unit; blank forms are kept at the desk."])
def test_no_filler(line):
    assert not r.is_filler(line)


@pytest.mark.parametrize("line", ["blah " * 50, "The fan froze. " + "text, " * 60, "lead text, second text and " * 30 + "for unit", "Unit: " + "x" * 400])
def test_long_filler(line):
    assert r.is_filler(line.strip())


def test_long_filler_found():
    assert r.examine(text := ("blah " * 50).strip(), [text])[0] == "filler"


# for every pattern of FILLERS, in their order, texts that it matches
MATCHED = [
    ["TODO: write depot"], ["Your unit text comes here"], ["unit content goes here"], ["this is a placeholder copy for unit"], ["Details on unit to be supplied"], ["Hier folgt noch die Beschreibung"], ["Här fylls texten in unit"], ["Insert your unit below"],
    ["dummytext", "sampletext", "fillertext", "placeholdertext", "BLINDTEXT", "unit: filler text"], ["Overwrite this paragraph with unit"], ["Exempel för unit", "Platzhalter unit", "platshållartext unit"], ["unit: folgt", "unit – kommt bald"],
    ["example unit entry", "PLACEHOLDER unİt text"], ["lead text, second text"], ["test row for unit", "Dummy record of unit"], ["bitte ausfüllen: unit", "Fill me in: unit"], ["texten om unit skrivs senare"], ["blahblahblah", "TEXT text text", "xyz;xyz;xyz"],
    ["XXXX", "Description: xxxxxxxx", "tba", "unit: TBD", "to be determined", "exempeltext"], ["Type unit here"], ["click here to add unit"],
    ["Add your text here", "Please enter the title", "put a short summary below"], ["write something about unit"], ["your content here", "Title goes here"], ["This text is only a placeholder", "the following is sample text"],
    ["Dummy entry, please delete", "sample paragraph. Replace this", "placeholder text"], ["Click to add text", "tap here to edit unit"], ["test test test", "qwerty, qwerty, qwerty", "asdf asdf asdf asdf"], ["Description to follow", "Inhalt folgt in Kürze"],
    ["Fülltext", "Platzhaltertext"], ["unit: to be completed", "TBD - to be determined"], ["lägg till text här"], ["Här ska det stå en text"], ["Bitte Text hier einfügen", "Beschreibung eintragen"], ["Lorem ipsum"],
]


def test_every_filler_is_looked_for():
    assert len(MATCHED) == len(r.FILLERS)
    for texts, (needles, pattern) in zip(MATCHED, r.FILLERS, strict=True):
        for text in texts:
            assert pattern.fullmatch(text) and any(n in r.folded(text) for n in needles), text
            whole = f"The fan froze.\n{text}"
            assert r.examine(whole, whole.split("\n"))[0] == "filler", text


def test_crosses_around_filler():
    assert r.is_filler("XXX INSERT TITLE HERE XXX") and not r.is_filler("XXX the fan froze XXX")


def decided(text):
    """The reason for a text that stands alone in its host."""
    tidy = r.clean(text)
    whole, kinds = r.examine(tidy, r.lines_of(tidy))
    return bool(whole or {"script", "error"} & set(kinds) and "content" not in kinds)


def test_other_words():
    """Recall and false cases on texts that are none of the tables': the first half of each list shaped the rules, the second did not."""
    groups = [CASES[k : k + 40] for k in (0, 40, 80)]
    known, unseen = [x for g in groups for x in g[:20]], [x for g in groups for x in g[20:]]
    assert sum(map(decided, known)) == 60 and sum(map(decided, unseen)) >= 54
    assert not any(map(decided, NOT_CASES[:20])) and sum(map(decided, NOT_CASES[20:])) <= 1


NOTICES = ["[403] Forbidden.", "HTTP/1.1 429 Too Many Requests: Connection refused by the page store", "Seite nicht gefunden", "Enable JavaScript. Go back!", "<html><head><title>wiper drive</title></head><body><h1>Error 404</h1><p>Error 404.<br>The page you were looking for doesn't exist or has moved.</p></body></html>", "Log of fan, frame\n\nnoscript: JavaScript needed", "Slå på JS för att visa sidan."]
TEXTS = ["The driver asked why error 403 appears when the fan froze.", "The panel showed 'page not found' for 17 minutes until the fan ran hot.", "JavaScript memory of the panel grew by 44 MB.", "ERROR recovered by fan", "2016-01-07 12:24:47 net.gateway GET /diag/cable/458 -> 403 Forbidden in 589 ms", "The fan stopped answering.\nError 404"]


def test_table(spark):
    rows = [(i, t, "h") for i, t in enumerate(NOTICES)] + [(100 + i, t, "h") for i, t in enumerate(TEXTS)]
    rows += [(200, None, "h"), (201, "", None), (202, "  \n", "h"), (203, "Unit: {{unit}}", None), (204, "x " * 200_000, "h"), (0, NOTICES[0], "h"), (None, "TODO: write unit", "h")]
    rows += [(300 + i, f"Imprint of the long operator association of the north\nThe fan number {i} of the train was seen on track.", "frame") for i in range(5)]
    rows += [(400, "Imprint of the long operator association of the north\n\nForbidden.", "frame"), (401, "Imprint of the long operator association of the north\n\nForbidden.", "other")]
    frame = spark.createDataFrame([(*x, "clash", "clash") for x in rows], SCHEMA)
    got = {x.doc_id for x in r.found_residue(frame).collect()}
    assert got == set(range(len(NOTICES))) | {203, None, 400}
    assert {x.doc_id for x in r.remaining_corpus(frame).collect()} >= {100, 200, 204, 300, 401}
    assert r.found_residue(frame.limit(0)).count() == 0


def test_frame_of_a_hot_host(spark):
    """A frame counts as recurrent in a host of any size."""
    frame = "Imprint of the long operator association of the north"
    rows = [(i, f"{frame}\nThe fan number {i} of the train was seen on track." if i < 4 else f"The door {'x' * (i % 40)} of unit {i} was repaired.", "hot") for i in range(600)]
    rows.append((600, f"{frame}\n\nForbidden.", "hot"))
    assert [x.doc_id for x in r.found_residue(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()] == [600]
