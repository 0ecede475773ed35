import random

from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.llm.splitting import cut_run, cuts, found_large, rejoined, split_chunks

SCHEMA = "id bigint, source_path string, chunk_id int, content_text string, text string, cut string"


def pieces(text, size, least=20, overlap=10):
    out, start = [], 0
    for end, kind in cuts(text, size, least, overlap):
        out.append((text[max(0, start - overlap) : end] if start else text[:end], kind))
        start = end
    return out


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n\r\té😀", max_size=600))
def test_round_trip(text):
    found = pieces(text, 60)
    whole = found[0][0]
    for piece, _ in found[1:]:
        assert piece[:10] == whole[-10:]
        whole += piece[10:]
    assert whole == text
    assert all(len(p) <= 60 for p, _ in found)
    assert not any(a.endswith("\r") and whole[whole.index(a) + len(a) : whole.index(a) + len(a) + 1] == "\n" and kind != "hard" for (a, kind) in found if whole.count(a) == 1)


def test_hard_only_without_blanks():
    text = " ".join("w" * 30 for _ in range(400))
    assert {k for _, k in cuts(text)} <= {"blank", "line", "sentence", "end"}
    assert "hard" in {k for _, k in cuts("x" * 9000)}


def test_edit_alters_neighbours_only():
    rng = random.Random(5)
    text = "\n".join(" ".join(rng.choice(["brake", "door", "fan", "alarm", str(rng.randrange(999))]) for _ in range(12)) for _ in range(900))
    edited = text[:20_000] + "an inserted sentence" + text[20_000:]
    before = {text[a:b] for (a, _), (b, _) in zip(cuts(text), cuts(text)[1:], strict=False)}
    after = {edited[a:b] for (a, _), (b, _) in zip(cuts(edited), cuts(edited)[1:], strict=False)}
    assert len(after - before) <= 4


def test_edit_alters_neighbours_only_in_unbroken_text():
    rng = random.Random(6)
    for _ in range(60):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(40_000))
        at = rng.randrange(2_000, 6_000)
        edited = text[:at] + "xyz" + text[at:]
        before = {text[a:b] for (a, _), (b, _) in zip(cuts(text), cuts(text)[1:], strict=False)}
        after = {edited[a:b] for (a, _), (b, _) in zip(cuts(edited), cuts(edited)[1:], strict=False)}
        assert len(after - before) <= 4


def test_cut_runs():
    for text, expected in (("x" * 9000, 9000), ("y" * 2995 + " b", 0), ("a " * 4000, 0), ("a " * 40 + "z" * 3001 + " b" * 900, 3001), ("u" * 4000 + "\n" + "v" * 5000, 5000), ("", 0)):
        assert cut_run(text, cuts(text)) == expected
    short = "a b " * 700 + "w" * 2995 + " c"  # a piece with its overlap cannot hold this run, one without could
    assert cut_run(short, cuts(short)) in (0, 2995)


def test_table(spark):
    rows = [(1, "p", 0, "a b " * 1000), (1, "p", 0, "a b " * 1000), (2, None, None, "x" * 3001), (3, "p", 1, "x" * 3000), (4, "p", 2, ""), (5, "p", 3, None), (6, "p", 4, "y" * 3000 + " " + "z" * 200_000)]
    frame = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in found_large(frame).collect()) == [(1, 0), (1, 0), (2, 1), (6, 1)]
    found = split_chunks(frame).where("id = 6").orderBy("piece_no").collect()
    assert found[0].text + "".join(r.text[10:] for r in found[1:]) == rows[-1][3]
    assert found_large(frame.limit(0)).count() == 0
    whole = {r.id: r for r in rejoined(split_chunks(frame.where("id > 1"))).collect()}
    assert {i: (r.n_chars, r.longest <= 3000, r.reached) for i, r in whole.items()} == {2: (3001, True, 3001), 6: (203_001, True, 203_001)}
