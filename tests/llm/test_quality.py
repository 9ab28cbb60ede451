import random

import reference

from skyledger.llm import quality

_DRAW = random.Random(1)
CLEAN = "\n".join(reference.prose(_DRAW, 12).capitalize() + "." for _ in range(8))


def test_measures_against_brute_force(odd, odd_rows):
    got = {r.doc_id: r.quality for r in quality.with_quality(odd).collect()}
    for row in odd_rows:
        for name, value in reference.quality_base(row[1]).items():
            assert got[row[0]][name] == value, (row[0], name)


def test_lines_and_verdicts(spark):
    menu = "Home | About | Contact | News | Sport | Weather | Shop | Help |"
    shout = "BUY!! NOW!! CHEAP!! GOLD!! HERE!! TODAY!! ONLY!! BEST!!"
    rows = [(1, CLEAN), (2, CLEAN + "\n" + menu), (3, "\n".join([menu] * 9 + [CLEAN[:300]])), (4, "\n".join(
        f"{shout} {i}" for i in range(20))), (5, None), (6, "")]
    got = {r.doc_id: r.quality for r in quality.with_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].kept for i in range(1, 7)] == [True, True, False, False, False, False]
    assert got[1].clean_text == CLEAN and got[2].clean_text == CLEAN
    assert quality.line_fails(menu, quality.LineRules()) == "navigation"
    assert quality.line_fails("All rights reserved.", quality.LineRules()) == "boilerplate"
    assert quality.line_fails("", quality.LineRules()) is None


def test_clashing_columns_and_empty_tables(twice, none):
    got = quality.with_quality(twice, name="llm_quality")
    assert got.columns == [*twice.columns, "llm_quality"] and got.count() == 141
    assert quality.with_quality(none).count() == 0


def test_lost_characters_and_verdicts_by_definition(odd, odd_rows):
    """Failing lines are those of `line_fails`; what they lose and leave is counted plainly."""
    rules = quality.LineRules()
    got = {r.doc_id: r.quality for r in quality.with_quality(odd).collect()}
    lost_some = 0
    for row in odd_rows:
        text = row[1] or ""
        bad = [line for line in text.split("\n") if quality.line_fails(line, rules)]
        q, base = got[row[0]], reference.quality_base(row[1])
        lost = sum(len("".join(line.split())) for line in bad)
        assert q.lost_chars == lost
        assert q.kept == (not base["base_failed"] and lost <= 0.5 * base["word_chars"])
        assert q.clean_text == "\n".join(x for x in text.split("\n") if x not in bad)
        lost_some += lost > 0
    assert lost_some > 3
