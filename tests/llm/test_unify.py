import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.unify import same_looking, unifier, unify

EQUAL = [
    ("Übersicht", "Übersicht"),
    ("king of", "king of"),
    ("king of", "king of"),
    ("king", "ki​ng"),
    ("king", "k­ing"),
    ("king", "ｋｉｎｇ"),
    ("A king", "А king"),
    ("city", "сіtу"),
    ("eté", "еté"),
    ("così", "cosі̀"),
    ("field", "ﬁeld"),
    ("1:2", "１：２"),
    ("Москва", "Mocквa"),
    ("να", "vα"),
    ("a-b", "a‑b"),
    ("한", "한"),
    ("µ", "μ"),
    ("vow", "ѵow"),
    ("king", "kiոg"),
    ("AB", "ꓮꓐ"),
    ("DRAMA", "ᎠᎡᎪᎷᎪ"),
    ("gig", "ɡiɡ"),
    ("copy", "ⲥοⲣу"),
]
APART = [("King", "king"), ("ete", "été"), ("x2", "x²"), ("1", "①"), ("½", "1/2"), ("a b", "a  b"), ("a.", "a!"), ("l", "I"), ("0", "O"), ("rn", "m"), ("👩‍🌾", "👩🌾"), ("«a»", "a"), ("a–b", "a-b"), ("a", "α"), ("p", "ρ"), ("r", "г"), ("q", "զ"), ("I", "ꓲl")]


@pytest.mark.parametrize("a,b", EQUAL)
def test_equal_looking(a, b):
    assert unifier().skeleton(a) == unifier().skeleton(b) and unifier().form(a) == unifier().form(b)


@pytest.mark.parametrize("a,b", APART)
def test_visibly_different(a, b):
    assert unifier().skeleton(a) != unifier().skeleton(b) and unifier().form(a) != unifier().form(b)


def test_forms_keep_their_script():
    own = unifier()
    assert own.form("Mocквa и дом") == "Москва и дом" and own.form("сіtу") == "city" and own.form("Ωδές οδός") == "Ωδές οδός"
    assert own.form("հոսանք ոսօմ") == "հոսանք ոսօմ" and own.form("ᎠᎡᎣ") == "ᎠᎡᎣ" and own.form("KING и GOD") == "KING и GOD"


def test_look_alikes_are_unicodes(spark):
    """Every letter of the tables and the Latin one that it stands for are confusable by Unicode's own list, as ICU has it."""
    from lectern.llm import unify as u

    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    same = lambda a, b: checker.getSkeleton(1, a) == checker.getSkeleton(1, b)
    pairs = [(a, b) for m in (*u.ALIKE.values(), u.PHONETIC) for a, b in m.items()]
    assert len(pairs) > 100 and [(a, b) for a, b in pairs if not same(a, b) and (a, b) not in {("Κ", "K"), ("һ", "h")}] == []
    assert all(a.isupper() == b.isupper() or not (a.isupper() or a.islower()) for a, b in pairs)
    assert u.unifier().back["GREEK"][ord("M")] == "Μ"


def test_popular_value_and_short_form(spark):
    """One spelling of many rows, and another: every pair comes, over several parts; the short form has a row a record."""
    from lectern.llm.unify import looking_alike

    values = ["king"] * 300 + ["kіng", "kіng", "alone", "alone", None]
    rows = spark.createDataFrame(list(enumerate(values)), "id long, text string")
    fields = {"f": (rows, "id", "text")}
    assert {tuple(r)[1:] for r in same_looking(fields).collect()} == {(a, b) for a in range(300) for b in (300, 301)}
    short = looking_alike(fields).collect()
    assert len(short) == 302 and {(r.class_id, r.spellings, r.records) for r in short} == {(0, 2, 302)}


@given(st.text(max_size=40) | st.text("aéàо́̈ﬁ２ ​‍👩k", max_size=30))
@settings(max_examples=300, deadline=None)
def test_splicing_equals_whole_normalisation(text):
    text = text.encode("utf-8", "replace").decode()
    own = unifier()
    once = own.text(text)
    assert unicodedata.is_normalized("NFC", once) and own.text(once) == once
    assert own.skeleton(own.form(text)) == own.skeleton(text)
    assert own.text(unicodedata.normalize("NFC", text)) == once


def test_pairs_against_brute_force(spark):
    values = [v for pair in EQUAL + APART for v in pair] + [None, "", " ", " ", "same", "same", "sаme", "ѕame"]
    rows = spark.createDataFrame([(k, v, 7) for k, v in enumerate(values)], "id long, text string, look int")
    own = unifier()
    want = set()
    for i, a in enumerate(values):
        for j in range(i + 1, len(values)):
            b = values[j]
            if a and b and a.strip() and b.strip() and a != b and own.skeleton(a) == own.skeleton(b) and own.skeleton(a).strip():
                want.add(("f", i, j))
    got = [tuple(r) for r in same_looking({"f": (rows, "id", "text"), "g": (rows.limit(0), "id", "text")}).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (2, "")], "id long, name string")
    assert [tuple(r) for r in unify(rows, "id", "name").orderBy("id").collect()] == [(1, None), (2, ""), (2, "")]
