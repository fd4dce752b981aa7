import itertools

import pytest

from lectern.plans import search as s
from lectern.plans.proximity import chain

UNITS = [
    ("a", 1, 1, 1, "The faith, hope and love."),
    ("a", 2, 1, 1, "wine in a bottle {G12}"),
    ("a", 3, 1, 2, "Wine without; FAITH only"),
    ("a", 4, 19, 1, "hope"),
    ("a", 5, 19, 2, "Épée de l'été joy"),
    ("a", 6, 19, 2, None),
    ("b", 1, 1, 1, "hope and joy, faithful"),
    ("a", 7, 19, 2, "faith"),
]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(UNITS, "module string, id int, book int, chapter int, text string").cache()


def found(units, text, kind="boolean", limit=None, **how):
    from pyspark.sql import functions as F

    rows = units.withColumn("text", F.coalesce("text", F.lit("")))
    return {(r.module, r.id) for r in rows.where(s.column(s.parse(text, kind, limit).parts[0], **how)).collect()}


def test_operators(units):
    want = {("a", 2)}
    for text in ("wine bottle", "wine AND bottle", "wine && bottle", "wine & bottle", '"wine" (bottle)'):
        assert found(units, text) == want
    for text in ("wine NOT bottle", "wine !bottle", "wine -bottle", "wine AND NOT bottle"):
        assert found(units, text) == {("a", 3)}
    assert found(units, "faith (hope || love) and") == {("a", 1), ("b", 1)}
    assert found(units, "joy || wine && bottle") == {("a", 2), ("a", 5), ("b", 1)}
    assert found(units, "hope XOR joy XOR faith") == {("a", 3), ("a", 4), ("a", 5), ("a", 7), ("b", 1)}
    assert found(units, "`fai.h`") == {("a", 1), ("a", 3), ("a", 7), ("b", 1)}


def test_terms(units):
    assert found(units, "faith", "and", whole_words=True) == {("a", 1), ("a", 3), ("a", 7)}
    assert found(units, "faith", "and", exact_case=True) == {("a", 1), ("a", 7), ("b", 1)}
    assert found(units, "ete", "and") == {("a", 5)}
    assert found(units, "faith%", "and", whole_words=True) == {("a", 1), ("a", 3), ("a", 7), ("b", 1)}
    assert found(units, "*ful", "and", whole_words=True) == {("b", 1)}
    assert found(units, "hope and", "phrase") == {("a", 1), ("b", 1)}
    assert found(units, "g12", "and") == {("a", 2)}
    assert found(units, "faith hope love joy", "two_or_more") == {("a", 1), ("b", 1)}
    assert found(units, "faith hope love joy", "keyword_limit", 3) == {("a", 1), ("b", 1)}
    assert found(units, "100%", "and") == set()
    assert found(units, "faith", "not") == {("a", 2), ("a", 4), ("a", 5), ("a", 6)}


@pytest.mark.parametrize("text", ["", "AND a", "a AND", "a OR", "(a", "a)", "NOT", "a (b PROX c)", "a OR (b", '""', "%"])
def test_refused(text):
    with pytest.raises(s.SearchError):
        s.parse(text, "boolean")


def test_stop_words():
    tree = s.parse("the of", "and")
    with pytest.raises(s.SearchError):
        s.stop_words(tree, {"the", "of"})
    s.stop_words(s.parse("the faith"), {"the"})
    with pytest.raises(s.SearchError):
        s.stop_words(s.parse("the faith"), {"the"}, "always")


def test_hops():
    tree = s.parse_boolean("a b PROX(3) c ~ d CHAP e PROXC(2) f BOOK g ~p(4) h")
    assert [h.kind for h in tree.hops] == ["prox", "prox", "chap", "proc", "book", "prox"]
    assert [h.distance for h in tree.hops] == [3, None, None, 2, None, 4]


def brute(search, inside=lambda r: True, scoped=(19,), default=5):
    rows = [r for r in UNITS if r[4] is not None]
    words = [t.text for t in s.terms(search)]
    ok = lambda r, w: w in r[4].lower()

    def near(a, b, hop):
        if a[0] != b[0] or a[2] != b[2]:
            return False
        if hop.kind == "book":
            return True
        if hop.kind == "chap":
            return a[3] == b[3]
        if (hop.kind == "proc" or a[2] in scoped) and a[3] != b[3]:
            return False
        return abs(a[1] - b[1]) <= (default if hop.distance is None else hop.distance)

    out = set()
    for combo in itertools.product(*[[r for r in rows if ok(r, w)] for w in words]):
        if inside(combo[0]) and all(near(x, y, h) for x, y, h in zip(combo, combo[1:], search.hops)):
            out |= {(r[0], r[1]) for r in combo if inside(r)}
    return out


@pytest.mark.parametrize("text", ["faith PROX(2) wine", "faith PROX(1) wine PROX(1) bottle", "hope ~ faith", "hope BOOK joy", "joy CHAP faith", "hope PROC(9) faith CHAP joy", "wine PROX(0) bottle"])
def test_chains_against_brute_force(units, text):
    from pyspark.sql import functions as F

    tree = s.parse_boolean(text)
    assert {(r.module, r.id) for r in chain(units, tree).collect()} == brute(tree)
    got = {(r.module, r.id) for r in chain(units, tree, F.col("id") <= 2).collect()}
    assert got == brute(tree, lambda r: r[1] <= 2)


def test_chain_of_nothing(units):
    assert chain(units.limit(0), s.parse_boolean("a ~ b")).count() == 0
