from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lectern import corpus
from lectern.config import search_type
from lectern.functions import text as T
from lectern.operators import catalog, grid, mutate, parallel, quota, shape, stats


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_text_functions(spark):
    v = lambda c: value(spark, c)
    assert v(T.fold(F.lit("ÉTÉ Ångström"))) == "ete angstrom"
    assert v(T.strip_markup(F.lit("‹In [the] day {H12} of›"))) == "In the day of"
    assert v(T.highlight(F.lit("silver cups, cup"), ["cup", "silver cup"])) == "<b>silver cup</b>s, <b>cup</b>"
    assert v(T.highlight(F.lit("the the then"), ["the"], whole_words=True)) == "<b>the</b> <b>the</b> then"
    assert v(T.html_to_text(F.lit("<p>a<br>b &amp; c</p>"))) == "a\nb & c"
    assert v(T.host(F.lit("https://www.Example.org:80/x?y#z"))) == "example.org" and v(T.host(F.lit("localhost:80"))) is None
    assert [v(T.ordinal(F.lit(n))) for n in (1, 2, 3, 4, 11, 12, 13, 21, 112)] == "1st 2nd 3rd 4th 11th 12th 13th 21st 112th".split()
    assert v(T.size_bytes(F.lit("512M"))) == 512 * 1024**2
    assert v(T.version_parts(F.lit("5.10.2")) > T.version_parts(F.lit("5.9"))) is True
    assert v(T.import_text(F.lit("<i>the</i> word<WH0123> ."), ("<i>", "</i>"))) == "[the] word{H123}."
    assert v(T.usfm_inline(F.lit(r'\w word|strong="G0011"\w* \f + note\f* end'))) == "word{G11} end"
    assert v(T.wrap(F.lit("aa bb cc dd"), 5)) == "aa bb\ncc dd"
    assert v(T.clean_spaces(F.lit(" a  b , c . "))) == "a b, c."
    assert v(T.slug(F.lit("  New Édition (2) "))) == "new_dition_2"
    assert v(F.lit("epee").rlike(T.accent_classes("epee"))) and v(F.lit("épée").rlike(T.accent_classes("epee")))
    assert v(T.lexicon_numbers(F.lit("a {H0012} g7"))) == ["H12", "G7"]


def test_newest(spark):
    rows = spark.createDataFrame([("a", 1, 5, 1, None), ("a", 1, 5, 2, "y"), (None, 1, 1, 3, "n"), (None, 1, 2, 4, "m"), ("b", 1, 9, 5, "z")], "k string, j int, t int, u int, v string")
    for fn in (corpus.latest, corpus.newest):
        assert sorted((r.k or "", r.u) for r in fn(rows, ["k", "j"], ["t", "u"]).collect()) == [("", 4), ("a", 2), ("b", 5)]
        assert fn(rows.limit(0), ["k", "j"], ["t", "u"]).count() == 0


def test_eviction_is_sequential(spark):
    sizes = [50.0, 30.0, 20.0, 10.0, 5.0, 40.0]
    rows = spark.createDataFrame([(k, s, k) for k, s in enumerate(sizes)], "id int, size double, rank int")
    for needed, want in ((0.0, {5}), (41.0, {5, 0}), (95.0, {5, 0, 1}), (1000.0, {0, 1, 2, 4, 5})):
        got = mutate.eviction(rows, needed, F.col("id") == 3, F.col("id") == 5, [F.col("rank").asc()])
        assert {r.id for r in got.collect()} == want
    assert mutate.eviction(rows.limit(0), 5.0, F.lit(False), F.lit(False), [F.col("rank")]).count() == 0


def test_mutations(spark):
    a = spark.createDataFrame([(1, "x", 1)], "id int, v string, n int")
    b = spark.createDataFrame([(1, "y", 2), (2, "z", 1), (2, "z", 1)], "id int, v string, n int")
    assert sorted(tuple(r) for r in mutate.insert_or_ignore(a, b, ["id"]).collect()) == [(1, "x", 1), (2, "z", 1)]
    assert sorted(tuple(r) for r in mutate.update_or_create(a, b, ["id"], "n").collect()) == [(1, "y", 2), (2, "z", 1)]
    assert mutate.cascade_delete(b, a, "id").count() == 1


def test_quota_boundary(spark):
    log = spark.createDataFrame([(k, "c" if k < 6 else None, datetime(2024, 1, 1 + k // 5, 1, 0, k)) for k in range(8)], "id int, who string, ts timestamp")
    day = {(r.client, r.day): (r.hits, r.accepted, r.limit_reached) for r in quota.daily_usage(log, "who", "ts", 5).collect()}
    assert day == {("c", date(2024, 1, 1)): (5, 5, True), ("c", date(2024, 1, 2)): (1, 1, False), (None, date(2024, 1, 2)): (2, 2, False)}
    assert {r.id for r in quota.accepted_requests(log, "who", "ts", "id", 2).collect()} == {0, 1, 5, 6, 7}
    assert quota.accepted_requests(log, "who", "ts", "id", 0).count() == 8 and quota.accepted_requests(log, "who", "ts", "id", -1).count() == 0
    assert quota.daily_usage(log, "who", "ts", -1).agg(F.sum("accepted")).first()[0] == 0


def test_grid_operators(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, "bcd"), (3, None)], "id int, name string")
    got = lambda op, v, f="name": {r.id for r in rows.where(grid.rule(f, op, v)).collect()}
    assert got("bw", "ab") == {1} and got("bn", "ab") == {2, 3} and got("ew", "d") == {2} and got("en", "d") == {1, 3}
    assert got("cn", "bc") == {1, 2} and got("nc", "bc") == {3} and got("eq", "abc") == {1} and got("ne", "abc") == {2, 3}
    assert got("lt", 2, "id") == {1} and got("ge", 2, "id") == {2, 3}
    assert grid.is_free(rows, "name", "abc", "id", 1) and not grid.is_free(rows, "name", "abc", "id", 2)
    with pytest.raises(ValueError):
        grid.rule("id", "xx", 1)


UNITS = [("a", 1, 1, 1, 1, "x ¶"), ("a", 2, 1, 1, 2, "y"), ("a", 3, 1, 2, 1, "z"), ("a", 4, 2, 1, 1, "w"), ("b", 1, 1, 1, 1, "x"), ("b", 2, 1, 1, 3, "v")]


@pytest.fixture(scope="module")
def units(spark):
    return corpus.addressed(spark.createDataFrame(UNITS, "module string, id int, book int, chapter int, verse int, text string"))


def test_stats(units):
    nav = {(r.module, r.book, r.chapter): (r.prev_book, r.prev_chapter, r.next_book, r.next_chapter) for r in stats.navigation(units).collect()}
    assert nav[("a", 1, 2)] == (1, 1, 2, 1) and nav[("a", 1, 1)][:2] == (None, None) and nav[("a", 2, 1)][2:] == (None, None)
    assert {(r.module, r.verse) for r in stats.missing_from_default(units, "a").where("book = 1 and chapter = 1").collect()} == {("b", 2)}
    assert stats.statistics(units.limit(0), F.lit(True), 1, 1).count() == 0


def test_parallel_and_shape(units, spark):
    got = {(r.module, r.id): r.unmatched for r in parallel.aligned(units, F.col("text") == "x").collect()}
    assert got == {("b", 1): False, ("a", 1): True}
    assert parallel.envelope(units, 3, 2).first().asDict() == {"total": 6, "per_page": 2, "current_page": 3, "last_page": 3, "from_row": 5, "to_row": 6}
    assert parallel.envelope(units.limit(0)).first().last_page == 1
    assert parallel.random_unit(units, 3).collect() == parallel.random_unit(units, 3).collect()
    carried = {r.id: r.text for r in shape.carry_paragraph(units.where("module = 'a'")).collect()}
    assert carried == {1: "x", 2: "¶ y", 3: "z", 4: "w"}
    ranges = spark.createDataFrame([(1, 1, 1001, 1002), (2, 1, 1001, 1002)], "passage int, book int, low int, high int")
    assert stats.claimed(units, ranges).count() == 6


def test_resolvers(spark):
    books = spark.createDataFrame([("en", 1, "Alpha", "Al", None, "first"), ("en", 2, "Alphabet", "Ab", "the song of love", None)], "lang string, id int, name string, shortname string, matching1 string, matching2 string")
    names = spark.createDataFrame([("alpha", "en"), ("Alphab", "en"), ("2B", "en"), ("love", "en"), ("zz", "en")], "entered string, lang string")
    got = {r.entered: (r.book, r.tier) for r in catalog.resolve_books(names, books, loose=True).collect()}
    assert got == {"alpha": (1, 1), "Alphab": (2, 2), "2B": (2, 0), "love": (2, 3)}
    resolve = catalog.book_resolver(books, "en", frozenset({"al p"}))
    assert resolve("AL") == 1 and resolve("alphabe.") == 2 and resolve("(x)") is None
    assert search_type("any_word").name == "or"


def test_loose_resolvers(spark):
    books = spark.createDataFrame([("en", 1, "Songs of Lokiba", "Loki", None, None), ("en", 2, "Rain and Ashes", "Labe", "the letter to x", "Labeb."), ("en", 3, "Torome", None, None, "(third|3rd)")], "lang string, id int, name string, shortname string, matching1 string, matching2 string")
    want = {"lokiba": (1, 3), "LETTER": (2, 3), "abe": (2, 4), "l.tt": (2, 4), "hird": (3, 4), "Lok": (1, 2), "torome": (3, 1), "and": None, "okib": None, "?x": None, "x??": None, "a(": None, "*": None, "": None}
    names = spark.createDataFrame([(k, "en") for k in want], "entered string, lang string")
    got = {r.entered: (r.book, r.tier) for r in catalog.resolve_books(names, books, loose=True, common=catalog.COMMON).collect()}
    assert got == {k: v for k, v in want.items() if v}
    resolve = catalog.book_resolver(books, "en", catalog.COMMON, loose=True)
    assert {k: resolve(k) for k in want} == {k: v and v[0] for k, v in want.items()}
    strict = catalog.book_resolver(books, "en")
    assert strict("lokiba") is None and strict("abe") is None


def test_highlight_accents(spark):
    mark = lambda text, terms, **how: value(spark, T.highlight(F.lit(text), terms, **how))
    assert mark("Les épis, EPIS, Épîs", ["epis"]) == "Les <b>épis</b>, <b>EPIS</b>, <b>Épîs</b>"
    assert mark("les épis epis", ["ÉPIS"]) == "les <b>épis</b> <b>epis</b>"
    assert mark("épis epis", ["ep*"]) == "<b>épis</b> <b>epis</b>"
    assert mark("épis epis", ["epis"], exact_case=True) == mark("épis epis", ["epis"], whole_words=True) == "épis <b>epis</b>"
    assert mark("les épis d'or, epis d'or", ["epis d'or"]) == "les épis d'or, <b>epis d'or</b>"
    assert mark("épis epis", [], phrases=["epis"]) == "épis <b>epis</b>"
