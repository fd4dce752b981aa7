"""Formats as their files really are: books outside the canon, parts of it, metadata, registered renderers."""

import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern import config, corpus
from lectern.functions import text as T
from lectern.operators import catalog
from lectern.plans import refs, search
from lectern.sources import exports, importers

ROWS = [("m", 1, 1, 1, 1, "a 'b'"), ("m", 2, 1, 1, 2, "c"), ("n", 1, 2, 3, 4, "d")]


@pytest.fixture(scope="module")
def units(spark):
    rows = spark.createDataFrame(ROWS, "module string, id int, book int, chapter int, verse int, text string")
    return corpus.addressed(rows).withColumn("book_name", F.concat(F.lit("Book "), F.col("book").cast("string")))


def content(df):
    return sorted((r.book, r.chapter, r.verse, r.text) for r in df.collect())


def test_usfm_books_by_their_codes(spark, tmp_path):
    path = str(tmp_path / "u.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("70MAT.usfm", "\\id MAT Gospel\n\\toc1 The long one\n\\toc2 Matt\n\\toc3 Mt\n\\mt1 Title\n\\c 1\n\\s1 A heading\n\\v 1 one\n\\q1 more\n\\s Next\n\\p\n\\q1\n\\v 2 two\n\\p\n\\c 2\n\\v 1 three\n")
        z.writestr("71MRK.usfm", "\\id MRK\n\\c 1\n\\v 1 four\n")
        z.writestr("41TOB.usfm", "\\id TOB\n\\c 1\n\\v 1 outside\n")
        z.writestr("00FRT.usfm", "\\id FRT\n\\c 1\n\\v 1 front\n")
        z.writestr("none.txt", "no code")
    assert content(importers.usfm_zip(spark, path)) == [(40, 1, 1, "one more"), (40, 1, 2, "¶ two"), (40, 2, 1, "¶ three"), (41, 1, 1, "four")]
    names = {r.book: (r.name_long, r.name, r.shortname) for r in importers.usfm_names(importers.usfm_files(spark, path)).collect()}
    assert names == {40: ("The long one", "Matt", "Mt"), 41: (None, None, None)}
    assert len(importers.USFM_BOOKS) == len(set(importers.USFM_BOOKS)) == 66


def _mybible(path, numbers, info=()):
    with sqlite3.connect(path) as con:
        con.execute("create table verses (book_number int, chapter int, verse int, text text)")
        con.executemany("insert into verses values (?, 1, 1, ?)", [(b, f"b{b}") for b in numbers])
        con.execute("create table info (name text, value text)")
        con.executemany("insert into info values (?, ?)", info)
    con.close()
    return path


def test_mybible_keeps_numbers_of_a_part(spark, tmp_path):
    got = content(importers.mybible(spark, _mybible(str(tmp_path / "a.sqlite3"), [470, 480, 730, 170, 190, 220, 460])))
    assert got == [(17, 1, 1, "b190"), (18, 1, 1, "b220"), (39, 1, 1, "b460"), (40, 1, 1, "b470"), (41, 1, 1, "b480"), (66, 1, 1, "b730")]
    assert [r[0] for r in content(importers.mybible(spark, _mybible(str(tmp_path / "b.sqlite3"), [40, 41, 66])))] == [40, 41, 66]
    assert len(importers.MYBIBLE_BOOKS) == 66


def test_metadata_of_files(tmp_path):
    path = _mybible(str(tmp_path / "a.sqlite3"), [470], [("description", "An edition"), ("language", "de"), ("detailed_info", "long")])
    info = importers.attributes_of(importers.sqlite_info(path))
    assert info == {"name": "An edition", "shortname": None, "description": "long", "year": None, "lang_short": "de"}
    word = str(tmp_path / "w.mybible")
    with sqlite3.connect(word) as con:
        con.execute("create table Details (Title text, Abbreviation text, Comments text, PublishDate text)")
        con.execute("insert into Details values ('T', 'Ab', 'c', '1 May 1899')")
    con.close()
    assert importers.attributes_of(importers.sqlite_info(word)) == {"name": "T", "shortname": "Ab", "description": "c", "year": 1899, "lang_short": None}


def test_wide_sheet_rows(tmp_path):
    cell = '<table:table-cell {}><text:p>{}</text:p></table:table-cell>'
    row = "<table:table-row>" + cell.format("", "a") + '<table:table-cell table:number-columns-repeated="100"/>' + cell.format('table:number-columns-repeated="70"', "b") + '<table:table-cell table:number-columns-repeated="16000"/></table:table-row>'
    xml = f'<x xmlns:table="t" xmlns:text="u">{row}</x>'
    path = str(tmp_path / "s.ods")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("content.xml", xml)
    assert importers.sheet_cells(path) == [["a", *[""] * 100, *["b"] * 70]]


def test_34th_row(spark):
    schema = "row_no int, book int, book_name string, chapter int, verse int, text string"
    good = [(k + 1, 1, "x", 1 + (k > 30), k % 31 + 1, "t") for k in range(40)]
    assert importers.check_sample(spark.createDataFrame(good, schema)) == []
    bad = [(n, b, x, v, c, t) for n, b, x, c, v, t in good]
    assert importers.check_sample(spark.createDataFrame(bad, schema)) == ["the 34th row isn't 1:2:3"]


def test_dump_with_several_rows_a_statement(spark):
    line = "INSERT INTO `t` (`a`, `b`) VALUES (1, 'x, (y)'), (2, NULL),(3, 'it''s');"
    rows = importers.sql_rows(spark.createDataFrame([(line,), ("-- note",)], "value string"), "t", ["a", "b"])
    assert sorted((r.a, r.b) for r in rows.collect()) == [("1", "x, (y)"), ("2", None), ("3", "it's")]


def test_every_registered_format_renders(spark, units, tmp_path):
    for group in exports.GROUPS.values():
        for kind in group:
            out = tmp_path / kind
            exports.render(units, kind, str(out))
            assert list(out.iterdir())
    assert sqlite3.connect(tmp_path / "sqlite" / "n.sqlite").execute("select text from verses").fetchall() == [("d",)]
    assert importers.sheet_cells(str(tmp_path / "sheet" / "m.xlsx"))[0][-1] == "a 'b'"
    exports.render(units, "sql", str(tmp_path / "dump"), {"m": {"name": "M"}})
    dump = (tmp_path / "dump" / "m.sql").read_text(encoding="utf-8").splitlines()
    assert dump[0] == "-- M" and dump[1].startswith("CREATE TABLE IF NOT EXISTS `verses_m`") and len(dump) == 4
    wide = exports.text_lines(units.withColumn("text", F.lit("word " * 60)).withColumn("lang_short", F.when(F.col("module") == "n", "th").otherwise("en")))
    longest = {r.module: max(map(len, r.line.split("\n"))) for r in wide.collect()}
    assert longest["m"] <= 80 < longest["n"] <= 320


def test_caps_refuse(spark):
    books = spark.range(1200).selectExpr("'en' as lang", "cast(id as int) as id", "concat('b', id) as name", "'' as shortname", "'' as matching1", "'' as matching2")
    with pytest.raises(ValueError):
        catalog.book_resolver(books, "en")
    short = spark.range(50_000).selectExpr("cast(id as int) as id", "'en' as lang", "concat('s', id) as name", "cast(null as string) as short1", "cast(null as string) as short2", "cast(null as string) as short3", "'1B 1' as reference")
    with pytest.raises(ValueError):
        catalog.shortcut_map(short, "en")


def test_search_types_and_languages():
    many = {t.name: t.many_languages for t in config.SEARCH_TYPES}
    assert many == {"and": True, "or": True, "xor": True, "two_or_more": True, "keyword_limit": True, "phrase": True, "regexp": True, "not": True, "boolean": True, "proximity": False, "chapter": False, "book": False}
    assert [t.name for t in config.SEARCH_TYPES if t.boolean] == ["boolean"]


def test_terms_by_class():
    tree = search.parse('cup "silver cup and more" `x+`', "boolean")
    assert search.terms_by_class(tree) == {"word": ["cup"], "phrase": ["silver cup and more"], "regexp": ["x+"]}
    with pytest.raises(search.SearchError):
        search.misplaced("king 3:16")
    for text, kind in (("king H316", "and"), ('"at 3:16"', "boolean"), ("at 3:16", "phrase"), ("king", None)):
        search.misplaced(text, kind)


def test_navigation():
    names, last = {b: (f"Book {b}", f"B{b}") for b in range(1, 67)}, {1: 50, 2: 40, 3: 27, 65: 1, 66: 22}
    go = lambda text: refs.navigation(refs.parse_references(text, lambda b: int(b[:-1]))[0], names, last)
    a = go("2B 40")
    assert (a["pcb"], a["pcc"], a["ncb"], a["ncc"], a["ccb"]) == (2, 39, 3, 1, None) and a["next_chapter"] == "Book 3 1" and a["prev_book"] == "Book 1"
    b = go("2B 1:3-5")
    assert (b["pcb"], b["pcc"], b["ncb"], b["ncc"], b["ccb"], b["ccc"], b["cur_chapter"]) == (1, 50, 2, 2, 2, 1, "Book 2 1")
    assert go("1B 1")["pcb"] is None and go("66B 22")["ncb"] is None and go("66B 22")["nb"] is None
    assert go("2B 1:3") is None
    assert refs.navigation(refs.parse_references("2B 1", lambda b: int(b[:-1]))[0], names, last, verbose=False)["next_book"] is None


def test_dates_and_inputs(spark):
    v = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    assert [v(T.year_of(F.lit(x))) for x in ("c. 1611", "2019-04-01", "about 90", None, "1 May 1899", "16111")] == [1611, 2019, None, None, 1899, None]
    assert [v(T.positive_int(F.lit(x), 30)) for x in ("7", " 8 ", "0", "-3", "x", None)] == [7, 8, 30, 30, 30, 30]
    assert v(T.one_line(F.lit("a\r\nb\nc"))) == "a b c"


def test_import_hooks(spark, units, tmp_path):
    path, seen = str(tmp_path / "m.zip"), []
    exports.write_module(units.where("module = 'm'"), {"name": "M"}, path)
    hooks = importers.Hooks([lambda *x: seen.append(x)], [lambda rows: rows.withColumn("text", F.upper("text"))], [lambda m, rows: seen.append((m, rows.count()))])
    rows = importers.import_edition(spark, "module", path, "mine", hooks=hooks)
    assert content(rows) == [(1, 1, 1, "A 'B'"), (1, 1, 2, "C")] and seen == [("module", path, "mine"), ("mine", 2)]


def test_section_list_bootstrap(spark):
    found = spark.createDataFrame([(k, f"b{k}") for k in range(66)], "id int, name string")
    known = spark.createDataFrame([("en",)], "lang string")
    assert catalog.section_list_usable(found, known, "de") and not catalog.section_list_usable(found, known, "en")
    assert not catalog.section_list_usable(found.limit(65), known, "de")
    assert not catalog.section_list_usable(found.withColumn("name", F.when(F.col("id") > 0, F.col("name"))), known, "de")
