import gzip
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern import corpus
from lectern.sources import exports, importers
from lectern.streaming import quota as stream_quota

ROWS = [("m", 1, 1, 1, 1, "In the {H1} 'day', \"so\""), ("m", 2, 1, 1, 2, "b, c"), ("m", 3, 1, 2, 1, "d"), ("m", 4, 2, 1, 1, "é ‹x›")]


@pytest.fixture(scope="module")
def units(spark):
    rows = spark.createDataFrame(ROWS, "module string, id int, book int, chapter int, verse int, text string")
    return corpus.addressed(rows).withColumn("book_name", F.concat(F.lit("Book "), F.col("book").cast("string")))


def content(df):
    return sorted((r.book, r.chapter, r.verse, r.text) for r in df.collect())


WANT = sorted(r[2:] for r in ROWS)


def test_module_round_trip(spark, units, tmp_path):
    path = str(tmp_path / "m.zip")
    exports.write_module(units, {"name": "M"}, path)
    info, rows = importers.module_zip(spark, path)
    assert info["name"] == "M" and content(rows) == WANT
    again = importers.import_edition(spark, "module", path, "mine")
    assert [r.id for r in again.orderBy("id").collect()] == [1, 2, 3, 4] and content(again) == WANT
    with pytest.raises(ValueError):
        importers.import_edition(spark, "module", path, "books")
    with pytest.raises(ValueError):
        importers.import_edition(spark, "nothing", path, "mine")


def test_sheet_round_trip(spark, units, tmp_path):
    path = str(tmp_path / "m.xlsx")
    exports.write_sheet(units, {}, path)
    rows = importers.sheet_edition(spark, path, ["none", "bn", "b", "c", "v", "t"])
    assert content(rows) == WANT and importers.check_sample(rows) == []


def test_csv_roles(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('title\n\nGen 1:1,"a, b",=1+1\nGen 1:2,c,\nEx 1:1,d,\n,e,\n', encoding="utf-8")
    rows = importers.csv_edition(spark, str(path), ["bn c:v", "t", "t"], 3)
    assert content(rows) == [(1, 1, 1, "a, b"), (1, 1, 2, "c"), (2, 1, 1, "d")]
    assert importers.check_sample(spark.createDataFrame([(1, 1, "x", 2, 1, "12")], "row_no int, book int, book_name string, chapter int, verse int, text string"))


def test_sqlite_forms(spark, units, tmp_path):
    path = str(tmp_path / "out.sqlite")
    exports.write_sqlite(units, {"name": "M"}, path)
    assert sqlite3.connect(path).execute("select count(*) from verses").fetchone() == (4,)
    word = str(tmp_path / "w.mybible")
    with sqlite3.connect(word) as con:
        con.execute("create table Bible (Book int, Chapter int, Verse int, Scripture text)")
        con.executemany("insert into Bible values (?, ?, ?, ?)", [r[2:] for r in ROWS])
    con.close()
    assert content(importers.mysword(spark, word)) == WANT
    packed = word + ".gz"
    with gzip.open(packed, "wb") as f:
        f.write(open(word, "rb").read())
    assert content(importers.import_edition(spark, "mysword", packed, "w")) == WANT
    my = str(tmp_path / "y.sqlite3")
    with sqlite3.connect(my) as con:
        con.execute("create table verses (book_number int, chapter int, verse int, text text)")
        con.executemany("insert into verses values (?, ?, ?, ?)", [(b * 10, c, v, t) for _, _, b, c, v, t in ROWS])
    con.close()
    assert content(importers.mybible(spark, my)) == WANT
    bib = str(tmp_path / "a.bib")
    with sqlite3.connect(bib) as con:
        con.execute("create table bible (id int, ref text, verse text)")
        con.executemany("insert into bible values (?, ?, ?)", [(1, "Alpha 1:1", "x"), (2, "No 1:1", "y"), (3, "bad", "z")])
    con.close()
    assert content(importers.analyzer(spark, bib, {"Alpha": 1}.get)) == [(1, 1, 1, "x")]


def test_marker_files(spark, tmp_path):
    text = "\\id GEN\n\\h Gen\n\\c 1\n\\p\n\\v 1 In \\w the|strong=\"H0001\"\\w* day\\f + n\\f*\n\\v 2 so\n\\c 2\n\\v 1 end"
    path = str(tmp_path / "u.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("01GEN.usfm", text)
        z.writestr("copr.htm", "x")
    assert content(importers.usfm_zip(spark, path)) == [(1, 1, 1, "¶ In the{H1} day"), (1, 1, 2, "so"), (1, 2, 1, "end")]
    xml = '<usx><chapter number="1"/><para><verse number="1"/>a <note>n</note>b<verse number="2"/>c</para></usx>'
    assert content(importers.usx(spark.createDataFrame([(3, xml)], "book int, value string"))) == [(3, 1, 1, "a b"), (3, 1, 2, "c")]
    numbered = str(tmp_path / "i.zip")
    with zipfile.ZipFile(numbered, "w") as z:
        z.writestr("02-GEN.txt", "\\id GEN\n\\c 1\n\\p\n\\v 1 *first\n\\v 2 second (see 3:4)\n")
        z.writestr("70-MAT.txt", "\\c 2\n\\v 1 third\n")
        z.writestr("readme", "x")
    assert content(importers.import_edition(spark, "irv", numbered, "i")) == [(1, 1, 1, "¶ first"), (1, 1, 2, "second"), (40, 2, 1, "third")]
    tab = str(tmp_path / "t.zip")
    with zipfile.ZipFile(tab, "w") as z:
        z.writestr("n_utf8.txt", "#name\tx\n01O\t1\t1\t\t10\ta\n02O\t1\t2\t\t20\tb\n03O\t1\t1\tc\n")
    assert content(importers.unbound_zip(spark, tab)) == [(1, 1, 1, "a"), (2, 1, 2, "b"), (3, 1, 1, "c")]


def test_lines(spark, units, tmp_path):
    dump = exports.sql_lines(units, F.lit("v"), ["id", "book", "chapter", "verse", "text"]).select(F.col("line").alias("value"))
    back = importers.sql_rows(dump, "v", ["id", "book", "chapter", "verse", "text"])
    assert sorted((int(r.book), int(r.chapter), int(r.verse), r.text) for r in back.collect()) == WANT
    body = [r.line for r in exports.text_lines(units).orderBy("book", "chapter", "verse").collect()]
    assert body[0].startswith("BOOK 1\n\nChapter 1\n\n1 In") and body[2].startswith("Chapter 2") and not body[1].startswith("Chapter")
    exports.render(units, "json", str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    exports.write_csv(units, {"name": "M", "statement": "free"}, str(tmp_path / "m.csv"))
    lines = (tmp_path / "m.csv").read_text(encoding="utf-8").splitlines()
    assert lines[0] == "M" and lines[2] == "free" and len(lines) == 9
    exports.write_json(units, {"name": "M"}, str(tmp_path / "m.json"))
    import json

    assert len(json.loads((tmp_path / "m.json").read_text(encoding="utf-8"))["verses"]) == 4
    exports.write_bundle({"a.txt": b"x"}, "index", str(tmp_path / "b.zip"))
    assert sorted(zipfile.ZipFile(tmp_path / "b.zip").namelist()) == ["a.txt", "readme.txt"]
    with pytest.raises(ValueError):
        exports.render(units, "nothing", str(tmp_path / "n"))


def test_positions_and_dimensions(spark, units):
    lines = spark.createDataFrame([(k, f"line {k}") for k in range(1, 5)], "line_no int, text string")
    assert importers.positional(lines, units).where("id = 3").first().text == "line 3"
    with pytest.raises(ValueError):
        importers.positional(lines.limit(2), units)
    raw = spark.createDataFrame([("1", "yes", " "), ("1", "no", "x"), (None, "yes", "y")], "id string, flag string, name string")
    got = importers.dimension_csv(raw, {"id": "int", "flag": "boolstr", "name": "string", "more": "int"}, "id")
    assert got.count() == 1 and got.first().more is None
    entries = spark.createDataFrame([("H1", "<b>ab</b><br>father<br/>av<br>a father"), ("G2", "tense")], "number string, entry string")
    rows = {r.number: r for r in importers.lexicon_entries(entries).collect()}
    assert rows["H1"].root_word == "ab" and rows["H1"].definition == "a father" and rows["G2"].tvm == "tense"


def test_stream_twin(spark, tmp_path):
    from datetime import datetime

    rows = [("a", datetime(2024, 1, 1, 1, m)) for m in range(4)] + [("b", datetime(2024, 1, 1, 2)), ("a", datetime(2024, 3, 1))]
    spark.createDataFrame(rows, "who string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("who string, ts timestamp").parquet(str(tmp_path / "in"))
    stream_quota.run_available(stream_quota.daily_usage(stream, "who", "ts", 3), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.client, str(r.day)): (r.hits, r.accepted, r.limit_reached) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[("a", "2024-01-01")] == (4, 3, True) and got[("b", "2024-01-01")] == (1, 1, False)


def _bible(path, table, columns, rows):
    with sqlite3.connect(path) as con:
        con.execute(f"create table {table} ({columns})")
        con.executemany(f"insert into {table} values ({', '.join('?' * len(rows[0]))})", rows)
    con.close()
    return path


def test_import_markup(spark, tmp_path):
    read = lambda *a, **k: [r.text for r in importers.import_edition(spark, *a, **k).orderBy("id").collect()]
    path = tmp_path / "x.csv"
    path.write_bytes("Gen 1:1,<i>the</i> word<WG0123> .\nGen 1:2,b\xffc <H07> {H1 (H2)}\n".encode("latin-1"))
    roles = ["bn c:v", "t"]
    assert read("csv", str(path), "c", roles) == ["the word{G123}.", "bc {H7} {H1} {(H2)}"]
    assert read("csv", str(path), "c", roles, parentheses="trim")[1] == "bc {H7} {H1} {H2}"
    assert read("csv", str(path), "c", roles, parentheses="discard")[1] == "bc {H7} {H1}"
    assert read("csv", str(path), "c", roles, raw=True)[0] == "<i>the</i> word<WG0123> ."
    word = _bible(str(tmp_path / "w.mybible"), "Bible", "Book int, Chapter int, Verse int, Scripture text", [(1, 1, 1, "<FI>a<Fi> b<WH0430><CM>"), (1, 1, 2, "<FR>c<Fr><CM>"), (1, 2, 1, "d<RF>note<Rf>")])
    assert read("mysword", word, "w") == ["[a] b{H430}", "¶ ‹c›", "¶ dnote"]
    my = _bible(str(tmp_path / "y.sqlite3"), "verses", "book_number int, chapter int, verse int, text text", [(10, 1, 1, "<pb/><J>a</J> <i>b</i><S>25</S> c ."), (10, 1, 2, b"d")])
    with sqlite3.connect(my) as con:
        con.execute("update verses set text = cast(x'64ff65' as text) where verse = 2")
    con.close()
    assert read("mybible", my, "y") == ["¶ ‹a› [b]{25} c.", "de"]
    bib = _bible(str(tmp_path / "a.bib"), "bible", "id int, ref text, verse text", [(1, "Alpha 1:1", "<i>a</i> b[H12 (H8804)] <r>c</r> [note]")])
    assert read("analyzer", bib, "a", {"Alpha": 1}.get) == ["[a] b{H12} {(H8804)} ‹c› [note]"]
    tab = str(tmp_path / "t.zip")
    with zipfile.ZipFile(tab, "w") as z:
        z.writestr("n_utf8.txt", "01O\t1\t1\t\t10\ta <b>x</b><WG5> ;\n")
    assert read("unbound", tab, "t") == ["a x{G5};"]
    marks = str(tmp_path / "u.zip")
    with zipfile.ZipFile(marks, "w") as z:
        z.writestr("01GEN.usfm", "\\id GEN\n\\c 1\n\\v 1 In \\add the\\add* \\wj day \\+add so\\+add* \\wj*.\n")
    assert read("usfm", marks, "u") == ["In [the] ‹day [so] ›."]
    sheet = str(tmp_path / "m.xlsx")
    rows = spark.createDataFrame([("m", 1, 1, 1, 1, "x<WH1> <i>y</i>", "B")], "module string, id int, book int, chapter int, verse int, text string, book_name string")
    exports.write_sheet(corpus.addressed(rows), {}, sheet)
    assert read("sheet", sheet, "s", ["none", "bn", "b", "c", "v", "t"]) == ["x{H1} y"]
