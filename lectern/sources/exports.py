"""Editions and dimensions as files.

Line formats are string expressions over rows and are written by all tasks; formats that are one small file by nature (SQLite,
spreadsheet, archives) are filled from a local iterator, which holds one partition at a time.
"""

from __future__ import annotations

import json
import os
import sqlite3
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import wrap

CANONICAL = ["module", "book", "chapter", "verse"]


def with_book_names(units: DataFrame, books: DataFrame, lang: str) -> DataFrame:
    """Units with ``book_name``; a section list has 66 rows, so Spark broadcasts it by itself."""
    names = books.where(F.col("lang") == lang).select(F.col("id").alias("book"), F.col("name").alias("book_name"))
    return units.join(names, "book")


def without_lexicon(text: Column, lang: Column, keep: tuple[str, ...] = ("en", "es", "zh")) -> Column:
    """Lexicon numbers dropped except in the languages that have a lexicon."""
    return F.when(lang.isin(*keep), text).otherwise(F.trim(F.regexp_replace(F.regexp_replace(text, r"\{[^}]+\}", ""), " {2,}", " ")))


def machine_lines(units: DataFrame) -> DataFrame:
    """``line``: ``Book c:v text``."""
    return units.select(*CANONICAL, F.format_string("%s %d:%d %s", "book_name", "chapter", "verse", "text").alias("line"))


def module_lines(units: DataFrame) -> DataFrame:
    """``line``: the native module's ``|``-separated fields."""
    return units.select(*CANONICAL, F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("book", "chapter", "verse", "text")]).alias("line"))


def csv_field(c: Column) -> Column:
    s = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(s.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_lines(units: DataFrame) -> DataFrame:
    return units.select(*CANONICAL, F.concat_ws(",", *[csv_field(F.col(c)) for c in ("id", "book_name", "book", "chapter", "verse", "text")]).alias("line"))


def sql_literal(c: Column) -> Column:
    s = F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
    return F.coalesce(F.concat(F.lit("'"), s, F.lit("'")), F.lit("NULL"))


def sql_lines(rows: DataFrame, table: Column, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """``line``: one INSERT a row; numbers bare, text quoted, nulls as NULL."""
    numeric = {f.name for f in rows.schema if f.dataType.typeName() in ("integer", "long", "short", "byte", "double", "float")}
    values = F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) if c in numeric else sql_literal(F.col(c)) for c in columns])
    head = ", ".join(f"`{c}`" for c in columns)
    return rows.select(*(keep or []), F.concat(F.lit("INSERT INTO `"), table, F.lit(f"` ({head}) VALUES ("), values, F.lit(");")).alias("line"))


WIDTH, WIDE = 80, 320  # characters of a line; the greater in scripts that put no blanks between words
WIDE_LANGUAGES = ("th",)


def dump_lines(units: DataFrame) -> DataFrame:
    """``line``: one INSERT a verse into the table of its edition."""
    return sql_lines(units, F.concat(F.lit("verses_"), F.col("module")), ["id", "book", "chapter", "verse", "text"], CANONICAL)


def ddl(module: str) -> str:
    """The statement that makes an edition's table."""
    columns = "`id` int unsigned not null primary key, `book` tinyint unsigned not null, `chapter` tinyint unsigned not null, `verse` tinyint unsigned not null, `text` text"
    return f"CREATE TABLE IF NOT EXISTS `verses_{module}` ({columns}) DEFAULT CHARSET=utf8mb4;"


def text_lines(units: DataFrame, width: int = WIDTH) -> DataFrame:
    """``line``: wrapped text, with a header where book or chapter changes. The window is a book of an edition.

    Where units have a ``lang_short``, ``WIDE_LANGUAGES`` have lines of ``WIDE`` characters.
    """
    w = W.partitionBy("module", "book").orderBy("chapter", "verse")
    first_of_book = F.lag("chapter").over(w).isNull()
    first_of_chapter = F.coalesce(F.lag("chapter").over(w) != F.col("chapter"), F.lit(True))
    head = F.concat(F.when(first_of_book, F.concat(F.upper("book_name"), F.lit("\n\n"))).otherwise(""), F.when(first_of_chapter, F.concat(F.lit("Chapter "), F.col("chapter").cast("string"), F.lit("\n\n"))).otherwise(""))
    verse = F.concat_ws(" ", F.col("verse").cast("string"), "text")
    body = F.when(F.col("lang_short").isin(*WIDE_LANGUAGES), wrap(verse, WIDE)).otherwise(wrap(verse, width)) if "lang_short" in units.columns else wrap(verse, width)
    return units.select(*CANONICAL, F.concat(head, body).alias("line"))


def json_lines(units: DataFrame) -> DataFrame:
    """``line``: one JSON object a verse."""
    return units.select(*CANONICAL, F.to_json(F.struct("book", "chapter", "verse", "text")).alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in canonical order, a folder an edition; the order is by range, so no task sorts everything."""
    ordered = lines.repartitionByRange(*CANONICAL).sortWithinPartitions(*CANONICAL)
    ordered.select("module", F.col("line").alias("value")).write.mode("overwrite").partitionBy("module").text(path)


def preamble(meta: dict[str, str]) -> str:
    """Title, blank line, copyright, blank line."""
    return f"{meta.get('name', '')}\n\n{meta.get('statement', '')}\n\n"


# Fixed value: the header of the format.
CSV_HEADER = "Verse ID,Book Name,Book Number,Chapter,Verse,Text"


def write_csv(units: DataFrame, meta: dict[str, str], path: str) -> None:
    """One edition as a CSV with preamble and header."""
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(preamble(meta) + CSV_HEADER + "\n")
        f.writelines(r.line + "\n" for r in csv_lines(units).orderBy(*CANONICAL).toLocalIterator())


def write_sql(units: DataFrame, meta: dict[str, str], path: str) -> None:
    """One edition as a dump: its table, then its rows."""
    module = meta["module"]
    with open(path, "w", encoding="utf-8") as f:
        f.write("".join(f"-- {x}\n" for x in preamble(meta).splitlines() if x) + ddl(module) + "\n")
        f.writelines(r.line + "\n" for r in dump_lines(units).orderBy(*CANONICAL).toLocalIterator())


def write_json(units: DataFrame, meta: dict[str, str], path: str) -> None:
    """One edition as ``{"metadata": ..., "verses": [...]}``."""
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"metadata": ' + json.dumps(meta, ensure_ascii=False) + ', "verses": [')
        for k, r in enumerate(json_lines(units).orderBy(*CANONICAL).toLocalIterator()):
            f.write((",\n" if k else "\n") + r.line)
        f.write("\n]}\n")


def write_sqlite(units: DataFrame, meta: dict[str, str], path: str) -> None:
    con = sqlite3.connect(path)
    with con:
        con.execute("create table meta (field text primary key, value text)")
        con.executemany("insert into meta values (?, ?)", meta.items())
        con.execute("create table verses (id integer primary key, book integer, chapter integer, verse integer, text text)")
        con.executemany("insert into verses values (?, ?, ?, ?, ?)", (tuple(r) for r in units.select("id", "book", "chapter", "verse", "text").orderBy("id").toLocalIterator()))
    con.close()


def write_module(units: DataFrame, meta: dict, path: str) -> None:
    """A native module archive that the importer reads back."""
    info = meta | {"delimiter": "|", "fields": ["book", "chapter", "verse", "text"]}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("info.json", json.dumps(info, ensure_ascii=False))
        with z.open("verses.txt", "w") as f:
            f.write(b"# book|chapter|verse|text\n")
            for r in module_lines(units).orderBy(*CANONICAL).toLocalIterator():
                f.write((r.line.replace("\n", " ") + "\n").encode())


def write_sheet(units: DataFrame, meta: dict[str, str], path: str) -> None:
    """One edition as a minimal XLSX sheet, row by row."""
    ns = "http://schemas.openxmlformats.org"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{ns}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Type="{ns}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="r1" Type="{ns}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/officeDocument/2006/relationships"><sheets><sheet name="verses" sheetId="1" r:id="r1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
            for r in units.select("id", "book_name", "book", "chapter", "verse", "text").orderBy("id").toLocalIterator():
                cells = "".join(f"<c><v>{v}</v></c>" if isinstance(v, int) else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v or ""))}</t></is></c>' for v in r)
                f.write(f"<row>{cells}</row>".encode())
            f.write(b"</sheetData></worksheet>")


def write_dimension(rows: DataFrame, path: str) -> None:
    """A dimension table as CSV with a header; booleans as yes and no."""
    flags = {f.name for f in rows.schema if f.dataType.typeName() == "boolean"}
    rows.select(*[F.when(F.col(c), "yes").otherwise("no").alias(c) if c in flags else F.col(c) for c in rows.columns]).write.mode("overwrite").option("header", True).csv(path)


def bundle_index(editions: DataFrame) -> DataFrame:
    """``lang_short, entries``: names of the bundled editions by language, for the index of an archive."""
    entry = F.concat_ws(" - ", "module", "name")
    return editions.groupBy("lang_short").agg(F.array_join(F.array_sort(F.collect_list(entry)), "\n").alias("entries"))


def write_bundle(files: dict[str, bytes], index: str, path: str) -> None:
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("readme.txt", index)
        for name in sorted(files):
            z.writestr(name, files[name])


def extras(tables: dict[str, DataFrame]) -> DataFrame:
    """``tbl, line``: INSERT statements of several dimension tables, all their columns."""
    out = None
    for name, rows in tables.items():
        part = sql_lines(rows, F.lit(name), rows.columns).select(F.lit(name).alias("tbl"), "line")
        out = part if out is None else out.unionByName(part)
    return out


LINES: dict[str, Callable[[DataFrame], DataFrame]] = {"csv": csv_lines, "json": json_lines, "text": text_lines, "machine": machine_lines, "module": module_lines, "sql": dump_lines}
FILES: dict[str, tuple[Callable, str]] = {"csv": (write_csv, "csv"), "json": (write_json, "json"), "sqlite": (write_sqlite, "sqlite"), "module": (write_module, "zip"), "sheet": (write_sheet, "xlsx"), "sql": (write_sql, "sql")}
GROUPS = {"text": ["text", "machine"], "data": ["csv", "json", "module", "sqlite"], "sheet": ["sheet"], "sql": ["sql"]}
MOST_FILES = 10_000  # editions written as files of their own at once


def render(units: DataFrame, kind: str, path: str, meta: dict[str, dict[str, str]] | None = None) -> None:
    """Write editions in a registered format.

    Line formats are written by all tasks. ``sheet`` and ``sqlite``, and any other format that is one file an edition if
    ``meta`` (by module) is given, are written by the driver, one partition at a time, as ``path/<module>.<ending>``.
    """
    if kind not in LINES and kind not in FILES:
        raise ValueError(f"unknown format: {kind}; there are {', '.join(dict.fromkeys([*LINES, *FILES]))}")
    if kind not in FILES or (kind in LINES and meta is None):
        return write_lines(LINES[kind](units), path)
    write, ending = FILES[kind]
    modules = [r.module for r in units.select("module").distinct().orderBy("module").limit(MOST_FILES + 1).collect()]
    if len(modules) > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} editions at once")
    os.makedirs(path, exist_ok=True)
    for m in modules:
        write(units.where(F.col("module") == m), {"module": m} | (meta or {}).get(m, {}), os.path.join(path, f"{m}.{ending}"))
