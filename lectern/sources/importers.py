"""Editions from foreign files: every importer yields ``book, chapter, verse, text`` (and what else the file has).

Plain-text files are read and parsed by Spark. Archives, spreadsheets and SQLite files are single small files by nature; they
are opened on the driver and handed to Spark as rows.
"""

from __future__ import annotations

import atexit
import gzip
import io
import json
import re
import sqlite3
import tempfile
import zipfile
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..corpus import chapter_verse
from ..functions.text import import_text, usfm_inline, valid_utf8

UNITS = "book int, chapter int, verse int, text string"


def numbered(rows: DataFrame, book: str = "book") -> DataFrame:
    """Rows with the derived address; ids count the edition's verses in canonical order by book offsets, not by one global sort."""
    rows = rows.withColumn("chapter_verse", chapter_verse(F.col("chapter"), F.col("verse")))
    # the offsets have a row a chapter, so Spark broadcasts them when it sees their size
    size = rows.groupBy("book", "chapter").agg(F.count("*").alias("_n"))
    offset = size.withColumn("_offset", F.coalesce(F.sum("_n").over(W.orderBy("book", "chapter").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(W.partitionBy("book", "chapter").orderBy("verse"))
    return rows.join(offset.drop("_n"), ["book", "chapter"]).withColumn("id", (F.col("_offset") + rank).cast("int")).drop("_offset")


def module_zip(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """A native module: ``info.json`` (delimiter, fields, metadata) and ``verses.txt``, whose ``#`` lines are comments."""
    with zipfile.ZipFile(path) as z:
        info = json.loads(z.read("info.json"))
        lines = io.TextIOWrapper(z.open("verses.txt"), "utf-8", errors="ignore").read().splitlines()
    fields = info.get("fields", ["book", "chapter", "verse", "text", "italics", "strongs"])
    return info, delimited_lines(spark.createDataFrame([(x,) for x in lines], "value string"), fields, info.get("delimiter", "|"))


def delimited_lines(lines: DataFrame, fields: list[str], delimiter: str = "|", comment: str = "#") -> DataFrame:
    """Lines of a module as rows: whole-number address columns, empty values null, incomplete rows dropped."""
    parts = F.split("value", re.escape(delimiter), len(fields))
    kept = lines.where(~F.col("value").startswith(comment) & (F.trim("value") != ""))
    cols = [F.nullif(F.get(parts, F.lit(k)), F.lit("")).alias(f) for k, f in enumerate(fields)]
    rows = kept.select(*cols)
    for c in ("id", "book", "chapter", "verse"):
        if c in fields:
            rows = rows.withColumn(c, F.col(c).try_cast("int"))
    return rows.where("book is not null and chapter is not null and verse is not null")


def role_mapped(rows: DataFrame, roles: list[str], as_stored: bool = False) -> DataFrame:
    """Spreadsheet rows as verses by the role of each column; ``rows`` has ``row_no`` and ``cells array<string>``.

    Roles: ``b c v t`` (numbers and text), ``bn`` (book name), ``c:v``, ``b c:v``, ``bn c:v``, ``none``. Of several columns
    that give a value the first non-empty one counts. Cells that begin with ``=`` are formulas and count as empty. Without
    book numbers, books are numbered as their names change. Rows without an address or text are dropped. Cells lose outer
    blanks, and inner ones become single, unless ``as_stored``, which keeps the text as it is.
    """
    cell = lambda k: F.get("cells", F.lit(k))
    usable = lambda k: F.when(~F.trim(cell(k)).startswith("="), F.nullif(F.regexp_replace(F.trim(cell(k)), r"\s+", " "), F.lit("")))
    own = lambda k: F.when(~F.trim(cell(k)).startswith("=") & (F.trim(cell(k)) != ""), cell(k))
    take: dict[str, list[Column]] = {"b": [], "c": [], "v": [], "t": [], "bn": []}
    for k, role in enumerate(roles):
        if role in take:
            take[role].append(own(k) if role == "t" and as_stored else usable(k))
        elif role in ("c:v", "b c:v", "bn c:v"):
            head = role.split(" ")[0] if " " in role else None
            whole = usable(k)
            take["c"].append(F.nullif(F.regexp_extract(whole, r"([0-9]+)\s*:\s*[0-9]+\s*$", 1), F.lit("")))
            take["v"].append(F.nullif(F.regexp_extract(whole, r"[0-9]+\s*:\s*([0-9]+)\s*$", 1), F.lit("")))
            if head:
                take[head].append(F.nullif(F.trim(F.regexp_extract(whole, r"^(.*?)\s+[0-9]+\s*:\s*[0-9]+\s*$", 1)), F.lit("")))
    first = {k: F.coalesce(*v) if v else F.lit(None).cast("string") for k, v in take.items()}
    out = rows.select(F.col("row_no"), first["b"].try_cast("int").alias("book"), first["bn"].alias("book_name"), first["c"].try_cast("int").alias("chapter"), first["v"].try_cast("int").alias("verse"), first["t"].alias("text"))
    if not take["b"]:
        # names change a few dozen times in a file; only the rows where they do are numbered
        w = W.orderBy("row_no")
        named = out.where("book_name is not null").select("row_no", "book_name")
        turns = named.withColumn("_new", F.coalesce(F.lag("book_name").over(w) != F.col("book_name"), F.lit(True))).where("_new").withColumn("_book", F.row_number().over(w)).groupBy("book_name").agg(F.min("_book").alias("_book"))
        ranked = turns.withColumn("_book", F.row_number().over(W.orderBy("_book")))
        out = out.join(ranked, "book_name", "left").withColumn("book", F.col("_book")).drop("_book")
    return out.where("book is not null and chapter is not null and verse is not null and text is not null").select("row_no", "book", "book_name", "chapter", "verse", "text")


def csv_cells(lines: DataFrame, width: int) -> DataFrame:
    """``row_no, cells`` of CSV lines (``row_no, value``), one record a line; cells beyond ``width`` aren't read, missing ones are null."""
    record = F.from_csv(F.regexp_replace(valid_utf8(F.col("value")), "^\ufeff", ""), ", ".join(f"c{k} string" for k in range(width)), {"escape": '"'})
    return lines.select("row_no", record.alias("r")).select("row_no", F.array(*[F.col(f"r.c{k}") for k in range(width)]).alias("cells"))


def csv_edition(spark: SparkSession, path: str, roles: list[str], first_row: int = 1) -> DataFrame:
    """A CSV edition by column roles, one record a line; data begin at line ``first_row`` (from 1).

    Lines are numbered by the file's parts, so numbers rise but needn't be dense behind the first part, which holds the head.
    """
    lines = spark.read.text(path).select((F.monotonically_increasing_id() + 1).alias("row_no"), "value")
    return role_mapped(csv_cells(lines.where(F.col("row_no") >= first_row), len(roles)), roles)


def sheet_cells(path: str) -> list[list[str]]:
    """The first sheet of an XLSX or ODS file as text, formulas with their sign; by the archive's XML alone."""
    with zipfile.ZipFile(path) as z:
        if "content.xml" in z.namelist():
            return _ods(ElementTree.fromstring(z.read("content.xml")))
        strings: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                strings.append("".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")))
        sheet = ElementTree.fromstring(z.read(min(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))))
    rows = []
    for row in (x for x in sheet.iter() if x.tag.endswith("}row")):
        cells: dict[int, str] = {}
        for c in (x for x in row if x.tag.endswith("}c")):
            at = 0
            for letter in re.match(r"[A-Z]*", c.get("r", "")).group():
                at = at * 26 + ord(letter) - 64
            at = at or max(cells, default=-1) + 2  # a cell without a name follows the one before
            formula = next((x.text for x in c if x.tag.endswith("}f")), None)
            value = "".join(x.text or "" for x in c.iter() if x.tag.endswith(("}v", "}t")))
            cells[at - 1] = f"={formula}" if formula else strings[int(value)] if c.get("t") == "s" and value else value
        rows.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
    return rows


def _ods(root: ElementTree.Element) -> list[list[str]]:
    rows = []
    for row in (x for x in root.iter() if x.tag.endswith("}table-row")):
        cells: list[str] = []
        empty = 0
        for c in (x for x in row if x.tag.endswith("}table-cell")):
            again = int(next((v for k, v in c.attrib.items() if k.endswith("}number-columns-repeated")), "1"))
            formula = next((v for k, v in c.attrib.items() if k.endswith("}formula")), None)
            text = f"={formula}" if formula else "\n".join("".join(p.itertext()) for p in c if p.tag.endswith("}p"))
            if text:
                cells += [""] * empty + [text] * again
            empty = 0 if text else empty + again  # a row often ends with thousands of empty cells
        rows.append(cells)
    return rows


def sheet_edition(spark: SparkSession, path: str, roles: list[str], first_row: int = 1) -> DataFrame:
    cells = [(k, row) for k, row in enumerate(sheet_cells(path), 1) if k >= first_row]
    return role_mapped(spark.createDataFrame(cells, "row_no int, cells array<string>"), roles)


def check_sample(rows: DataFrame, size: int = 100) -> list[str]:
    """What is wrong with the first rows of a mapped edition (a deliberate sample); empty if nothing.

    The first must be 1:1:1 and the 34th 1:2:3, which tells swapped columns; numbers must be positive; text must not be a bare number.
    """
    sample = rows.orderBy("row_no").limit(size).collect()
    if not sample:
        return ["no rows"]
    out = []
    if (sample[0].book, sample[0].chapter, sample[0].verse) != (1, 1, 1):
        out.append("the first row isn't 1:1:1")
    if len(sample) >= 34 and (sample[33].book, sample[33].chapter, sample[33].verse) != (1, 2, 3):
        out.append("the 34th row isn't 1:2:3")
    for r in sample:
        if min(r.book, r.chapter, r.verse) < 1:
            out.append(f"row {r.row_no}: an address isn't positive")
        if re.fullmatch(r"\s*[\d.,]+\s*", r.text):
            out.append(f"row {r.row_no}: the text is a number")
    return out


def tabbed_lines(lines: DataFrame) -> DataFrame:
    """Tab-separated lines: book, chapter, verse and, in the last of three or five further columns, the text.

    Header lines begin with ``#``; book numbers may carry a letter for their part of the canon.
    """
    parts = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(parts.alias("p"))
    text = F.when(F.size("p") >= 9, F.get("p", F.lit(8))).when(F.size("p") >= 6, F.get("p", F.lit(5))).otherwise(F.get("p", F.lit(3)))
    number = F.regexp_extract(F.get("p", F.lit(0)), r"^0*([0-9]+)", 1)
    out = rows.select(number.try_cast("int").alias("book"), F.get("p", F.lit(1)).try_cast("int").alias("chapter"), F.get("p", F.lit(2)).try_cast("int").alias("verse"), F.nullif(F.trim(text), F.lit("")).alias("text"))
    return out.where("book is not null and chapter is not null and verse is not null and text is not null")


def unbound_zip(spark: SparkSession, path: str) -> DataFrame:
    with zipfile.ZipFile(path) as z:
        name = next(n for n in z.namelist() if n.endswith("_utf8.txt"))
        lines = z.read(name).decode("utf-8-sig", "ignore").splitlines()
    return tabbed_lines(spark.createDataFrame([(x,) for x in lines], "value string"))


# The codes of the books of the canon in its order, as they stand behind ``\\id``.
USFM_BOOKS = (
    "GEN EXO LEV NUM DEU JOS JDG RUT 1SA 2SA 1KI 2KI 1CH 2CH EZR NEH EST JOB PSA PRO ECC SNG ISA JER LAM EZK DAN HOS JOL AMO OBA JON MIC NAM HAB ZEP HAG"
    " ZEC MAL MAT MRK LUK JHN ACT ROM 1CO 2CO GAL EPH PHP COL 1TH 2TH 1TI 2TI TIT PHM HEB JAS 1PE 2PE 1JN 2JN 3JN JUD REV"
).split()


def usfm_book(value: Column) -> Column:
    """The number of a USFM file's book by the code behind ``\\id``; null for books outside the canon."""
    code = F.upper(F.regexp_extract(value, r"^\ufeff?\s*\\id\s+(\w{3})", 1))
    return F.nullif(F.array_position(F.array(*[F.lit(c) for c in USFM_BOOKS]), code), F.lit(0)).cast("int")


def usfm_names(files: DataFrame) -> DataFrame:
    """``book, name_long, name, shortname``: what USFM files (``value``) call their books, null where they don't."""
    line = lambda k: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^\s*\\toc{k}\s+(.*?)\r?$", 1)), F.lit(""))
    return files.select(usfm_book(F.col("value")).alias("book"), *[line(k).alias(c) for k, c in ((1, "name_long"), (2, "name"), (3, "shortname"))]).where("book is not null")


def usfm(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """USFM files (``book int, value string``, one a book) as verses; markers are split and carried forward in one array pass.

    ``keep`` names columns that tell files apart beside the book (an edition) and come back. A paragraph line marks the verse behind it; headings aren't part of a verse.
    """
    value = F.regexp_replace("value", r"(?m)^[ \t]*\\(?:s|mt|ms|r|d)(?![a-z]{2}|[a-z]*\*).*$", "")
    # a paragraph line and the marker lines between it and its verse
    value = F.regexp_replace(value, r"(?m)^[ \t]*\\p[a-z0-9]*[ \t\r]*\n((?:[ \t]*(?:\\(?!v)[^\n]*)?\n)*)[ \t]*\\v\s+(\S+)\s", "$1\\\\v $2 ¶ ")
    # a marker begins each chapter and verse; what follows until the next one is its text
    marks = F.split(F.regexp_replace(value, r"\\(c|v)\s+", "\u0001$1"), "\u0001")
    keys = [*(keep or []), "book"]
    rows = files.select(*keys, F.posexplode(marks).alias("at", "part")).where("at > 0")
    kind = F.substring("part", 1, 1)
    number = F.regexp_extract("part", r"^[cv]([0-9]+)", 1).try_cast("int")
    w = W.partitionBy(*keys).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    chapter = F.last(F.when(kind == "c", number), ignorenulls=True).over(w)
    body = usfm_inline(F.regexp_replace("part", r"^[cv][0-9]+(?:-[0-9]+)?[a-z]?\s*", ""))
    return rows.select(*keys, chapter.alias("chapter"), F.when(kind == "v", number).alias("verse"), body.alias("text")).where("chapter is not null and verse is not null and text <> ''")


def usfm_files(spark: SparkSession, path: str, pattern: str = r"(?i)\.(usfm|sfm|txt)$") -> DataFrame:
    """``value``: the USFM files of an archive."""
    with zipfile.ZipFile(path) as z:
        rows = [(z.read(n).decode("utf-8-sig", "ignore"),) for n in sorted(z.namelist()) if re.search(pattern, n)]
    return spark.createDataFrame(rows, "value string")


def usfm_zip(spark: SparkSession, path: str, pattern: str = r"(?i)\.(usfm|sfm|txt)$") -> DataFrame:
    """An archive of USFM files; the code behind ``\\id`` tells the book, and files of other books or without a code are left out."""
    files = usfm_files(spark, path, pattern)
    return usfm(files.select(usfm_book(F.col("value")).alias("book"), "value").where("book is not null"))


def numbered_usfm_zip(spark: SparkSession, path: str) -> DataFrame:
    """An archive whose file numbers give the book: below 70 one less, else 30 less.

    A note with a reference in parentheses at a verse's end is cut, asterisks go, and a paragraph line marks the verse behind it.
    """
    rows = []
    with zipfile.ZipFile(path) as z:
        for n in z.namelist():
            m = re.match(r"0*([1-9]\d*)", n)
            if m:
                rows.append((int(m.group(1)) - (1 if int(m.group(1)) < 70 else 30), z.read(n).decode("utf-8-sig", "ignore")))
    files = spark.createDataFrame(rows, "book int, value string")
    text = F.when(F.col("text").rlike(r"[0-9]+:[0-9]+"), F.regexp_replace("text", r"\s*\([^(]*$", "")).otherwise(F.col("text"))
    return usfm(files).withColumn("text", F.trim(F.replace(text, F.lit("*"), F.lit(""))))


def usx(files: DataFrame) -> DataFrame:
    """USX files (``book int, value string``) as verses: chapter and verse milestones with the text between them."""
    plain = F.regexp_replace("value", r"(?s)<note\b.*?</note>", "")
    plain = F.regexp_replace(plain, r'<chapter\b[^>]*\bnumber="([0-9]+)"[^>]*/?>', r"\\c $1 ")
    plain = F.regexp_replace(plain, r'<verse\b[^>]*\bnumber="([0-9]+)[^"]*"[^>]*/?>', r"\\v $1 ")
    return usfm(files.select("book", F.regexp_replace(plain, r"<[^>]+>", " ").alias("value")))


def _sqlite(path: str, sql: str) -> list[tuple]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        con.text_factory = lambda x: x.decode("utf-8", "ignore")
        return con.execute(sql).fetchall()


def _unpacked(path: str) -> str:
    """The SQLite file itself, out of a .zip or .gz if it is packed; the copy, which only the driver reads, goes when the process ends."""
    if path.endswith((".zip", ".gz")):
        data = gzip.open(path).read() if path.endswith(".gz") else (lambda z: z.read(z.namelist()[0]))(zipfile.ZipFile(path))
        with tempfile.NamedTemporaryFile(delete=False, suffix=".sqlite") as f:
            f.write(data)
        atexit.register(Path(f.name).unlink, missing_ok=True)
        return f.name
    return path


def sqlite_info(path: str) -> dict[str, str]:
    """What an edition's SQLite file tells of itself, by field: from ``title`` (desc, abbr, info), ``Details`` or ``info`` (name, value)."""
    own = _unpacked(path)
    tables = {t.lower(): t for (t,) in _sqlite(own, "select name from sqlite_master where type = 'table'")}
    if "info" in tables:
        return {str(k): str(v) for k, v in _sqlite(own, f"select name, value from {tables['info']}") if v is not None}
    source = tables.get("details") or tables.get("title")
    if source is None:
        return {}
    names = [c[1] for c in _sqlite(own, f"pragma table_info({source})")]
    row = next(iter(_sqlite(own, f"select * from {source}")), ())
    return {k.lower(): str(v) for k, v in zip(names, row) if v is not None}


# Attributes of an edition and the fields of the formats that give them, first one first.
ATTRIBUTES = {"name": ["title", "description", "desc"], "shortname": ["abbreviation", "abbr", "short_name"], "description": ["information", "info", "comments", "detailed_info", "description"], "year": ["publishdate", "versiondate", "year"], "lang_short": ["language", "lang"]}


def attributes_of(info: dict[str, str]) -> dict[str, str | int | None]:
    """Attributes of an edition from the fields of its file; a year is the first of four digits in its date."""
    known = {k.lower(): v.strip() for k, v in info.items() if v and v.strip()}
    out: dict[str, str | int | None] = {name: next((known[f] for f in fields if f in known), None) for name, fields in ATTRIBUTES.items()}
    year = re.search(r"(?<!\d)(1\d{3}|20\d{2})(?!\d)", str(out["year"] or ""))
    return out | {"year": int(year.group()) if year else None}


def analyzer(spark: SparkSession, path: str, resolve: Callable[[str], int | None]) -> DataFrame:
    """SQLite with ``bible(id, ref, verse)``, where ref is ``Book c:v``; rows of unknown books are dropped."""
    rows = []
    for ref, text in _sqlite(path, "select ref, verse from bible order by id"):
        m = re.fullmatch(r"\s*(.+?)\s+(\d+):(\d+)\s*", ref or "")
        book = resolve(m.group(1)) if m else None
        if book is not None and text:
            rows.append((book, int(m.group(2)), int(m.group(3)), text))
    return spark.createDataFrame(rows, UNITS)


def mysword(spark: SparkSession, path: str) -> DataFrame:
    """SQLite with ``Bible(Book, Chapter, Verse, Scripture)``, plain or packed."""
    return spark.createDataFrame(_sqlite(_unpacked(path), "select Book, Chapter, Verse, Scripture from Bible where Scripture is not null"), UNITS)


# Numbers of the format for the books of the canon; those between are of other books.
MYBIBLE_BOOKS = {b: k for k, b in enumerate([*range(10, 170, 10), 190, *range(220, 270, 10), *range(290, 320, 10), *range(330, 470, 10), *range(470, 740, 10)], 1)}


def mybible(spark: SparkSession, path: str) -> DataFrame:
    """SQLite with ``verses(book_number, chapter, verse, text)``.

    The format's book numbers go in steps that leave room for books outside the canon, which are left out; a part of the canon
    keeps its numbers. Files whose numbers are all below 67 are taken to count the canon.
    """
    rows = _sqlite(_unpacked(path), "select book_number, chapter, verse, text from verses where text is not null")
    plain = all(r[0] <= 66 for r in rows) and not {r[0] for r in rows} <= MYBIBLE_BOOKS.keys()
    number = (lambda b: b) if plain else MYBIBLE_BOOKS.get
    return spark.createDataFrame([(number(b), *rest) for b, *rest in rows if number(b)], UNITS)


def positional(lines: DataFrame, base: DataFrame) -> DataFrame:
    """The i-th line gets the i-th address of a base edition: ``lines`` has ``line_no`` and ``text``, ``base`` has ``id``.

    Both must have as many rows; ids and line numbers count from 1. An equi-join on the number aligns them.
    """
    a, b = lines.count(), base.count()
    if a != b:
        raise ValueError(f"{a} lines for {b} addresses")
    return base.select("id", "book", "chapter", "verse").join(lines.select(F.col("line_no").alias("id"), "text"), "id")


def dimension_csv(rows: DataFrame, types: dict[str, str], key: str) -> DataFrame:
    """Rows of a CSV with typed columns: empty is null, missing columns are null, ``boolstr`` reads yes and no, rows without a key go, repeated keys are taken once."""
    cols = []
    for name, kind in types.items():
        raw = F.nullif(F.trim(F.col(name)), F.lit("")) if name in rows.columns else F.lit(None).cast("string")
        cols.append((F.lower(raw).isin("yes", "true", "1", "y") if kind == "boolstr" else raw.try_cast(kind)).alias(name))
    return rows.select(*cols).where(F.col(key).isNotNull()).dropDuplicates([key])


def sql_rows(lines: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Rows of the ``INSERT`` statements of a dump as strings; a statement stands on a line and may hold several rows."""
    every = F.regexp_extract("value", rf"^INSERT INTO `?{table}`?(?: \([^)]*\))? VALUES\s*(\(.*\));\s*$", 1)
    tuples = F.regexp_extract_all(every, F.lit(r"\(((?:'(?:[^'\\]|''|\\.)*'|[^'()])*)\)"), F.lit(1))
    lines = lines.where(F.col("value").startswith("INSERT INTO")).select(F.explode(tuples).alias("_values"))
    values = F.col("_values")
    parts = F.regexp_extract_all(values, F.lit(r"('(?:[^'\\]|''|\\.)*'|[^,]+)(?:,\s*|$)"), F.lit(1))
    plain = F.transform(parts, lambda x: F.when(F.trim(x) == "NULL", F.lit(None)).otherwise(F.regexp_replace(F.replace(F.regexp_replace(F.trim(x), r"^'|'$", ""), F.lit("''"), F.lit("'")), r"\\(.)", "$1")))
    return lines.select(plain.alias("p")).where(F.size("p") == len(columns)).select(*[F.get("p", F.lit(k)).alias(c) for k, c in enumerate(columns)])


def lexicon_entries(rows: DataFrame) -> DataFrame:
    """Lexicon entries split at line breaks: root, transliteration, pronunciation, rest; grammar codes keep one field."""
    part = F.transform(F.split("entry", r"(?i)<br\s*/?>"), lambda x: F.trim(F.regexp_replace(x, r"<[^>]+>", "")))
    word = F.size(part) >= 4
    return rows.select("number", *[F.when(word, F.get(part, F.lit(k))).alias(n) for k, n in enumerate(("root_word", "transliteration", "pronunciation"))], F.when(word, F.array_join(F.slice(part, 4, 1000), " ")).alias("definition"), F.when(~word, F.array_join(part, " ")).alias("tvm"))


IMPORTERS: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "module": (module_zip, (".zip",)),
    "csv": (csv_edition, (".csv",)),
    "sheet": (sheet_edition, (".xlsx", ".ods")),
    "unbound": (unbound_zip, (".zip",)),
    "usfm": (usfm_zip, (".zip",)),
    "irv": (numbered_usfm_zip, (".zip",)),
    "analyzer": (analyzer, (".bib",)),
    "mysword": (mysword, (".mybible", ".gz", ".zip", ".sqlite")),
    "mybible": (mybible, (".sqlite3", ".gz", ".zip")),
}
RESERVED = frozenset({"verses", "bibles", "books", "languages", "shortcuts"})


#: How the formats write what ``import_text`` turns into the corpus's markup; native modules have that already.
MARKUP: dict[str, dict] = {
    "irv": {"red": ("<", ">")},
    "analyzer": {"italics": ("<i>", "</i>"), "red": ("<r>", "</r>"), "lexicon": ("[", "]")},
    "mysword": {"italics": ("<FI>", "<Fi>"), "red": ("<FR>", "<Fr>"), "paragraph": "<CM>"},
    "mybible": {"italics": ("<i>", "</i>"), "red": ("<J>", "</J>"), "lexicon": ("<S>", "</S>"), "paragraph": "<pb/>"},
}
ENDING = frozenset({"mysword"})  # formats whose paragraph sign stands at the end of the verse before


def next_paragraph(rows: DataFrame) -> DataFrame:
    """A paragraph sign at a verse's end moved to the start of the book's next verse."""
    w = W.partitionBy("book").orderBy("chapter", "verse")
    sign = r"\s*¶\s*([›\]]*)\s*$"
    bare = F.regexp_replace("text", sign, "$1")
    carry = F.lag(F.col("text").rlike(sign)).over(w)
    return rows.withColumn("text", F.when(carry & ~bare.startswith("¶"), F.concat(F.lit("¶ "), bare)).otherwise(bare))


@dataclass
class Hooks:
    """What a caller adds to imports: functions called before one with (kind, path, module), on its rows as a plan that is
    returned changed, and after it with (module, rows)."""

    before: list[Callable[[str, str, str], None]] = field(default_factory=list)
    on_rows: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    after: list[Callable[[str, DataFrame], None]] = field(default_factory=list)


def import_edition(spark: SparkSession, kind: str, path: str, module: str, *args, raw: bool = False, parentheses: str = "retain", hooks: Hooks | None = None) -> DataFrame:
    """Read a file of a registered kind into the corpus layout under a module name.

    Texts are brought into the corpus's markup unless ``raw``; ``parentheses`` as in ``import_text``. Bytes that aren't UTF-8 go.
    """
    if kind not in IMPORTERS:
        raise ValueError(f"unknown import type: {kind}")
    if module in RESERVED or not re.fullmatch(r"[a-z][a-z0-9_]*", module):
        raise ValueError(f"not a usable module name: {module}")
    read, endings = IMPORTERS[kind]
    if not path.lower().endswith(endings):
        raise ValueError(f"{kind} reads files ending in {', '.join(endings)}")
    hooks = hooks or Hooks()
    for call in hooks.before:
        call(kind, path, module)
    rows = read(spark, path, *args)
    rows = rows[1] if isinstance(rows, tuple) else rows
    rows = rows.withColumn("text", valid_utf8(F.col("text")))
    if not raw and kind != "module":
        rows = rows.withColumn("text", import_text(F.col("text"), parentheses=parentheses, **MARKUP.get(kind, {})))
        rows = next_paragraph(rows) if kind in ENDING else rows
    for change in hooks.on_rows:
        rows = change(rows)
    out = numbered(rows.drop("id", "row_no")).select(F.lit(module).alias("module"), "id", "book", "chapter", "verse", "chapter_verse", "text")
    for call in hooks.after:
        call(module, out)
    return out


def rows_of(cells: Iterable[Iterable[str]], spark: SparkSession) -> DataFrame:
    schema = T.StructType([T.StructField("row_no", T.IntegerType()), T.StructField("cells", T.ArrayType(T.StringType()))])
    return spark.createDataFrame([(k, [*r]) for k, r in enumerate(cells, 1)], schema)
