"""Splitting fields that pack several values.

The field is cut at enclosing quotes first: odd pieces are quoted literals, even pieces are split on delimiters, and an
array fold puts the values back in order. All of it is one JVM expression per row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Noncharacters as internal marks; Unicode keeps them out of interchanged text, and they are removed from the input.
QUOTE, KIND, CUT = "\ufdd0", "\ufdd1", "\ufdd2"

HARD = r"[/|&+\t\r\n]|(?<=\s)(?i:and)(?=\s)"
SOFT = r"[,;；，]"
#: What begins a value after a soft delimiter: a letter (behind one digit at most), any other sign but a number's, or nothing.
BEGINS = r"\s*(?:\d[ \x{a0}]?(?!(?i:and)\s)\p{L}|[^\d\s\-–]|$)"
BLANK = r"[\s\p{Z}\x{feff}]"


def _joined(acc: Column, literal: Column, odd: Column) -> Column:
    """One step of the fold over (pieces of one part, whether it was quoted)."""
    # text right behind a quoted value that no delimiter cuts off belongs to that value
    glue = ~odd & (F.size(acc) > 0) & (F.size(literal) > 0) & F.element_at(literal, 1).rlike(rf"^\s*(?:{SOFT})?\s*\S")
    head = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.element_at(literal, 1))))
    rest = F.slice(literal, F.lit(2), F.greatest(F.size(literal) - 1, F.lit(0)))
    return F.when(glue, F.concat(head, rest)).otherwise(F.concat(acc, literal))


def packed_values(col: Column, hard: str = HARD, soft: str = SOFT, begins: str = BEGINS) -> Column:
    """The values of a packed field as an array of strings, in order.

    ``hard`` delimiters always separate; ``soft`` ones only before what matches ``begins``. A value may stand in double,
    single or curly quotes, in which delimiters are literal and a quote sign may be doubled or escaped by a backslash; a
    quote sign that doesn't enclose a whole value is an ordinary character, as is one that is never closed. Values lose
    outer blanks and enclosing quotes; empty ones don't count. Null gives null, an empty or blank field an empty array.
    """
    stop = f"(?:{hard.replace('(?<=' + chr(92) + 's)', '')}|{soft})"
    quoted = (
        rf"(^|{hard}|{soft})({BLANK}*)"
        rf'(?:"([^"\\]*+(?:(?:""|\\.)[^"\\]*+)*+)"|“([^”]*+)”|\'((?:[^\'\\\p{{L}}]|\p{{L}}++(?:\'(?=\p{{L}}))?|\'\'|\\.)*+)\')'
        rf"(?={BLANK}*(?:$|{stop}))"
    )
    clean = F.translate(col, QUOTE + KIND + CUT, "")
    parts = F.split(F.regexp_replace(clean, quoted, f"$1$2{QUOTE}$3{KIND}$4{KIND}$5{QUOTE}"), QUOTE, -1)

    def unquoted(part: Column) -> Column:
        by_kind = F.split(part, KIND, -1)
        back = lambda c: F.regexp_replace(c, r"\\(.)", "$1")
        whole = F.concat(back(F.replace(by_kind[0], F.lit('""'), F.lit('"'))), by_kind[1], back(F.replace(by_kind[2], F.lit("''"), F.lit("'"))))
        return F.array(whole)

    def plain(part: Column) -> Column:
        # a leading delimiter leaves an empty first piece, so that only uncut text joins the value before it
        return F.split(F.regexp_replace(part, rf"{hard}|{soft}(?={begins})", CUT), CUT, -1)

    pieces = F.transform(parts, lambda p, i: F.struct(F.when(i % 2 == 1, unquoted(p)).otherwise(plain(p)).alias("v"), (i % 2 == 1).alias("q")))
    values = F.aggregate(pieces, F.array().cast("array<string>"), lambda acc, x: _joined(acc, x["v"], x["q"]))
    trimmed = F.transform(values, lambda v: F.regexp_replace(v, rf"^{BLANK}+|{BLANK}+$", ""))
    return F.filter(trimmed, lambda v: v != "")


def split_packed(df: DataFrame, id_col: str, text_col: str, **how: str) -> DataFrame:
    """``<id_col>, item_no, item``: one row for each value of a packed field, ``item_no`` from 1 in the order written.

    Null, empty and blank fields give no rows; repeated records give their rows again; other columns aren't read.
    """
    values = packed_values(F.col(text_col).cast("string"), **how)
    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.posexplode(values).alias("at", "item"))
    return rows.select(id_col, (F.col("at") + 1).cast("int").alias("item_no"), "item")
