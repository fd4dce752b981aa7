"""Counts, positions and differences of editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def verse_counts(units: DataFrame) -> DataFrame:
    """``module, book, chapter, verses``: the greatest verse number of each chapter (editions may leave verses out)."""
    return units.groupBy("module", "book", "chapter").agg(F.max("verse").alias("verses"))


def chapter_counts(units: DataFrame) -> DataFrame:
    """``module, book, chapters, verses_by_chapter``: the greatest chapter, and a map of chapter to greatest verse."""
    by_chapter = verse_counts(units)
    return by_chapter.groupBy("module", "book").agg(F.max("chapter").alias("chapters"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("chapter", "verses")))).alias("verses_by_chapter"))


def count_differences(units: DataFrame, baseline: str) -> DataFrame:
    """Chapters whose greatest verse differs from the baseline edition's: ``module, book, chapter, verses, expected``.

    Chapters that the baseline lacks are left out.
    """
    counts = verse_counts(units)
    base = counts.where(F.col("module") == baseline).select("book", "chapter", F.col("verses").alias("expected"))
    return counts.where(F.col("module") != baseline).join(base, ["book", "chapter"]).where("verses <> expected").select("module", "book", "chapter", "verses", "expected")


def statistics(units: DataFrame, passage: Column, book: int, chapter: int) -> DataFrame:
    """Rows, chapters and books of each edition within a passage, its chapter, its book and the whole, in one pass.

    ``module, scope, n_verses, n_chapters, n_books``. Chapters are counted by a first aggregate over (book, chapter), so
    no distinct count is expanded.
    """
    inside, in_book = F.coalesce(passage, F.lit(False)), F.col("book") == book
    in_chapter = in_book & (F.col("chapter") == chapter)
    scopes = {"passage": inside, "chapter": in_chapter, "book": in_book, "full": F.lit(True)}
    one = units.groupBy("module", "book", "chapter").agg(*[F.count_if(c).alias(f"_{s}") for s, c in scopes.items()])
    two = one.groupBy("module", "book").agg(*[F.sum(f"_{s}").alias(f"_{s}") for s in scopes], *[F.count_if(F.col(f"_{s}") > 0).alias(f"_{s}_c") for s in scopes])
    three = two.groupBy("module").agg(*[F.sum(f"_{s}").alias(f"_{s}") for s in scopes], *[F.sum(f"_{s}_c").alias(f"_{s}_c") for s in scopes], *[F.count_if(F.col(f"_{s}") > 0).alias(f"_{s}_b") for s in scopes])
    rows = F.array(*[F.struct(F.lit(s).alias("scope"), F.col(f"_{s}").alias("n_verses"), F.col(f"_{s}_c").alias("n_chapters"), F.col(f"_{s}_b").alias("n_books")) for s in scopes])
    return three.select("module", F.inline(rows))


def chapter_positions(units: DataFrame) -> DataFrame:
    """``module, book, chapter, position``: the ordinal of each chapter in its edition. The windows hold chapters, not verses."""
    spine = units.select("module", "book", "chapter").distinct()
    return spine.withColumn("position", F.row_number().over(W.partitionBy("module").orderBy("book", "chapter")))


def navigation(units: DataFrame) -> DataFrame:
    """Chapter before and after each chapter of an edition, across book ends; null at both ends of the edition."""
    spine = units.select("module", "book", "chapter").distinct()
    w = W.partitionBy("module").orderBy("book", "chapter")
    step = {f"{side}_{c}": fn(c).over(w) for side, fn in (("prev", F.lag), ("next", F.lead)) for c in ("book", "chapter")}
    return spine.withColumns(step)


def book_navigation(units: DataFrame) -> DataFrame:
    """Book before and after each book of an edition."""
    w = W.partitionBy("module").orderBy("book")
    return units.select("module", "book").distinct().withColumns({"prev_book": F.lag("book").over(w), "next_book": F.lead("book").over(w)})


def verse_index(units: DataFrame) -> DataFrame:
    """``book, chapter, verse_numbers``: the verse numbers that any edition has in a chapter, sorted."""
    return units.groupBy("book", "chapter").agg(F.array_sort(F.collect_set("verse")).alias("verse_numbers"))


def missing_addresses(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one edition at addresses that another lacks."""
    keys = ["book", "chapter", "verse"]
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


MOST_EDITIONS = 100_000


def missing_from_default(units: DataFrame, default: str) -> DataFrame:
    """Addresses of the default edition that each other edition lacks: ``module, book, chapter, verse``.

    Each default address gathers the editions that have it, and what is left of the list of all editions is missing. That
    list is the catalog of editions, a dimension; more than ``MOST_EDITIONS`` are refused.
    """
    keys = ["book", "chapter", "verse"]
    rest = units.where(F.col("module") != default)
    names = [r.module for r in rest.select("module").distinct().limit(MOST_EDITIONS + 1).collect()]
    if len(names) > MOST_EDITIONS:
        raise ValueError("too many editions to compare at once")
    spine = units.where(F.col("module") == default).select(*keys).distinct()
    held = spine.join(rest.select("module", *keys), keys, "left").groupBy(*keys).agg(F.collect_set("module").alias("held"))
    return held.select(F.explode(F.array_except(F.lit(names) if names else F.array().cast("array<string>"), "held")).alias("module"), *keys)


def count_verses(units: DataFrame, inside: Column) -> DataFrame:
    """``n``: how many rows a passage has."""
    return units.where(inside).agg(F.count("*").alias("n"))


def passage_labels(units: DataFrame, ranges: DataFrame, by_edition: bool = True) -> DataFrame:
    """The label that the rows found for a passage justify: ``c:first - last; ...``, gaps ignored; by edition or over all.

    ``ranges`` has ``passage, book, low, high`` in chapter*1000+verse.
    """
    hit = claimed(units, ranges)
    keys = ["passage", "module"] if by_edition else ["passage"]
    by_chapter = hit.groupBy(*keys, "chapter").agg(F.min("verse").alias("a"), F.max("verse").alias("b"))
    part = F.concat(F.col("chapter").cast("string"), F.lit(":"), F.col("a").cast("string"), F.when(F.col("a") < F.col("b"), F.concat(F.lit(" - "), F.col("b").cast("string"))).otherwise(""))
    sorted_parts = F.transform(F.array_sort(F.collect_list(F.struct("chapter", part.alias("part")))), lambda x: x["part"])
    return by_chapter.groupBy(*keys).agg(F.concat_ws("; ", sorted_parts).alias("label"))


def claimed(units: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows by the passages that they are in; a passage that is asked for twice claims its rows twice.

    The join is by book. ``ranges`` is as large as one request, so it is broadcast.
    """
    r = ranges.withColumnRenamed("book", "_book")
    inside = (F.col("book") == F.col("_book")) & F.col("chapter_verse").between(F.col("low"), F.col("high"))
    return units.join(F.broadcast(r), inside).drop("_book", "low", "high")


def claim_counts(units: DataFrame, ranges: DataFrame) -> DataFrame:
    """``passage, verses_count``: the most rows that any edition has in each passage."""
    per = claimed(units, ranges).groupBy("passage", "module").count()
    return per.groupBy("passage").agg(F.max("count").alias("verses_count"))
