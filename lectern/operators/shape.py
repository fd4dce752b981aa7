"""Shaping of results: grouping by passage, nesting, marked context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import claimed, passage_labels


def by_passage(units: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row a passage and edition with its verses nested in canonical order."""
    verses = F.array_sort(F.collect_list(F.struct("chapter", "verse", "text")))
    return claimed(units, ranges).groupBy("passage", "module").agg(verses.alias("verses"), F.count("*").alias("n_verses"))


def passage_results(units: DataFrame, ranges: DataFrame, asked: DataFrame) -> DataFrame:
    """One row a requested passage: what ``asked`` tells of it (``refs.described``), label, verse index, verses by edition, count.

    ``ranges`` and ``asked`` are one request's, so they are broadcast. A passage without verses has no label, index and verses.
    """
    hit = claimed(units, ranges)
    verses = F.array_sort(F.collect_list(F.struct("chapter", "verse", "text")))
    by_edition = hit.groupBy("passage", "module").agg(verses.alias("verses"), F.count("*").alias("n"))
    body = by_edition.groupBy("passage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("module", "verses")))).alias("verses"), F.max("n").alias("verses_count"))
    numbers = hit.groupBy("passage", "chapter").agg(F.array_sort(F.collect_set("verse")).alias("verse"))
    index = numbers.groupBy("passage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chapter", "verse")))).alias("verse_index"))
    label = passage_labels(units, ranges, by_edition=False).withColumnRenamed("label", "chapter_verse")
    rows = F.broadcast(asked).join(body, "passage", "left").join(index, "passage", "left").join(label, "passage", "left")
    return rows.withColumn("verses_count", F.coalesce("verses_count", F.lit(0)))


def by_address(hits: DataFrame) -> DataFrame:
    """Search results as one passage a verse: address, and a map from edition to text."""
    texts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("module", "text"))))
    return hits.groupBy("bcv", "book", "chapter", "verse").agg(texts.alias("texts"))


def hits_by_chapter(hits: DataFrame, ranges: DataFrame) -> DataFrame:
    """Hits grouped by requested passage, then by chapter."""
    return claimed(hits, ranges).groupBy("passage", "module", "book", "chapter").agg(F.count("*").alias("n_hits"), F.min("verse").alias("first_verse"), F.max("verse").alias("last_verse"))


def nested(units: DataFrame) -> DataFrame:
    """``module, book, chapters``: chapter to verse to text, for a raw nested result."""
    verses = F.map_from_entries(F.array_sort(F.collect_list(F.struct("verse", "text"))))
    chapter = units.groupBy("module", "book", "chapter").agg(verses.alias("verses"))
    return chapter.groupBy("module", "book").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chapter", "verses")))).alias("chapters"))


def mark_target(text: Column, target: Column, tag: str = "b") -> Column:
    """The looked-up verse itself wrapped in a tag among its context."""
    return F.when(target, F.concat(F.lit(f"<{tag}>"), text, F.lit(f"</{tag}>"))).otherwise(text)


def paragraphs(units: DataFrame, mark: str = "¶") -> DataFrame:
    """Verses joined to paragraphs within their chapter: ``module, book, chapter, paragraph, first_verse, text``.

    A verse with the mark begins a paragraph. The window is a chapter.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("module", "book", "chapter").orderBy("verse", "id")
    rows = units.withColumn("paragraph", F.sum(F.col("text").contains(mark).cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.struct("verse", "id", "text")))
    joined = F.array_join(F.transform(parts, lambda x: F.trim(F.replace(x["text"], F.lit(mark), F.lit("")))), " ")
    return rows.groupBy("module", "book", "chapter", "paragraph").agg(F.min("verse").alias("first_verse"), joined.alias("text"))


def carry_paragraph(units: DataFrame, mark: str = "¶") -> DataFrame:
    """A paragraph mark at a verse's end moved to the start of the next verse of the chapter."""
    from pyspark.sql import Window as W

    w = W.partitionBy("module", "book", "chapter").orderBy("verse", "id")
    ends = F.col("text").rlike(f"{mark}\\s*$")
    bare = F.trim(F.regexp_replace("text", f"\\s*{mark}\\s*$", ""))
    return units.withColumn("_carry", F.coalesce(F.lag(ends).over(w), F.lit(False))).withColumn("text", F.when(F.col("_carry") & ~F.col("text").startswith(mark), F.concat(F.lit(f"{mark} "), bare)).otherwise(bare)).drop("_carry")
