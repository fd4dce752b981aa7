"""The corpus: one long table of addressed text units, and its dimensions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ADDRESS = ["module", "book", "chapter", "verse"]


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def chapter_verse(chapter: Column, verse: Column) -> Column:
    return chapter * 1000 + verse


def bcv(book: Column, chapter: Column, verse: Column) -> Column:
    """One number for an address across editions."""
    return book.cast("long") * 1_000_000 + chapter * 1000 + verse


def from_bcv(code: Column) -> tuple[Column, Column, Column]:
    """Book, chapter and verse of an address number."""
    return F.floor(code / 1_000_000).cast("int"), (F.floor(code / 1000) % 1000).cast("int"), (code % 1000).cast("int")


def addressed(units: DataFrame) -> DataFrame:
    """Units with the derived address columns and a text that is never null."""
    return units.withColumn("chapter_verse", chapter_verse(F.col("chapter"), F.col("verse"))).withColumn("bcv", bcv(F.col("book"), F.col("chapter"), F.col("verse"))).withColumn("text", F.coalesce("text", F.lit("")))


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, with the largest ``order``; of tied rows one is taken.

    Null keys form groups as in SQL grouping. Whole rows are shuffled.
    """
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*rows.columns)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of each key with the largest ``order``, whose last column is unique, so that one row a key stays.

    Made for tables where few keys repeat: only keys and order columns are aggregated, and whole rows meet just the repeated
    keys, by a broadcast that Spark chooses while those are few. Null keys form groups as in SQL grouping.
    """
    top = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("_n"), F.max(F.struct(*order)).alias("_top")).where("_n > 1")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = rows.join(top, reduce(lambda a, b: a & b, same), "left")
    return joined.where(F.col("_top").isNull() | (F.col("_top") == F.struct(*order))).select(*rows.columns)


def units(spark: SparkSession, root: str, text: bool = True, modules: Iterable[str] | None = None, inside: Column | None = None) -> DataFrame:
    """The current row of every unit of every edition: a unit that was loaded again counts by its last load.

    Without ``text`` only addresses are read and shuffled. ``modules`` are the editions wanted, ``inside`` a condition on the
    address (``book``, ``chapter``, ``verse``, ``chapter_verse``), which all loads of a unit share. Both are tested before the
    newest loads are sought, so every scan of the plan is pruned by them.
    """
    rows = table(spark, root, "verses")
    rows = rows if modules is None else rows.where(F.col("module").isin(*modules))
    rows = rows if inside is None else rows.where(inside)
    columns = ["row_id", "module", "id", "book", "chapter", "verse", *(["text"] if text else []), "loaded_at"]
    rows = latest(rows.select(*columns), ["module", "id"], ["loaded_at", "row_id"])
    return addressed(rows if text else rows.withColumn("text", F.lit(None).cast("string")))


SMALL = 64 << 20  # bytes up to which a dimension is broadcast


def small(dimension: DataFrame) -> DataFrame:
    """``dimension`` marked for broadcast if its estimated size allows; else Spark decides when it knows the real one."""
    size = dimension._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(dimension) if int(size) <= SMALL else dimension
