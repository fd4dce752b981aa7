"""Several editions side by side, result lists and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def aligned(units: DataFrame, hit: Column, modules: list[str] | None = None) -> DataFrame:
    """Units at any address that some edition matches, with ``unmatched`` for those that don't match themselves.

    One pass decides the matches; the matched addresses come back by a semi-join, which AQE broadcasts if they are few.
    """
    rows = units if modules is None else units.where(F.col("module").isin(modules))
    rows = rows.withColumn("unmatched", ~F.coalesce(hit, F.lit(False)))
    addresses = rows.where(~F.col("unmatched")).select("bcv").distinct()
    return rows.join(addresses, "bcv", "left_semi")


def result_list(hits: DataFrame, page: int = 1, page_size: int = 30) -> DataFrame:
    """Distinct addresses over all editions in canonical order: sort key, address, and whether the page shows it."""
    key = F.concat_ws("_", F.lpad(F.col("book").cast("string"), 2, "0"), F.lpad(F.col("chapter").cast("string"), 3, "0"), F.lpad(F.col("verse").cast("string"), 3, "0"))
    rows = hits.select("book", "chapter", "verse").distinct().withColumn("sort_key", key)
    shown = rows.select("sort_key", "book", "chapter", "verse").orderBy("book", "chapter", "verse").offset((page - 1) * page_size).limit(page_size)
    # the page is at most page_size rows, so its broadcast is bounded
    mark = F.broadcast(shown.select("sort_key").withColumn("_on", F.lit(True)))
    return rows.join(mark, "sort_key", "left").withColumn("showing", F.coalesce("_on", F.lit(False))).drop("_on")


def page(rows: DataFrame, order: list[str | Column], number: int = 1, size: int = 30, most: int = 500) -> DataFrame:
    """One page in a total order; the size is capped by the engine's maximum."""
    size = max(1, min(size, most))
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def envelope(rows: DataFrame, number: int = 1, size: int = 30, most: int = 500) -> DataFrame:
    """Paging facts of a result: total, per_page, current_page, last_page, from, to."""
    size = max(1, min(size, most))
    total = rows.agg(F.count("*").alias("total"))
    first = F.lit((number - 1) * size + 1)
    return total.select(
        "total",
        F.lit(size).alias("per_page"),
        F.lit(number).alias("current_page"),
        F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("long").alias("last_page"),
        F.when(F.col("total") >= first, first).cast("long").alias("from_row"),
        F.when(F.col("total") >= first, F.least(F.lit(number * size), F.col("total"))).cast("long").alias("to_row"),
    )


def first_of_each(rows: DataFrame, keys: list[str], order: list[str | Column], n: int) -> DataFrame:
    """At most ``n`` rows of each key in an order; Spark keeps each task's first ``n`` before the shuffle, so a hot key costs little."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def random_unit(units: DataFrame, seed: int, what: str = "verse") -> DataFrame:
    """One unit, chapter or book picked by an MD5 of the seed and its address; the same seed picks the same."""
    keys = {"verse": ["module", "book", "chapter", "verse"], "chapter": ["module", "book", "chapter"], "book": ["module", "book"]}[what]
    order = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))
    return units.select(*keys).distinct().orderBy(order, *keys).limit(1)
