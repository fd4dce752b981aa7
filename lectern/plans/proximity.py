"""Chains of terms near each other.

A unit is in the result of ``A hop B hop C`` if it takes part in some chain: it matches a term that is reachable from the
first term forwards and from which the last is reached. Forward flags pass from term to term, backward flags return, and
what is left of each term's matches is the result, so no tuple of the chain is ever built.

Flags pass over a distance in ids by window maxima. Windows are cut into blocks of ids with a margin of copied rows, so a
book of any size spreads over as many tasks as it has blocks, and all hops of a chain share one exchange. Flags pass over a
chapter by a window and over a book by a small aggregate of the flagged books and a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import durable
from .search import Hop, Search, column

BLOCK = 4096  # ids of one edition that a task looks at together
SCOPED = frozenset({19})


def _scope(hop: Hop, scoped_books: frozenset[int]) -> Column:
    chapter = F.col("chapter")
    return chapter if hop.kind == "proc" else F.when(F.col("book").isin(*scoped_books), chapter).otherwise(0) if scoped_books else F.lit(0)


def _near(flag: str, hop: Hop, distance: int, scoped_books: frozenset[int]) -> Column:
    w = W.partitionBy("module", "_block", "book", _scope(hop, scoped_books)).orderBy("id").rangeBetween(-distance, distance)
    return F.max(F.col(flag)).over(w)


def _within_blocks(df: DataFrame, search: Search, distances: list[int], scoped_books: frozenset[int], width: int) -> DataFrame:
    """Forward and backward flags of a chain that has distance hops only, in one exchange."""
    margin = sum(distances)
    block = F.floor(F.col("id") / BLOCK)
    copies = F.sequence(F.floor((F.col("id") - margin) / BLOCK), F.floor((F.col("id") + margin) / BLOCK))
    # a row can only matter if it matches some term, so the others never leave the scan
    any_match = reduce(lambda a, b: a | b, [F.col(f"_m{k}") for k in range(width)])
    rows = df.where(any_match).withColumn("_home", block).withColumn("_block", F.explode(copies)).repartition("module", "_block")
    rows = rows.withColumn("_f0", F.col("_m0") & F.col("_inside"))
    for k in range(1, width):
        rows = rows.withColumn(f"_f{k}", F.col(f"_m{k}") & _near(f"_f{k - 1}", search.hops[k - 1], distances[k - 1], scoped_books))
    rows = rows.withColumn(f"_b{width - 1}", F.col(f"_f{width - 1}"))
    for k in range(width - 2, -1, -1):
        rows = rows.withColumn(f"_b{k}", F.col(f"_f{k}") & _near(f"_b{k + 1}", search.hops[k], distances[k], scoped_books))
    return rows.where(F.col("_block") == F.col("_home"))


def _pass(df: DataFrame, flag: str, hop: Hop, distance: int, scoped_books: frozenset[int]) -> DataFrame:
    """``df`` with ``_near``: whether a row flagged ``flag`` is in reach over one hop.

    A chapter is small enough for a window. A book may not be, so its flag is aggregated and joined back; the rows are kept
    before that, as they are read twice.
    """
    if hop.kind == "chap":
        return df.withColumn("_near", F.max(F.col(flag)).over(W.partitionBy("module", "book", "chapter")))
    if hop.kind == "book":
        df = durable(df)
        hit = df.where(F.col(flag)).select("module", "book").distinct().withColumn("_near", F.lit(True))
        return df.join(hit, ["module", "book"], "left").withColumn("_near", F.coalesce("_near", F.lit(False)))
    copies = F.sequence(F.floor((F.col("id") - distance) / BLOCK), F.floor((F.col("id") + distance) / BLOCK))
    rows = df.withColumn("_home", F.floor(F.col("id") / BLOCK)).withColumn("_block", F.explode(copies)).repartition("module", "_block")
    return rows.withColumn("_near", _near(flag, hop, distance, scoped_books)).where(F.col("_block") == F.col("_home")).drop("_home", "_block")


def chain(units: DataFrame, search: Search, inside: Column | None = None, default_distance: int = 5, scoped_books: frozenset[int] = SCOPED, **how: bool) -> DataFrame:
    """Units that take part in a chain of terms near each other.

    ``units`` has ``module, id, book, chapter, text`` and whatever else; its columns come back. Distance counts ids, never
    leaves the book, and never the chapter in ``scoped_books`` or for ``proc``. ``inside`` restricts the first term and the
    result, not the terms between. Null texts match nothing; a repeated unit is judged like the first; an empty table gives
    an empty result.
    """
    width = len(search.parts)
    text = F.coalesce(F.col("text"), F.lit(""))
    inside = F.lit(True) if inside is None else F.coalesce(inside, F.lit(False))
    df = units.withColumn("_inside", inside)
    for k, part in enumerate(search.parts):
        df = df.withColumn(f"_m{k}", column(part, text, **how))
    if width == 1:
        return df.where(F.col("_m0") & F.col("_inside")).select(*units.columns)
    distances = [default_distance if h.distance is None else h.distance for h in search.hops]
    if all(h.kind in ("prox", "proc") for h in search.hops):
        rows = _within_blocks(df, search, distances, scoped_books, width)
    else:
        rows = df.where(reduce(lambda a, b: a | b, [F.col(f"_m{k}") for k in range(width)])).withColumn("_f0", F.col("_m0") & F.col("_inside"))
        for k in range(1, width):
            rows = _pass(rows, f"_f{k - 1}", search.hops[k - 1], distances[k - 1], scoped_books).withColumn(f"_f{k}", F.col(f"_m{k}") & F.col("_near")).drop("_near")
        rows = rows.withColumn(f"_b{width - 1}", F.col(f"_f{width - 1}"))
        for k in range(width - 2, -1, -1):
            rows = _pass(rows, f"_b{k + 1}", search.hops[k], distances[k], scoped_books).withColumn(f"_b{k}", F.col(f"_f{k}") & F.col("_near")).drop("_near")
    keep = reduce(lambda a, b: a | b, [F.col(f"_b{k}") for k in range(width)])
    return rows.where(keep & F.col("_inside")).select(*units.columns)
