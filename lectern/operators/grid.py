"""Generic filtering, sorting and paging of a table by rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED = "_no_rest_"  # a value that stands for no restriction


def rule(field: str, op: str, value) -> Column:
    """One test: eq ne lt le gt ge, bw bn (begins with, doesn't), ew en (ends), cn nc (contains). Null fields fail all but the negated ones."""
    c, v = F.col(field), F.lit(value)
    text, part = c.cast("string"), F.lit(str(value))
    positive = {"bw": text.startswith(part), "ew": text.endswith(part), "cn": text.contains(part)}
    negative = {"bn": "bw", "en": "ew", "nc": "cn"}
    plain = {"eq": c == v, "ne": c != v, "lt": c < v, "le": c <= v, "gt": c > v, "ge": c >= v}
    if op in plain:
        return F.coalesce(plain[op], F.lit(op == "ne"))
    if op in positive:
        return F.coalesce(positive[op], F.lit(False))
    if op in negative:
        return ~F.coalesce(positive[negative[op]], F.lit(False))
    raise ValueError(f"unknown operator: {op}")


def condition(rules: list[dict], group: str = "AND", fields: dict[str, str] | None = None) -> Column:
    """Rules joined by AND or OR; ``fields`` maps shown names to columns. No effective rule means no restriction."""
    parts = [rule((fields or {}).get(r["field"], r["field"]), r["op"], r["data"]) for r in rules if r["data"] != IGNORED]
    if not parts:
        return F.lit(True)
    return reduce((lambda a, b: a & b) if group.upper() == "AND" else (lambda a, b: a | b), parts)


def grid(df: DataFrame, rules: list[dict], group: str = "AND", fields: dict[str, str] | None = None, post: Column | None = None, sort: str | None = None, descending: bool = False, page: int = 1, size: int = 30, tie: str = "id") -> DataFrame:
    """A filtered, sorted page; ``post`` is always ANDed, whatever joins the rules."""
    rows = df.where(condition(rules, group, fields))
    if post is not None:
        rows = rows.where(post)
    key = (fields or {}).get(sort, sort) if sort else tie
    order = F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_first()
    return rows.orderBy(order, tie).offset((page - 1) * size).limit(size)


def is_free(df: DataFrame, field: str, value, id_col: str, own_id=None) -> bool:
    """Whether no other row has this value."""
    taken = df.where(F.col(field) == value)
    return taken.where(F.col(id_col) != own_id).isEmpty() if own_id is not None else taken.isEmpty()


def unshared(rows: DataFrame, field: str, id_col: str) -> DataFrame:
    """Rows whose value of a field no row of another id has; nulls are no values."""
    one = rows.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("_v")).agg(F.min(id_col).alias("_lo"), F.max(id_col).alias("_hi")).where("_lo = _hi").select("_v")
    return rows.join(one, F.col(field) == F.col("_v"), "left_semi")
