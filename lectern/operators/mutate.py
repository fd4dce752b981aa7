"""Changes to tables as plans that yield the new table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..corpus import newest
from ..storage import durable


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows whose key it lacks; of repeated new keys one row is taken."""
    new = rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(new.select(*table.columns))


def update_or_create(table: DataFrame, rows: DataFrame, keys: list[str], version: str | list[str]) -> DataFrame:
    """``table``, which has each key once, with ``rows`` put in: of each key the row of the greatest ``version`` stays.

    Only rows of keys that are put in are aggregated; the others pass as they are, joined with the keys alone, which Spark
    broadcasts while they are few. Null keys are keys.
    """
    new = rows.select(*table.columns)
    touched = rows.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    old = table.join(touched, same, "left_semi")
    changed = newest(old.unionByName(new), keys, [version] if isinstance(version, str) else version)
    return table.join(touched, same, "left_anti").unionByName(changed)


def without_editions(units: DataFrame, modules: list[str]) -> DataFrame:
    """Units without those of some editions."""
    return units.where(~F.col("module").isin(*modules))


def replace_edition(units: DataFrame, rows: DataFrame, path: str | None = None) -> DataFrame:
    """Units with the editions in ``rows`` in place of their former ones.

    With ``path`` the rows also replace those editions' folders in the stored table, which is partitioned by ``module``;
    no other folder is touched.
    """
    if path is not None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("module").parquet(path)
    kept = units.join(rows.select("module").distinct(), "module", "left_anti")
    return kept.unionByName(rows.select(*kept.columns))


def cleaned_up(tables: dict[str, DataFrame], rules: dict[str, tuple[str, int]], now: Column) -> dict[str, DataFrame]:
    """The weekly clean-up: each table without the rows that its rule (column of time, months kept) has run out for; other tables stay."""
    gone = lambda c, n: F.coalesce(F.add_months(F.col(c), n) < F.to_date(now), F.lit(False))
    return {k: t.where(~gone(*rules[k])) if k in rules else t for k, t in tables.items()}


def cache_requests(cache: DataFrame, forms: DataFrame, now: Column, months: int = 1) -> DataFrame:
    """The stored cache of requests (``hash, form, created_at``) with new ``forms`` (``form, created_at``) and without those run out.

    A form is kept under the first 24 digits of its SHA-256 with the time it was first asked for.
    """
    new = forms.where("form is not null").groupBy("form").agg(F.min("created_at").alias("created_at")).select(F.substring(F.sha2("form", 256), 1, 24).alias("hash"), "form", "created_at")
    held = cleaned_up({"cache": cache}, {"cache": ("created_at", months)}, now)["cache"]
    return insert_or_ignore(held, new, ["hash"])


def cascade_delete(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent still exists."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def soft_deleted(rows: DataFrame, column: str = "deleted_at") -> DataFrame:
    return rows.where(F.col(column).isNull())


def expired(rows: DataFrame, created: str, now: Column, months: int = 1) -> DataFrame:
    """Rows older than some months."""
    return rows.where(F.add_months(F.col(created), months) < F.to_date(now))


def eviction(artifacts: DataFrame, needed: float, protected: Column, doomed: Column, order: list[Column]) -> DataFrame:
    """Artifacts to delete until ``needed`` is freed, with ``reason``: all that a rule dooms, then greedily in order.

    Sizes of rule deletions count first; a row is deleted as long as what goes before it frees too little. Protected rows
    stay. The running sum is two-level: exact ranges of the order by a range partitioning, so no task holds all rows.
    ``artifacts`` has ``id`` and ``size``.
    """
    rows = artifacts.where(~F.coalesce(protected, F.lit(False))).withColumn("_rule", F.coalesce(doomed, F.lit(False)))
    ruled = rows.where("_rule")
    freed = ruled.agg(F.coalesce(F.sum("size"), F.lit(0.0))).first()[0]
    rest = running_sum(rows.where(~F.col("_rule")), "size", [*order, F.col("id").asc()])
    greedy = rest.where(F.col("_before") + F.lit(float(freed)) < F.lit(float(needed)))
    columns = artifacts.columns
    return ruled.select(*columns, F.lit("rule").alias("reason")).unionByName(greedy.select(*columns, F.lit("space").alias("reason")))


def running_sum(rows: DataFrame, value: str, order: list[Column]) -> DataFrame:
    """``_before``: the sum of all rows before each in a total order, without one task for all.

    Rows are range-partitioned; each partition's total is small, and a window over the totals gives every partition its start.
    Both read the same kept partitioning, as bounds that were sampled twice might differ.
    """
    parted = durable(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inner = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = parted.withColumn("_local", F.coalesce(F.sum(value).over(inner), F.lit(0.0)))
    # one row a partition
    starts = parted.groupBy("_part").agg(F.sum(value).alias("_sum")).withColumn("_start", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    return local.join(F.broadcast(starts.select("_part", "_start")), "_part").withColumn("_before", F.col("_local") + F.col("_start")).drop("_part", "_local", "_start")
