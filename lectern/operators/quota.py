"""Usage limits over a log of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counted(log: DataFrame, action: str, free: frozenset[str]) -> DataFrame:
    """The requests that count; free actions don't."""
    return log.where(~F.coalesce(F.col(action).isin(*free), F.lit(False))) if free else log


def daily_usage(log: DataFrame, client: str, ts: str, limit: int | Column = 2000) -> DataFrame:
    """``client, day, hits, accepted, limit_reached``. Exactly ``limit`` requests a day are accepted; 0 is no limit, below 0 revoked.

    Requests without a client form one client of their own. Counting combines before the shuffle, so a hot client is cheap.
    """
    cap = F.lit(limit) if isinstance(limit, int) else limit
    n = log.groupBy(F.col(client).alias("client"), F.to_date(ts).alias("day")).agg(F.count("*").alias("hits"))
    accepted = F.when(cap < 0, F.lit(0)).when(cap == 0, F.col("hits")).otherwise(F.least("hits", cap)).cast("long")
    return n.withColumn("accepted", accepted).withColumn("limit_reached", (cap < 0) | ((cap > 0) & (F.col("hits") >= cap)))


def accepted_requests(log: DataFrame, client: str, ts: str, tie: str, limit: int) -> DataFrame:
    """The requests that a daily limit lets through: the first ``limit`` of each client and day.

    The rank filter is pushed before the shuffle by Spark, so each task sends at most ``limit`` rows of a key.
    """
    if limit == 0:
        return log
    if limit < 0:
        return log.limit(0)
    w = W.partitionBy(F.col(client), F.to_date(ts)).orderBy(ts, tie)
    return log.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= limit).drop("_rank")


def throttled(log: DataFrame, client: str, ts: str, per_minute: int = 60) -> DataFrame:
    """``client, minute, hits, rejected`` of tumbling minutes."""
    n = log.groupBy(F.col(client).alias("client"), F.date_trunc("minute", ts).cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("hits"))
    return n.withColumn("rejected", F.greatest(F.col("hits") - per_minute, F.lit(0)))


def hits_by_key(log: DataFrame, key: str, client: str, ts: str) -> DataFrame:
    """``key, client, day, hits``."""
    return log.groupBy(F.col(key).alias("key"), F.col(client).alias("client"), F.to_date(ts).alias("day")).agg(F.count("*").alias("hits"))


def effective_limit(whitelisted: Column, same_host: Column, private: Column, own: Column, level: Column, default: int = 2000) -> Column:
    """0 (no limit) for whitelisted or own hosts, -1 (revoked) in private mode, else own limit, level limit, default."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(whitelisted) | yes(same_host), 0).when(yes(private), -1).otherwise(F.coalesce(own, level, F.lit(default))).cast("int")


def permitted(action: Column, allowed: Column) -> Column:
    """Whether an access level allows an action; a level without a list allows all."""
    return F.coalesce(F.array_contains(allowed, action), F.lit(True))
