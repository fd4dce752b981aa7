"""Mixing sources to target weights."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import durable
from .tokens import token_counts

MOST_SOURCES = 10_000  # a target table is a setting; a larger one is refused, as its rates are worked out on the driver


def source_key(col):
    """Sources match without regard to case and outer blanks."""
    return F.lower(F.trim(col))


def repetition_rates(available: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """How often each source is used on average, so that the shares of the result meet the weights.

    ``total`` is the wished size, by default all that the target sources hold. A source whose share would need more than
    its allowed repeats gives all it may; what it lacks goes to the others in proportion to their weights, until every
    remaining source has enough. Sources without content get rate 0.
    """
    left = {s for s, (w, r) in targets.items() if available.get(s, 0) > 0 and w > 0 and r > 0}
    goal = float(sum(available[s] for s in left) if total is None else total)
    rates = dict.fromkeys(targets, 0.0)
    while left and goal > 0:
        weight = sum(targets[s][0] for s in left)
        short = {s for s in left if goal * targets[s][0] / weight >= targets[s][1] * available[s]}
        if not short:
            for s in left:
                rates[s] = goal * targets[s][0] / weight / available[s]
            break
        for s in short:
            rates[s] = float(targets[s][1])
            goal -= targets[s][1] * available[s]
        left -= short
    return rates


def largest_exact(available: dict[str, int], targets: dict[str, tuple[float, int]]) -> float:
    """The largest size at which every source that has content meets its weight within its repeats.

    Weights of sources without content are spread over the others.
    """
    held = {s: w for s, (w, r) in targets.items() if available.get(s, 0) > 0 and w > 0 and r > 0}
    return min((targets[s][1] * available[s] * sum(held.values()) / w for s, w in held.items()), default=0.0)


SEEDS = 16  # draws tried for each source


class Mixture:
    """Documents of several sources combined to target weights, measured in tokens.

    ``total`` is the wished size in tokens, by default all that the target sources hold, at which sources with too little give
    all they may; ``exact`` asks for the largest size at which every source that has content meets its weight instead.

    The last copy of a document is a draw by a hash of its id and its source's seed. Of ``SEEDS`` seeds each source takes the
    one whose draw comes nearest to its target, as whole documents of a small source may miss it by far.

    ``targets`` has ``source, weight, max_repeats``; repeated sources, null sources and null weights in it are refused
    or ignored as stated: a null source or weight is ignored, a null ``max_repeats`` counts as 1, and two rows of one
    source are an error. Documents of other sources, of null sources and with no tokens aren't chosen. Extra columns of
    either table aren't read; repeated documents are chosen independently of nothing but their id, so equal ids get
    equal repeats.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total: float | None = None, seed: int = 17, exact: bool = False):
        rows = targets.select(source_key("source").alias("s"), F.col("weight").cast("double").alias("w"), F.coalesce(F.col("max_repeats").cast("long"), F.lit(1)).alias("r")).where("s is not null and w is not null").limit(MOST_SOURCES + 1).collect()
        self.targets = {x.s: (x.w, x.r) for x in rows}
        if len(rows) > MOST_SOURCES or len(self.targets) < len(rows):
            raise ValueError("a target table has one row a source and at most %d rows" % MOST_SOURCES)
        self.spark, self.id_col, self.seed = docs.sparkSession, id_col, seed
        wanted = docs.select(F.col(id_col), F.col(text_col), source_key(F.col(source_col)).alias("source")).where(F.col("source").isin(list(self.targets)))
        self.counts = durable(token_counts(wanted, id_col, text_col, ["source"]).where("n_tokens > 0"))
        self.available = {x.source: x.n for x in self.counts.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
        self.rates = repetition_rates(self.available, self.targets, largest_exact(self.available, self.targets) if exact else total)
        self.seeds = self._best_seeds()

    def _draw(self, seed: Column) -> Column:
        return F.pmod(F.xxhash64(seed, F.col(self.id_col)), F.lit(1 << 52)) / F.lit(float(1 << 52))

    def _best_seeds(self) -> dict[str, int]:
        """Of each source the seed whose draw meets the fraction of its rate best; one aggregate over the counts, a row a source."""
        wanted = {s: r - int(r) for s, r in self.rates.items() if r - int(r) > 0}
        if not wanted:
            return {}
        part = F.create_map(*chain.from_iterable((F.lit(s), F.lit(v)) for s, v in wanted.items()))[F.col("source")]
        drawn = [F.sum(F.when(self._draw(F.lit(self.seed + k)) < part, F.col("n_tokens")).otherwise(0)).alias(f"s{k}") for k in range(SEEDS)]
        rows = self.counts.where(F.col("source").isin(list(wanted))).groupBy("source").agg(*drawn).collect()
        return {x.source: self.seed + min(range(SEEDS), key=lambda k: abs(x[f"s{k}"] - wanted[x.source] * self.available[x.source])) for x in rows}

    def _rates(self) -> DataFrame:
        goal = sum(self.rates[s] * self.available.get(s, 0) for s in self.targets)
        whole = sum(w for w, _ in self.targets.values()) or 1.0
        rows = []
        for s, (w, r) in self.targets.items():
            given = self.rates[s] * self.available.get(s, 0)
            rows.append((s, w, int(r), self.available.get(s, 0), float(self.rates[s]), self.seeds.get(s, self.seed), max(0.0, goal * w / whole - given)))
        return self.spark.createDataFrame(rows, "source string, weight double, max_repeats long, available long, rate double, seed int, shortfall double")

    def chosen(self) -> DataFrame:
        """``<id>, source, n_tokens, repeats``: the chosen documents; each counts floor(rate) times, and once more by a hash-seeded draw."""
        draw, rate = self._draw(F.col("seed")), F.col("rate")
        repeats = (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")
        # the rates are at most MOST_SOURCES rows, so their broadcast is bounded
        joined = self.counts.join(F.broadcast(self._rates().select("source", "rate", "seed")), "source")
        return joined.withColumn("repeats", repeats).where("repeats > 0").select(self.id_col, "source", "n_tokens", "repeats")

    def copies(self) -> DataFrame:
        """The mixture as rows, one for each copy: ``<id>, source, n_tokens, copy`` (from 1)."""
        return self.chosen().select(self.id_col, "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("copy"))

    def shares(self) -> DataFrame:
        """A row for each target source: target weight, what it holds, rate, shortfall, and what the mixture really has of it.

        ``shortfall`` are the tokens that a source's rate leaves it short of its weight of the mixture, ``share`` is its actual one.
        """
        used = self.chosen().groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("repeats").alias("n_copies"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
        rows = self._rates().drop("seed").join(used, "source", "left").fillna(0, ["n_docs", "n_copies", "tokens"])
        total = rows.agg(F.sum("tokens")).first()[0] or 0
        return rows.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
