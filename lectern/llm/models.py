"""Fitted models as artifacts, so that they are fitted once and used by many jobs."""

from __future__ import annotations

import pickle
from typing import Any

from pyspark.sql import SparkSession


def save_model(spark: SparkSession, model: Any, path: str) -> None:
    """Write a language or abuse model, whose size is bounded by its sample, to any folder that Spark can write."""
    spark.createDataFrame([(type(model).__name__, pickle.dumps(model))], "kind string, model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Any:
    """A model that ``save_model`` wrote. Only load files of your own: a pickled object may run code."""
    row = spark.read.parquet(path).first()
    if row is None:
        raise ValueError(f"no model in {path}")
    return pickle.loads(row.model)
