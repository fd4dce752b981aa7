"""Shared plumbing of the Arrow-batched operators."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import durable as durable

Batches = Iterator[pa.RecordBatch]


def arrow_schema(schema: T.StructType) -> pa.Schema:
    """The Arrow schema that Spark expects back for ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once an application, so that workers need no path of the driver's."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="lectern-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, fn: Callable[[Batches], Iterable[dict[str, Any]]], ddl: str) -> DataFrame:
    """``mapInArrow`` whose function yields dicts of columns; a dict without rows gives no batch."""
    schema = T._parse_datatype_string(ddl)
    ship(df.sparkSession)

    def run(batches: Batches) -> Batches:
        out = arrow_schema(schema)
        for cols in fn(batches):
            arrays = [cols[f.name] if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], f.type) for f in out]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return df.mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt out to all of them before costly work.

    That is only so where the whole input is small (one file of one row group, say); other plans stay as they are.
    """
    plan = df._jdf.queryExecution().executedPlan()
    if "Exchange" in plan.toString() or plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under names of its own, so extra columns cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("rec_id"), F.col(text_col).cast("string").alias("text"))
