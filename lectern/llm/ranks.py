"""Gapless ranks within keys, without bringing the rows of a key together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def _counted(key: str, n_keys: int):
    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(n_keys, np.int64)
        for b in batches:
            k = b.column(key).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(k, kind="stable")
            s = k[order]
            first = np.flatnonzero(np.diff(s, prepend=-1))
            rank = np.empty(len(k), np.int64)
            rank[order] = np.arange(len(k)) - np.repeat(first, np.diff(np.append(first, len(k)))) + seen[s]
            seen += np.bincount(k, minlength=n_keys)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(k), part, np.int64)), pa.array(rank)], names=[*b.schema.names, "part_", "in_part_"])

    return run


def ranked(df: DataFrame, key: str, n_keys: int, name: str = "rank") -> tuple[DataFrame, DataFrame]:
    """The frame with a rank from 0 among the rows of an equal key (an integer in [0, n_keys)), and the counts of all keys.

    Each task numbers its own rows key by key and the numbered rows are written; then only the counts by
    task and key are summed up, so a key with any share of the rows stays spread over all tasks.
    """
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("part_", T.LongType()), T.StructField("in_part_", T.LongType())])
    rows = written(df.mapInArrow(_counted(key, n_keys), schema), "ranked")
    by_part = rows.groupBy(key, "part_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(key).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_part.select(key, "part_", F.coalesce(before, F.lit(0)).alias("before_"))
    out = rows.join(offsets, [key, "part_"]).withColumn(name, F.col("before_") + F.col("in_part_")).drop("part_", "in_part_", "before_")
    return out, by_part.groupBy(key).agg(F.sum("n_").alias("n"))
