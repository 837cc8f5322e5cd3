"""Folders that all executors share, tables written there to cut lineage, and joins that broadcast only what is small."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows (of a few numbers each) of a side that is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, below a local folder, but only in local mode."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/lectern-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again: a lost executor costs no recomputation.

    The shuffle files of the write aren't read again, so they go as soon as it has ended.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if "/lectern-" in folder:
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The frame, to be broadcast if it has at most BROADCAST_ROWS rows (counted, if the count isn't given)."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def small_batches(df: DataFrame) -> DataFrame:
    """The frame itself; from now on its session sends rows to Python in batches of at most 1000 rows or 4 MB.

    A worker holds a batch, its result and copies of both, so the usual 10 000 long texts would cost it some 200 MB.
    Frames are planned when they are run, so the setting has to stay.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = conf.get(key)  # the default where it isn't set
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def text_bytes(docs: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of text, of a frame with a text column."""
    n, b = docs.select(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return int(n), int(b)


def own_columns(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: other columns can't clash with those that an operator makes."""
    return docs.select(*[F.col(f"`{n}`").cast("long").alias(n) if n == "doc_id" else F.col(f"`{n}`") for n in names])
