"""Sinks: CSV and Parquet outputs, rendered packets and reports. Spark's commit protocol makes a write whole or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def scratch(df: DataFrame) -> DataFrame:
    """The frame as a table in a new folder (`scratch_path`), read again: what is read several times is made once."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Where that setting is unset, a local folder is taken in local mode, and an error is raised on a cluster.
    """
    import tempfile
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/lectern-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, fields: list[str], path: str) -> None:
    """The fields in their order, others left out; arrays are joined by a pipe."""
    flat = [F.array_join(c, "|").alias(c) if df.schema[c].dataType.typeName() == "array" else F.col(c) for c in fields]
    df.select(*flat).write.option("header", True).option("escape", '"').csv(path)


def appended_run(runs: DataFrame, seq: str = "seq") -> DataFrame:
    """Research runs with their citations as JSON text."""
    return runs.withColumn("citations_json", F.to_json("citations"))


def memory_packet(memories: DataFrame, most_links: int = 8) -> DataFrame:
    """article and a rendered section: score, excerpt, external links, and cues of claim status."""
    cues = F.array_compact(F.array(F.when(F.col("excerpt").rlike(r"(?i)\b(alleged|unconfirmed|claimed)\b"), "UNCONFIRMED"), F.when(F.col("excerpt").rlike(r"(?i)\b(document|memo|record)s?\b"), "DOCUMENTED"), F.when(F.col("excerpt").rlike(r"(?i)\b(suggests|implies|likely)\b"), "INFERENCE")))
    links = F.array_join(F.transform(F.slice("links", 1, most_links), lambda l: F.format_string("- [%s](%s)", l["anchor"], l["url"])), "\n")
    return memories.select("article", F.format_string("### %s (%.4f)\nCues: %s\n%s\n%s", "title", "score", F.array_join(cues, ", "), "excerpt", links).alias("section"))


def candidate_packet(memories: DataFrame, most_links: int = 6, most_chars: int = 2600) -> DataFrame:
    return memories.select("article", F.substring("excerpt", 1, most_chars).alias("excerpt"), F.slice("links", 1, most_links).alias("links"))


def curated_links(asked: Column, real: Column) -> Column:
    """The asked URLs that are real ones; all real ones if none is."""
    both = F.array_intersect(asked, real)
    return F.when(F.size(both) == 0, real).otherwise(both)


def audit_rows(results: DataFrame) -> DataFrame:
    return results.select("wr_id", "included", "judged", F.round("score", 4).alias("score"), "relationship")


def voice_packet(passages: DataFrame) -> DataFrame:
    return passages.select("article", F.format_string("> %s\n— %s, paragraph %s (%s)", "text", "title", F.col("number").cast("string"), F.array_join(text.traits(F.col("text")), "; ")).alias("section"))


def link_report(links: DataFrame) -> DataFrame:
    """linked, n and phrases: how often each is linked, and by how many different phrases."""
    return links.groupBy("linked").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("phrase").alias("phrases"))
