"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked


def draws(key: Column, weights: Sequence[float], first: int = 0) -> list[Column]:
    """The draw and number of each shard of some weight, numbered from `first`."""
    if any(w < 0 or not math.isfinite(w) for w in weights):
        raise ValueError("weights must be finite and not negative")
    out = []
    for i, w in enumerate(weights, first):
        if w:
            u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"#{i}"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
            out.append(F.struct((-F.log(u) / float(w)).alias("draw"), F.lit(i).alias("shard")))
    return out


def winner(drawn: list[Column]) -> Column:
    """The least draw with its shard; of equal draws, that of the lower number."""
    if not drawn:
        raise ValueError("weights must not be all 0")
    return F.least(*drawn) if len(drawn) > 1 else drawn[0]


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a string key: each shard draws -ln(u) / weight, u from a hash of key and shard; the least draw wins.

    A shard's draws don't depend on the other shards, so one more shard takes rows only into itself, and a
    changed weight moves only rows that this shard gains or loses.  A shard of weight 0 gets no rows.
    """
    return winner(draws(key, weights)).getField("shard").cast("int")


def record_key(docs: DataFrame) -> Column:
    """doc_id as text; where it is null, a digest of the text, so that such rows spread too."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))


def shard(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """All rows of `docs` (doc_id, text) with size, text_crc32, law, shard, slot and grown_shard.

    law is `key`: the key and the shards alone decide.  size: bytes of the text plus 1.  slot: a gapless number
    from 0 within the shard, in no order that matters.  grown_shard: the shard under `grown`, one weight more.
    A null text is empty, a very long one is one row like any other; rows of equal doc_id go to one shard, each with a
    slot of its own.  A row of null doc_id has its text in place of the key, so such rows spread too.  Other columns are
    left out.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    more = [1.0] if grown is None else grown[len(weights) :] if [*grown[: len(weights)]] == [*weights] else None
    drawn = docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), record_key(docs).alias("key_"), winner(draws(record_key(docs), weights)).alias("won_"))
    if more is None:  # other weights, all shards draw again
        won = winner(draws(F.col("key_"), grown))
    else:  # the shards that were there keep their draws
        won = winner([F.col("won_"), *draws(F.col("key_"), more, len(weights))])
    rows = drawn.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("won_.shard").cast("int").alias("shard"), won.getField("shard").cast("int").alias("grown_shard"))
    out, _ = ranked(rows, "shard", len(weights), "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, weights: Sequence[float], path: str, files_per_shard: int = 8) -> None:
    """Whole rows written as Parquet below one folder for each shard; a hot shard is spread over several files."""
    rows = docs.withColumn("shard_", rendezvous(record_key(docs), weights))
    rows.repartition(len(weights) * files_per_shard, "shard_", F.pmod(F.xxhash64(record_key(docs)), F.lit(files_per_shard))).write.partitionBy("shard_").parquet(path)
