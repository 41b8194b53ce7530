"""Shards by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speccurve.llm.common import maybe_broadcast, stored, text_bytes

# Rows that share one numbering task at most, apart from rows of one input partition.
ROWS_PER_BUCKET = 100_000
LEAST_BUCKETS = 8
# What a record costs besides its text.
RECORD_BYTES = 16


def _cost(key: Column, shard: Column, weight: Column) -> Column:
    """-ln(u) / weight with u in (0, 1) from the 53 upper bits of a hash of key and shard."""
    bits = F.shiftrightunsigned(F.xxhash64(key, shard.cast("int")), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / weight


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """struct(cost, shard) of the shard with the least cost for ``key``.

    A shard wins with a probability in proportion to its weight, whatever the
    other shards are, so another shard takes rows only into itself, and a
    removed shard gives up only its own rows.  Equal keys share a shard; a null
    key counts as one more key.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    table = F.array(*[F.lit(float(w)) for w in weights])
    costs = F.transform(
        table, lambda w, i: F.struct(_cost(key, i, w).alias("cost"), i.alias("shard"))
    )
    return F.array_min(costs)


def assign_shards(
    df: DataFrame,
    weights: Sequence[float],
    key: str = "doc_id",
    text: str = "text",
    grown_weight: float = 1.0,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per record: key, size, text_crc32, shard, slot, grown_shard.

    ``grown_shard`` is the shard once one more shard of ``grown_weight`` is
    there.  ``size`` is UTF-8 bytes plus 16.  ``slot`` counts the records of a
    shard from 0 without gaps, in the order of hash buckets and then of keys;
    repeated rows and null keys keep their rows and get slots of their own.  A
    null text counts as an empty one.  Other columns are ignored; an empty
    table gives no rows.

    The text is read once.  Numbering needs one shuffle of narrow rows: rows of
    a shard are dealt to hash buckets, a bucket starts where the counts of
    those before it end.  The number of the input partition takes part in the
    hash, so that no single key, however frequent, fills a bucket.
    """
    shards = len(weights)
    best = rendezvous(F.col(key), weights)
    more = _cost(F.col(key), F.lit(shards), F.lit(float(grown_weight)))
    narrow = (
        df.select(
            F.col(key).alias("_key"),
            (text_bytes(F.col(text)) + RECORD_BYTES).alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            F.spark_partition_id().alias("_part"),
            best.alias("_best"),
            more.alias("_more"),
        )
        .select(
            "_key", "size", "text_crc32", "_part",
            F.col("_best.shard").alias("shard"),
            F.when(F.col("_more") < F.col("_best.cost"), shards)
            .otherwise(F.col("_best.shard"))
            .alias("grown_shard"),
        )
    )
    narrow = stored(narrow, "shards")
    buckets = max(LEAST_BUCKETS, -(-narrow.count() // (shards * rows_per_bucket)))
    spread = F.pmod(F.xxhash64("_key", "size", "text_crc32", "_part"), F.lit(buckets))
    narrow = narrow.withColumn("_bucket", spread)
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        narrow.groupBy("shard", "_bucket").count()
        .select(
            "shard", "_bucket",
            F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"),
        )
    )
    inside = Window.partitionBy("shard", "_bucket").orderBy("_key", "size", "text_crc32", "_part")
    placed = narrow.withColumn("_place", F.row_number().over(inside) - 1)
    return placed.join(
        maybe_broadcast(starts, shards * buckets, 40), ["shard", "_bucket"]
    ).select(
        F.col("_key").alias(key), "size", "text_crc32", "shard",
        (F.col("_start") + F.col("_place")).cast("long").alias("slot"), "grown_shard",
    )


def write_shards(df: DataFrame, assigned: DataFrame, folder: str, key: str = "doc_id") -> None:
    """Write whole records below ``folder``, one directory per shard.

    Records meet their shard by key (a null key meets a null key).
    """
    shard_of = assigned.groupBy(F.col(key).alias("_key")).agg(F.min("shard").alias("shard"))
    (
        df.join(shard_of, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
        .write.partitionBy("shard").parquet(folder)
    )
