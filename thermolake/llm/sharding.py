"""Sharding by a two-pass external shuffle.

Pass one scatters records into memory-sized buckets by a seeded hash of their id. Pass two puts each bucket in id
order, shuffles it with Spark's seeded ``shuffle`` (a Fisher-Yates shuffle) and numbers its records after those of
all earlier buckets. Shards are equal runs of that order, so their row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_offsets, n_pieces, stored

BUCKET_BYTES = 16 << 20
SEED = 20240131


def external_shuffle(
    records: DataFrame,
    n_shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    seed: int = SEED,
) -> DataFrame:
    """One row (shard int, slot long, record struct) for each record, repeated and null ones included.

    ``record`` holds all columns, whatever their names. Slots of a shard run from 0 without gaps. Records with the
    same id share a bucket. An empty table gives no rows. A record longer than a bucket makes its bucket longer.
    """
    bytes_col = F.coalesce(F.octet_length(text_col), F.lit(0)) + 1
    n_rows, n_bytes = records.agg(F.count("*"), F.coalesce(F.sum(bytes_col), F.lit(0))).first()
    n_buckets = n_pieces(n_bytes, bucket_bytes)
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(n_buckets))
    # ids alone give the bucket sizes, hence where each bucket starts
    sizes = records.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    starts = stored(add_offsets(sizes, [], "bucket", "n", "start"), "shard-starts").select("bucket", "start")
    shuffled = (
        records.select(bucket.alias("bucket"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"),
                       F.struct("*").alias("record"))
        .repartition(n_buckets, "bucket")
        .groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("id", "h", "record"))).alias("records"))
        # the shuffle draws from one generator per partition: with buckets in order it is the same on every run
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle("records", seed).alias("records"))
    )
    position = F.col("start") + F.col("i")
    shard = F.floor(((position + 1) * n_shards - 1) / F.lit(max(n_rows, 1)))
    return (
        shuffled.join(starts, "bucket")
        .select("start", F.posexplode("records").alias("i", "r"))
        .select(shard.cast("int").alias("shard"), position.alias("position"), F.col("r.record").alias("record"))
        .select("shard", (F.col("position") - F.floor(F.col("shard").cast("long") * n_rows / n_shards)).alias("slot"),
                "record")
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Writes one folder per shard; files of a shard follow each other in slot order."""
    (shuffled.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .select("shard", "slot", "record.*").write.partitionBy("shard").parquet(path))


def shard_digest(shuffled: DataFrame) -> DataFrame:
    """What the shuffled records hold: sizes and checksums of their texts."""
    text = F.col("record.text")
    return shuffled.select(
        F.col("record.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
