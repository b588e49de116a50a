"""Memory of keys that outlives a stream's runs, in buckets with a Bloom filter each (STM1, STM3, STM5).

A key belongs to a bucket by its hash; rows lie in one folder a bucket and epoch, and each
epoch leaves a filter of its keys in every bucket that it added to.  A micro-batch asks
the filters first and reads only the buckets in which one of its keys may be, so what it
reads follows the batch and not the memory.  Filters are bitmaps of built-in functions;
a key is known for sure only after the anti-join with the rows themselves.  An epoch that
is tried again writes the same folders and doesn't look at its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a memory, bits of a filter and probes of a key; a memory keeps those it began with.
BUCKETS, BITS, PROBES = 64, 1 << 17, 4


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _probes(df: DataFrame, keys: list[str]) -> DataFrame:
    """(bucket, keys, part, bit) for each probe of each key."""
    at = [F.pmod(F.xxhash64(F.lit(n), *keys), F.lit(BITS)) + 1 for n in range(PROBES)]
    probes = df.select(_bucket(keys).alias("bucket"), *keys, F.explode(F.array(*at)).alias("_at"))
    return probes.select("bucket", *keys, F.bitmap_bucket_number("_at").alias("part"), F.bitmap_bit_position("_at").alias("bit"))


def filters(df: DataFrame, keys: list[str]) -> DataFrame:
    """(bucket, part, bits): the Bloom filter of the keys of each bucket."""
    return _probes(df, keys).groupBy("bucket", "part").agg(F.bitmap_construct_agg("bit").alias("bits"))


def buckets_to_read(batch: DataFrame, blooms: DataFrame, keys: list[str]) -> list[int]:
    """Buckets in which a key of the batch may be; at most ``BUCKETS`` numbers."""
    every = blooms.groupBy("bucket", "part").agg(F.bitmap_or_agg("bits").alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.get(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda n: F.floor(byte / F.pow(F.lit(2), n)) % 2 == 1), (F.col("bit") % 8).cast("int"))
    asked = _probes(batch.select(*keys).distinct(), keys).join(every, ["bucket", "part"], "left")
    may = asked.groupBy("bucket", F.struct(*keys).alias("key")).agg(F.bool_and(F.coalesce(hit, F.lit(False))).alias("may")).filter("may")
    return sorted(r.bucket for r in may.select("bucket").distinct().collect())


def rows(spark: SparkSession, path: str) -> DataFrame:
    """All that is remembered."""
    return spark.read.parquet(f"{path}/rows")


def candidates(batch: DataFrame, path: str, keys: list[str], epoch: int) -> DataFrame | None:
    """Remembered rows of the buckets that may hold a key of the batch, but for the epoch's own; None where no bucket does."""
    spark = batch.sparkSession
    if not _exists(spark, f"{path}/filters"):
        return None
    blooms = spark.read.parquet(f"{path}/filters").filter(F.col("epoch") != epoch)
    wanted = buckets_to_read(batch, blooms, keys)
    return rows(spark, path).filter(F.col("bucket").isin(wanted) & (F.col("epoch") != epoch)) if wanted else None


def remember(batch: DataFrame, path: str, keys: list[str], epoch: int) -> None:
    """Appends the batch's new keys, the first row of each, and their filters."""
    batch = batch.persist()  # read for the filters, for the join and for writing
    try:
        fresh = batch.dropDuplicates(keys)
        known = candidates(batch, path, keys, epoch)
        if known is not None:
            pair = [fresh[k].eqNullSafe(known[k]) for k in keys]
            fresh = fresh.join(known.select(*keys).distinct(), pair if len(pair) > 1 else pair[0], "left_anti")
        own = fresh.withColumns({"bucket": _bucket(keys), "epoch": F.lit(epoch)})
        for df, at, by in ((own, "rows", ("bucket", "epoch")), (filters(fresh, keys).withColumn("epoch", F.lit(epoch)), "filters", ("epoch",))):
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{path}/{at}")
    finally:
        batch.unpersist()


def into_memory(df: DataFrame, path: str, checkpoint: str, keys: list[str]):
    """STM1, STM3, STM5: each micro-batch's new keys appended to the memory, whatever is tried again."""
    return df.writeStream.foreachBatch(lambda batch, epoch: remember(batch, path, keys, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
