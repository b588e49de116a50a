"""Byte-bounded shards by extendible hashing, with DataFrame operations only.

A directory is indexed by the leading bits of a document's hash.  It starts at
the depth where the mean bucket fits; only buckets over the byte limit split on
further bits.  Each round reads just the rows that are still in an oversized
bucket, as (hash, bytes), sums them on ``step`` more bits and rolls the sums up
to every depth between, so that a split stops at the first depth that fits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, shared, text_of

_BITS = 62  # of the hash that are used; the shift below stays in positive longs


def _prefix(h: Column, depth: Column) -> Column:
    """The first ``depth`` of the hash's bits as a number."""
    return F.call_function("shiftright", h, F.lit(_BITS) - depth)


def _hash(id_col: str, text_col: str) -> Column:
    return F.xxhash64(col(id_col), text_of(text_col)).bitwiseAND((1 << _BITS) - 1)


def _hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(col(id_col).alias("id"), _hash(id_col, text_col).alias("h"), F.octet_length(text_of(text_col)).cast("long").alias("bytes"))


def _placed(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Rows with a column h and their leaf: depth, prefix, shard_id, shard_bytes, shard_docs."""
    depths = [r.depth for r in leaves.select("depth").distinct().orderBy("depth").collect()]  # 63 at most
    at = F.explode(F.transform(F.array([F.lit(d) for d in depths]).cast("array<int>"), lambda d: F.struct(d.alias("depth"), F.call_function("shiftright", F.col("h"), F.lit(_BITS) - d).alias("prefix"))))
    bits = F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), 64, "0")
    name = F.when(F.col("depth") == 0, "root").otherwise(F.substring(bits, F.lit(65) - F.col("depth"), F.col("depth")))
    named = leaves.select("depth", "prefix", name.alias("shard_id"), F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))
    return rows.withColumn("_at", at).select(*rows.columns, "_at.*").join(named, ["depth", "prefix"])


def directory(rows: DataFrame, limit: int, step: int = 6) -> DataFrame:
    """Leaves (depth, prefix, bytes, docs) over rows (h, bytes); every leaf fits ``limit`` or can't split.

    Prefixes of one document, or of equal rows, can't be divided by any number of
    bits; such leaves stop at the full depth and may be over the limit.
    """
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    low, high = 0, min(_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + step)
    left, leaves = rows.select("h", "bytes"), None
    while True:
        fine = left.groupBy(_prefix(F.col("h"), F.lit(high)).alias("fine")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"), F.min("h").alias("least"), F.max("h").alias("most"))
        depths = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
        rolled = fine.select("*", depths).groupBy("depth", F.call_function("shiftright", F.col("fine"), F.lit(high) - F.col("depth")).alias("prefix"))
        nodes = rolled.agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.min("least").alias("least"), F.max("most").alias("most"))
        over = (F.col("bytes") > limit) & (F.col("least") != F.col("most"))
        nodes = shared(nodes.withColumn("over", over))
        parents = nodes.filter("over").select((F.col("depth") + 1).alias("depth"), (F.col("prefix") * 2).alias("prefix"))
        children = parents.unionByName(parents.withColumn("prefix", F.col("prefix") + 1))
        stop = nodes.filter("not over")
        new = stop.join(children, ["depth", "prefix"], "left_semi")
        new = new.unionByName(stop.filter(F.col("depth") == low)).select("depth", "prefix", "bytes", "docs")
        leaves = new if leaves is None else leaves.unionByName(new)
        more = nodes.filter((F.col("depth") == high) & F.col("over")).select(F.col("prefix").alias("open"))
        if high == _BITS or more.isEmpty():
            return leaves.dropDuplicates(["depth", "prefix"])
        left = left.withColumn("open", _prefix(F.col("h"), F.lit(high))).join(more, "open", "left_semi").select("h", "bytes")
        low, high = high + 1, min(_BITS, high + step)


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assigns each row to a shard of at most ``limit`` bytes of text.

    Result: (id, bytes, depth, prefix, shard_id, shard_bytes, shard_docs), one row for
    each row in; ``shard_id`` is the leaf's bits as text, ``root`` for no bits.

    Defined cases: a null text has 0 bytes; a single row above the limit, and rows
    that are equal in id and text, form a shard of their own that may be above it
    (no hash can part them); null ids hash like any other; an empty table gives no
    rows; columns other than the two named aren't read.
    """
    rows = _hashed(docs, id_col, text_col)
    placed = _placed(rows, shared(directory(rows, limit)))
    return placed.select(F.col("id").alias(id_col), "bytes", "depth", "prefix", "shard_id", "shard_bytes", "shard_docs")


def write_shards(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the documents as Parquet, one folder for each shard.

    Every row is written once, into the folder that its own hash names: null ids and
    repeated rows too, which no join on ids could place.
    """
    leaves = shared(directory(_hashed(docs, id_col, text_col), limit))
    rows = docs.select(F.struct(*map(col, docs.columns)).alias("_row"), _hash(id_col, text_col).alias("h"))
    placed = _placed(rows, leaves).select("_row.*", "shard_id")
    placed.repartition("shard_id").write.partitionBy("shard_id").parquet(path)
