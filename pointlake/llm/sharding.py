"""Sharding by extendible hashing, from Spark expressions only.

The directory is indexed by the leading bits of a key's hash.  A bucket that exceeds the byte limit is
split on its next bit, others stay, so a shard is a hash prefix with the fewest bits at which it fits.
Each round looks 12 bits ahead with one aggregate over the rows of buckets that are still too large
(at most 4096 rows per such bucket leave the tasks); further rounds run only if such buckets remain.  Rows
with equal keys share all key bits; if they exceed the limit together, bits of a row number written
beforehand separate them, so a hot key is split as well.

Defined results: a NULL text has no bytes; NULL keys hash like the empty text; a single row larger than
the limit is a shard of its own; repeated rows are separate rows; an empty table gives an empty result;
other columns are kept and outputs replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.llm.common import store

AHEAD = 12
KEY_BITS = 60
OUTPUTS = ("bytes", "depth", "shard", "shard_bytes")


def hash_bits(value: Column) -> Column:
    """60 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _prefix(depth: Column) -> Column:
    """The first ``depth`` of 120 bits: key bits, then bits of the row number."""
    bits = F.concat(F.lpad(F.bin("key_bits"), KEY_BITS, "0"), F.lpad(F.bin("row_bits"), KEY_BITS, "0"))
    return F.substring(bits, F.lit(1), depth)


def split_buckets(rows: DataFrame, limit: int) -> DataFrame:
    """Rows ``(key_bits, row_bits, bytes, ...)`` with ``depth``, ``shard`` and ``shard_bytes``."""
    done = None
    for low in range(0, 2 * KEY_BITS, AHEAD):
        high = low + AHEAD
        cells = rows.groupBy(_prefix(F.lit(high)).alias("cell")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        level = cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
        bucket = level.groupBy("depth", F.substring("cell", F.lit(1), F.col("depth")).alias("shard")).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("n"))
        fits = bucket.filter((F.col("shard_bytes") <= limit) | (F.col("n") == 1) | (F.col("depth") == 2 * KEY_BITS))
        at = level.select("cell", "depth", F.substring("cell", F.lit(1), F.col("depth")).alias("shard")).join(fits, ["depth", "shard"])
        leaf = store(at.groupBy("cell").agg(F.min(F.struct("depth", "shard", "shard_bytes")).alias("leaf")), "buckets")
        placed = rows.withColumn("cell", _prefix(F.lit(high))).join(leaf, "cell", "left")
        ready = placed.filter("leaf IS NOT NULL").select(*rows.columns, "leaf.*")
        done = ready if done is None else done.unionByName(ready)
        if leaf.count() == cells.count():
            return done
        rows = store(placed.filter("leaf IS NULL").select(*rows.columns), "open-buckets")
    return done


def shards(df: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row without ``text`` and with its bytes, and the depth, bit prefix and bytes of its shard."""
    rest = [c for c in df.columns if c not in (*OUTPUTS, text)]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"), hash_bits(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).alias("key_bits"),
                     hash_bits(F.monotonically_increasing_id().cast("string")).alias("row_bits"), F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("bigint").alias("bytes"))
    return split_buckets(store(rows, "sharded-rows"), limit).select("rest.*", *OUTPUTS)


def write_shards(df: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the rows of ``df`` below ``path``, one folder ``shard=<bits>`` per shard, and return the
    plan of ``shards``.  Keys must be unique here: the plan is joined back by key."""
    found = store(shards(df.select(F.col(f"`{key}`"), F.col(f"`{text}`")), limit, key, text), "shard-plan")
    named = found.select(F.col(f"`{key}`").alias("_key"), F.concat(F.lit("b"), "shard").alias("shard"))
    rows = df.drop("shard").join(named, F.col(f"`{key}`").eqNullSafe(F.col("_key"))).drop("_key")
    rows.repartition("shard").write.partitionBy("shard").parquet(path)
    return found
