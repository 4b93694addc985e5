"""Shards of limited size by extendible hashing (operator 2), with DataFrame functions.

The directory is indexed by the leading bits of a document's hash. A bucket that holds more bytes than the limit splits on one
more bit, the others stay as they are; a shard is a bucket that fits while the one above it doesn't. Sizes are summed by
prefixes of a first depth and rolled up, which gives every split down to there at once; only buckets that are too large even
then go on, a few bits deeper each time. When the 60 bits of the key's hash are used up (many rows of one key), bits of the
row's own hash follow, so a hot key splits like any other bucket.

Defined results: null texts have no bytes; a document larger than the limit is a shard of its own; a null doc_id hashes like an
empty string; repeated rows are rows of their own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgate.llm.common import checkpointed, free_name, numbered

LIMIT = 1 << 20
KEY_BITS = 60
ROW_BITS = 60
DEEPER = 4
#: Most directory entries that are broadcast to the rows; more are joined by a shuffle.
BROADCAST_ENTRIES = 200_000


def _bits(text: Column) -> Column:
    return F.lpad(F.conv(F.substring(F.md5(text), 1, 15), 16, 2), KEY_BITS, "0")


def prefix(depth: int) -> Column:
    return F.substring("bits", 1, depth)


def split(sums: DataFrame, above: int, depth: int, limit: int) -> DataFrame:
    """Directory entries (prefix, local): the fewest bits after `above` with which the bucket fits; null if `depth` is not enough."""
    up = sums.withColumn("k", F.explode(F.sequence(F.lit(above), F.lit(depth)))).withColumn("bucket", F.expr("substring(prefix, 1, k)"))
    sizes = up.groupBy("k", "bucket").agg(F.sum("bytes").alias("all_bytes"), F.sum("n").alias("all_n"))
    fits = sizes.filter((F.col("all_bytes") <= limit) | (F.col("all_n") == 1)).select("k", "bucket")
    local = up.select("prefix", "k", "bucket").join(fits, ["k", "bucket"]).groupBy("prefix").agg(F.min("k").alias("local"))
    return sums.select("prefix").join(local, "prefix", "left")


def sharded(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, shard (its hash prefix), depth, shard_bytes, shard_rows."""
    rows = placed_rows(docs, F.monotonically_increasing_id(), limit)
    shards = rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return rows.join(shards, "shard").select("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows")


def placed_rows(docs: DataFrame, row: Column, limit: int) -> DataFrame:
    """(row, doc_id, n_bytes, shard, depth) of every row; `row` numbers the rows."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    pending = checkpointed(docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), size.alias("n_bytes"), F.concat(_bits(key), _bits(row.cast("string"))).alias("bits")))
    total = pending.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()["n"]
    above, depth, done = 0, 2 + max(0, (total // limit).bit_length()), []
    while True:
        sums = pending.groupBy(prefix(depth).alias("prefix")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
        entries = checkpointed(split(sums, above, depth, limit))
        known = F.broadcast(entries) if entries.count() <= BROADCAST_ENTRIES else entries
        placed = pending.withColumn("prefix", prefix(depth)).join(known, "prefix").drop("prefix")
        if depth == KEY_BITS + ROW_BITS:
            placed = placed.fillna(depth, ["local"])
        done.append(placed.filter("local IS NOT NULL"))
        if depth == KEY_BITS + ROW_BITS or not entries.filter("local IS NULL").limit(1).count():
            break
        pending = checkpointed(placed.filter("local IS NULL").drop("local"))
        above, depth = depth + 1, min(depth + DEEPER, KEY_BITS + ROW_BITS)
    shard = F.expr("substring(bits, 1, local)").alias("shard")
    return checkpointed(reduce(DataFrame.union, done).select("row", "doc_id", "n_bytes", shard, F.col("local").cast("int").alias("depth")))


def write(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write the documents, one folder for each shard; every row goes to the shard it was placed in.

    The folders are named by `shard`, or by that name with underscores where the documents have such a column.
    """
    keyed, row = numbered(docs)
    shard = free_name("shard", docs)
    places = placed_rows(keyed, F.col(row), limit).select(F.col("row").alias(row), F.col("shard").alias(shard))
    keyed.join(places, row).drop(row).repartition(shard).write.partitionBy(shard).parquet(path)
