"""Places in a global order and joins on keys that may be hot, without a task that holds a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evalgate.session import checkpointed

SALTS = 32


def placed(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """The rows with their place (0, 1, ...) in the given order, nulls first; equal rows take their places in any order.

    Rows are range-partitioned and numbered inside each partition; the partitions' counts, one row each, give the offsets.
    """
    nulls_first = [F.asc_nulls_first(c) for c in order]
    spread = rows.withColumn("_tie", F.rand(11)).repartitionByRange(*nulls_first, "_tie").sortWithinPartitions(*nulls_first, "_tie").drop("_tie")
    seen = checkpointed(spread.withColumn("_number", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_number", 33)))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = seen.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_number") - F.shiftleft("_part", 33)
    return seen.join(starts, "_part").withColumn(name, place).drop("_number", "_part", "_start")


def salted_join(rows: DataFrame, facts: DataFrame, keys: list[str], spread_by: list[str], how: str = "left") -> DataFrame:
    """Null-safe join of `rows` with `facts` (one row per key), where a hot key's rows are dealt over SALTS tasks.

    A mask of the salts that a key's rows use is aggregated map-side; a fact is copied to those salts only.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
    used = salted.groupBy(*keys).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_salt"))).alias("_used"))
    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_u_{k}"]) for k in keys])
    named = used.select(*[F.col(k).alias(f"_u_{k}") for k in keys], "_used")
    of_key = facts.join(named, same(facts, named)).drop(*[f"_u_{k}" for k in keys])
    salts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.call_function("getbit", F.col("_used"), s) == 1)
    spread = of_key.withColumn("_s", F.explode(salts)).drop("_used")
    for key in keys:
        spread = spread.withColumnRenamed(key, f"_u_{key}")
    return salted.join(spread, same(salted, spread) & (salted["_salt"] == spread["_s"]), how).drop("_salt", "_s", *[f"_u_{k}" for k in keys])
