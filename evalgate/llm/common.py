"""Helpers that several corpus operators share: table access, salted lookups and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalgate.session import checkpointed, shared_folder

#: The words of every contract: runs of anything but space and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes 65-90 to 97-122; UTF-8 continuation bytes are above 127, so whole texts can be mapped as bytes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SALTS = 64
#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_rows(df: DataFrame) -> DataFrame:
    """Whole texts go to Python in small Arrow batches: a worker's memory follows the texts, not a count of rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def free_name(base: str, *taken: DataFrame) -> str:
    """A column name that none of the tables has, whatever its case."""
    used = {c.lower() for df in taken for c in df.columns}
    while base.lower() in used:
        base += "_"
    return base


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number of their own and the name of its column. Written once, so that every later read finds the same numbers."""
    row, place = free_name("__row", docs), f"{shared_folder(docs.sparkSession)}/rows-{uuid.uuid4().hex}"
    docs.withColumn(row, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(place)
    return docs.sparkSession.read.parquet(place), row


def row_number(row: str | None) -> Column:
    """The column that numbers the rows, or numbers of this reading."""
    return F.monotonically_increasing_id() if row is None else F.col(row)


def written(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder as zstd Parquet and read again: like a checkpoint, but with known sizes."""
    place = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.parquet(place)


def salt_of(col: str) -> Column:
    """One of SALTS numbers, fixed by the value of a column."""
    return F.pmod(F.xxhash64(F.col(col)), F.lit(SALTS)).cast("int")


def salt_bit(salt: Column) -> Column:
    return F.expr("shiftleft(1L, salt)") if isinstance(salt, str) else F.call_function("shiftleft", F.lit(1).cast("long"), salt)


def salted_lookup(rows: DataFrame, key: str, salted_by: str, facts: DataFrame) -> DataFrame:
    """Left join of `rows` with `facts` (one row per key) that a hot key cannot pull into one task.

    Rows of a key are dealt over SALTS salts by `salted_by`. Which salts a key uses is a 64-bit mask, aggregated
    map-side, so a fact is copied only to the salts where its key occurs: once for a key that occurs once.
    """
    salted = rows.withColumn("salt", salt_of(salted_by))
    used = salted.groupBy(key).agg(F.bit_or(salt_bit(F.col("salt"))).alias("salts"))
    spread = (
        facts.join(used, key)
        .withColumn("salt", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.call_function("getbit", F.col("salts"), s) == 1)))
        .drop("salts")
    )
    return salted.join(spread, [key, "salt"], "left").drop("salt")


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with their place (0, 1, ...) in the given order; equal rows take their places in any order.

    Rows are range-partitioned and numbered inside each partition; the partitions' own counts, one row each, give the offsets.
    """
    number = F.monotonically_increasing_id()
    nulls_first = [F.asc_nulls_first(c) for c in order]
    tie = F.rand(11).alias("__tie")
    spread = rows.select("*", tie).repartitionByRange(*nulls_first, "__tie").sortWithinPartitions(*nulls_first, "__tie").drop("__tie")
    seen = checkpointed(spread.withColumn("__number", number).withColumn("__part", F.shiftright("__number", 33)))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = seen.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__start") + F.col("__number") - F.shiftleft("__part", 33)
    return seen.join(starts, "__part").withColumn("place", place).drop("__number", "__start")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node: (node, label). `edges` are (a, b) rows of node ids, in one direction.

    Each round takes the smallest label among the neighbours and then the label of that label (pointer jumping), so
    the rounds grow with the logarithm of the longest chain. Labels are written out; rounds go on until nothing changes.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    inner = both.select(F.col("a").alias("node")).distinct()
    labels = written(inner.select("node", F.col("node").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        jumped = written(salted_lookup(hooked, "label", "node", roots).select("node", "old", F.least("label", "jump").alias("label")))
        changed = jumped.filter("label <> old").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
