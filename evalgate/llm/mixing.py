"""Mixing sources to target weights (operator 4), with DataFrame functions only.

Words of each source are packed, document after document in pseudorandom order, into blocks of `block` words. Sources weigh
5, 2, 1, repeating by code point of their names (null last); targets stop at three times a source's words and the excess is
shared again. A target is turned into a number of block slots. Every output shard draws multinomial source counts for its
slots; a draw beyond a source's slots is cut and what is missing goes to closing shards, so the totals are exact. The j-th slot
of a source takes block perm(j mod blocks) of pass j div blocks; perm is a swap-or-not shuffle keyed by the source, so every
block is taken floor or ceil of slots / blocks times, at most three. Slots and packed documents meet in a join on the block.

Running positions are summed in two levels (hash bucket, then row), so no source is one task.

Defined results: null texts have size 0 and are never taken; null sources are one source, the last; repeated rows and rows
with null doc_id are documents of their own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgate.llm.common import WORD, checkpointed, free_name, numbered, row_number

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 64
SHARD_SLOTS = 16_384
BUCKETS = 1024
ROUNDS = 24
SEED = 7


def with_sizes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(row, doc_id, source, size): size counts words of the whole text; row tells repeated rows apart."""
    return docs.select(
        row_number(row).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )


def targets(sized: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per source: sid, source, source_size, target, blocks and slots.

    The share per unit of weight is the level at which capped sources and weighted ones add up to all words: the largest of
    (words left) / (weights left) as sources are taken in order of cap over weight.
    """
    by_name, by_cap = Window.orderBy(F.asc_nulls_last("source")), Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    sources = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("sid", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * float(MOST))
        .withColumn("left", F.sum("source_size").over(every) - F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("cap"))
        .withColumn("level", F.max(F.col("left") / F.sum("weight").over(rest)).over(every))
    )
    target = F.least("cap", F.col("weight") * F.col("level"))
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    return sources.select(
        "sid", "source", "source_size", target.alias("target"), blocks.alias("blocks"),
        F.when(F.col("source_size") > 0, F.least(F.round(target * blocks / F.col("source_size")).cast("long"), blocks * MOST)).otherwise(0).alias("slots"),
    )


def packed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with words, each with the position of its first word in its source: (row, sid, size, start)."""
    rows = (
        sized.filter("size > 0").join(sources.select("sid", F.col("source").alias("of")), F.col("source").eqNullSafe(F.col("of")))
        .select("row", "doc_id", "sid", "size", F.xxhash64(F.lit(SEED), "doc_id").alias("order"))
        .withColumn("bucket", F.pmod("order", F.lit(BUCKETS)))
    )
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words")).select(
        "sid", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("sid", "bucket").orderBy("order", "doc_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("upto", F.sum("size").over(inside)).join(offsets, ["sid", "bucket"]).select(
        "row", "sid", "size", (F.col("offset") + F.col("upto") - F.col("size")).alias("start")
    )


def pieces(packs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Parts of documents in blocks: (sid, block, row, first, words); first is the part's first word in its document."""
    last = F.col("start") + F.col("size")
    parts = packs.withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    first = F.greatest("start", F.col("block") * block)
    return parts.select("sid", "block", "row", (first - F.col("start")).alias("first"), (F.least(last, (F.col("block") + 1) * block) - first).alias("words"))


def shard_counts(sources: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Slots of each source in each output shard: (shard, sid, blocks, first, count); first is the source's slot number.

    Every slot of a shard draws a source with probability slots / all slots. Draws beyond a source's slots are cut; the
    missing slots of all sources form the closing shards.
    """
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]
    upto = F.sum("slots").over(Window.orderBy("sid"))
    ranges = sources.filter("slots > 0").select("sid", "slots", "blocks", (upto - F.col("slots")).alias("lo"), upto.alias("hi"))
    # cumulative probabilities: one array for all sources, so that drawing needs no join
    table = ranges.agg(F.sort_array(F.collect_list(F.struct("hi", "sid"))).alias("cuts"))
    point = F.pmod(F.xxhash64(F.lit(SEED), F.lit("draw"), "id"), F.lit(max(total, 1)))
    drawn = spark.range(total).select((F.col("id") / shard_slots).cast("long").alias("shard"), point.alias("point")).crossJoin(F.broadcast(table))
    counts = drawn.select("shard", F.filter("cuts", lambda c: c["hi"] > F.col("point"))[0]["sid"].alias("sid")).groupBy("shard", "sid").agg(F.count("*").alias("draws"))
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    known = counts.withColumn("first", F.coalesce(F.sum("draws").over(before), F.lit(0))).join(ranges.select("sid", "slots", "blocks"), "sid")
    drawn_slots = known.select("shard", "sid", "blocks", "first", F.least(F.col("draws"), F.col("slots") - F.col("first")).alias("count")).filter("count > 0")
    have = counts.groupBy("sid").agg(F.sum("draws").alias("have"))
    missing = ranges.join(have, "sid", "left").withColumn("first", F.coalesce("have", F.lit(0))).filter("first < slots")
    step = F.explode(F.expr(f"sequence(first, slots - 1, {shard_slots}L)"))
    closing = missing.withColumn("from", step).select(
        (F.lit((total + shard_slots - 1) // shard_slots) + F.expr(f"(from - first) div {shard_slots}")).alias("shard"),
        "sid", "blocks", F.col("from").alias("first"), F.least(F.lit(shard_slots), F.col("slots") - F.col("from")).alias("count"),
    )
    return drawn_slots.unionByName(closing)


def permuted(index: Column, n: Column, key: Column) -> Column:
    """Swap-or-not shuffle of 0..n-1: each round may swap x with k - x, as a bit of a hash of the larger one says."""

    def turn(x: Column, number: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), key, number), n) - x, n)
        swap = F.xxhash64(key, number, F.greatest(x, other)).bitwiseAND(1) == 1
        return F.when(swap, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, turn)


def slots(counts: DataFrame) -> DataFrame:
    """Every slot with its block: (shard, sid, slot, pass, block)."""
    each = counts.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
    return each.select("shard", "sid", "slot", F.expr("slot div blocks").alias("pass"), permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.col("sid")).alias("block"))


def mixture(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, row: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix: (rows with sizes, sources with targets, taken parts).

    A taken part is (shard, sid, slot, pass, block, row, first, words): words first.. of a document in one slot of a shard.
    """
    sized = checkpointed(with_sizes(docs, row))
    sources = checkpointed(targets(sized, block))
    taken = slots(shard_counts(sources, shard_slots)).join(pieces(packed(sized, sources), block), ["sid", "block"])
    return sized, sources, taken


def mixed_documents(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target of its source and the words that the mix takes of it."""
    sized, sources, taken = mixture(docs, block, shard_slots)
    words = taken.groupBy("row").agg(F.sum("words").alias("taken"))
    names = sources.select(F.col("source").alias("of"), "source_size", "target")
    return (
        sized.join(words, "row", "left").join(names, F.col("source").eqNullSafe(F.col("of")))
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def mixed_texts(docs: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, row: str | None = None) -> DataFrame:
    """The mixed corpus with the columns of `docs`: a row for each document and pass that takes words of it.

    A document taken whole keeps its text; otherwise text holds the taken words, joined by one space, and n_chars their length. `row` names a column that numbers the rows and is dropped; without one the rows are numbered in a written copy.
    """
    keyed, row = numbered(docs) if row is None else (docs, row)
    n_words, listed = free_name("__words", keyed), free_name("__parts", keyed)
    _, _, taken = mixture(keyed, block, shard_slots, row)
    sums = taken.groupBy("row", "pass").agg(F.sum("words").alias(n_words), F.sort_array(F.collect_list(F.struct("first", "words"))).alias(listed))
    parts = sums.select(F.col("row").alias(row), n_words, listed)
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    # the words are the start of a fold, so that they are found once however many parts there are
    start = F.struct(words.alias("w"), F.array().cast("array<string>").alias("out"))

    def add(done: Column, p: Column) -> Column:
        mine = F.slice(done["w"], (p["first"] + 1).cast("int"), p["words"].cast("int"))
        return F.struct(done["w"].alias("w"), F.concat(done["out"], mine).alias("out"))

    cut = F.array_join(F.aggregate(listed, start, add, lambda done: done["out"]), " ")
    text = F.when(F.col(n_words) == F.regexp_count("text", F.lit(WORD)), F.col("text")).otherwise(cut)
    out = keyed.join(parts, row).withColumn("text", text).drop(row, n_words, listed)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
