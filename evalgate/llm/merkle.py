"""Merkle manifest of a dataset with pointer-jumping proofs (operator 11).

Every row is a leaf. The leaves of a source ascend by doc_id; runs of three neighbours become their hash, level by level, until
one node, the subroot, is left; the subroots of all sources grow into the root the same way. Node numbers are the place of the
first leaf below a node times 64 plus its level, so all trees share one table of links (node, parent, siblings before and after).

Proofs come from pointer jumping over that table: a node holds the sibling segments of its way to some ancestor, and a self-join
on the ancestor appends the ancestor's own segments, which doubles the distance. An ancestor 2^r levels up has at most
3^(2^r) descendants at that distance: few for the first four rounds, after which it may be hot and is looked up in salted form.
Only inner nodes jump (half as many as leaves); leaves join their finished parents, of which each has three at most.

Places come from a range partitioning in three steps (partition, then row), so no source is ever one task.

Defined results: a null value is `-` in a leaf, an empty text `0:`; null sources are the first source; null doc_ids come first in a
source and are not tampered with; rows that share a doc_id are ordered by their leaves, and each has its own proof; equal rows are
interchangeable; a table of one row has an empty proof; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgate.llm.common import checkpointed, placed, salted_lookup

ARITY = 3
LEVELS = 64
#: Levels of the trees of sources; those of the tree of subroots are numbered from here.
TOP = 40
#: From this distance on an ancestor may have more descendants than one task should hold.
FAR = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(parts: Column) -> Column:
    return F.sha2(parts, 256)


def leaf_of(**changed: Column) -> Column:
    """Hash of a row's fields, each `-` or its UTF-8 length, `:` and value."""

    def field(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return sha(F.concat(*[field(name) for name in FIELDS]))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered): the second hash is that of the row without the line ends of its text, for even CRC-32 of doc_id."""
    even = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0
    text = F.col("text").cast("string")
    without = F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf_of().alias("leaf"), leaf_of(text=without).alias("tampered"))


def in_trees(rows: DataFrame) -> DataFrame:
    """Leaves with the node number, tree (place of the source's first leaf), position in the tree and size of the tree."""
    ranked = checkpointed(placed(rows, ["source", "doc_id", "leaf"]))
    by_part = ranked.groupBy("source", "__part").agg(F.min("place").alias("lo"), F.count("*").alias("n"))
    by_source = by_part.groupBy("source").agg(F.min("lo").alias("tree"), F.sum("n").alias("size"))
    # a source meets its facts once per partition, so a hot one isn't joined row by row in one task
    facts = by_part.alias("p").join(by_source.alias("s"), F.expr("p.source <=> s.source")).selectExpr("p.source AS of", "p.__part AS part", "tree", "size")
    known = ranked.join(facts, F.expr("source <=> of AND __part = part"))
    return known.select((F.col("place") * LEVELS).alias("node"), "tree", (F.col("place") - F.col("tree")).alias("pos"), "size", F.col("leaf").alias("digest"), "doc_id", "tampered")


def height(size: int) -> int:
    level = 0
    while ARITY**level < size:
        level += 1
    return level


def grown(nodes: DataFrame, base: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels above `nodes`, lowest first, and the nodes that are the only one of their tree.

    Nodes are (node, tree, pos, size, digest, doc_id, tampered), size being the number of nodes of the tree at that level. A
    parent holds its children in order, three at most, and drops out as soon as its tree has one node.
    """
    levels, alone, current = [], [nodes.filter("size = 1")], nodes.filter("size > 1")
    largest = nodes.agg(F.max("size").alias("n")).first()["n"] or 0
    child = F.struct("pos", "node", "digest", "doc_id", "tampered")
    for level in range(1, height(largest) + 1):
        runs = current.groupBy("tree", F.expr(f"pos div {ARITY}").alias("run"), "size").agg(F.sort_array(F.collect_list(child)).alias("children"))
        first = F.col("children")[0]["node"]
        parents = checkpointed(
            runs.select(
                (first - F.pmod(first, F.lit(LEVELS)) + base + level).alias("node"), "tree", F.col("run").alias("pos"),
                F.expr(f"(size + {ARITY - 1}) div {ARITY}").alias("size"), sha(F.array_join("children.digest", "")).alias("digest"), "children",
            )
        )
        levels.append(parents)
        current = parents.drop("children").withColumns({"doc_id": F.lit(None).cast("long"), "tampered": F.lit(None).cast("string")})
        alone.append(current.filter("size = 1"))
        current = current.filter("size > 1")
    return levels, reduce(DataFrame.unionByName, alone)


def links_of(levels: list[DataFrame]) -> DataFrame | None:
    """(node, up, step, digest, doc_id, tampered): every child with its parent and the siblings before and after it."""
    if not levels:
        return None
    # by position: all but the children's order is lost after the explode
    rows = reduce(DataFrame.unionByName, levels).select(F.col("node").alias("up"), "children", F.posexplode("children").alias("at", "child"))
    digests = F.col("children.digest")
    step = F.struct(
        F.array_join(F.slice(digests, F.lit(1), F.col("at")), "").alias("before"), F.array_join(F.slice(digests, F.col("at") + 2, F.lit(ARITY)), "").alias("after")
    )
    return rows.select("child.node", "up", step.alias("step"), "child.digest", "child.doc_id", "child.tampered")


def jumped(links: DataFrame, subroots: DataFrame, rounds: int, far: int = FAR) -> DataFrame:
    """Inner nodes with all segments up to the root and the subroot on that way: (node, path, subroot)."""
    own = links.filter(F.pmod("node", F.lit(LEVELS)) > 0).select("node", "up", F.array("step").alias("path"))
    way = checkpointed(own.join(subroots, "node", "left"))
    for turn in range(rounds):
        ahead = way.select(F.col("node").alias("up"), F.struct(F.col("up").alias("up"), "path", "subroot").alias("more"))
        met = salted_lookup(way, "up", "node", ahead) if 2**turn >= far else way.join(ahead, "up", "left")
        way = checkpointed(
            met.select(
                "node", F.coalesce("more.up", "up").alias("up"),
                F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more.path")).alias("path"),
                F.coalesce("subroot", "more.subroot").alias("subroot"),
            )
        )
    return way.select("node", "path", "subroot")


def proofs(docs: DataFrame, far: int = FAR) -> DataFrame:
    """Every row's leaf with its path to the root: (doc_id, leaf, tampered, subroot, root, path of (before, after))."""
    spark = docs.sparkSession
    base = checkpointed(in_trees(checkpointed(leaves(docs))))
    trees, subroots = grown(base, 0)
    subroots = checkpointed(subroots)
    tops = placed(subroots.select("node", F.col("tree").alias("first"), "digest", "doc_id", "tampered"), ["first"])
    count = subroots.count()
    tops = tops.select("node", F.lit(-1).cast("long").alias("tree"), F.col("place").alias("pos"), F.lit(count).cast("long").alias("size"), "digest", "doc_id", "tampered")
    above, last = grown(checkpointed(tops), TOP)
    last = checkpointed(last)
    empty_path = F.array().cast("array<struct<before:string,after:string>>")
    # the only row of a table is its own root
    single = last.filter(F.col("doc_id").isNotNull() | F.col("tampered").isNotNull()).select("doc_id", F.col("digest").alias("leaf"), "tampered", F.col("digest").alias("subroot"), empty_path.alias("path"))
    root = last.select("digest").first()
    links = links_of(trees + above)
    if links is None:
        return single.withColumn("root", F.lit(root["digest"] if root else None).cast("string"))
    rounds = max(0, len(trees) + len(above) - 1).bit_length()
    names = subroots.select("node", F.col("digest").alias("subroot"))
    inner = jumped(links, names, rounds, far)
    ends = links.filter(F.pmod("node", F.lit(LEVELS)) == 0).join(names, "node", "left")
    more = inner.select(F.col("node").alias("up"), F.col("path").alias("rest"), F.col("subroot").alias("above"))
    found = ends.join(more, "up", "left").select(
        "doc_id", F.col("digest").alias("leaf"), "tampered", F.coalesce("subroot", "above", F.lit(root["digest"])).alias("subroot"),
        F.concat(F.array("step"), F.coalesce("rest", empty_path)).alias("path"),
    )
    return found.unionByName(single).withColumn("root", F.lit(root["digest"]))


def folded(leaf: str) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate("path", F.col(leaf), lambda h, s: sha(F.concat(s["before"], h, s["after"])))


def verified(docs: DataFrame, far: int = FAR) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified (of the tampered leaf)."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = proofs(docs, far).withColumn("folded_root", folded("tampered"))
    return out.select("doc_id", "leaf", "subroot", "root", sha(siblings).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
