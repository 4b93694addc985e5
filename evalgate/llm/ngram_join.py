"""N-gram Jaccard join by signature trees (operator 12).

A document is the set of its distinct word shingles (their XXH64); equal sets are one node from the start. Two sets of n tokens and
a similarity of t or more differ in less than p = n - ceil(t n) + 1 tokens of each, so of their pools, the min(n, 2p) smallest
tokens, they share least_shared(n) = pool - p + 1 or more. A node that shares fewer pool tokens with anyone is alone.

A token in the pools of 2 to HOT nodes is a cell. A more frequent one is hot: it is a cell only for heavy nodes, of which that
many pool tokens are hot, and only where it is among the first p. Two nodes that link meet in a cell: by a rare token if one of
them is light, by one of the first p tokens if both are heavy. Cells of the same members are one cell, which weighs as many tokens as they were.

A light node keeps only some of its cells of rare tokens. It shares as many rare tokens with a partner as it must share tokens and
has no hot ones for. In one order of all cells, the heaviest first, the first cell that two linked nodes share has all they share
at or behind it; so a node leaves out the cells at the end that weigh less than that together.

Every cell has a tree: its members in order of component and size are the leaves, `FANOUT` neighbours share a node, and a node holds
the OR of its members' token bitmaps with ranges of their sizes. The traversal goes down from pairs of nodes to pairs of children
and drops a pair as soon as its largest possible overlap (bits in common plus the tokens without a bit of their own) or its
sizes are too small, or when all members of both are known to be in one component. For that, hot cells first link their members to
the member with the most copies. Surviving pairs of leaves are verified by the exact sets, at most once each: first every node
with the partner that is in the most pairs, then the pairs whose ends are still in different components. Before whole sets, counts
of their tokens in bins (a byte for 2 to 4 tokens) tell pairs that cannot link: equal tokens are in the same bin.

No group is one task: tokens that are frequent in a batch are flagged hot before the shuffle and don't go to their bucket; places
come from a range partitioning; pairs of nodes are rows; sets are looked up in salted form.

Defined results: null, empty and blank texts have the empty set and are linked with nothing; a null doc_id takes part as the
smallest id; texts under one doc_id are apart unless their sets link; repeated rows are copies; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgate.llm.common import LOWER, checkpointed, components, long_rows, placed, salted_lookup, salt_of, written

PERCENT = 90
HOT = 32
FANOUT = 16
BITS = 1024
#: Tokens of a bucket, and of a batch that is dealt into buckets; a token found oftener than OFTEN in a batch is hot.
BUCKET = 1_000_000
DEALT = 1_000_000
OFTEN = 64
SPREAD = 4096
#: Fewest bins of a set, and the count at which a bin is full and tells nothing.
BINS = 32
FULL = 255
NO_ID = -(2**63)
SEED = 42
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words are one shingle."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *[e + 1 for e in ends]]
    hash_of = xxhash.xxh64_intdigest
    return np.unique(np.array([hash_of(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :], strict=False)], dtype=np.uint64))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n + percent * n * -1 // 100 + 1


def pool_size(n: int, percent: int = PERCENT) -> int:
    return min(n, 2 * prefix_size(n, percent))


def least_shared(n: int, percent: int = PERCENT) -> int:
    """Pool tokens that a set of n shares with any set that it links with: the smallest partner needs the fewest."""
    return min(pool_size(k, percent) - prefix_size(k, percent) + 1 for k in (n, -(-percent * n // 100)))


def profiles(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, n, key, pool): size, 128-bit digest and smallest tokens of every document's set; no key for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t or b"", width) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            pools = [s[: pool_size(len(s), percent)].view(np.int64) if len(s) else s.view(np.int64) for s in sets]
            offsets = pa.array(np.cumsum([0, *map(len, pools)]).astype(np.int32))
            flat = pa.array(np.concatenate(pools)) if pools else pa.array([], pa.int64())
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.record_batch([batch.column(0), sizes, pa.array(keys, pa.binary()), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "n", "key", "pool"])

    return long_rows(_texts(docs)).mapInArrow(run, "doc_id long, n long, key binary, pool array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))


def dealt(nodes: DataFrame, buckets: int, percent: int) -> DataFrame:
    """Pool tokens dealt by hash: (bucket, tokens, members), both packed; a member is twice the node, plus one for its first p tokens.

    A token that is frequent within one batch stays out of its bucket: its members go to spread rows (bucket below zero) and the
    bucket only gets enough members -1 to know that the token is hot.
    """

    def pack(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        tokens, members = (np.concatenate(x) for x in zip(*parts, strict=True))
        values, at, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        hot = (counts > OFTEN)[at]
        notices = np.repeat(values[counts > OFTEN], HOT + 1)
        spread = -1 - ((members.view(np.uint64) * _MIX) >> np.uint64(33)).astype(np.int64)[hot] % buckets
        rest = np.concatenate([tokens[~hot], notices])
        bucket = ((rest.view(np.uint64) * _MIX) >> np.uint64(24)).astype(np.int64) % buckets
        keys = np.concatenate([spread, bucket])
        tokens = np.concatenate([tokens[hot], rest])
        members = np.concatenate([members[hot], members[~hot], np.full(len(notices), -1)])
        order = np.argsort(keys, kind="stable")
        keys, tokens, members = keys[order], tokens[order], members[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
        packed = [[x[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:], strict=False)] for x in (tokens, members)]
        yield pa.record_batch([pa.array(keys[cuts[:-1]]), *[pa.array(p, pa.binary()) for p in packed]], names=["bucket", "tokens", "members"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            if not lengths.sum():
                continue
            place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            first = np.array([prefix_size(n, percent) for n in batch.column(1).to_pylist()])
            members = np.repeat(batch.column(0).to_numpy() * 2, lengths) + (place < np.repeat(first, lengths))
            parts.append((batch.column(2).flatten().to_numpy(), members))
            size += len(members)
            if size >= DEALT:
                yield from pack(parts)
                parts, size = [], 0
        if parts:
            yield from pack(parts)

    return nodes.select("node", "n", "pool").mapInArrow(run, "bucket long, tokens binary, members binary")


def token_cells(packed: DataFrame) -> DataFrame:
    """(cell, hot, times, members): the nodes of each set of shared tokens, a row; hot tokens in rows of up to SPREAD members, with their flags."""

    def found(key: tuple, table: pa.Table) -> pa.Table:
        tokens, members = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=np.int64) for c in ("tokens", "members"))
        order = np.lexsort((members, tokens))
        tokens, members = tokens[order], members[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(tokens)) + 1, [len(tokens)]])
        sizes = np.diff(cuts)
        spread = key[0].as_py() < 0
        cells: dict[bytes, int] = {}
        out: list[tuple[int, bool, int, np.ndarray]] = []
        for lo, size in zip(cuts[:-1][(sizes > 1) | spread].tolist(), sizes[(sizes > 1) | spread].tolist(), strict=True):
            if spread or size > HOT:
                mine = members[lo : lo + size]
                mine = mine[mine >= 0]
                out += [(int(tokens[lo]), True, 1, mine[k : k + SPREAD]) for k in range(0, len(mine), SPREAD)]
            else:
                name = (members[lo : lo + size] >> 1).tobytes()
                cells[name] = cells.get(name, 0) + 1
        out += [(int(np.int64(np.uint64(xxhash.xxh64_intdigest(name)))), False, times, np.frombuffer(name, dtype=np.int64)) for name, times in cells.items()]
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["cell", "hot", "times", "members"])

    return packed.groupBy("bucket").applyInArrow(found, "cell long, hot boolean, times long, members array<long>")


def meetings(cells: DataFrame) -> DataFrame:
    """(cell, node, hot, times, first): cells of the same rare tokens put together and their members apart."""
    rare = cells.filter("NOT hot").groupBy("cell").agg(F.sum("times").alias("times"), F.first("members").alias("members"))
    apart = rare.select("cell", F.explode("members").alias("node"), F.lit(False).alias("hot"), "times", F.lit(True).alias("first"))
    hot = cells.filter("hot").select("cell", F.explode("members").alias("member"))
    return apart.unionByName(hot.selectExpr("cell", "shiftright(member, 1) AS node", "true AS hot", "1L AS times", "member % 2 = 1 AS first"))


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, n, set, slack, sig) of the wanted nodes (node, key, least): read again from one document of each.

    sig has a bit for each token, slack is the number of tokens beyond the bits. Documents without an id are dealt over salts.
    """
    salts = F.when(F.col("least") == NO_ID, F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))
    ids = wanted.select(F.col("least").alias("doc_id"), F.explode(salts).alias("salt")).distinct()
    salt = F.when(F.col("doc_id") == NO_ID, salt_of("text")).otherwise(F.lit(0))
    rows = _texts(docs).withColumn("salt", salt).join(ids, ["doc_id", "salt"], "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for s in (shingles(t or b"", width) for t in batch.column(0).cast(pa.binary()).to_pylist()) if len(s)]
            marks = np.zeros((len(sets), BITS), dtype=bool)
            for row, tokens in zip(marks, sets, strict=True):
                row[((tokens * _MIX) >> np.uint64(40)).astype(np.int64) % BITS] = True
            words = np.packbits(marks, axis=1, bitorder="little").view(np.int64)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (BITS // 64))
            yield pa.record_batch(
                [pa.array(keys, pa.binary()), pa.array(sizes), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(sizes - marks.sum(axis=1)), pa.ListArray.from_arrays(offsets, pa.array(words.ravel()))],
                names=["key", "n", "set", "slack", "sig"],
            )

    found = long_rows(rows).mapInArrow(run, "key binary, n long, set binary, slack long, sig array<long>")
    return found.join(wanted.select("key", "node"), "key").drop("key").dropDuplicates(["node"])


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked, by their exact tokens."""
    of = lambda node, name: sets.select(F.col("node").alias(node), F.col("set").alias(name))
    both = salted_lookup(salted_lookup(pairs, "a", "b", of("a", "x")), "b", "a", of("b", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = len(np.intersect1d(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), assume_unique=True))
                keep.append(100 * both >= percent * ((len(x) + len(y)) // 8 - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def nearest(pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b), one for each node: that with the partner which is in the most pairs."""
    ends = pairs.select(F.col("a").alias("node"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("node"), F.col("a").alias("other")))
    degrees = ends.groupBy(F.col("node").alias("other")).agg(F.count("*").alias("degree"))
    most = salted_lookup(ends, "other", "node", degrees).groupBy("node").agg(F.max(F.struct("degree", "other")).alias("most"))
    return most.select(F.least("node", "most.other").alias("a"), F.greatest("node", "most.other").alias("b")).distinct()


def links_of(pairs: DataFrame, stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links `stars` and as many of the pairs (a, b), written once, as join all nodes that links join.

    Whole sets go only with likely pairs: one for each node, and those whose ends these links leave apart.
    """
    fit = likely(pairs, sets, percent)
    chosen = written(nearest(fit))
    links = written(stars.unionByName(linked(chosen, sets, percent)))
    ends = written(fit.join(chosen, ["a", "b"], "left_anti"))
    nodes = ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct()
    labels = written(components(nodes, links))
    of = lambda node, name: labels.select(F.col("node").alias(node), F.col("label").alias(name))
    apart = salted_lookup(salted_lookup(ends, "a", "b", of("a", "x")), "b", "a", of("b", "y")).filter("x <> y").select("a", "b")
    return written(links.unionByName(linked(written(apart), sets, percent)))


def binned(tokens: np.ndarray) -> np.ndarray:
    """How many tokens fall in each bin, a byte each, FULL at most; a power of two of bins, a quarter to a half of the tokens."""
    bins = max(BINS, 1 << max(0, (len(tokens) - 1).bit_length() - 2))
    return np.minimum(np.bincount((tokens & np.uint64(bins - 1)).astype(np.int64), minlength=bins), FULL).astype(np.uint8)


def may_link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether sets with these bins can be as similar as asked: they have no more tokens in common than the bins."""
    if x.max() == FULL or y.max() == FULL:
        return True
    bins = min(len(x), len(y))
    x, y = (v.reshape(-1, bins).sum(axis=0, dtype=np.int64) for v in (x, y))
    most = int(np.minimum(x, y).sum())
    return 100 * most >= percent * (int(x.sum()) + int(y.sum()) - most)


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), written once, without those that the bins of their tokens rule out; no link is lost."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [binned(np.frombuffer(s, dtype=np.uint64)).tobytes() for s in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(bins, pa.binary())], names=["node", "bins"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v, dtype=np.uint8) for v in batch.column(c).to_pylist()] for c in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array([may_link(v, w, percent) for v, w in zip(x, y, strict=True)], pa.bool_()))

    counts = written(sets.select("node", "set").mapInArrow(count, "node long, bins binary"))
    of = lambda node, name: counts.select(F.col("node").alias(node), F.col("bins").alias(name))
    both = salted_lookup(salted_lookup(pairs, "a", "b", of("a", "x")), "b", "a", of("b", "y"))
    return written(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def possible(x: Column, y: Column, percent: int) -> Column:
    """Whether a member of one tree node may link with one of the other, not being known to be connected."""
    common = F.aggregate(F.zip_with(x["sig"], y["sig"], lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda s, c: s + c)
    sizes = (x["hi"] * 100 >= y["lo"] * percent) & (y["hi"] * 100 >= x["lo"] * percent)
    joined = (x["from"] == x["to"]) & (y["from"] == y["to"]) & (x["from"] == y["from"])
    return sizes & ~joined & ((F.least(x["slack"], y["slack"]) + common) * (100 + percent) >= (x["lo"] + y["lo"]) * percent)


def _pairs(xs: Column, ys: Column, percent: int, inside: bool) -> Column:
    """(a, b) of the possible pairs of two lists of children, or of one list with itself."""

    def partners(x: Column, i: Column) -> Column:
        fit = lambda y, j: (j > i) & possible(x, y, percent) if inside else possible(x, y, percent)
        return F.transform(F.filter(ys, fit), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))

    return F.flatten(F.transform(xs, partners))


def tree_levels(members: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Nodes of all cells' trees, a level each, the roots last: (cell, id, lo, hi, slack, from, to, sig, children).

    `members` are (cell, node, n, slack, sig, comp). Nodes are cut at places of the whole order, so a cell may begin within one.
    """
    ranked = placed(members, ["cell", "comp", "n", "node"])
    leaf = F.struct(F.col("node").alias("id"), F.col("n").alias("lo"), F.col("n").alias("hi"), "slack", F.col("comp").alias("from"), F.col("comp").alias("to"), "sig")
    rows = checkpointed(ranked.select("cell", "place", leaf.alias("child")))
    largest = rows.groupBy("cell").count().agg(F.max("count").alias("n")).first()["n"] or 0
    levels: list[DataFrame] = []
    depth = 1
    while fanout**depth < largest:
        depth += 1
    for level in range(depth + 1):
        # the root has the one or two nodes that the cell's places fall in
        at = F.lit(0).cast("long") if level == depth else F.expr(f"place div {fanout}")
        grown = rows.groupBy("cell", at.alias("place")).agg(F.sort_array(F.collect_list("child")).alias("children"))
        of = lambda name: F.col(f"children.{name}")
        zeros = F.array(*[F.lit(0).cast("long")] * (BITS // 64))
        either = F.aggregate(of("sig"), zeros, lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))
        nodes = checkpointed(
            grown.select(
                "cell", F.col("place").alias("id"), F.array_min(of("lo")).alias("lo"), F.array_max(of("hi")).alias("hi"), F.array_max(of("slack")).alias("slack"),
                F.array_min(of("from")).alias("from"), F.array_max(of("to")).alias("to"), either.alias("sig"), "children",
            )
        )
        levels.append(nodes)
        rows = nodes.select("cell", F.col("id").alias("place"), F.struct("id", "lo", "hi", "slack", "from", "to", "sig").alias("child"))
    return levels


def candidates(members: DataFrame, percent: int = PERCENT, fanout: int = FANOUT) -> DataFrame:
    """Distinct pairs (a, b) of members that the dual traversal of the trees leaves over."""
    levels = tree_levels(members, fanout)
    crossing: DataFrame | None = None
    for level in reversed(range(len(levels))):
        nodes = levels[level]
        inside = nodes.filter("`from` < `to`").select("cell", F.explode(_pairs(F.col("children"), F.col("children"), percent, True)).alias("p"))
        found = [inside.select("cell", "p.a", "p.b")]
        if crossing is not None:
            side = lambda name: nodes.select("cell", F.col("id").alias(name), F.col("children").alias(f"of_{name}"))  # noqa: E731, B023
            met = crossing.join(side("a"), ["cell", "a"]).join(side("b"), ["cell", "b"])
            found.append(met.select("cell", F.explode(_pairs(F.col("of_a"), F.col("of_b"), percent, False)).alias("p")).select("cell", "p.a", "p.b"))
        crossing = checkpointed(reduce(DataFrame.unionByName, found)) if level else reduce(DataFrame.unionByName, found)
    return crossing.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()


def joined(docs: DataFrame, width: int = 3, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id (smallest doc_id reachable by links)."""
    rows = written(profiles(docs, width, percent))
    grouped = rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("pool").alias("pool"))
    nodes = written(grouped.withColumn("node", F.monotonically_increasing_id()))
    tokens = nodes.agg(F.sum(F.size("pool")).alias("n")).first()["n"] or 0
    met = written(meetings(token_cells(dealt(nodes, max(16, tokens // BUCKET), percent))))
    linkable = _linkable(met, nodes, percent)
    known = written(memberships(met.join(linkable.select("node", "copies", "least_rare"), "node")))
    wanted = linkable.join(known.select("node").distinct(), "node", "left_semi")
    sets = written(whole_sets(docs, wanted.select("node", "key", "least"), width))
    # apart from the sets, they are small enough not to move the memberships for a while
    prints = written(sets.drop("set"))
    stars = written(_stars(known, sets, percent))
    labels = components(wanted.select("node"), stars).withColumnRenamed("label", "comp")
    members = known.join(prints.join(labels, "node"), "node").select("cell", "node", "n", "slack", "sig", "comp")
    links = links_of(written(candidates(written(members), percent)), stars, sets, percent)
    graph = checkpointed(components(linkable.select("node"), links).join(linkable.select("node", "key", "least"), "node"))
    smallest = graph.groupBy("label").agg(F.min("least").alias("component"))
    by_key = salted_lookup(graph.select("key", "label"), "label", "key", smallest).select("key", "component")
    facts = nodes.select("key", "least").join(by_key, "key", "left").select("key", F.coalesce("component", "least").alias("component"))
    # rows without a key have the empty set and are not looked up
    out = salted_lookup(rows.filter("n > 0").select("doc_id", "n", "key"), "key", "doc_id", facts).select("doc_id", "n", "component")
    every = out.unionByName(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component")))
    told = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return every.select(told("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), told("component").alias("component_id"))


def memberships(met: DataFrame) -> DataFrame:
    """(cell, node, hot, copies): the cells in which two linked nodes meet, without rare ones that a node needs not be in.

    `met` are (cell, node, hot, times, first, copies, least_rare) of linkable nodes; least_rare is the weight of cells of rare
    tokens that a node shares with any set that it links with, 0 or less for heavy nodes.
    """

    def shared(rows: DataFrame) -> DataFrame:
        return rows.withColumn("sharers", F.count("*").over(Window.partitionBy("cell"))).filter("sharers > 1").drop("sharers")

    # the lightest first, so that the sum is the weight from the end of the order up to and with the cell
    behind = Window.partitionBy("node").orderBy("times", "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rare = shared(met.filter("NOT hot")).withColumn("weight", F.sum("times").over(behind)).filter("weight >= least_rare")
    hot = met.filter("hot AND first AND least_rare <= 0")
    return shared(rare).select("cell", "node", "hot", "copies").unionByName(hot.select("cell", "node", "hot", "copies"))


def _linkable(met: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(node, key, least, n, copies, least_rare) of the nodes that share enough pool tokens to link with anyone."""
    shared = met.groupBy("node").agg(F.sum("times").alias("shared"), F.sum(F.when(F.col("hot"), 1).otherwise(0)).alias("hot"))
    of = lambda n: f"least({n}, 2 * ({n} - ({percent} * {n} + 99) div 100 + 1)) - ({n} - ({percent} * {n} + 99) div 100 + 1) + 1"
    need = f"least({of('n')}, {of(f'(({percent} * n + 99) div 100)')})"
    found = nodes.drop("pool").join(shared, "node").withColumn("need", F.expr(need)).filter("shared >= need")
    return written(found.select("node", "key", "least", "n", "copies", (F.col("need") - F.col("hot")).alias("least_rare")))


def _stars(known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of the members of hot cells with the member that has the most copies."""
    hot = known.filter("hot").select("cell", "node", "copies")
    centres = hot.groupBy("cell").agg(F.max(F.struct("copies", "node")).alias("most")).select("cell", F.col("most.node").alias("centre"))
    pairs = salted_lookup(hot.select("cell", "node"), "cell", "node", centres).filter("centre <> node")
    return linked(likely(written(pairs.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()), sets, percent), sets, percent)
