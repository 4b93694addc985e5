"""SimHash near-duplicates through pivot distance tables (operator 6).

A fingerprint is the bitwise majority of the XXH64 values of a text's word shingles. Two fingerprints link when they differ in
at most two bits. Every distinct fingerprint gets a row in a pivot table: its Hamming distances to `PIVOTS` reference
fingerprints, each kept as the five distances within five blocks of bits (their sum is the whole distance). By the triangle
inequality linked fingerprints have coordinates at most two apart, and two bits touch at most two blocks, so in three blocks
all partial distances agree: each choice of three blocks is an equi-join key made of those coordinates. Pairs within a key are
discarded by the largest difference of whole coordinates and the survivors are verified by exact distance.

A key that more than `CELL` fingerprints share is not paired up. Its members are at most two free bits apart exactly when they
share a value within one bit of both, so each member names its neighbours over the free bits and the members of one neighbour
(65 at most) are linked in a star. That is exact and linear in the members. Equal fingerprints are one node from the start.

Defined results: null texts count as empty; texts without words have fingerprint zero; an empty table gives an empty result;
repeated rows are linked like any copies; a null doc_id takes part as the smallest id; different texts under one doc_id (or under
none) are linked by their fingerprints only; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgate.llm.common import LOWER, checkpointed, components, long_rows, salted_lookup

SEED = 42
PIVOTS = 16
CELL = 48
MAX_BITS = 2
NO_ID = -(2**63)
_EDGES = (0, 13, 26, 39, 52, 64)
BLOCKS = [np.uint64(sum(1 << b for b in range(lo, hi))) for lo, hi in zip(_EDGES, _EDGES[1:], strict=False)]
CHOICES = list(combinations(range(len(BLOCKS)), 3))
_RANDOM = np.random.default_rng(20240607)
REFERENCES = _RANDOM.integers(0, 2**64, PIVOTS, dtype=np.uint64, endpoint=False)
_WEIGHTS = _RANDOM.integers(0, 2**64, (PIVOTS, len(BLOCKS)), dtype=np.uint64, endpoint=False) | np.uint64(1)
_SLICE = 65_536


def fingerprint(text: bytes, width: int) -> int:
    """Majority bits of the shingle hashes, repeats included; texts shorter than a shingle are one shingle."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts = [0, *[e + 1 for e in ends]]
    hash_of = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, dtype=np.int64), len(words) - width + 1
    for lo in range(0, total, _SLICE):
        hi = min(lo + _SLICE, total)
        values = np.array([hash_of(joined[s:e], SEED) for s, e in zip(starts[lo:hi], ends[lo + width - 1 : hi + width - 1], strict=True)], dtype="<u8")
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > total).tolist())


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of every whole text; fp is the unsigned fingerprint in a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t or b"", width) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    return long_rows(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def partial_distances(fps: np.ndarray) -> np.ndarray:
    """Distances to every reference within every block: (fingerprint, reference, block)."""
    apart = fps[:, None] ^ REFERENCES[None, :]
    return np.stack([np.bitwise_count(apart & mask) for mask in BLOCKS], axis=2)


def pivot_table(nodes: DataFrame) -> DataFrame:
    """A row per choice of three blocks: (cell, fp, node, coords). `nodes` are (node, fp) with distinct fp.

    cell mixes the choice with the partial distances of its blocks; coords are the whole distances, one byte each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(1).to_numpy().view(np.uint64)
            parts = partial_distances(fps)
            coords = parts.sum(axis=2, dtype=np.uint8)
            mixed = (parts.astype(np.uint64) * _WEIGHTS[None]).sum(axis=1)
            packed = pa.array([c.tobytes() for c in coords], pa.binary())
            for number, choice in enumerate(CHOICES):
                cell = np.full(len(fps), number, dtype=np.uint64)
                for block in choice:
                    cell = (cell ^ mixed[:, block]) * np.uint64(0x9E3779B97F4A7C15)
                    cell ^= cell >> np.uint64(29)
                # the low digit names the choice, so a cell knows which bits are free
                cell = cell - cell % np.uint64(16) + np.uint64(number)
                yield pa.record_batch([pa.array(cell.view(np.int64)), batch.column(1), batch.column(0), packed], names=["cell", "fp", "node", "coords"])

    return nodes.select("node", "fp").mapInArrow(run, "cell long, fp long, node long, coords binary")


def _pairs(fps: np.ndarray, nodes: np.ndarray, coords: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    i, j = np.triu_indices(len(fps), 1)
    near = np.abs(coords[i].astype(np.int16) - coords[j]).max(axis=1) <= MAX_BITS
    i, j = i[near], j[near]
    linked = np.bitwise_count(fps[i] ^ fps[j]) <= MAX_BITS
    return nodes[i[linked]], nodes[j[linked]]


def _neighbours(cell: int, fps: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each member with itself and the values one free bit away."""
    fixed = CHOICES[cell & 15]
    free = [b for k in range(len(BLOCKS)) if k not in fixed for b in range(_EDGES[k], _EDGES[k + 1])]
    flips = np.array([0, *[1 << b for b in free]], dtype=np.uint64)
    return (fps[:, None] ^ flips[None]).ravel().view(np.int64), np.repeat(nodes, len(flips))


def candidate_links(cells: DataFrame) -> DataFrame:
    """(a, b, star): verified pairs of nodes with star false; (neighbour value, node) with star true from crowded cells.

    Cells arrive sorted, so a task holds one cell of at most CELL members and one batch; a crowded cell streams through.
    """

    def out(a: list[np.ndarray], b: list[np.ndarray], star: bool) -> pa.RecordBatch:
        left, right = np.concatenate(a), np.concatenate(b)
        return pa.record_batch([pa.array(left), pa.array(right), pa.array(np.full(len(left), star))], names=["a", "b", "star"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        crowded: int | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            coords = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.uint8).reshape(-1, PIVOTS)
            rows = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(), coords]
            if held:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            cells_ = rows[0]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(cells_)) + 1, [len(cells_)]])
            pairs, stars = ([], []), ([], [])
            whole = np.flatnonzero(np.diff(cuts[:-1]) > 1).tolist()
            if len(cuts) > 2 and cells_[0] == crowded and 0 not in whole:
                whole.append(0)
            for k in whole:
                lo, hi = cuts[k], cuts[k + 1]
                _sort_out(int(cells_[lo]), *[x[lo:hi] for x in rows[1:]], crowded, pairs, stars)
            lo = cuts[-2]
            if cells_[lo] == crowded or len(cells_) - lo > CELL:
                crowded, held = int(cells_[lo]), []
                _sort_out(crowded, *[x[lo:] for x in rows[1:]], crowded, pairs, stars)
            else:
                held = [x[lo:] for x in rows]
            yield from [out(*x, star) for x, star in ((pairs, False), (stars, True)) if x[0]]
        if held and len(held[0]) > 1:
            a, b = _pairs(*held[1:])
            yield out([a], [b], False)

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long, star boolean")


def _sort_out(cell: int, fps: np.ndarray, nodes: np.ndarray, coords: np.ndarray, crowded: int | None, pairs: tuple, stars: tuple) -> None:
    if cell == crowded or len(fps) > CELL:
        found, into = _neighbours(cell, fps, nodes), stars
    else:
        found, into = _pairs(fps, nodes, coords), pairs
    into[0].append(found[0])
    into[1].append(found[1])


def links(nodes: DataFrame) -> DataFrame:
    """Distinct (a, b) edges between nodes (node, fp) whose fingerprints differ in one or two bits, or a chain of such."""
    found = checkpointed(candidate_links(pivot_table(nodes)))
    members = found.filter("star").groupBy("a").agg(F.collect_set("b").alias("ids")).filter(F.size("ids") > 1)
    stars = members.select(F.array_min("ids").alias("a"), F.explode("ids").alias("b")).filter("a <> b")
    return found.filter("not star").select("a", "b").union(stars).distinct()


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest reachable doc_id)."""
    rows = checkpointed(fingerprints(docs, width))
    # a fingerprint is its own node: doc_ids repeat, and null ones are all NO_ID
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least"))).withColumn("node", F.col("fp"))
    labels = checkpointed(components(nodes.select("node"), links(nodes)).join(nodes.select("node", "least"), "node"))
    smallest = labels.groupBy("label").agg(F.min("least").alias("component_id"))
    facts = salted_lookup(labels.select(F.col("node").alias("fp"), "label"), "label", "fp", smallest).select("fp", "component_id")
    found = salted_lookup(rows, "fp", "doc_id", facts)
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return found.select(known("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), known("component_id"))
