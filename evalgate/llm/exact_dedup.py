"""Exact deduplication with a cuckoo-filter index of live digests (operator 10).

Texts are equal when they are identical after lower-casing A-Z. A digest is the SHA-256 of that normal form. The index is
dealt into shards by digest prefix; a shard is one cuckoo filter whose slots hold a 16-bit fingerprint and point to the
bucketed content: the stored digest with the largest document id, the group size and the salts of the group's rows. A
fingerprint hit counts only after the stored digest is compared. When an insertion finds no free slot after `KICKS` moves, the
filter doubles and is filled again from the stored digests, so it never turns a digest away. A shard takes insertions and
deletions later on (`insert`, `delete`), `lookup` tells what is live.

Defined results: null texts count as empty; a null doc_id is the smallest of all; rows that repeat a doc_id and text share
their decision; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgate.llm.common import LOWER, SALTS, checkpointed, long_rows, salted_lookup

KICKS = 200
SLOTS = 4
#: Digests that one shard is meant to hold; the number of shards follows the number of rows.
SHARD_KEYS = 50_000
NO_ID = -(2**63)
ROWS = "doc_id long, digest binary"
ENTRIES = "digest binary, keep_id long, group_size long, salts long"
INDEX = "shard int, slots long, filter binary, digests binary, keep_ids binary, sizes binary, salts binary"


class CuckooFilter:
    """Partial-key cuckoo hashing over stored digests: buckets of four slots, two buckets for each fingerprint."""

    def __init__(self, buckets: int = 256) -> None:
        self.keys: list[bytes | None] = [None]
        self.prints: list[int] = [0]
        self.keep: list[int] = [0]
        self.size: list[int] = [0]
        self.salts: list[int] = [0]
        self.live = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.slots = [0] * (buckets * SLOTS)

    def _places(self, key: bytes, mark: int) -> tuple[int, int]:
        first = int.from_bytes(key[8:14], "little") & self.mask
        return first, (first ^ (mark * 0x5BD1E995)) & self.mask

    def find(self, key: bytes) -> int:
        """Slot of a live digest, or -1. A fingerprint hit is verified against the stored digest."""
        mark = int.from_bytes(key[6:8], "little")
        for bucket in self._places(key, mark):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                record = self.slots[slot]
                if record and self.prints[record] == mark and self.keys[record] == key:
                    return slot
        return -1

    def insert(self, key: bytes, keep: int, size: int, salts: int) -> None:
        """Add a digest, or merge into the live one: the larger id stays, sizes add up."""
        slot = self.find(key)
        if slot >= 0:
            record = self.slots[slot]
            self.keep[record] = max(self.keep[record], keep)
            self.size[record] += size
            self.salts[record] |= salts
            return
        self.keys.append(key)
        self.prints.append(int.from_bytes(key[6:8], "little"))
        self.keep.append(keep)
        self.size.append(size)
        self.salts.append(salts)
        self.live += 1
        if not self._place(len(self.keys) - 1):
            self._grow()

    def delete(self, key: bytes) -> bool:
        slot = self.find(key)
        if slot < 0:
            return False
        self.keys[self.slots[slot]] = None
        self.slots[slot] = 0
        self.live -= 1
        return True

    def _place(self, record: int) -> bool:
        mark = self.prints[record]
        bucket, other = self._places(self.keys[record], mark)
        for kick in range(KICKS):
            for b in (bucket, other):
                for slot in range(b * SLOTS, b * SLOTS + SLOTS):
                    if not self.slots[slot]:
                        self.slots[slot] = record
                        return True
            slot = other * SLOTS + kick % SLOTS
            record, self.slots[slot] = self.slots[slot], record
            mark = self.prints[record]
            bucket = other
            other = (other ^ (mark * 0x5BD1E995)) & self.mask
        return False

    def _grow(self) -> None:
        """Overflow: double the buckets and place every stored digest anew."""
        buckets = (self.mask + 1) * 2
        while True:
            self._clear(buckets)
            if all(self._place(r) for r in range(1, len(self.keys)) if self.keys[r] is not None):
                return
            buckets *= 2

    def records(self) -> list[int]:
        return [r for r in range(1, len(self.keys)) if self.keys[r] is not None]

    def pack(self) -> tuple[int, bytes, bytes, bytes, bytes, bytes]:
        """Slot count, slot fingerprints and, slot by slot, the stored content."""
        at = [r for r in self.slots if r]
        marks = np.zeros(len(self.slots), dtype=np.uint32)
        marks[np.flatnonzero(np.array(self.slots, dtype=np.int64))] = [self.prints[r] + 1 for r in at]
        ints = [np.array([x[r] for r in at], dtype=np.uint64 if x is self.salts else np.int64).tobytes() for x in (self.keep, self.size, self.salts)]
        return len(self.slots), marks.tobytes(), b"".join(self.keys[r] for r in at), *ints

    @classmethod
    def unpack(cls, slots: int, marks: bytes, digests: bytes, keep: bytes, sizes: bytes, salts: bytes) -> CuckooFilter:
        out = cls(slots // SLOTS)
        used = np.flatnonzero(np.frombuffer(marks, dtype=np.uint32)).tolist()
        out.keys += [digests[i : i + 32] for i in range(0, len(digests), 32)]
        out.prints += [int.from_bytes(k[6:8], "little") for k in out.keys[1:]]
        out.keep += np.frombuffer(keep, dtype=np.int64).tolist()
        out.size += np.frombuffer(sizes, dtype=np.int64).tolist()
        out.salts += np.frombuffer(salts, dtype=np.uint64).tolist()
        for record, slot in enumerate(used, 1):
            out.slots[slot] = record
        out.live = len(used)
        return out


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row: SHA-256 of the whole text, A-Z lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = [hashlib.sha256((t or b"").translate(LOWER)).digest() for t in texts]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "digest"])

    return long_rows(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ROWS)


def _entries(index: CuckooFilter) -> pa.RecordBatch:
    at = index.records()
    salts = np.array([index.salts[r] for r in at], dtype=np.uint64).view(np.int64)
    return pa.record_batch(
        [
            pa.array([index.keys[r] for r in at], pa.binary()),
            pa.array([index.keep[r] for r in at], pa.int64()),
            pa.array([index.size[r] for r in at], pa.int64()),
            pa.array(salts, pa.int64()),
        ],
        names=["digest", "keep_id", "group_size", "salts"],
    )


def combined(rows: DataFrame) -> DataFrame:
    """Entries of each task's own rows, merged in a task-local index: a hot digest leaves a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooFilter()
        for batch in batches:
            for doc, key, salt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                index.insert(key, NO_ID if doc is None else doc, 1, 1 << salt)
            if index.live > 4 * SHARD_KEYS:
                yield _entries(index)
                index = CuckooFilter()
        yield _entries(index)

    salted = rows.select("doc_id", "digest", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    return salted.mapInArrow(run, ENTRIES)


def _shard(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", (F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long") % shards).cast("int"))


def _packed(shard: int, index: CuckooFilter) -> pa.Table:
    values = index.pack()
    types = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
    names = [x.split()[0] for x in INDEX.split(", ")]
    return pa.table([pa.array([v], t) for v, t in zip((shard, *values), types, strict=True)], names=names)


def _loaded(table: pa.Table) -> CuckooFilter:
    if not table.num_rows:
        return CuckooFilter()
    return CuckooFilter.unpack(*[table.column(i)[0].as_py() for i in range(1, 7)])


def _add(index: CuckooFilter, entries: pa.Table) -> CuckooFilter:
    columns = [entries.column(n).to_pylist() for n in ("digest", "keep_id", "group_size", "salts")]
    for key, keep, size, salts in zip(*columns, strict=True):
        index.insert(key, keep, size, salts & 0xFFFFFFFFFFFFFFFF)
    return index


def build(rows: DataFrame, shards: int) -> DataFrame:
    """Index of all digests: one packed cuckoo filter per shard. `rows` are (doc_id, digest)."""

    def run(key: tuple, entries: pa.Table) -> pa.Table:
        return _packed(key[0].as_py(), _add(CuckooFilter(), entries))

    return _shard(combined(rows), shards).groupBy("shard").applyInArrow(run, INDEX)


def insert(index: DataFrame, rows: DataFrame, shards: int) -> DataFrame:
    """The index with more rows added; `shards` is the number it was built with."""

    def run(key: tuple, old: pa.Table, new: pa.Table) -> pa.Table:
        return _packed(key[0].as_py(), _add(_loaded(old), new))

    return index.groupBy("shard").cogroup(_shard(combined(rows), shards).groupBy("shard")).applyInArrow(run, INDEX)


def delete(index: DataFrame, gone: DataFrame, shards: int) -> DataFrame:
    """The index without the digests of `gone`; digests that are not live are passed over."""

    def run(key: tuple, old: pa.Table, dead: pa.Table) -> pa.Table:
        live = _loaded(old)
        for digest in dead.column("digest").to_pylist():
            live.delete(digest)
        return _packed(key[0].as_py(), live)

    dead = _shard(gone.select("digest").distinct(), shards)
    return index.groupBy("shard").cogroup(dead.groupBy("shard")).applyInArrow(run, INDEX)


def entries(index: DataFrame) -> DataFrame:
    """Live digests of the index with the id that stays, the group size and the salts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield _entries(CuckooFilter.unpack(*[batch.column(i)[row].as_py() for i in range(1, 7)]))

    return index.mapInArrow(run, ENTRIES)


def lookup(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Each row of (doc_id, digest) with keep_id and group_size of its live digest, null if there is none.

    Rows of one digest are dealt over salts; an entry goes only to the salts of the rows looked up, whether or not the index
    has seen these rows.
    """
    return salted_lookup(rows, "digest", "doc_id", entries(index).drop("salts"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. The largest doc_id of equal texts stays."""
    rows = checkpointed(digests(docs))
    shards = 1 + rows.count() // SHARD_KEYS
    found = lookup(build(rows, shards), rows)
    keep = F.when(F.col("keep_id") != NO_ID, F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
