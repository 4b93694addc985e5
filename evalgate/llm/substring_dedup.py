"""Removal of repeated 50-byte strings by prefix-free parsing (operator 8).

Texts are bytes. A byte goes when a 50-byte string that covers it also starts in a document with a smaller doc_id.

Parsing: the rolling hash of the 24 bytes at a position triggers where it is the smallest (the leftmost of equals) of the 27
hashes inside some 50-byte string. Every 50-byte string so has one trigger, and equal strings have it at the same place. A
phrase is the text of consecutive strings with one trigger; the dictionary holds each distinct phrase once, with its smallest
document. Phrases meet by trigger:

1. Equal phrases: all strings of a later document repeat. A phrase whose trigger occurs once is left out at once; in repetitive
   text nearly all others are settled here, copies within a batch even before the shuffle.
2. A trigger with several distinct phrases (the edges of passages, edits): the suffixes that start in those phrases, cut at 50
   bytes, are brought into lexicographic order - the suffix array of that part of the dictionary; equal neighbours are one
   string, and its smallest document decides, string by string.
3. The parse is read again: a document's phrases, by their ordinal, take their verdicts and the covered bytes are removed.

Rows move as packed arrays between three kinds of partitions (by trigger, by block of documents); every partition holds a
share of the input that does not grow. Defined results: null texts count as empty; texts under 50 bytes stay whole; rows that
repeat a doc_id do not shorten each other; a null doc_id is the smallest; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgate.llm.common import checkpointed

LENGTH = 50
GRAM = 24
SPAN = LENGTH - GRAM + 1
#: Bytes of text for each partition of triggers and each block of documents.
SHARE = 16 << 20
#: Windows of a text that are parsed at once; strings do not care where a text is cut. The grams of a chunk, SPAN - 1 more than
#: its windows, are numbered in 20 bits.
CHUNK = (1 << 20) - 64
#: Suffixes that are sorted at once.
SORTED = 1 << 20
NO_ID = -(2**63)
RESULT, OPEN, TEXT = 0, 1, 2
MOVED = "part int, kind int, block int, blob binary"
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_LOW = np.uint64((1 << 20) - 1)


def _words(raw: bytes) -> np.ndarray:
    """The eight bytes at every position as an integer."""
    n = len(raw) - 7
    out = np.empty(n, dtype=np.uint64)
    for shift in range(min(8, n)):
        count = (len(raw) - shift) // 8
        out[shift::8] = np.frombuffer(raw, dtype="<u8", count=count, offset=shift)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _C[3]
    return x ^ (x >> np.uint64(32))


def parsed(text: bytes) -> np.ndarray:
    """Phrases of a text, one row each: trigger hash, phrase hash, first string, number of strings, trigger's offset in it."""
    found = []
    for at in range(0, len(text) - LENGTH + 1, CHUNK):
        raw = text[at : at + CHUNK + LENGTH - 1]
        words = _words(raw)
        n = len(raw) - GRAM + 1
        grams = _mixed(words[:n] * _C[0] ^ _mixed(words[8 : 8 + n] * _C[1]) ^ _mixed(words[16 : 16 + n] + _C[2]))
        keys = (grams & ~_LOW) | np.arange(n, dtype=np.uint64)
        low = keys
        for step in (1, 2, 4, 8):
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[: n - SPAN + 1], low[SPAN - 16 : n - SPAN + 1 + SPAN - 16])
        trigger = (low & _LOW).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(trigger)) + 1])
        count = np.diff(np.append(first, len(trigger)))
        trigger = trigger[first]
        end = first + count - 1 + LENGTH
        phrase = _mixed(((trigger - first) * 64 + count).astype(np.uint64))
        for j in range(0, LENGTH + SPAN, 8):
            phrase = _mixed(phrase * _C[1] + words[np.minimum(first + j, end - 8)])
        found.append(np.column_stack([grams[trigger].view(np.int64), phrase.view(np.int64), first + at, count, trigger - first]))
    return np.concatenate(found) if found else np.zeros((0, 5), dtype=np.int64)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, compressed; integers that grow are kept as differences."""
    parts = [len(columns[0]).to_bytes(8, "little")]
    for c in columns:
        flat = np.diff(c, prepend=c.dtype.type(0)) if c.dtype == np.int64 and c.ndim == 1 else c
        # the bytes of equal weight side by side compress best
        parts.append(np.ascontiguousarray(flat.view(np.uint8).reshape(len(c), -1).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpack(blob: bytes, *kinds: tuple[type, int]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind, width in kinds:
        size = n * width * np.dtype(kind).itemsize
        flat = np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(-1, n).T).view(kind)
        flat = flat.reshape(n, width) if width > 1 else flat.reshape(n)
        out.append(np.cumsum(flat, dtype=np.int64) if kind is np.int64 and width == 1 else flat)
        at += size
    return out


#: Phrases on the way to their trigger: low bytes of both hashes, document, row, ordinal.
_PHRASES = ((np.uint8, 6), (np.uint8, 6), (np.int64, 1), (np.int64, 1), (np.int64, 1))
#: Verdicts and open phrases on the way to their block: row, ordinal, strings that repeat as bits (0: all).
_VERDICTS = ((np.int64, 1), (np.int64, 1), (np.uint32, 1))
#: Contents of open phrases: trigger, document, row, ordinal, strings, trigger's offset, text padded to its longest.
_CONTENTS = ((np.int64, 1), (np.int64, 1), (np.int64, 1), (np.int64, 1), (np.uint8, 1), (np.uint8, 1), (np.uint8, LENGTH + SPAN - 1 + 6))
#: Texts: row, document, length; the bytes follow in a column of their own.
_TEXTS = ((np.int64, 1), (np.int64, 1), (np.int64, 1))


def _block_of(rows: np.ndarray, blocks: int) -> np.ndarray:
    return (_mixed(rows.view(np.uint64) * _C[0]) % np.uint64(blocks)).astype(np.int64)


def _low_bytes(hashes: np.ndarray, width: int = 6) -> np.ndarray:
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(len(hashes), 8)[:, :width]


def _whole(low: np.ndarray) -> np.ndarray:
    out = np.zeros((len(low), 8), dtype=np.uint8)
    out[:, : low.shape[1]] = low
    return out.view(np.int64).reshape(-1)


def _moved(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    part, kind, block, blob = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.record_batch([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(block, pa.int32()), pa.array(blob, pa.binary())], names=["part", "kind", "block", "blob"])


def _by(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Positions by number, in their old order."""
    order = np.argsort(numbers, kind="stable")
    cuts = np.flatnonzero(np.diff(numbers[order], prepend=-1, append=-1)) if len(numbers) else []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(numbers[order[lo]]), order[lo:hi]


def _verdicts(rows: np.ndarray, ordinals: np.ndarray, bits: np.ndarray, blocks: int, kind: int) -> list[tuple[int, int, int, bytes]]:
    out = []
    for block, at in _by(_block_of(rows, blocks)):
        at = at[np.lexsort((ordinals[at], rows[at]))]
        out.append((block, kind, block, _pack(rows[at], ordinals[at], bits[at])))
    return out


def _least(groups: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Smallest document of each row's group; rows are sorted by group."""
    starts = np.flatnonzero(np.diff(groups, prepend=groups[:1] - 1)) if len(groups) else np.zeros(0, dtype=np.int64)
    return np.repeat(np.minimum.reduceat(docs, starts), np.diff(np.append(starts, len(groups)))) if len(starts) else docs


def phrases(docs: DataFrame, parts: int, blocks: int) -> DataFrame:
    """MOVED rows: phrases for their trigger's partition (kind OPEN), and verdicts on copies within a batch (RESULT)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, owners = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found, which = [np.zeros((0, 5), dtype=np.int64)], [0]
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                found.append(parsed(text or b""))
                which.append(len(found[-1]))
            all_ = np.concatenate(found)
            row, doc = np.repeat(ids, which[1:]), np.repeat(owners, which[1:])
            ordinal = np.arange(len(all_)) - np.repeat(np.cumsum(which)[:-1], which[1:])
            trigger, phrase = all_[:, 0], all_[:, 1]
            order = np.lexsort((doc, phrase, trigger))
            same = np.cumsum((np.diff(trigger[order], prepend=0) != 0) | (np.diff(phrase[order], prepend=0) != 0))
            later = np.zeros(len(all_), dtype=bool)
            later[order] = doc[order] > _least(same, doc[order])
            out = _verdicts(row[later], ordinal[later], np.zeros(later.sum(), dtype=np.uint32), blocks, RESULT)
            at = np.flatnonzero(~later)
            for part, mine in _by((trigger[at].view(np.uint64) % np.uint64(parts)).astype(np.int64)):
                mine = at[mine]
                out.append((part, OPEN, 0, _pack(_low_bytes(trigger[mine]), _low_bytes(phrase[mine]), doc[mine], row[mine], ordinal[mine])))
            yield _moved(out)

    return _numbered(docs).mapInArrow(run, MOVED)


def settled(moved: DataFrame, parts: int, blocks: int) -> DataFrame:
    """MOVED rows by block: verdicts (RESULT), and the phrases whose strings must be compared (OPEN)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            kinds = batch.column(1).to_pylist()
            for i, kind in enumerate(kinds):
                if kind == OPEN:
                    held.append(_unpack(batch.column(3)[i].as_py(), *_PHRASES))
            mine = np.flatnonzero(np.array(kinds) == RESULT)
            if len(mine):
                yield batch.take(pa.array(mine))
        if not held:
            return
        trigger, phrase, doc, row, ordinal = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        trigger, phrase = _whole(trigger), _whole(phrase)
        order = np.lexsort((doc, phrase, trigger))
        trigger, phrase = trigger[order], phrase[order]
        met = np.diff(trigger, prepend=~trigger[0]) != 0
        size = np.diff(np.append(np.flatnonzero(met), len(trigger)))
        many = np.repeat(size > 1, size)
        order, trigger, phrase = order[many], trigger[many], phrase[many]
        if not len(order):
            return
        doc, row, ordinal = doc[order], row[order], ordinal[order]
        new = np.diff(trigger, prepend=~trigger[0]) != 0
        group = np.cumsum(new)
        class_ = np.cumsum(new | (np.diff(phrase, prepend=0) != 0))
        later = doc > _least(class_, doc)
        starts = np.flatnonzero(new)
        classes = np.repeat(np.maximum.reduceat(class_, starts) - np.minimum.reduceat(class_, starts), np.diff(np.append(starts, len(group))))
        yield _moved(_verdicts(row[later], ordinal[later], np.zeros(later.sum(), dtype=np.uint32), blocks, RESULT))
        left = ~later & (classes > 0)
        yield _moved(_verdicts(row[left], ordinal[left], np.zeros(left.sum(), dtype=np.uint32), blocks, OPEN))

    return moved.repartition(parts, "part").mapInArrow(run, MOVED)


def packed_texts(docs: DataFrame, blocks: int) -> DataFrame:
    """MOVED rows of compressed texts by block (kind TEXT)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, owners = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = batch.column(2).cast(pa.binary())
            out = []
            for block, at in _by(_block_of(ids, blocks)):
                mine = [texts[int(i)].as_py() or b"" for i in at]
                head = _pack(ids[at], owners[at], np.array([len(t) for t in mine], dtype=np.int64))
                body = zstandard.ZstdCompressor(level=1).compress(b"".join(mine))
                out.append((block, TEXT, block, len(head).to_bytes(8, "little") + head + body))
            yield _moved(out)

    return _numbered(docs).mapInArrow(run, MOVED)


def _texts(blob: bytes) -> Iterator[tuple[int, int, bytes]]:
    head = int.from_bytes(blob[:8], "little")
    ids, owners, lengths = _unpack(blob[8 : 8 + head], *_TEXTS)
    body, at = zstandard.ZstdDecompressor().decompressobj().decompress(blob[8 + head :]), 0
    for row, doc, length in zip(ids.tolist(), owners.tolist(), lengths.tolist(), strict=True):
        yield row, doc, body[at : at + length]
        at += length


class _Verdicts:
    """Ordinals and bits of a block's rows."""

    def __init__(self, blobs: list[bytes]) -> None:
        held = [_unpack(b, *_VERDICTS) for b in blobs] or [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)]]
        row, ordinal, bits = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(row, kind="stable")
        self.row, self.ordinal, self.bits = row[order], ordinal[order], bits[order]

    def of(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.searchsorted(self.row, (row, row + 1))
        return self.ordinal[lo:hi], self.bits[lo:hi]


def _gathered(batches: Iterator[pa.RecordBatch], kind: int) -> tuple[list[bytes], list[bytes]]:
    """Compressed texts and the blobs of a kind in a partition."""
    texts: list[bytes] = []
    others: list[bytes] = []
    for batch in batches:
        for k, blob in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if k == TEXT:
                texts.append(blob)
            elif k == kind:
                others.append(blob)
    return texts, others


def contents(texts: DataFrame, opened: DataFrame, parts: int, blocks: int) -> DataFrame:
    """MOVED rows: the text of open phrases, for their trigger's partition."""
    wide = _CONTENTS[-1][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, blobs = _gathered(batches, OPEN)
        wanted = _Verdicts(blobs)
        for blob in packed:
            kept = []
            for row, doc, text in _texts(blob):
                ordinals, _ = wanted.of(row)
                if not len(ordinals):
                    continue
                mine = parsed(text)[ordinals]
                raw = np.frombuffer(text + bytes(wide), dtype=np.uint8)
                bodies = raw[mine[:, 2, None] + np.arange(wide)[None]]
                bodies = np.where(np.arange(wide)[None] < mine[:, 3, None] + LENGTH - 1, bodies, 0).astype(np.uint8)
                n = len(ordinals)
                kept.append((mine[:, 0], np.full(n, doc), np.full(n, row), ordinals, mine[:, 3].astype(np.uint8), mine[:, 4].astype(np.uint8), bodies))
            if kept:
                columns = [np.concatenate(c) for c in zip(*kept, strict=True)]
                yield _moved([(part, OPEN, 0, _pack(*[c[at] for c in columns])) for part, at in _by((columns[0].view(np.uint64) % np.uint64(parts)).astype(np.int64))])

    return texts.union(opened).repartition(blocks, "block").mapInArrow(run, MOVED)


def _compared(trigger: np.ndarray, doc: np.ndarray, count: np.ndarray, bodies: np.ndarray) -> np.ndarray:
    """Bits of the strings of each phrase that start in a smaller document as well. Whole triggers only.

    The strings are put in order as seven big-endian words after their trigger; equal neighbours are one string.
    """
    owner = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    strings = np.zeros((len(owner), 56), dtype=np.uint8)
    strings[:, :LENGTH] = bodies[owner[:, None], number[:, None] + np.arange(LENGTH)[None]]
    words = strings.view(">u8").astype(np.uint64)
    keys = [doc[owner], *words.T[::-1], trigger[owner]]
    order = np.lexsort(keys)
    words, sorted_trigger, sorted_doc = words[order], trigger[owner][order], doc[owner][order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (words[1:] != words[:-1]).any(axis=1) | (sorted_trigger[1:] != sorted_trigger[:-1])
    repeated = np.zeros(len(order), dtype=bool)
    repeated[order] = sorted_doc > _least(np.cumsum(new), sorted_doc)
    bits = np.zeros(len(count), dtype=np.uint32)
    np.bitwise_or.at(bits, owner[repeated], np.uint32(1) << number[repeated].astype(np.uint32))
    return bits


def ordered(moved: DataFrame, parts: int, blocks: int) -> DataFrame:
    """MOVED rows by block: verdicts on single strings of open phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpack(b.as_py(), *_CONTENTS) for batch in batches for b in batch.column(3)]
        if not held:
            return
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        held.clear()
        order = np.argsort(columns[0], kind="stable")
        trigger, doc, row, ordinal, count, _, bodies = (c[order] for c in columns)
        ends = np.append(np.flatnonzero(np.diff(trigger)) + 1, len(trigger))
        lo = 0
        while lo < len(trigger):
            # whole triggers, about SORTED suffixes at once
            hi = int(ends[min(np.searchsorted(ends, lo + SORTED // SPAN, side="left"), len(ends) - 1)])
            bits = _compared(trigger[lo:hi], doc[lo:hi], count[lo:hi].astype(np.int64), bodies[lo:hi])
            hit = np.flatnonzero(bits)
            yield _moved(_verdicts(row[lo:hi][hit], ordinal[lo:hi][hit], bits[hit], blocks, RESULT))
            lo = hi

    return moved.repartition(parts, "part").mapInArrow(run, MOVED)


def removed(text: bytes, ordinals: np.ndarray, bits: np.ndarray) -> tuple[int, int, bytes]:
    """Bytes removed, runs of them and the bytes that stay."""
    if not len(ordinals):
        return 0, 0, text
    change = np.zeros(len(text) + 1, dtype=np.int64)
    mine = parsed(text)[ordinals]
    whole = bits == 0
    np.add.at(change, mine[whole, 2], 1)
    np.add.at(change, mine[whole, 2] + mine[whole, 3] - 1 + LENGTH, -1)
    for at, number in zip(mine[~whole, 2], bits[~whole], strict=True):
        starts = at + np.flatnonzero(number >> np.arange(32, dtype=np.uint32) & 1)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + LENGTH, -1)
    gone = np.cumsum(change[:-1]) > 0
    runs = int(gone[0]) + int((np.diff(gone.astype(np.int8)) == 1).sum())
    return int(gone.sum()), runs, np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()


def _numbered(docs: DataFrame) -> DataFrame:
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.select(F.monotonically_increasing_id().alias("row"), doc.alias("doc_id"), F.col("text").cast("string").alias("text"))


def verdicts(docs: DataFrame) -> tuple[DataFrame, int]:
    """Verdicts on phrases by block of documents, and the number of blocks."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"] or 0
    parts = blocks = 1 + size // SHARE
    first = checkpointed(settled(phrases(docs, parts, blocks), parts, blocks))
    moved = contents(packed_texts(docs, blocks), first.filter(F.col("kind") == OPEN), parts, blocks)
    second = checkpointed(ordered(moved, parts, blocks))
    return first.filter(F.col("kind") == RESULT).union(second), blocks


def _applied(docs: DataFrame, schema: str, made: object) -> DataFrame:
    results, blocks = verdicts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, blobs = _gathered(batches, RESULT)
        known = _Verdicts(blobs)
        for blob in packed:
            yield made([(doc, text, *removed(text, *known.of(row))) for row, doc, text in _texts(blob)])

    return packed_texts(docs, blocks).union(results).repartition(blocks, "block").mapInArrow(run, schema)


def _ids(rows: list[tuple]) -> pa.Array:
    return pa.array([None if r[0] == NO_ID else r[0] for r in rows], pa.int64())


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        ints = [pa.array(x, pa.int64()) for x in ([len(r[1]) for r in rows], [r[2] for r in rows], [r[3] for r in rows])]
        hashes = pa.array([hashlib.sha256(r[4]).hexdigest() for r in rows], pa.string())
        return pa.record_batch([_ids(rows), *ints, hashes], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _applied(docs, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", made)


def kept_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text): what stays of every document; characters cut in the middle become replacement marks."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([_ids(rows), pa.array([r[4].decode("utf-8", "replace") for r in rows], pa.string())], names=["doc_id", "text"])

    return _applied(docs, "doc_id long, text string", made)
