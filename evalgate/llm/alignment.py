"""Alignment of two tokenizers over a corpus (operator 13), as an Arrow pipeline inside Spark tasks.

A batch of texts is encoded by both tokenizers. From then on a batch is Arrow: token lists are flattened with their parent
indices, byte ends are cumulative sums of token lengths less those of the documents before, and tokens that end together come
from an Acero hash join on (document, end). Ends that both sides share cut a document into groups.

Tasks write chunks of about `CHUNK` links: the documents with their links as places in the chunk's own list of id pairs, and
that list with its partial counts (`Table.group_by`). Spark merges the counts of all chunks, finds the highest count of every B id
and hands each chunk the counts of its own pairs, so neither a table of pairs nor the links of a frequent pair are in one place.

Defined results: texts that are null, empty or that a tokenizer doesn't give back byte for byte have no tokens, zeros and '' for
groups; strings of special tokens are plain text; rows that repeat a doc_id are aligned each on its own, and a null doc_id stays
null; an empty table gives an empty result; other columns are not looked at. Chunks are written once to the shared folder of
spark.checkpoint.dir (zstd Parquet), like checkpoints, and left to whoever cleans up that folder.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgate.llm.common import checkpointed, long_rows, shared_folder

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Links of a chunk, and bytes of text encoded at once; a longer text is encoded alone.
CHUNK = 100_000
SLICE = 200_000
# Fixed value: how byte-level files split a text before merging.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SAVED = "chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places array<int>, place int, a int, b int, n long"
DOC = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@dataclass
class Side:
    """Bytes of every id, with lengths."""

    tokens: pa.LargeBinaryArray
    lengths: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Side:
        return cls(pa.array(tokens, pa.large_binary()), np.array([len(t) for t in tokens], dtype=np.int64))


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones as they are, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers with the bytes of their ids and the texts that groups are written with."""

    def __init__(self, byte_level: dict, pieces: bytes) -> None:
        import sentencepiece
        import tiktoken

        self.second = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        letters = byte_letters()
        vocabulary = byte_level["model"]["vocab"]
        named: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for name, number in vocabulary.items():
            named[number] = bytes(letters[c] for c in name)
        self.first = tiktoken.Encoding("file", pat_str=WORDS, mergeable_ranks={t: i for i, t in enumerate(named) if t}, special_tokens={})
        ids = range(self.second.get_piece_size())
        texts = [self.second.id_to_piece(i) for i in ids]
        self.a = Side.of(named)
        self.b = Side.of([bytes([int(t[3:5], 16)]) if self.second.is_byte(i) else t.replace("▁", " ").encode() for i, t in zip(ids, texts, strict=True)])
        # two forms of an A id (inside and at the end of a group) and three of a B id (the third ends the text)
        marks = [f"{i}{m}" for i in range(len(named)) for m in ",|"] + [f"{i}{m}" for i in ids for m in (",", ";", "")]
        self.marks, self.from_b = pa.array([m.encode() for m in marks], pa.large_binary()), 2 * len(named)

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [self.first.encode_ordinary(" " + t) for t in texts], self.second.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def tokenizers(byte_level: str, pieces: bytes) -> Tokenizers:
    """One pair of tokenizers for a worker, however many tasks it runs."""
    return Tokenizers(json.loads(byte_level), pieces)


def byte_level_file(path: str) -> str:
    """The text of a byte-level BPE file whose merges are applied in the order of their ids, without a normaliser or other words."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    model = json.loads(text)
    split, vocabulary, merges = model["pre_tokenizer"], model["model"]["vocab"], model["model"]["merges"]
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    if split["type"] != "ByteLevel" or not split.get("use_regex", True) or model["normalizer"] or made != sorted(made):
        raise ValueError(f"{path} is not a plain byte-level file with merges in the order of ids")
    return text


def _flat(lists: list[list[int]], side: Side) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, document of each, byte end of each in the batch, byte end of each document in the batch)."""
    listed = pa.array(lists, pa.large_list(pa.int32()))
    ids = listed.flatten()
    ends = np.cumsum(side.lengths[ids.to_numpy()])
    stops = np.concatenate([[0], ends])[listed.offsets.to_numpy()[1:]]
    return ids, pc.list_parent_indices(listed).to_numpy(), ends, stops


def _data(taken: pa.Array) -> memoryview:
    buffer = taken.buffers()[2]
    return memoryview(buffer).cast("B") if buffer is not None else memoryview(b"")


def _given_back(flat: tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray], side: Side, want: list[bytes]) -> list[bool]:
    """Whether the bytes of each document's tokens are the text's."""
    data, lo, same = _data(side.tokens.take(flat[0])), 0, []
    for hi, text in zip(flat[3].tolist(), want, strict=True):
        same.append(data[lo:hi] == text)
        lo = hi
    return same


@dataclass
class Aligned:
    """Aligned documents: a value per document, and the links of all of them in order."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    links_a: np.ndarray
    links_b: np.ndarray


def aligned(texts: list[str], book: Tokenizers) -> Aligned:
    want = [b" " + t.encode() if t else b"" for t in texts]
    encoded = [[ids if t else [] for ids, t in zip(lists, texts, strict=True)] for lists in book.encode(texts)]
    sides = (book.a, book.b)
    flat = [_flat(lists, side) for lists, side in zip(encoded, sides, strict=True)]
    keep = [bool(t) and x and y for t, x, y in zip(texts, *[_given_back(f, side, want) for f, side in zip(flat, sides, strict=True)], strict=True)]
    if not all(k or not t for k, t in zip(keep, texts, strict=True)):
        # rare: a text that one side doesn't give back has no tokens on either
        flat = [_flat([ids if k else [] for ids, k in zip(lists, keep, strict=True)], side) for lists, side in zip(encoded, sides, strict=True)]
    (ids_a, doc_a, ends_a, stops), (ids_b, doc_b, ends_b, _) = flat
    count = len(texts)
    before = np.concatenate([[0], stops[:-1]]) if count else stops
    # tokens that end together: a hash join on the document and the byte end in it
    left = pa.table({"doc": doc_a, "end": ends_a - before[doc_a], "a": ids_a})
    right = pa.table({"doc": doc_b, "end": ends_b - before[doc_b], "b": ids_b})
    links = left.join(right, keys=["doc", "end"], join_type="inner", use_threads=False).sort_by([("doc", "ascending"), ("end", "ascending")])
    of_link = links.column("doc").to_numpy()
    cuts, first = np.unique(before[of_link] + links.column("end").to_numpy(), return_index=True)
    of_doc = lambda docs: np.bincount(docs, minlength=count)
    groups = _written(ids_a.to_numpy(), ends_a, ids_b.to_numpy(), ends_b, cuts, stops, book)
    n_a, n_b = (np.bincount(d, minlength=count) for d in (doc_a, doc_b))
    sizes, data, lo, digests = np.cumsum(n_a + n_b), _data(groups), 0, []
    offsets = np.concatenate([[0], np.frombuffer(groups.buffers()[1], dtype=np.int64)[1 : len(groups) + 1]])
    for hi, k in zip(offsets[sizes].tolist(), keep, strict=True):
        digests.append(hashlib.sha256(data[lo:hi]).hexdigest() if k else "")
        lo = hi
    return Aligned(n_a, n_b, of_doc(of_link[first]), of_doc(of_link), digests, links.column("a").to_numpy(), links.column("b").to_numpy())


def _written(a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray, cuts: np.ndarray, stops: np.ndarray, book: Tokenizers) -> pa.Array:
    """The tokens of all documents in the order in which groups are written, each with the mark that follows it."""
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    last_a, last_b = (np.diff(g, append=-1) != 0 for g in (group_a, group_b))
    closing = np.isin(ends_b, stops) & last_b
    marks = np.concatenate([a.astype(np.int64) * 2 + last_a, book.from_b + b.astype(np.int64) * 3 + last_b + closing])
    order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
    return book.marks.take(pa.array(marks[order]))


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for at, text in enumerate(texts):
        if at > lo and size + len(text) > SLICE:
            yield lo, at
            lo, size = at, 0
        size += len(text)
    if lo < len(texts):
        yield lo, len(texts)


def _chunk_rows(chunk: int, ids: list[pa.Array], found: list[Aligned]) -> Iterator[pa.RecordBatch]:
    """The rows of one chunk: its documents with the places of their links' pairs, and the pairs with their counts."""
    joined = lambda name: np.concatenate([getattr(f, name) for f in found])
    pairs = pa.array((joined("links_a").astype(np.int64) << 32) | joined("links_b")).dictionary_encode()
    counts = pa.table({"place": pairs.indices}).group_by("place", use_threads=False).aggregate([("place", "count")]).sort_by("place")
    links = joined("n_links")
    offsets = pa.array(np.concatenate([[0], np.cumsum(links)]).astype(np.int32))
    values = pairs.dictionary.to_numpy()
    docs = {
        "doc_id": pa.concat_arrays(ids), "n_a": joined("n_a"), "n_b": joined("n_b"), "n_groups": joined("n_groups"), "n_links": links,
        "groups_sha256": [g for f in found for g in f.groups], "places": pa.ListArray.from_arrays(offsets, pairs.indices.cast(pa.int32())),
    }
    rows = {"place": counts.column("place").cast(pa.int32()), "a": (values >> 32).astype(np.int32), "b": (values & 0xFFFFFFFF).astype(np.int32), "n": counts.column("place_count")}
    for part in (docs, rows):
        table = pa.table(part)
        size = table.num_rows
        full = {n: table.column(n).cast(t) if n in part else pa.nulls(size, t) for n, t in _TYPES.items()}
        yield from pa.table(full | {"chunk": pa.array(np.full(size, chunk))}).select(list(_TYPES)).combine_chunks().to_batches()


_TYPES = {f.split()[0]: {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[f.split()[1]] for f in SAVED.split(", ")}


def chunks(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, chunk: int = CHUNK) -> DataFrame:
    """All chunks, written once: document rows (place is null) and pair rows (place, a, b and n are set)."""
    with open(pieces, "rb") as file:
        files = docs.sparkSession.sparkContext.broadcast((byte_level_file(byte_level), file.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, number = tokenizers(*files.value), TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        found: list[Aligned] = []
        held = 0
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in _slices(texts):
                found.append(aligned(texts[lo:hi], book))
                ids.append(batch.column(0).slice(lo, hi - lo))
                held += len(found[-1].links_a)
                if held >= chunk:
                    yield from _chunk_rows(number, ids, found)
                    ids, found, held, number = [], [], 0, number + 1
                    pa.default_memory_pool().release_unused()
        if found:
            yield from _chunk_rows(number, ids, found)

    place = f"{shared_folder(docs.sparkSession)}/alignment-{uuid.uuid4().hex}"
    rows = long_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(run, SAVED).write.option("compression", "zstd").parquet(place)
    return docs.sparkSession.read.parquet(place)


def pair_counts(saved: DataFrame) -> DataFrame:
    """(a, b, count, best): links of every id pair in the corpus and whether its B id has no pair with more."""
    counts = checkpointed(saved.filter("place IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("count")))
    # a row per B id at most: as many as the vocabulary has
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def alignments(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    saved = chunks(docs, byte_level, pieces, chunk)
    facts = saved.filter("place IS NOT NULL").select("chunk", "place", "a", "b").join(pair_counts(saved), ["a", "b"]).select(F.col("chunk").alias("of"), "place", "count", "best")

    def scored(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("place")
        places = left.column("places").combine_chunks()
        at = places.flatten()
        each = pa.table({
            "doc": pc.list_parent_indices(places), "count": right.column("count").take(at), "best": right.column("best").take(at).cast(pa.int64()),
        })
        sums = each.group_by("doc", use_threads=False).aggregate([("count", "sum"), ("best", "sum")])
        out = {name: np.zeros(left.num_rows, dtype=np.int64) for name in ("count", "best")}
        for name, values in out.items():
            values[sums.column("doc").to_numpy()] = sums.column(f"{name}_sum").to_numpy()
        return left.drop_columns(["chunk", "places"]).append_column("n_best", pa.array(out["best"])).append_column("count_sum", pa.array(out["count"])).select(DOC)

    rows = saved.filter("place IS NULL").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places")
    return rows.groupBy("chunk").cogroup(facts.groupBy("of")).applyInArrow(scored, RESULT)
