"""SentencePiece encoding and decoding by a max-plus scan (operator 3).

The model file holds a byte-pair vocabulary: an encoding is right exactly when every two neighbouring pieces are what the merges
make of their joint text. In the max-plus semiring an edge between two pieces so weighs 0 or minus infinity, the state at a
position is the piece that ends there, and the best path is the only one of weight 0: the library's own encoding.

Documents longer than `CHUNK` characters are cut at fixed places. The state at a cut is the piece over the character before it.
Every chunk yields its transfer matrix from the states of its left cut to those of its right cut (sparse: the pairs of weight 0).
Prefix and suffix products of the matrices, combined associatively, leave one state at every cut; each chunk is then traced back
on its own between its two states. Shorter documents are one chunk between the start and the end.

Runs of spaces are merged last by the model (all their pieces have one score), so they are put together after the scan. No piece
goes from a letter into a space, so words are encoded once and remembered. Nor does any merge join two neighbouring characters
that no piece holds side by side: words are cut there, and of a new word only the parts that are new are searched.

Defined results: null texts count as empty and have no pieces; characters without a piece become byte pieces; U+2581 in a text
is the model's space and comes back as one; rows that repeat a doc_id are encoded on their own; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgate.llm.common import long_rows

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 16_384
SPACE = "▁"
#: Words, parts of words, and pairs of pieces, that a worker remembers; words and parts in two generations.
REMEMBERED = 200_000
CUTS = "row long, doc_id long, chunk int, chunks int, before string, body string, after string"
State = tuple[int, str]
#: Before the first and after the last character there is one state.
EDGE: State = (0, "")


@dataclass
class Vocabulary:
    """Pieces with ids and scores, the merges they imply, and what has been found out about words and neighbours."""

    pieces: list[str]
    scores: list[float]
    plain: list[bool]
    byte: list[int]
    #: Pieces that merging their own text gives; worked out once and sent along.
    good: frozenset[str] = frozenset()
    #: Ids of words, as the bytes of 32-bit integers.
    words: dict[str, bytes] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.id = {p: i for i, p in enumerate(self.pieces) if self.plain[i]}
        self.byte_id = {b: i for i, b in enumerate(self.byte) if b >= 0}
        self.longest = max(map(len, self.id))
        self.runs = {p for p in self.id if len(p) > 1 and not p.strip(SPACE)}
        many = [p for p in self.id if len(p) > 1 and p not in self.runs]
        if any(SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) for p in many):
            raise ValueError("a piece goes from a letter into a space, or joins spaces to letters")
        # merges that are not of spaces alone; no two have one score
        self.rank = {p: self.scores[self.id[p]] for p in many}
        alone = "" if any("\n" in p for p in many) else "\n"
        self.split = re.compile(f"{SPACE}[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|{alone}" if alone else "")).findall
        self.turn = re.compile(f"[^{SPACE}](?={SPACE})").search
        self.fits = lru_cache(maxsize=REMEMBERED)(self._fits)
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.older_parts: dict[str, bytes] = {}
        #: Neighbouring characters that some piece holds.
        self.inside = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.good = self.good or frozenset(p for p in self.rank if self.merged(p) == [p])
        self.number = {p: self.id[p] for p in self.good} | {p: i for p, i in self.id.items() if len(p) == 1}
        self.pairs: dict[int, bool] = {}
        #: Length of the longest piece that begins with three characters.
        self.ahead: dict[str, int] = {}
        for p in self.good:
            self.ahead[p[:3]] = max(self.ahead.get(p[:3], 0), len(p))
        self.output = [bytes([b]) if b >= 0 else p.replace(SPACE, " ").encode() if ok else b"" for p, b, ok in zip(self.pieces, self.byte, self.plain, strict=True)]

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in ids]
        byte = [int(p[3:5], 16) if model.is_byte(i) else -1 for i, p in enumerate(pieces)]
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in ids]
        return cls(pieces, [model.get_score(i) for i in ids], plain, byte)

    def __getstate__(self) -> tuple:
        return self.pieces, self.scores, self.plain, self.byte, self.good

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text: the best-scored neighbours first, the leftmost of equals."""
        parts, rank = list(text), self.rank.get
        while True:
            best, at, before = None, 0, parts[0]
            for i in range(1, len(parts)):
                after = parts[i]
                score = rank(before + after)
                if score is not None and (best is None or score > best):
                    best, at = score, i
                before = after
            if best is None:
                return parts
            parts[at - 1 : at + 1] = [parts[at - 1] + parts[at]]

    def _fits(self, a: str, b: str) -> bool:
        """Weight 0 of an edge: merging the joint text gives these two pieces."""
        return self.merged(a + b) == [a, b]

    def forward(self, text: str, known: list[str | None]) -> list[str | None]:
        """The piece that ends at each position, None where no path of weight 0 does; `known` holds the first positions.

        An empty string stands for an edge, whose neighbour is free.
        """
        last = known + [None] * (len(text) + 1 - len(known))
        good, fits, longest = self.good, self.fits, self.longest
        latest = max((p for p, piece in enumerate(known) if piece is not None), default=-longest)
        for end in range(len(known), len(text) + 1):
            if end - latest > longest:
                break
            for begin in range(max(0, end - longest), end):
                before = last[begin]
                if before is None:
                    continue
                piece = text[begin:end]
                if (end - begin == 1 or piece in good) and (not before or fits(before, piece)):
                    last[end] = piece
                    latest = end
                    break
        return last

    def searched(self, text: str) -> bytes:
        """Ids along the path of weight 0 through a word, the longest piece first.

        What leads to a place is the encoding of the text before it, so there is one state at each place, and a place
        without a way on is dead for good. A character that is no piece fits any neighbour.
        """
        n, at, before = len(text), 0, -1
        known, pairs, ahead, dead = self.number.get, self.pairs, self.ahead, set()
        steps: list[tuple[int, int]] = []
        size = min(ahead.get(text[:3], 2), n)
        while at < n:
            while size:
                piece = known(text[at : at + size], -1)
                if (piece >= 0 or size == 1) and not (dead and at + size in dead):
                    if before < 0 or piece < 0:
                        break
                    if (fit := pairs.get(before << 20 | piece)) is None:
                        fit = self._pair(before, piece)
                    if fit:
                        break
                size -= 1
            if size:
                steps.append((piece, size))
                at, before = at + size, piece
                size = min(ahead.get(text[at : at + 3], 2), n - at)
            else:
                dead.add(at)
                size = steps.pop()[1]
                at, size, before = at - size, size - 1, steps[-1][0] if steps else -1
        if min(steps)[0] >= 0:
            return array("i", [piece for piece, _ in steps]).tobytes()
        found, at = [], 0
        for _, size in steps:
            found.append(text[at : at + size])
            at += size
        return self.packed(found)

    def _pair(self, before: int, piece: int) -> bool:
        """Weight of the edge between two pieces, remembered."""
        if len(self.pairs) >= 2 * REMEMBERED:
            self.pairs.clear()
        fit = self.pairs[before << 20 | piece] = self._fits(self.pieces[before], self.pieces[piece])
        return fit

    def word(self, text: str) -> bytes:
        """Ids of a stretch without a space after its first character; the latest words are remembered."""
        if (ids := self.older.get(text)) is None:
            ids = self.by_parts(text) if text else b""
        if len(text) <= 32:
            if len(self.words) >= REMEMBERED:
                self.older = dict(self.words)
                self.words.clear()
            self.words[text] = ids
        return ids

    def by_parts(self, text: str) -> bytes:
        """Ids of a word from its parts, which end where no piece holds both neighbouring characters."""
        inside, get = self.inside, self.parts.get
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in inside]
        if not cuts:
            return get(text) or self.part(text)
        parts = [text[lo:hi] for lo, hi in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        return b"".join([get(p) or self.part(p) for p in parts])

    def part(self, text: str) -> bytes:
        """Ids of a part of a word; the latest parts are remembered."""
        if (ids := self.older_parts.get(text)) is None:
            ids = self.searched(text)
        if len(text) <= 32:
            if len(self.parts) >= REMEMBERED:
                self.older_parts = dict(self.parts)
                self.parts.clear()
            self.parts[text] = ids
        return ids

    def packed(self, found: list[str]) -> bytes:
        """Ids of pieces; a character that is none becomes byte pieces."""
        get, out = self.id.get, array("i")
        for piece in found:
            if (i := get(piece)) is not None:
                out.append(i)
            else:
                out.extend([self.byte_id[b] for b in piece.encode("utf-8", "replace")])
        return out.tobytes()

    def spaces(self, count: int) -> list[int]:
        """Pieces of a run of spaces: equal scores, so the leftmost two neighbours that make a piece are merged first."""
        parts = [1] * count
        at = 0
        while at < len(parts) - 1:
            if SPACE * (parts[at] + parts[at + 1]) in self.runs:
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                at = max(at - 1, 0)
            else:
                at += 1
        return [self.id[SPACE * n] for n in parts]

    def with_runs(self, packed: bytes) -> np.ndarray:
        """Ids with runs of single spaces merged."""
        ids = np.frombuffer(packed, dtype=np.int32)
        space = ids == self.id[SPACE]
        if not (space[1:] & space[:-1]).any():
            return ids
        edges = np.flatnonzero(np.diff(np.concatenate([[False], space, [False]]).astype(np.int8)))
        out, at = [], 0
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            out += [ids[at:lo], np.array(self.spaces(hi - lo), dtype=np.int32)]
            at = hi
        return np.concatenate([*out, ids[at:]])

    def encode_whole(self, normal: str) -> bytes:
        """Ids of a whole normalised text, runs of spaces not yet merged."""
        get, word = self.words.get, self.word
        return b"".join([get(w) or word(w) for w in self.split(normal)])

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.output.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    # chunks of a long document

    def states(self, left: str, right: str) -> list[State]:
        """States at a cut between two texts: pieces over the last character of `left`, as (characters left of the cut, piece)."""
        joint, cut = left + right, len(left)
        if not left or not right:
            return [EDGE]
        found = []
        for begin in range(max(0, cut - self.longest), cut):
            for end in range(cut, min(len(joint), begin + self.longest) + 1):
                piece = joint[begin:end]
                if len(piece) == 1 or piece in self.good:
                    found.append((cut - begin, piece))
        return found

    def word_starts(self, body: str) -> tuple[int, int] | None:
        """First and last place in a chunk that no piece crosses: a space after a letter."""
        first = self.turn(body)
        if first is None:
            return None
        last = body.rfind(SPACE, 1)
        while body[last - 1] == SPACE:
            last = body.rfind(SPACE, 1, last)
        return first.end(), last

    def transfer(self, before: str, body: str, after: str) -> list[tuple[State, State]]:
        """Transfer matrix of a chunk: the pairs of entry and exit states that a path of weight 0 joins.

        All paths meet at a place that no piece crosses; without one, paths that agree on the last positions of the
        chunk's head go on alike.
        """
        found, onward = [], {}
        turns = self.word_starts(body)
        text, head = body + after[: self.longest - 1], turns[0] if turns else min(len(body), 4 * self.longest)
        for entry in self.states(before[-self.longest :], body[: self.longest]) if before else [EDGE]:
            last = self.forward(body[:head], self._entered(entry))
            tail = (last[head] and "",) if turns else tuple(last[-self.longest :])
            if any(x is not None for x in tail):
                if tail not in onward:
                    at = turns[1] if turns else 0
                    onward[tail] = self._exits(self.forward(text[at:], [""] if turns else last), len(body) - at, after)
                found += [(entry, out) for out in onward[tail]]
        return found

    @staticmethod
    def _entered(entry: State) -> list[str | None]:
        return [None] * (len(entry[1]) - entry[0]) + [entry[1]]

    def _exits(self, last: list[str | None], n: int, after: str) -> list[State]:
        if not after:
            return [EDGE] if last[n] is not None else []
        ends = [(end, last[end]) for end in range(n, min(len(last), n + self.longest)) if last[end]]
        return [(n - (end - len(piece)), piece) for end, piece in ends if end - len(piece) < n]

    def trace(self, before: str, body: str, after: str, entry: State, leave: State) -> bytes:
        """Ids of the pieces that begin in a chunk, between its two states."""
        turns, known = self.word_starts(body), self._entered(entry)
        end = len(body) if leave == EDGE else len(body) - leave[0] + len(leave[1])
        text = body + after[: self.longest - 1]
        if turns is None:
            return self._traced(self.forward(text, known), len(known) - 1, end)
        first, last = turns
        head = self._traced(self.forward(body[:first], known), len(known) - 1, first)
        return head + self.encode_whole(body[first:last]) + self._traced(self.forward(text[last:], [""]), 0, end - last)

    def _traced(self, last: list[str | None], start: int, end: int) -> bytes:
        found = []
        while end > start:
            found.append(last[end])
            end -= len(last[end])
        return self.packed(found[::-1])


Matrix = frozenset[tuple[State, State]]


def product(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product of sparse matrices with weights 0 and minus infinity; associative."""
    onward: dict[State, list[State]] = {}
    for left, right in b:
        onward.setdefault(left, []).append(right)
    return frozenset((left, out) for left, middle in a for out in onward.get(middle, ()))


def prefixes(matrices: list[Matrix]) -> list[Matrix]:
    """All prefix products, by recursive doubling."""
    out, step = list(matrices), 1
    while step < len(out):
        out = [product(out[i - step], out[i]) if i >= step else out[i] for i in range(len(out))]
        step *= 2
    return out


def suffixes(matrices: list[Matrix]) -> list[Matrix]:
    flipped = [frozenset((b, a) for a, b in m) for m in reversed(matrices)]
    return [frozenset((b, a) for a, b in m) for m in reversed(prefixes(flipped))]


def cut_states(matrices: list[Matrix]) -> list[State]:
    """The state at each inner cut: reachable from the start, and the end reachable from it."""
    ahead, back = prefixes(matrices), suffixes(matrices)
    return [next(iter({out for _, out in ahead[k]} & {entry for entry, _ in back[k + 1]})) for k in range(len(matrices) - 1)]


def normal(text: str | None) -> str:
    """Spaces as the model writes them, one before the text; nothing for an empty text."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def _list(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32)))


def _arrays(lists: pa.ListArray) -> Iterator[np.ndarray]:
    """Rows of a list column, one at a time; a null row is empty."""
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for lo, hi, there in zip(ends, ends[1:], lists.is_valid().to_pylist(), strict=False):
        yield values[lo:hi] if there else values[:0]


def encoded(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids) of every row."""
    return _encoded(docs, model, chunk, lambda book, doc, found: [doc, _list(found)], "doc_id long, ids array<int>")


def _encoded(docs: DataFrame, model: str, chunk: int, told: Callable[[Vocabulary, pa.Array, list[np.ndarray]], list[pa.Array]], columns: str) -> DataFrame:
    """What `told` makes of doc_ids and their ids, in the same pass that has encoded them."""
    names = [c.split()[0] for c in columns.split(", ")]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.load(model))
    reach = shared.value.longest
    rows = long_rows(docs).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) >= chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for batch in batches:
            found = [book.with_runs(book.encode_whole(normal(t))) for t in batch.column(2).to_pylist()]
            yield pa.record_batch(told(book, batch.column(1), found), names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                full = normal(text)
                count = -(-len(full) // chunk)
                for k in range(count):
                    lo, hi = k * chunk, min((k + 1) * chunk, len(full))
                    texts = full[max(0, lo - reach) : lo], full[lo:hi], full[hi : hi + reach]
                    yield pa.record_batch([pa.array([v], t) for v, t in zip((row, doc, k, count, *texts), _CUT_TYPES, strict=True)], names=[c.split()[0] for c in CUTS.split(", ")])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for batch in batches:
            found = [book.transfer(*t) for t in zip(*[batch.column(c).to_pylist() for c in ("before", "body", "after")], strict=True)]
            flat = [[_written(*a, *b) for a, b in m] for m in found]
            yield pa.record_batch([batch.column("row"), batch.column("chunk"), pa.array(flat, pa.list_(pa.string()))], names=["row", "chunk", "matrix"])

    def scanned(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        found = cut_states([frozenset(_read(x) for x in m) for m in table.column("matrix").to_pylist()])
        states = [EDGE, *found, EDGE]
        both = [_written(*a, *b) for a, b in zip(states, states[1:], strict=False)]
        return pa.table([table.column("row"), table.column("chunk"), pa.array(both, pa.string())], names=["row", "chunk", "between"])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for batch in batches:
            found = []
            for before, body, after, between in zip(*[batch.column(c).to_pylist() for c in ("before", "body", "after", "between")], strict=True):
                found.append(np.frombuffer(book.trace(before, body, after, *_read(between)), dtype=np.int32))
            yield pa.record_batch([*[batch.column(c) for c in ("row", "doc_id", "chunk")], _list(found)], names=["row", "doc_id", "chunk", "ids"])

    def run_merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for batch in batches:
            found = [book.with_runs(ids.tobytes()) for ids in _arrays(batch.column(1))]
            yield pa.record_batch(told(book, batch.column(0), found), names=names)

    chunks = rows.filter(long).mapInArrow(cut, CUTS).filter("row IS NOT NULL AND chunk IS NOT NULL").repartition("row", "chunk")
    states = chunks.mapInArrow(matrices, "row long, chunk int, matrix array<string>").groupBy("row").applyInArrow(scanned, "row long, chunk int, between string")
    parts = chunks.join(states, ["row", "chunk"]).mapInArrow(traced, "row long, doc_id long, chunk int, ids array<int>")
    joined = parts.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    giant = joined.select("doc_id", F.flatten("parts.ids").alias("ids")).mapInArrow(run_merged, columns)
    return rows.filter(~long).mapInArrow(whole, columns).union(giant)


_CUT_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())


def _written(a: int, x: str, b: int, y: str) -> str:
    return f"{a},{b},{len(x)},{x}{y}"


def _read(text: str) -> tuple[State, State]:
    a, b, n, rest = text.split(",", 3)
    return (int(a), rest[: int(n)]), (int(b), rest[int(n) :])


def decoded(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, text) of (doc_id, ids)."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.decode(ids.tolist()) for ids in _arrays(batch.column(1))]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def tokenized(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids and decoded_sha256, the hash of the text that the ids decode to."""

    def told(book: Vocabulary, doc: pa.Array, found: list[np.ndarray]) -> list[pa.Array]:
        hashes = [hashlib.sha256(book.decode(ids.tolist()).encode()).hexdigest() for ids in found]
        return [doc, pa.array([len(ids) for ids in found], pa.int64()), _list(found), pa.array(hashes, pa.string())]

    return _encoded(docs, model, chunk, told, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")
