"""Quality rules judged by an isolation forest (operator 1).

Each whole text gives rule statistics: words, characters in words, symbols, upper-case letters, repeated lines, repeated word
windows. How far their ratios lie beyond the usual rule limits are the features of an isolation forest: every tree splits a
small draw of rows at random values of random features, and a row that is isolated after few splits, on average over the
trees, is anomalous. A tree's draw is taken from all labelled rows, and no two trees share a row while there are enough. Every
document is scored with the same small model. The path-length score at which a row is rejected is calibrated on the `quality` of
all labelled rows, for the best balanced accuracy: counts per score, summed up in cells of scores.

Base rules come first: fewer than 50 words, or more than half of them in repeated windows, fail whatever the forest says.

Defined results: null and empty texts have no words and fail; without any labelled row the forest has no say and the base rules
decide; labels that are null or whose doc_id is unknown are not learned from; repeated rows are judged alike; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgate.functions.scores import cell_borders
from evalgate.llm.common import checkpointed
from evalgate.operators.metrics import running_counts

TREES = 100
DRAW = 512
SEED = 11
MIN_WORDS = 50
SYMBOLS = re.compile(r"[#*$%&|<>]")
NOT_CONTINUING = bytes(b for b in range(256) if not 128 <= b < 192)
NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"
#: Limits of the usual rules: symbols per word, upper-case letters, repeated lines and repeated words as shares, mean word length.
LIMITS = (0.1, 0.3, 0.3, 0.2)
WORD_LENGTH = (3.0, 10.0)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    if len(ids) < 4:
        return 0
    base = len(number)
    # pairs are numbered densely first, so that three ids always fit 64 bits
    pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
    windows, times = np.unique(pairs[:-1] * base + ids[2:], return_inverse=True, return_counts=True)[1:]
    again = times[windows] > 1
    inside = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        inside[shift : shift + len(again)] |= again
    return int(inside.sum())


def repeated_lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines)), len(lines)


def statistics(docs: DataFrame) -> DataFrame:
    """COUNTS of every row of (doc_id, text)."""

    def one(text: str | None) -> tuple[int, ...]:
        text = text or ""
        raw = text.encode("utf-8", "replace")
        words = raw.split()
        dup, lines = repeated_lines(text)
        # a character starts at every byte that does not continue one
        chars = sum(map(len, words)) - len(raw.translate(None, NOT_CONTINUING))
        return len(words), chars, len(SYMBOLS.findall(text)), dup, repeated_words(words), lines, len(raw.translate(None, NOT_UPPER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([one(t) for t in batch.column(1).to_pylist()], dtype=np.int64).reshape(-1, 7)
            yield pa.record_batch([batch.column(0), *[pa.array(found[:, i]) for i in range(7)]], names=[x.split()[0] for x in COUNTS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, COUNTS)


def features(counts: np.ndarray) -> np.ndarray:
    """Excess over the rule limits, from the counts (columns of COUNTS after doc_id)."""
    words, chars, symbols, dup, repeat, lines, upper = np.maximum(counts, 0).astype(np.float64).T
    some = np.maximum(words, 1)
    length = chars / some
    ratios = (symbols / some, upper / np.maximum(chars, 1), dup / np.maximum(lines, 1), repeat / some)
    over = [np.maximum(r - limit, 0) for r, limit in zip(ratios, LIMITS, strict=True)]
    return np.column_stack([*over, np.maximum(length - WORD_LENGTH[1], 0) + np.maximum(WORD_LENGTH[0] - length, 0)])


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays, one row per tree; leaves carry their path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    norm: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for rows that are isolated at once."""
        if not len(rows):
            return np.zeros(0)
        total, at_row = np.zeros(len(rows)), np.arange(len(rows))
        for tree in range(len(self.feature)):
            node = np.zeros(len(rows), dtype=np.int64)
            while True:
                split = self.feature[tree, node]
                inner = split >= 0
                if not inner.any():
                    break
                low = rows[at_row, np.maximum(split, 0)] < self.value[tree, node]
                node = np.where(inner, np.where(low, self.left[tree, node], self.right[tree, node]), node)
            total += self.length[tree, node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def expected_path(n: int) -> float:
    """Mean depth of an unsuccessful search among n values."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(rows: np.ndarray, trees: int = TREES, draw: int = DRAW, seed: int = SEED) -> Forest:
    """Trees from rows in random order: dealt to the trees if each can have its full draw, else every tree draws from all."""
    rng = np.random.default_rng(seed)
    size = min(draw, len(rows))
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    nodes = 2 ** (depth + 1)
    feature, left, right = np.full((trees, nodes), -1), np.zeros((trees, nodes), dtype=np.int64), np.zeros((trees, nodes), dtype=np.int64)
    value, length = np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for tree in range(trees):
        mine = rows[tree : trees * draw : trees] if len(rows) >= trees * draw else rows[rng.choice(len(rows), size, replace=False)]
        used, todo = 1, [(0, mine, 0)]
        while todo:
            node, part, level = todo.pop()
            wide = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(part) > 1 and level < depth else []
            if not len(wide):
                length[tree, node] = level + expected_path(len(part))
                continue
            by = int(rng.choice(wide))
            cut = rng.uniform(part[:, by].min(), part[:, by].max())
            low = part[:, by] < cut
            feature[tree, node], value[tree, node], left[tree, node], right[tree, node] = by, cut, used, used + 1
            todo += [(used, part[low], level + 1), (used + 1, part[~low], level + 1)]
            used += 2
    return Forest(feature, value, left, right, length, max(expected_path(size), 1e-9))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows that pass the base rules, with their known quality."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality IN (0, 1)")
    return known.join(rows.filter(~failed()), "doc_id")


def fit(counts: DataFrame, labels: DataFrame) -> Forest | None:
    """Forest whose trees draw from all labelled rows, by the hash of their id; None if there are none."""
    known = labelled(counts, labels).select("doc_id", *[x.split()[0] for x in COUNTS.split(", ")[1:]])
    wanted, total = TREES * DRAW, known.count()
    # rows far beyond the draws are left out by their hash alone, so that few are sorted
    share = min(1.0, 1.5 * wanted / max(total, 1))
    order = F.xxhash64("doc_id")
    drawn = known.filter(F.pmod(order, F.lit(1_000_003)) < share * 1_000_003).orderBy(order, "doc_id").limit(wanted).toPandas()
    return grow(features(drawn.iloc[:, 1:].to_numpy())) if len(drawn) else None


def calibrated(scored: DataFrame, labels: DataFrame) -> float:
    """Score above which a row is rejected: best balanced accuracy over all labelled rows, in the middle between neighbouring scores."""
    values = checkpointed(labelled(scored, labels).groupBy(F.lit("all").alias("scope"), F.col("anomaly").alias("prob")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("quality").alias("pos")))
    cum = running_counts(values, ["scope"], borders=cell_borders(values, "prob")[0])
    above, good_above = F.col("ge_n") - F.col("n"), F.col("ge_pos") - F.col("pos")
    gain = (F.col("all_pos") - good_above) / F.col("all_pos") + (above - good_above) / (F.col("all_n") - F.col("all_pos"))
    # of equal gains the lowest cut; keeping nothing gains 1, as keeping all does
    found = cum.filter((F.col("all_pos") > 0) & (F.col("all_pos") < F.col("all_n"))).agg(
        F.max_by(F.struct(gain.alias("gain"), "prob", "hi_prob"), F.struct(gain, -F.col("prob"))).alias("b")).select("b.*").first()
    if found.gain is None or found.hi_prob is None:
        return 1.0
    return (found.prob + found.hi_prob) / 2 if found.gain > 1 else 0.0


def failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, the five statistics, base_failed, the anomaly score and kept."""
    counts = checkpointed(statistics(docs))
    forest = fit(counts, labels)
    names = [x.split()[0] for x in COUNTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([batch.column(i).to_numpy() for i in range(1, len(names))]) if batch.num_rows else np.zeros((0, 7))
            score = forest.score(features(rows)) if forest else np.zeros(len(rows))
            yield pa.record_batch([*batch.columns[: len(STATS) + 1], pa.array(score)], names=[*names[: len(STATS) + 1], "anomaly"])

    kinds = ", ".join(COUNTS.split(", ")[: len(STATS) + 1])
    scored = counts.mapInArrow(run, f"{kinds}, anomaly double")
    threshold = 1.0
    if forest:
        scored = checkpointed(scored)
        threshold = calibrated(scored, labels)
    return scored.select("doc_id", *STATS, failed().alias("base_failed"), (~failed() & (F.col("anomaly") <= threshold)).alias("kept"), "anomaly")
