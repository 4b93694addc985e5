"""Toxicity by compression distance (operator 9).

Two zstandard dictionaries are trained on labelled text: one on the windows of ordinary documents, one on those plus the windows
that mark toxic documents. A window is one word (long ones in pieces), framed by zero bytes so that zstandard always writes a
compressed block and the block's overhead cancels. Its distance is the length under the ordinary dictionary less the length under
the toxic one. Windows at or above distance thresholds are counted, and a logistic model calibrated on labelled rows turns the
shares into a score.

The dictionaries are fitted on a bounded sample of labelled rows (`SAMPLE` of each label), the calibration on another one. A
word's frequency is counted over its distinct neighbourhoods, so that copies of a document count once. Rows whose crc32(doc_id)
mod 5 is 0 are held out of both. Labels, lang, source and doc_id never enter a score.

Defined results: null and empty texts have no windows and score at the base rate; if the labels lack one of the two classes all
scores are 0; null labels are not learned from; repeated rows score alike; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgate.llm.common import LOWER, WORD, checkpointed, long_rows

#: Most labelled rows of each label that the dictionaries, and again the calibration, are fitted on.
SAMPLE = 6_000
ORDINARY_BYTES = 4_000
TOXIC_BYTES = 2_000
#: Fewest distinct neighbourhoods of a toxic window, and how much more frequent it is in toxic text.
LEAST_SEEN = 3
LEAST_RATIO = 6.0
FRAME = bytes(20)
WINDOW_BYTES = 64
CUTS = (3, 4, 5, 6)
CACHE = 200_000
SHARES = ", ".join(f"c{c} long" for c in CUTS)


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, half: int, sample: int) -> DataFrame:
    """(doc_id, toxic) of at most `sample` rows of each label, by hash; half 0 trains dictionaries, half 1 calibrates."""
    order = F.xxhash64("doc_id")
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(~F.coalesce(held_out(), F.lit(True))).filter(F.pmod(order, F.lit(2)) == half)
    )
    parts = [known.filter(F.col("toxic") == t).orderBy(order, "doc_id").limit(sample) for t in (0, 1)]
    return parts[0].union(parts[1])


def window_counts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(word, ordinary, toxic): distinct neighbourhoods of each lower-cased word by label, over the chosen documents."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.regexp_extract_all(F.translate(F.col("text").cast("string"), upper, lower), F.lit(WORD), F.lit(0))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("toxic", words.alias("w"))
    each = texts.select("toxic", "w", F.posexplode("w").alias("i", "word")).filter(F.length("word") <= WINDOW_BYTES // 2)
    around = F.xxhash64(F.get("w", F.col("i") - 1), F.get("w", F.col("i") + 1))
    seen = each.select("word", "toxic", around.alias("around")).distinct()
    return seen.groupBy("word").agg(F.sum(1 - F.col("toxic")).alias("ordinary"), F.sum("toxic").alias("toxic"))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[bytes, bytes] | None:
    """Contents of the ordinary and the toxic dictionary, the most telling windows last; None without both labels."""
    counts = checkpointed(window_counts(docs, labelled(docs, labels, 0, sample)))
    total = counts.agg(F.sum("ordinary").alias("o"), F.sum("toxic").alias("t")).first()
    if not total["o"] or not total["t"]:
        return None
    ratio = (F.col("toxic") + 0.5) / (total["t"] + 1) / ((F.col("ordinary") + 0.5) / (total["o"] + 1))
    # a window takes two bytes at least, so that many rows fill a dictionary
    common = counts.filter("ordinary > 0").orderBy(F.desc("ordinary"), "word").limit(ORDINARY_BYTES).collect()
    marks = counts.filter((F.col("toxic") >= LEAST_SEEN) & (ratio >= LEAST_RATIO)).orderBy(F.desc(F.col("toxic") * F.log(ratio)), "word").limit(TOXIC_BYTES).collect()
    # distinct bytes close a dictionary: zstandard does not look up its very last bytes
    close = bytes(range(1, 9)) * 2
    base, telling = (b"".join(f" {r['word']} ".encode() for r in reversed(rows)) for rows in (common, marks))
    return base[-ORDINARY_BYTES:] + close, base[-ORDINARY_BYTES:] + telling[-TOXIC_BYTES:] + close


class Distance:
    """Compressed length of a window under the ordinary dictionary less that under the toxic one, remembered by window."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        how = zstandard.ZstdCompressionParameters(
            window_log=13, chain_log=10, hash_log=12, search_log=4, min_match=4, target_length=0, strategy=zstandard.STRATEGY_GREEDY,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        books = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in (ordinary, toxic)]
        for book in books:
            book.precompute_compress(compression_params=how)
        self.ordinary, self.toxic = (zstandard.ZstdCompressor(dict_data=b, compression_params=how).compress for b in books)
        self.known: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        get = self.known.get
        found = [get(w) for w in words]
        for i, value in enumerate(found):
            if value is None:
                found[i] = self._measured(words[i])
        return np.array(found, dtype=np.int64)

    def _measured(self, word: bytes) -> int:
        if (value := self.known.get(word)) is None:
            framed = FRAME + b" " + word + b" " + FRAME
            value = len(self.ordinary(framed)) - len(self.toxic(framed))
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = value
        return value


def windows(text: bytes) -> list[bytes]:
    words = text.translate(LOWER).split()
    if max(map(len, words), default=0) <= WINDOW_BYTES:
        return words
    return [w[i : i + WINDOW_BYTES] for w in words for i in range(0, len(w), WINDOW_BYTES)]


def measured(docs: DataFrame, books: tuple[bytes, bytes], row: list[str]) -> DataFrame:
    """(doc_id, row columns, windows, largest distance, windows at or above each of CUTS) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(*books)
        for batch in batches:
            rows = np.zeros((batch.num_rows, 2 + len(CUTS)), dtype=np.int64)
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                found = distance.of(windows(text or b""))
                if len(found):
                    rows[i] = len(found), found.max(), *[(found >= c).sum() for c in CUTS]
            names = ["doc_id", *row, "n_windows", "most", *[f"c{c}" for c in CUTS]]
            yield pa.record_batch([batch.column(0), *batch.columns[2:], *[pa.array(c) for c in rows.T]], names=names)

    schema = ", ".join(["doc_id long", *[f"`{c}` long" for c in row], "n_windows long", "most long", SHARES])
    return long_rows(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *row).mapInArrow(run, schema)


def inputs() -> list[Column]:
    """What the logistic model sees."""
    n = F.greatest(F.col("n_windows"), F.lit(1))
    return [F.col("most").cast("double"), *[F.sqrt(F.col(f"c{c}") / n) for c in CUTS], *[F.log1p(F.col(f"c{c}").cast("double")) for c in CUTS], F.log1p(F.col("n_windows").cast("double"))]


def calibrated(rows: np.ndarray, toxic: np.ndarray, rounds: int = 60, ridge: float = 1.0) -> tuple[list[float], float]:
    """Weights and intercept of a logistic model by Newton steps on standardised inputs."""
    mean, spread = rows.mean(axis=0), np.maximum(rows.std(axis=0), 1e-9)
    x = np.column_stack([np.ones(len(rows)), (rows - mean) / spread])
    penalty = np.diag([1e-6, *[ridge] * rows.shape[1]])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (toxic - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[1:] / spread
    return weights.tolist(), float(w[0] - weights @ mean)


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, after doc_id the column `row` of row numbers if one is named."""
    row = [row] if row else []
    out = F.coalesce(held_out(), F.lit(False)).alias("held_out")
    nothing = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row).select("doc_id", *row, out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    books = trained(docs, labels, sample)
    if books is None:
        return nothing
    rows = checkpointed(measured(docs, books, row))
    known = rows.join(F.broadcast(labelled(docs, labels, 1, sample)), "doc_id").select("toxic", *[c.alias(f"x{i}") for i, c in enumerate(inputs())])
    seen = known.toPandas()
    if seen.toxic.nunique() < 2:
        return nothing
    weights, start = calibrated(seen.drop(columns="toxic").to_numpy(), seen.toxic.to_numpy())
    line = sum((c * w for c, w in zip(inputs(), weights, strict=True)), F.lit(start))
    return rows.select("doc_id", *row, out, (1 / (1 + F.exp(-line))).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
