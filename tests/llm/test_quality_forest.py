import re
from collections import Counter

import numpy as np

from evalgate.llm import quality_forest as forest

from .helpers import WORD, documents, frame, odd_rows, rows_of


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def test_statistics_and_base_rules(spark):
    table = documents("sf0.001")
    rows = odd_rows() + list(zip((table.doc_id + 10_000).tolist(), table.text.tolist(), strict=True)) + [(99, "a b c a b c\nx\nx\n \n \n" * 9)]
    labels = spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(rows) if r[0]], "doc_id long, quality int, toxic int")
    got = forest.judged(frame(spark, rows), labels)
    found = sorted(((r["doc_id"], *[r[s] for s in forest.STATS], r["base_failed"]) for r in got.collect()), key=repr)
    assert found == sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    assert not got.filter("base_failed AND kept").count()


def test_forest_finds_junk_and_keeps_clean_rows(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
    rows = [(i, " ".join(word() for _ in range(120))) for i in range(300)] + [(1000 + i, " ".join(word() + "$$$" for _ in range(120))) for i in range(60)]
    labels = spark.createDataFrame([(d, int(d < 1000), 0) for d, _ in rows if d % 2], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in forest.judged(frame(spark, rows), labels).collect()}
    assert all(not kept[1000 + i] for i in range(60)) and sum(kept[i] for i in range(300)) >= 295


def test_without_labels_and_empty(spark):
    docs = frame(spark, odd_rows() + [(50, " ".join(f"w{i}" for i in range(80)))])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = rows_of(forest.judged(docs, none))
    assert all(r[7] != r[6] for r in got)
    assert rows_of(forest.judged(docs.selectExpr("*", "1 AS n_words", "2 AS fine", "3 AS kept"), none)) == got
    assert forest.judged(docs.limit(0), none).count() == 0


def test_threshold_counts_every_labelled_row(spark):
    """10,000 labelled rows, more than the former sample held: the cut is the best one over all of them."""
    rng = np.random.default_rng(5)
    score = np.round(rng.random(10_000), 3)
    good = rng.random(10_000) < 0.9 - 0.6 * score
    scored = spark.createDataFrame([(i, 100, 0, float(s)) for i, s in enumerate(score)], "doc_id long, n_words long, n_repeat_words long, anomaly double")
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int")
    cuts = np.unique(score)
    gains = [(score[good] <= c).mean() + (score[~good] > c).mean() for c in cuts]
    at = int(np.argmax(np.round(gains, 12)))
    assert forest.calibrated(scored, labels) == (cuts[at] + cuts[at + 1]) / 2
    assert forest.calibrated(scored, labels.filter("quality = 1")) == 1.0


def test_trees_deal_out_all_rows():
    """With enough rows each tree has rows of its own: here all alike, so that none splits; draws from all rows would."""
    rows = np.tile(np.arange(3.0)[:, None], (4, 5))
    assert (forest.grow(rows, trees=3, draw=4).feature == -1).all()
    assert (forest.grow(rows[:11], trees=3, draw=4).feature >= 0).any()
