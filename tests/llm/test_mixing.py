from collections import defaultdict

import pytest

from evalgate.llm import mixing

from .helpers import WORD, documents, frame, odd_rows, rows_of


def plain_targets(sizes):
    """Repeated sharing, as the contract words it. `sizes` by source, null last."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, fixed = {}, {}
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        whole = sum(weight[s] for s in free)
        target = {s: left * weight[s] / whole for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return fixed | target
        fixed |= {s: 3 * sizes[s] for s in over}


def check(rows, got, near):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len(WORD.findall(r[1] or ""))
    want, taken = plain_targets(sizes), defaultdict(int)
    of = {(r[0], len(WORD.findall(r[1] or ""))): r[2] for r in rows}
    assert len(got) == len(rows)
    for doc, size, source_size, target, words in got:
        source = of[(doc, size)]
        assert source_size == sizes[source] and target == pytest.approx(want[source]) and 0 <= words <= 3 * size
        taken[source] += words
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(near * target, 2 * mixing.BLOCK + 1), (source, target, taken[source])


def test_odd_rows(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    got = rows_of(mixing.mixed_documents(docs))
    check(rows, got, 0.02)
    assert got == rows_of(mixing.mixed_documents(docs.selectExpr("*", "1 AS row", "2 AS sid", "3 AS size")))
    assert mixing.mixed_documents(docs.limit(0)).count() == 0
    assert [r[4] for r in rows_of(mixing.mixed_documents(frame(spark, [(1, None), (2, "")])))] == [0, 0]


def test_documents_and_reruns(spark):
    table = documents("sf0.001")
    rows = list(zip(table.doc_id.tolist(), table.text.tolist(), table.source.tolist(), strict=True))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = rows_of(mixing.mixed_documents(docs))
    check(rows, got, 0.03)
    assert got == rows_of(mixing.mixed_documents(docs.repartition(5)))


def test_permutation_is_one(spark):
    for n in (1, 2, 7, 100, 1000):
        df = spark.range(n).selectExpr("id", f"CAST({n} AS LONG) AS n", "3 AS key")
        assert sorted(r[0] for r in df.select(mixing.permuted(df["id"], df["n"], df["key"])).collect()) == list(range(n))


def test_shards_draw_all_slots_once(spark):
    sources = spark.createDataFrame([(0, 500, 300), (1, 1, 3), (2, 40, 97)], "sid int, blocks long, slots long")
    counts = mixing.shard_counts(sources, 16)
    seen = sorted((r["sid"], r["slot"]) for r in mixing.slots(counts).collect())
    assert seen == [(s, i) for s, n in ((0, 300), (1, 3), (2, 97)) for i in range(n)]
    taken = defaultdict(int)
    for r in mixing.slots(counts).collect():
        taken[(r["sid"], r["block"])] += 1
    assert max(taken.values()) <= 3 and len([k for k in taken if k[0] == 2]) == 40
    assert max(r["n"] for r in counts.groupBy("shard").agg({"count": "sum"}).toDF("shard", "n").collect()) <= 16 * 3


def test_mixed_texts_hold_the_taken_words(spark):
    docs = frame(spark, odd_rows())
    words = sum(len(WORD.findall(r["text"])) for r in mixing.mixed_texts(docs).collect())
    assert words == sum(r[4] for r in mixing.mixed_documents(docs).collect())
    assert mixing.mixed_texts(docs).columns == docs.columns


def test_clashing_columns_lose_no_row(spark):
    docs = frame(spark, odd_rows())
    plain = sorted((r["doc_id"] or -1, r["text"]) for r in mixing.mixed_texts(docs).collect())
    more = docs.selectExpr("*", "1 AS row", "2 AS pass", "3 AS __words", "4 AS __ROW", "5 AS __parts", "6 AS slot")
    out = mixing.mixed_texts(more)
    assert out.columns == more.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in out.collect()) == plain
