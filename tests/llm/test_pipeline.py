"""Each stage against a plain version of its operator's contract, on odd rows and on a real table."""

from pyspark.sql import functions as F

import corpus_pipeline
from evalgate.llm import mixing, toxicity

from . import test_exact_dedup, test_simhash_dedup
from .helpers import frame, odd_rows, rows_of

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=repr)


def test_run_keeps_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    predicted = {r["doc_id"]: r["predicted"] for r in toxicity.scored(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    clean = [r for r in rows if not predicted[r[0]]]
    one = corpus_pipeline.without_toxic(spark, docs, SF)
    assert ids(one) == sorted((r[0] for r in clean), key=repr) and one.columns == docs.columns
    keep = {r[0] for r in test_exact_dedup.brute(clean) if r[3]}
    two = corpus_pipeline.without_copies(spark, one, SF)
    assert ids(two) == sorted(keep, key=repr) and two.columns == docs.columns
    near = {r[0] for r in test_simhash_dedup.brute([r for r in clean if r[0] in keep]) if r[0] == r[2]}
    three = corpus_pipeline.without_near_copies(spark, two, SF)
    assert ids(three) == sorted(near, key=repr) and three.columns == docs.columns
    four = corpus_pipeline.mixed(spark, three, SF)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixed_documents(three).collect()}
    assert four.columns == docs.columns and {r["doc_id"] for r in four.collect()} == {d for d, n in taken.items() if n}
    assert len(ids(corpus_pipeline.run(spark, SF))) == four.count()


def test_stages_bear_odd_rows_and_empty_tables(spark):
    docs = frame(spark, odd_rows())
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        out = stage(spark, docs, SF)
        assert out.count() > 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
    assert rows_of(docs.select("doc_id"))


def test_rows_of_one_id_or_none_are_told_apart(spark, tmp_path):
    plain, rude = "plain words of document {} about nothing at all", "you idiot {} moron scum trash"
    known = [(i, plain.format(i)) for i in range(200)] + [(1000 + i, rude.format(i)) for i in range(200)]
    more = [(d, t.format(n)) for d in (None, 7000) for t, n in ((plain, 7), (rude, 3), (rude, 4))]
    spark.createDataFrame([(d, 1, int(d >= 1000)) for d, _ in known], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = corpus_pipeline.without_toxic(spark, frame(spark, known + more), str(tmp_path))
    assert rows_of(clean.filter("doc_id IS NULL OR doc_id = 7000").select("doc_id", "text")) == [(7000, plain.format(7)), (None, plain.format(7))]
    texts = [" ".join(f"{name}{i * k % 101}" for i in range(120)) for k, name in enumerate(("red", "blue"), 3)]
    docs = frame(spark, [(None, texts[0])] * 3 + [(None, texts[1]), (4, texts[1]), (4, texts[1]), (4, "alone"), (4, "ALONE"), (5, "other")])
    for stage, want in (
        (corpus_pipeline.without_copies, [(4, "alone"), (4, texts[1]), (5, "other"), (None, texts[0])]),
        (corpus_pipeline.without_near_copies, [(4, "alone"), (5, "other"), (None, texts[0]), (None, texts[1])]),
    ):
        out = stage(spark, docs, SF)
        assert rows_of(out.select("doc_id", F.lower("text"))) == sorted(want, key=repr) and out.columns == docs.columns


def test_toxic_documents_go(spark):
    rows = [(i, f"plain words of document {i} about nothing at all") for i in range(200)] + [(1000 + i, f"you idiot {i} moron scum trash") for i in range(200)]
    labels = spark.createDataFrame([(d, 1, int(d >= 1000)) for d, _ in rows], "doc_id long, quality int, toxic int")
    scored = {r["doc_id"]: r for r in toxicity.scored(frame(spark, [*rows, (None, None), (5000, "")]), labels).collect()}
    assert sum(scored[d]["predicted"] == (d >= 1000) for d, _ in rows) >= 396
    assert 0 <= scored[None]["score"] <= 1 and scored[5000]["score"] == scored[None]["score"]
    nothing = toxicity.scored(frame(spark, rows), labels.filter("toxic = 0"))
    assert {r["score"] for r in nothing.collect()} == {0.0}
