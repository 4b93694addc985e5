import hashlib
import random

import pytest

from evalgate.llm import substring_dedup

from .helpers import documents, frame, odd_rows, rows_of

NO_ID = substring_dedup.NO_ID


def brute(rows, n=50):
    least, raw = {}, [((NO_ID if r[0] is None else r[0]), (r[1] or "").encode()) for r in rows]
    for doc, text in raw:
        for i in range(len(text) - n + 1):
            s = text[i : i + n]
            least[s] = min(least.get(s, doc), doc)
    out = []
    for doc, text in raw:
        gone = bytearray(len(text))
        for i in range(len(text) - n + 1):
            if least[text[i : i + n]] < doc:
                gone[i : i + n] = b"\1" * n
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        runs = bytes(gone).split(b"\0")
        out.append((None if doc == NO_ID else doc, len(text), sum(gone), sum(1 for r in runs if r), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    shared = [" ".join(word() for _ in range(n)) for n in (8, 12, 30, 200)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40))) for _ in range(3)]
        text = parts[0] + rng.choice(shared) + parts[1] + rng.choice(shared)[rng.randint(0, 20) :] + parts[2]
        rows.append((i * 7 % 61, text))
    for i in range(20):
        words = shared[3].split(" ")
        words[rng.randrange(len(words))] = "edit" + str(i)
        rows.append((100 + i, " ".join(words)))
    rows += [(200, "ab" * 400), (201, "ab" * 300 + "c"), (202, "a" * 49), (203, "a" * 50), (204, "a" * 51), (205, "\0" * 120), (206, "\0" * 70 + "x")]
    return rows


@pytest.mark.parametrize("chunk", [None, 64])
def test_passages_and_odd_rows(spark, monkeypatch, chunk):
    rows = passages() + odd_rows()[:-2]
    if chunk:
        monkeypatch.setattr(substring_dedup, "SHARE", 4096)
    got = rows_of(substring_dedup.without_repeats(frame(spark, rows).repartition(5)))
    assert got == brute(rows)


def test_long_texts_are_cut_anywhere():
    text = bytes(random.Random(2).choices(b"abc ", k=3000))
    whole = substring_dedup.parsed(text)
    assert (whole[1:, 2] == whole[:-1, 2] + whole[:-1, 3]).all() and whole[0, 2] == 0 and whole[-1, 2] + whole[-1, 3] == 3000 - 49
    old, substring_dedup.CHUNK = substring_dedup.CHUNK, 500
    try:
        cut = substring_dedup.parsed(text)
        assert (cut[1:, 2] == cut[:-1, 2] + cut[:-1, 3]).all() and cut[-1, 2] + cut[-1, 3] == 3000 - 49
    finally:
        substring_dedup.CHUNK = old


def test_strings_at_the_edge_of_a_chunk(spark):
    text = "".join(random.Random(8).choices("abcdefghijklmnop", k=(1 << 20) + 500))
    edges = [(1 << 20) - 2, (1 << 20) - 66]
    rows = [(i, f"{i}XX{text[at : at + 50]}YY{i}") for i, at in enumerate(edges, 1)] + [(9, text)]
    found = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in substring_dedup.without_repeats(frame(spark, rows)).collect()}
    assert found == {1: (0, 0), 2: (0, 0), 9: (100, 2)}


def test_documents_empty_and_clashing_columns(spark):
    table = documents("sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute(list(zip(table.doc_id.tolist(), table.text.tolist(), strict=True)))
    assert rows_of(substring_dedup.without_repeats(docs)) == want
    assert rows_of(substring_dedup.without_repeats(docs.selectExpr("*", "1 AS row", "2 AS block", "3 AS kind"))) == want
    assert substring_dedup.without_repeats(docs.limit(0)).count() == 0
    same = frame(spark, [(1, "x" * 30 + " same text twice " * 9), (1, "y" * 30 + " same text twice " * 9)])
    assert sum(r["n_removed"] for r in substring_dedup.without_repeats(same).collect()) == 0
