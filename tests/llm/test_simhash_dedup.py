import numpy as np
import xxhash

from evalgate.llm import simhash_dedup
from evalgate.llm.simhash_dedup import CELL, NO_ID

from .helpers import A_TO_Z, WORD, documents, frame, odd_rows, rows_of


def plain_fingerprint(text, width=3):
    words = WORD.findall((text or "").translate(A_TO_Z))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    values = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute(rows):
    prints = np.array([plain_fingerprint(r[1]) for r in rows], dtype=np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 2
    ids = np.array([NO_ID if r[0] is None else r[0] for r in rows])
    label = ids.copy()
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    unknown = lambda x: None if x == NO_ID else int(x)
    return sorted(((unknown(d), f"{int(p):016x}", unknown(c)) for d, p, c in zip(ids, prints, label, strict=True)), key=repr)


def test_odd_rows_empty_and_clashing_columns(spark):
    docs = frame(spark, odd_rows())
    want = brute(odd_rows())
    assert rows_of(simhash_dedup.near_duplicates(docs)) == want
    assert rows_of(simhash_dedup.near_duplicates(docs.selectExpr("*", "1 AS fp", "2 AS node", "3 AS cell"))) == want
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_documents_equal_brute_force(spark):
    table = documents("sf0.001")
    rows = list(zip(table.doc_id.tolist(), table.text.tolist(), strict=True))
    assert rows_of(simhash_dedup.near_duplicates(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))) == brute(rows)


def test_links_of_crowded_cells_are_exact(spark):
    """A ball of fingerprints around one centre overfills its cells; its links must still connect what brute force connects."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 2**63))
    balls = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (6 * CELL, 2))}
    far = {int(x) for x in rng.integers(0, 2**63, 200)} | {(centre ^ 0b1111 << 20) ^ (1 << k) for k in range(8)}
    prints = sorted(balls | far)
    fps = np.array(prints, dtype=np.uint64)
    nodes = spark.createDataFrame([(i, int(np.int64(np.uint64(p)))) for i, p in enumerate(prints)], "node long, fp long")
    found = simhash_dedup.components(nodes.select("node"), simhash_dedup.links(nodes))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 2
    label = np.arange(len(fps))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    assert rows_of(found) == sorted(((i, int(c)) for i, c in enumerate(label)), key=repr)


def test_texts_without_an_id_and_of_one_id_are_apart(spark):
    far = [" ".join(f"{name}{i * k % 101}" for i in range(120)) for k, name in enumerate(("red", "blue", "green", "grey"), 3)]
    rows = [(None, far[0]), (None, far[1]), (None, far[1]), (1, far[0]), (2, far[1]), (3, far[2]), (3, far[3]), (4, far[2]), (5, far[3])]
    want = brute(rows)
    assert len({(r[1], r[2]) for r in want}) == 4
    assert rows_of(simhash_dedup.near_duplicates(frame(spark, rows))) == want


def test_partial_distances_add_up():
    fps = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    whole = np.bitwise_count(fps[:, None] ^ simhash_dedup.REFERENCES[None])
    assert (simhash_dedup.partial_distances(fps).sum(axis=2) == whole).all()
