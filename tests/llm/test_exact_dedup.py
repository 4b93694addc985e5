import hashlib
from collections import defaultdict

from evalgate.llm import exact_dedup
from evalgate.llm.exact_dedup import CuckooFilter

from .helpers import A_TO_Z, frame, odd_rows, rows_of


def brute(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[(text or "").translate(A_TO_Z)].append(doc)
    out = []
    for doc, text, *_ in rows:
        same = groups[(text or "").translate(A_TO_Z)]
        keep = max((d for d in same if d is not None), default=None)
        out.append((doc, keep, len(same), doc == keep, hashlib.sha256((text or "").translate(A_TO_Z).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_odd_rows(spark):
    rows = odd_rows()
    assert rows_of(exact_dedup.deduplicate(frame(spark, rows))) == brute(rows)


def test_empty_and_clashing_columns(spark):
    docs = frame(spark, odd_rows())
    assert exact_dedup.deduplicate(docs.limit(0)).count() == 0
    clash = docs.selectExpr("*", "'x' AS digest", "1 AS salt", "2 AS keep_id", "3 AS shard")
    assert rows_of(exact_dedup.deduplicate(clash)) == rows_of(exact_dedup.deduplicate(docs))


def test_one_group_holds_a_third(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(900)]
    assert rows_of(exact_dedup.deduplicate(frame(spark, rows).repartition(16))) == brute(rows)


def test_insert_delete_lookup(spark):
    first = exact_dedup.digests(frame(spark, [(i, f"text {i}") for i in range(300)]))
    more = exact_dedup.digests(frame(spark, [(1000 + i, f"text {i}") for i in range(200, 400)]))
    index = exact_dedup.insert(exact_dedup.build(first, 4), more, 4)
    index = exact_dedup.delete(index, exact_dedup.digests(frame(spark, [(0, f"text {i}") for i in range(100)] + [(0, "never seen")])), 4)
    found = {d.hex(): (k, n) for d, k, n, _ in rows_of(exact_dedup.entries(index))}
    want = {hashlib.sha256(f"text {i}".encode()).hexdigest(): (i if i < 200 else 1000 + i, 2 if 200 <= i < 300 else 1) for i in range(100, 400)}
    assert found == want


def test_lookup_of_rows_the_index_has_not_seen(spark):
    digests = lambda ids, texts: exact_dedup.digests(frame(spark, [(d, f"text {t}") for d, t in zip(ids, texts, strict=True)]))
    index = exact_dedup.build(digests(range(100), range(100)), 4)
    asked = exact_dedup.checkpointed(digests([*range(5000, 5200), None], [*range(200), 7]))
    hits = lambda index: {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.lookup(index, asked).collect()}
    none = (None, None)
    assert hits(index) == {5000 + i: (i, 1) if i < 100 else none for i in range(200)} | {None: (7, 1)}
    index = exact_dedup.insert(index, digests(range(1050, 1150), range(50, 150)), 4)
    live = {i: (i if i < 50 else 1000 + i, 2 if 50 <= i < 100 else 1) for i in range(150)}
    assert hits(index) == {5000 + i: live.get(i, none) for i in range(200)} | {None: (7, 1)}
    index = exact_dedup.delete(index, digests(range(60), range(60)), 4)
    assert hits(index) == {5000 + i: live[i] if 60 <= i < 150 else none for i in range(200)} | {None: none}


def test_filter_grows_and_survives_packing():
    index, keys = CuckooFilter(2), [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for i, key in enumerate(keys):
        index.insert(key, i, 1, 1)
    assert index.live == 5000 and all(index.find(k) >= 0 for k in keys) and index.mask + 1 > 2
    for key in keys[::2]:
        assert index.delete(key)
    again = CuckooFilter.unpack(*index.pack())
    assert again.live == 2500 and all((again.find(k) >= 0) == bool(i % 2) for i, k in enumerate(keys))
    again.insert(keys[1], 99_999, 2, 1)
    record = again.slots[again.find(keys[1])]
    assert (again.keep[record], again.size[record]) == (99_999, 3)
