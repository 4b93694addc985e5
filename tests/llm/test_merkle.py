import hashlib
import zlib

import pytest

from evalgate.llm import merkle

from .helpers import documents, frame, odd_rows, rows_of


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(digests):
    """(root, per leaf the (before, after) pairs of its way)."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for path, k in zip(paths, at, strict=True):
            lo = k - k % 3
            path.append(("".join(level[lo:k]), "".join(level[k + 1 : lo + 3])))
        at = [k // 3 for k in at]
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], [(p, k) for p, k in zip(paths, at, strict=True)]


def brute(rows):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    sources = {}
    for row in rows:
        sources.setdefault(row[1], []).append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        mine = sorted(sources[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((mine, *climb([leaf(r) for r in mine])))
    if not trees:
        return []
    root, tops = climb([t[1] for t in trees])
    out = []
    for (mine, subroot, paths), (top, _) in zip(trees, tops, strict=True):
        for row, (path, _) in zip(mine, paths, strict=True):
            even = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            changed = (*row[:4], row[4].replace("\n", "") if even and row[4] is not None else row[4])
            fold = leaf(changed)
            for before, after in path + top:
                fold = sha(before + fold + after)
            proof = sha("".join(b + a for b, a in path + top))
            out.append((row[0], leaf(row), subroot, root, proof, fold, fold == root))
    return sorted(out, key=repr)


def full(rows):
    return [(r[0], r[2] if len(r) > 2 else "s", "en", len(r[1] or ""), r[1]) for r in rows]


def test_odd_rows_empty_and_clashing_columns(spark):
    rows = odd_rows() + [(20, "a\nb", "a"), (21, "a\n\nb", "a"), (22, "a\nb", None), (None, "other\n", "d")]
    docs, want = frame(spark, rows), brute(full(rows))
    assert {r[6] for r in want} == {True, False}
    assert rows_of(merkle.verified(docs)) == want
    assert rows_of(merkle.verified(docs.selectExpr("*", "1 AS node", "2 AS leaf", "3 AS place", "4 AS tree", "5 AS `__part`", "6 AS PATH"))) == want
    assert merkle.verified(docs.limit(0)).count() == 0


@pytest.mark.parametrize("count", [1, 2, 3, 4, 28])
def test_one_source_of_few_rows(spark, count):
    rows = [(i, f"text\n{i}", "s") for i in range(count)]
    assert rows_of(merkle.verified(frame(spark, rows))) == brute(full(rows))


def test_rows_alone_in_their_sources(spark):
    rows = [(i, f"text\n{i}", f"s{i}") for i in range(11)]
    assert rows_of(merkle.verified(frame(spark, rows))) == brute(full(rows))


def test_documents_and_salted_jumps(spark):
    table = documents("sf0.001")
    want = brute(list(zip(table.doc_id.tolist(), table.source.tolist(), table.lang.tolist(), table.n_chars.tolist(), table.text.tolist(), strict=True)))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(merkle.verified(docs)) == want
    assert rows_of(merkle.verified(docs, far=1)) == want
