import random

import numpy as np
import pytest
import xxhash

from evalgate.llm import ngram_join
from evalgate.llm.ngram_join import NO_ID

from .helpers import A_TO_Z, WORD, documents, frame, odd_rows, rows_of


def plain_set(text, width=3):
    words = WORD.findall((text or "").translate(A_TO_Z))
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, percent=90):
    sets = [plain_set(r[1]) for r in rows]
    label = [NO_ID if r[0] is None else r[0] for r in rows]
    near = [[] for _ in rows]
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    near[i].append(j)
                    near[j].append(i)
    changed = True
    while changed:
        changed = False
        for i, others in enumerate(near):
            low = min([label[i], *[label[j] for j in others]])
            changed |= low != label[i]
            label[i] = low
    known = lambda x: None if x == NO_ID else x
    return sorted(((r[0], len(s), known(c)) for r, s, c in zip(rows, sets, label, strict=True)), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def groups(seed):
    """Copies with few and many edits, chains, families around one original, and texts made of the same frequent passages."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for size in (4, 9, 15, 30, 80, 200, 400):
        for _ in range(4):
            first = [word() for _ in range(size)]
            texts += [" ".join(first), *[edited(rng, first, k) for k in (0, 1, 1, 2, 3, size // 40, size // 20)]]
    chain = [word() for _ in range(300)]
    for _ in range(25):
        texts.append(" ".join(chain))
        for _ in range(3):
            chain[rng.randrange(300)] = word()
    family = [word() for _ in range(120)]
    texts += [" ".join(family)] * 3 + [edited(rng, family, 1 + k % 3) for k in range(90)]
    passages = [[word() for _ in range(60)] for _ in range(6)]
    texts += [" ".join(sum(rng.sample(passages, 2), []) + [word() for _ in range(rng.choice((4, 10, 40)))]) for _ in range(150)]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def test_odd_rows_empty_and_clashing_columns(spark):
    rows = odd_rows() + [(None, "no id here at all"), (None, "another text without id"), (14, "no id here at all"), (14, "Another text without ID")]
    docs, want = frame(spark, rows), brute(rows)
    assert rows_of(ngram_join.joined(docs)) == want
    assert rows_of(ngram_join.joined(docs.selectExpr("*", "1 AS node", "2 AS n", "3 AS cell", "4 AS KEY", "5 AS least"))) == want
    assert ngram_join.joined(docs.limit(0)).count() == 0
    assert rows_of(ngram_join.joined(frame(spark, [(1, None), (2, " ")]))) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize(("seed", "hot"), [(1, 32), (2, 4)])
def test_groups_equal_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "OFTEN", 2 * hot)
    rows = groups(seed)
    want = brute(rows)
    assert len({r[2] for r in want}) < len(rows) - 100
    assert rows_of(ngram_join.joined(frame(spark, rows).repartition(5))) == want


def test_trees_of_three_levels_lose_no_pair(spark):
    """All members in one cell, narrow nodes: the traversal must leave every pair that links."""
    rows = [r for r in groups(3) if len(r[1].split()) > 20]
    sets = [plain_set(t) for _, t in rows]
    prints = []
    for s in sets:
        marks = np.zeros(ngram_join.BITS, dtype=bool)
        marks[[xxhash.xxh64_intdigest(x) % ngram_join.BITS for x in s]] = True
        prints.append((np.packbits(marks, bitorder="little").view(np.int64).tolist(), len(s) - int(marks.sum())))
    members = [(7, i, len(s), slack, sig, i) for i, (s, (sig, slack)) in enumerate(zip(sets, prints, strict=True))]
    found = ngram_join.candidates(spark.createDataFrame(members, "cell long, node long, n long, slack long, sig array<long>, comp long"), fanout=4)
    pairs = {tuple(r) for r in found.collect()}
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])}
    assert want <= pairs
    assert len(pairs) < len(sets) * (len(sets) - 1) // 4


def test_documents_equal_brute_force(spark):
    table = documents("sf0.01")
    rows = list(zip(table.doc_id.tolist(), table.text.tolist(), strict=True))
    assert rows_of(ngram_join.joined(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))) == brute(rows)


def test_sizes():
    for n in range(1, 400):
        assert ngram_join.prefix_size(n) == n - -(-90 * n // 100) + 1
        assert 1 <= ngram_join.least_shared(n) <= ngram_join.pool_size(n) <= n


def test_whole_sets_go_only_with_pairs_that_may_matter(spark, monkeypatch):
    rng = np.random.default_rng(8)
    fresh = lambda n: rng.integers(0, 2**64 - 1, n, dtype=np.uint64)
    bases = [fresh(200), fresh(200)]
    # of each base: copies within the threshold of one another, and copies that are near it but link with nothing
    sets = [np.unique(np.concatenate([base[changed:], fresh(changed)])) for base in bases for changed in [4] * 8 + [30, 31, 32, 33, 34, 35]]
    table = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "node long, set binary")
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))]
    common = {p: len(np.intersect1d(sets[p[0]], sets[p[1]])) for p in pairs}
    links = {(a, b) for (a, b), c in common.items() if 100 * c >= 90 * (len(sets[a]) + len(sets[b]) - c)}
    frame = spark.createDataFrame(pairs, "a long, b long")
    kept = {(r.a, r.b) for r in ngram_join.likely(frame, table, 90).collect()}
    assert links <= kept and len(kept - links) < 5
    # a tree leaves over the links, and of the others those with the first copy of each base
    left = sorted(links | {(a, b) for a, b in pairs if a % 14 == 0 and b < a + 14})
    frame = spark.createDataFrame(left, "a long, b long")
    met, linked = [], ngram_join.linked
    monkeypatch.setattr(ngram_join, "linked", lambda p, s, percent: met.append(p.count()) or linked(p, s, percent))
    found = {(r.a, r.b) for r in ngram_join.links_of(frame, frame.limit(0), table, 90).collect()}
    assert found <= links and sum(met) < len(links)
    components = lambda edges: {(r.node, r.label) for r in ngram_join.components(table.select("node"), spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert components(found) == components(links)


def test_nodes_are_in_few_cells_and_linked_ones_still_meet(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for _ in range(30):
        first = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows += [(len(rows) + k, edited(rng, first, k)) for k in range(7)]
    met, candidates = [], ngram_join.candidates
    monkeypatch.setattr(ngram_join, "candidates", lambda members, percent: met.append(members.count()) or candidates(members, percent))
    assert rows_of(ngram_join.joined(frame(spark, rows))) == brute(rows)
    assert sum(met) < 5 * len(rows)  # 1390 when every shared pool token was a cell


def test_memberships_leave_every_pair_that_may_link_a_cell(spark):
    rng = random.Random(4)
    cells = {c: (rng.choice((1, 1, 2, 9)), rng.sample(range(40), rng.randrange(2, 9))) for c in range(120)}
    weight = {n: sum(times for times, nodes in cells.values() if n in nodes) for n in range(40)}
    least = {n: rng.choice((0, 1, weight[n] // 4, weight[n] // 2)) for n in range(40)}
    rows = [(c, n, False, times, True, 1, least[n]) for c, (times, nodes) in cells.items() for n in nodes]
    rows += [(1000, n, True, 1, n % 2 == 0, 1, least[n]) for n in range(40)] + [(2000, 7, False, 50, True, 1, least[7])]
    met = spark.createDataFrame(rows, "cell long, node long, hot boolean, times long, first boolean, copies long, least_rare long")
    kept = [(r.cell, r.node, r.hot) for r in ngram_join.memberships(met).collect()]
    together = lambda a, b: [c for c, (_, nodes) in cells.items() if a in nodes and b in nodes]
    for a, b in [(a, b) for a in range(40) for b in range(a) if together(a, b)]:
        if sum(cells[c][0] for c in together(a, b)) >= max(least[a], least[b]):
            assert any((c, a, False) in kept and (c, b, False) in kept for c in together(a, b))
    assert {n for _, n, hot in kept if hot} == {n for n in range(40) if n % 2 == 0 and least[n] <= 0}
    assert len(kept) == len(set(kept)) < len(rows) and (2000, 7, False) not in kept


def test_bins_rule_out_no_link_and_are_small():
    rng = np.random.default_rng(3)
    fresh = lambda n: rng.integers(0, 2**64 - 1, n, dtype=np.uint64)
    for n in (1, 2, 9, 30, 125, 128, 131, 260, 1000, 4090):
        for more in (0, 1, n // 20, n // 10):
            base = np.unique(fresh(n))
            for other in (np.concatenate([base, fresh(more)]), np.concatenate([base[more:], fresh(more)])):
                both = len(np.intersect1d(base, other))
                if 100 * both >= 90 * (len(base) + len(other) - both):
                    assert ngram_join.may_link(ngram_join.binned(base), ngram_join.binned(other), 90)
        assert ngram_join.binned(base).nbytes <= max(ngram_join.BINS, n / 2)
        assert n < 100 or not ngram_join.may_link(ngram_join.binned(base), ngram_join.binned(np.concatenate([base[n // 4 :], fresh(n // 4)])), 90)
    # full bins tell nothing: two sets of 10,000 tokens in one bin each are not ruled out
    crowded = np.arange(10_000, dtype=np.uint64) << np.uint64(32)
    assert ngram_join.may_link(ngram_join.binned(crowded), ngram_join.binned(crowded[:9_500]), 90)
