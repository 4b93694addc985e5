import hashlib
from collections import Counter

import sentencepiece
from tokenizers import Tokenizer

from evalgate.llm import alignment
from evalgate.llm.alignment import BYTE_LEVEL, PIECES, byte_letters

from .helpers import documents, frame, odd_rows, rows_of


def brute(rows):
    first = Tokenizer.from_file(BYTE_LEVEL)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    letters = byte_letters()
    names = {i: t for t, i in first.get_vocab().items()}

    def ends(tokens):
        out, at = [], 0
        for t in tokens:
            at += len(t)
            out.append(at)
        return out

    found, counts = [], Counter()
    for doc, text in rows:
        text = text or ""
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in names[i]) for i in a]
        bytes_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = b" " + text.encode()
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            found.append((doc, [], [], [], ""))
            continue
        ea, eb = ends(bytes_a), ends(bytes_b)
        cuts = sorted(set(ea) & set(eb))
        links = [(i, j) for i, x in zip(a, ea, strict=True) for j, y in zip(b, eb, strict=True) if x == y] if len(a) < 500 else [(a[ea.index(c)], b[eb.index(c)]) for c in cuts]
        counts.update(links)
        groups, lo = [], 0
        for hi in cuts:
            parts = [",".join(str(i) for i, e in zip(ids, es, strict=True) if lo < e <= hi) for ids, es in ((a, ea), (b, eb))] if len(a) < 500 else None
            groups.append(parts)
            lo = hi
        if len(a) < 500:
            written = ";".join("|".join(g) for g in groups)
        else:
            written, i, j, out = "", 0, 0, []
            for hi in cuts:
                k, m = ea.index(hi, i) + 1, eb.index(hi, j) + 1
                out.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
                i, j = k, m
            written = ";".join(out)
        found.append((doc, a, b, links, hashlib.sha256(written.encode()).hexdigest()))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return sorted(((d, len(a), len(b), len(x), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), g) for d, a, b, x, g in found), key=repr)


ODD = [
    (30, "<|endoftext|> and </s> and <unk> in a text"), (31, "a ▁ b"), (32, "  two spaces\n\n\nlines  "), (33, "日本語 \U0001f600‍ ́x"),
    (34, "\x00\x01 zero"), (35, "x"), (36, " "), (37, "é é ﬁ  nbsp"),
]


def test_odd_rows_empty_and_clashing_columns(spark):
    rows = odd_rows() + ODD
    docs, want = frame(spark, rows), brute([r[:2] for r in rows])
    assert rows_of(alignment.alignments(docs)) == want
    assert rows_of(alignment.alignments(docs.selectExpr("*", "1 AS chunk", "2 AS place", "3 AS a", "4 AS N_A"), chunk=100)) == want
    assert alignment.alignments(docs.limit(0)).count() == 0
    assert rows_of(alignment.alignments(frame(spark, [(1, None), (2, "")]))) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_documents_equal_brute_force_in_any_chunks(spark):
    table = documents("sf0.001")
    want = brute(list(zip(table.doc_id.tolist(), table.text.tolist(), strict=True)))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows_of(alignment.alignments(docs)) == want
    assert rows_of(alignment.alignments(docs.repartition(3), chunk=5_000)) == want


def test_every_character_is_split_as_by_the_file(spark):
    """The encoder built from the file gives the library's own ids around every code point and in long runs."""
    first = Tokenizer.from_file(BYTE_LEVEL)
    first.encode_special_tokens = True
    book = alignment.tokenizers(alignment.byte_level_file(BYTE_LEVEL), open(PIECES, "rb").read())
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = [f" a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} .{chr(c)}\n{chr(c)}" for c in points[::7] + points[:70_000]]
    texts += [" " + " " * 300_000 + "x", " " + "ab" * 200_000, " " + "\n \t" * 50_000, " " + "don't'll" * 999]
    for lo in range(0, len(texts), 20_000):
        part = texts[lo : lo + 20_000]
        assert [e.ids for e in first.encode_batch_fast(part, add_special_tokens=False)] == [book.first.encode_ordinary(t) for t in part]
