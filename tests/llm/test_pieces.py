import hashlib
import random

import pytest
import sentencepiece

from evalgate.llm import pieces

from .helpers import documents, frame, odd_rows, rows_of


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def book():
    return pieces.Vocabulary.load()


def want(library, rows):
    return sorted(((d, len(ids := library.encode(t or "")), ids, hashlib.sha256(library.decode(ids).encode()).hexdigest()) for d, t, *_ in rows), key=repr)


def texts():
    rng = random.Random(4)
    out = ["", " ", "  ", " a", "a ", "a  b   c" + " " * 15 + "d" + " " * 16 + "e" + " " * 31, "a\n\n b\r\nc\td", "ﬁ ½ Ⅷ é 😀　x​", "x\0y", "no" * 300, "a" * 500]
    return out + ["".join(rng.choice("abcdefghijklmnop  \nétheingation.,") for _ in range(rng.randint(1, 400))) for _ in range(150)]


def test_encoding_equals_the_library(book, library):
    for text in texts() + documents("sf0.001").text.tolist()[:80]:
        assert book.with_runs(book.encode_whole(pieces.normal(text))).tolist() == library.encode(text), text[:80]
        assert book.decode(library.encode(text)) == text


@pytest.mark.parametrize("chunk", [70, 150, 1000])
def test_chunks_and_their_matrices(book, library, chunk):
    samples = texts()[-40:] + ["no" * 300, "internationalisation" * 40, "a" * 333, "ab cd\n" * 90]
    for text in samples:
        full, reach = pieces.normal(text), book.longest
        if len(full) <= chunk:
            continue
        cuts = [(full[max(0, lo - reach) : lo], full[lo : lo + chunk], full[lo + chunk : lo + chunk + reach]) for lo in range(0, len(full), chunk)]
        matrices = [frozenset(book.transfer(*c)) for c in cuts]
        assert pieces.product(pieces.product(*matrices[:2]), matrices[-1]) == pieces.product(matrices[0], pieces.product(matrices[1], matrices[-1]))
        states = [pieces.EDGE, *pieces.cut_states(matrices), pieces.EDGE]
        found = b"".join(book.trace(*c, a, b) for c, a, b in zip(cuts, states, states[1:], strict=False))
        assert book.with_runs(found).tolist() == library.encode(text), text[:60]


def test_odd_rows_empty_and_clashing_columns(spark, library):
    rows = odd_rows() + [(50, "word " * 100 + "x" * 700 + "  \n tail"), (51, " " * 900)]
    docs = frame(spark, rows)
    got = rows_of(pieces.tokenized(docs, chunk=300))
    assert got == want(library, rows)
    assert rows_of(pieces.tokenized(docs.selectExpr("*", "1 AS row", "2 AS ids", "3 AS chunk"), chunk=300)) == got
    assert pieces.tokenized(docs.limit(0)).count() == 0


def test_new_words_are_searched_by_their_new_parts(book, library, monkeypatch):
    fresh, searched = pieces.Vocabulary(*book.__getstate__()), []
    monkeypatch.setattr(fresh, "searched", lambda text: searched.append(text) or book.searched(text))
    text = "Wörterbuch Wörterbuch. Wörterbuch, (Wörterbuch) Wörterbuch!? xWörterbuch§Wörterbuch, 名Wörterbuch"
    assert fresh.with_runs(fresh.encode_whole(pieces.normal(text))).tolist() == library.encode(text)
    assert searched.count("örterbuch") == 1 and len(set(searched)) == len(searched)
    # every two neighbours are either inside some piece or a place that no merge crosses
    for word in ("§.", "Wö,rter", "a!b?c", "«Wort».", "ab\u0301c", "x\u200by", "€5,00", "名前a"):
        assert fresh.by_parts("▁" + word) == book.searched("▁" + word)


def test_texts_are_encoded_and_decoded_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "a short text"), (2, "a long one " * 40)], "doc_id long, text string")
    plan = pieces.tokenized(docs, chunk=100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")
