import hashlib
import re

from evalgate.llm import disclosure

from .helpers import documents, frame, odd_rows, rows_of

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        values = [int(d) * (i % 2 + 1) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(v - 9 if v > 9 else v for v in values) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    spans = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if good(k, m[0])]
    spans.sort()
    counts = [sum(s[3] == k for s in spans) for k in PATTERNS]
    text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    return *counts, hashlib.sha256(text.encode()).hexdigest(), text


CASES = [
    "a@b.com_x@y.com a@b..c .%+-@a-b.c.d @x.y é@é.com", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1111 4111  1111",
    "+1 (262) 555-3752. +12345678901234567 ++1-2 +49 30 123456-78-", "ñ 😀 bob@example.org 😀 +1 (262) 555-3752 10.0.0.1", "5" * 3000, "1-" * 3000, "a" * 4000 + "@", "1." * 2000, "+1" * 500,
]


def check(rows, got):
    want = sorted(((r[0], *brute(r[1])) for r in rows), key=repr)
    base = sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"], ",".join(s for s in r["spans"].split(",") if not s.startswith("term"))) for r in got), key=repr)
    assert base == want


def test_odd_rows_and_cases(spark):
    rows = odd_rows() + [(100 + i, t) for i, t in enumerate(CASES)]
    docs = frame(spark, rows)
    check(rows, disclosure.personal_data(docs).collect())
    clash = docs.selectExpr("*", "1 AS row", "2 AS spans", "3 AS terms", "4 AS near")
    assert rows_of(disclosure.personal_data(clash)) == rows_of(disclosure.personal_data(docs))
    assert disclosure.personal_data(docs.limit(0)).count() == 0


def test_documents(spark):
    table = documents("sf0.001")
    check(list(zip(table.doc_id.tolist(), table.text.tolist(), strict=True)), disclosure.personal_data(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect())


def test_terms_that_reveal_an_entity(spark):
    """Zanzibarius stands only near one address, the word contact near many: the first one discloses, copies do not count."""
    rows = [(i, f"note {i} about Zanzibarius write to secret.agent@example.org please contact number {i}") for i in range(5)]
    rows += [(10 + i, f"please contact person{i}@example.org about number {i}") for i in range(400)]
    rows += [(1000 + i, "copied Words near copied@example.org only") for i in range(9)]
    rows += [(2000, "Nobody but zanzibarius knows")]
    got = {r["doc_id"]: r for r in disclosure.personal_data(frame(spark, rows)).collect()}
    assert "term:13:24" in got[0]["spans"] and got[2000]["spans"] == "term:11:22" and got[10]["n_term"] == 0 and got[1000]["n_term"] == 0
    texts = {r["doc_id"]: r["text"] for r in disclosure.sanitised(frame(spark, rows)).collect()}
    assert "[EMAIL]" in texts[0] and "Zanzibarius" not in texts[0] and texts[2000] in ("Nobody but  knows", "Nobody but [TERM] knows")
    assert texts[10] == "please contact [EMAIL] about number 0"


def test_sanitised_with_clashing_columns(spark):
    docs = frame(spark, odd_rows() + [(40, "write to ann@example.org or call +49 30 1234 5678 90")])
    plain = sorted((r["doc_id"] or -1, r["text"] or "") for r in disclosure.sanitised(docs).collect())
    more = docs.selectExpr("*", "1 AS row", "2 AS __row", "3 AS __SPANS", "4 AS __sure", "5 AS near")
    out = disclosure.sanitised(more)
    assert out.columns == more.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in out.collect()) == plain
