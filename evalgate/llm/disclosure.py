"""Personal data and information-theoretic sanitisation (operator 7), with DataFrame functions only.

Base spans come from fixed patterns for e-mail addresses, IP addresses, card and phone numbers. Every value found is a protected
entity. Terms (words of letters) near an entity are counted over the corpus: a term discloses an entity as far as it raises the
entity's probability, log2 P(entity | term) / P(entity) bits, with P(entity | term) the share of the documents with the term in
which it stands near the entity. Terms with enough support, bits and posterior are spans of their own, wherever they stand:
generalised to a placeholder, or removed where the posterior is nearly certain.

The patterns are possessive and anchored by lookbehind, which leaves their leftmost matches as they are and keeps long runs of
digits or letters linear. Positions count code points and come from the lengths of the pieces between the matches.

Defined results: null texts count as empty; repeated rows and rows with null doc_id have results of their own; copies of a text
support a term once; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalgate.llm.common import checkpointed, free_name, numbered, row_number

_LOCAL = r"[A-Za-z0-9._%+-]"
#: Kind, what a text must contain, and the pattern. A match of e-mail may begin where the last one ended.
PATTERNS = (
    ("email", "@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", ".", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", None, r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", "+", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
KINDS = (*[p[0] for p in PATTERNS], "term")
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Code points on either side of an entity in which terms count as near.
NEAR = 80
TERM = r"\p{L}{4,}"
SUPPORT = 3
BITS = 4.0
POSTERIOR = 0.5
CERTAIN = 0.9
#: Most terms that are broadcast to the texts; more are joined by a shuffle.
BROADCAST_TERMS = 50_000
SPAN = "array<struct<start:int,kind:int,end:int>>"


def luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string is divisible by ten."""

    def value(i: Column) -> Column:
        n = F.substr(digits, -i, F.lit(1)).cast("int") * ((i - 1) % 2 + 1)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def positions(text: Column, pattern: Column, kind: int) -> Column:
    """Spans of all matches: (start, kind, end), in code points."""
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    lengths = F.zip_with(F.transform(found, F.length), F.transform(between, F.length), lambda m, b: F.struct(m.alias("m"), b.alias("b")))
    # the last piece has no match after it
    lengths = F.slice(lengths, 1, F.size(found))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def add(done: Column, x: Column) -> Column:
        first = done["at"] + x["b"]
        span = F.struct(first.alias("start"), F.lit(kind).alias("kind"), (first + x["m"]).alias("end"))
        return F.struct((first + x["m"]).alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    return F.aggregate(lengths, start, add, lambda done: done["spans"])


def _valid_span(text: Column, kind: str) -> Callable[[Column], Column]:
    return lambda s: valid(kind, F.substr(text, s["start"] + 1, s["end"] - s["start"]))


def base_spans(text: Column) -> Column:
    """Valid spans of all kinds, by start and then kind."""
    parts = []
    for number, (kind, mark, pattern) in enumerate(PATTERNS):
        spans = F.filter(positions(text, F.lit(pattern), number), _valid_span(text, kind))
        may = F.contains(text, F.lit(mark)) if mark else text.rlike("[0-9][ -]?[0-9]")
        parts.append(F.when(may, spans).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*parts))


def found(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(row, doc_id, spans, near) of every row; near has value, kind and the text on either side of every base span."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(row_number(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    spans = rows.withColumn("spans", base_spans(F.col("text")))

    def around(s: Column) -> Column:
        before = F.greatest(s["start"] - NEAR, F.lit(0))
        return F.struct(
            F.lower(F.substr("text", s["start"] + 1, s["end"] - s["start"])).alias("value"), s["kind"].alias("kind"),
            F.concat_ws(" \n", F.substr("text", before + 1, s["start"] - before), F.substr("text", s["end"] + 1, F.lit(NEAR))).alias("context"),
        )

    return spans.select("row", "doc_id", "spans", F.transform("spans", around).alias("near"))


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def disclosing(rows: DataFrame, docs: DataFrame, support: int = SUPPORT, bits: float = BITS, posterior: float = POSTERIOR) -> DataFrame:
    """(term, posterior, bits) of the terms that reveal an entity; the strongest entity counts.

    Probabilities are shares of documents; support counts distinct neighbourhoods, so that copies of a text are one witness.
    """
    near = rows.select("row", F.explode("near").alias("n")).select("row", "n.value", "n.kind", F.xxhash64("n.context").alias("place"), terms_of(F.col("n.context")).alias("terms"))
    near = checkpointed(near)
    counts = lambda n: (F.count_distinct("row").alias(n), F.count_distinct("place").alias("places"))
    repeated = near.groupBy("value", "kind").agg(*counts("n_entity")).filter(F.col("places") >= support).drop("places")
    pairs = (
        near.join(repeated, ["value", "kind"]).select("value", "kind", "n_entity", "row", "place", F.explode("terms").alias("term"))
        .groupBy("value", "kind", "n_entity", "term").agg(*counts("n_both")).filter(F.col("places") >= support)
    )
    # every term of the corpus is counted map-side before candidates pick their counts
    known = docs.select(F.explode(terms_of(F.col("text").cast("string"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    chance = F.col("n_both") / F.col("n_term")
    gain = F.log2(chance * F.lit(docs.count()) / F.col("n_entity"))
    strong = pairs.join(known, "term").select("term", chance.alias("posterior"), gain.alias("bits"))
    best = strong.filter((F.col("posterior") >= posterior) & (F.col("bits") >= bits)).groupBy("term")
    return checkpointed(best.agg(F.max("posterior").alias("posterior"), F.max("bits").alias("bits")))


def _sized(terms: DataFrame) -> DataFrame:
    """A broadcast hint only for a list of bounded size."""
    terms = checkpointed(terms)
    return F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms


def term_spans(docs: DataFrame, terms: DataFrame, row: str | None = None) -> DataFrame:
    """(row, spans, sure): spans of disclosing terms in every document, and those of nearly certain ones."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(row_number(row).alias("row"), text.alias("text"))
    hits = rows.withColumn("term", F.explode(terms_of(F.col("text")))).join(_sized(terms), "term")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})\Q"), F.col("term"), F.lit(r"\E(?!\p{L})"))
    each = hits.select("row", "posterior", positions(F.col("text"), pattern, len(PATTERNS)).alias("spans"))
    sure = F.when(F.col("posterior") >= CERTAIN, F.col("spans")).otherwise(F.array().cast(SPAN))
    return each.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("terms"), F.flatten(F.collect_list(sure)).alias("sure"))


def with_spans(docs: DataFrame, row: str | None = None) -> DataFrame:
    """(row, doc_id, spans, terms, sure) of every document."""
    rows = checkpointed(found(docs, row))
    extra = term_spans(docs, disclosing(rows, docs), row)
    empty = F.array().cast(SPAN)
    return rows.drop("near").join(extra, "row", "left").withColumns({c: F.array_sort(F.coalesce(c, empty)) for c in ("terms", "sure")})


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _equals(value: int) -> Callable[[Column], Column]:
    return lambda x: x == value


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    rows = with_spans(docs)
    each = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(each, _equals(i))).cast("long").alias(f"n_{kind}") for i, (kind, *_) in enumerate(PATTERNS)]
    every = F.array_sort(F.concat("spans", "terms"))
    return rows.select("doc_id", *counts, F.sha2(written(F.col("spans")), 256).alias("base_sha256"), written(every).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitised(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced: [KIND] for entities and generalised terms, nothing for nearly certain terms."""
    keyed, row = numbered(docs)
    spans, sure = free_name("__spans", keyed), free_name("__sure", keyed)
    rows = with_spans(keyed, row).select(F.col("row").alias(row), F.array_sort(F.concat("spans", "terms")).alias(spans), F.col("sure").alias(sure))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(done: Column, s: Column) -> Column:
        put_in = F.when(F.exists(sure, lambda x: x == s), F.lit("")).otherwise(F.get(names, s["kind"]))
        text = F.concat(done["out"], F.substr("text", done["at"] + 1, s["start"] - done["at"]), put_in)
        inside = s["start"] < done["at"]
        return F.struct(F.when(inside, F.greatest(done["at"], s["end"])).otherwise(s["end"]).alias("at"), F.when(inside, done["out"]).otherwise(text).alias("out"))

    new = F.aggregate(spans, start, put, lambda done: F.concat(done["out"], F.substr("text", done["at"] + 1, F.length("text"))))
    return keyed.join(rows, row).withColumn("text", new).select(*docs.columns)
