"""The registered queries of the corpus operators and, where SQL can say it, their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalgate.llm import alignment, disclosure, exact_dedup, html_text, merkle, mixing, ngram_join, pieces, quality_forest, sharding, simhash_dedup, substring_dedup, toxicity
from evalgate.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op4_mixed_documents")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


@query("op6_simhash_components")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op10_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
              doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
       FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(table(spark, sf_dir, "documents"))


@query("op1_quality_forest")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_forest.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_personal_data")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.personal_data(table(spark, sf_dir, "documents"))


@query("op8_repeated_strings")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf_dir, "documents"))


@query("op3_pieces")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.tokenized(table(spark, sf_dir, "documents"))


@query("op5_main_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


@query(
    "op2_shards",
    f"""WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
                          lpad(bin(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)), 60, '0') AS bits FROM documents),
             p AS (SELECT doc_id, n_bytes, k, substr(bits, 1, k) AS shard FROM d, range(0, 40) r(k)),
             g AS (SELECT k, shard, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY k, shard),
             f AS (SELECT p.doc_id, p.n_bytes, p.shard, p.k, g.shard_bytes, g.shard_rows,
                          row_number() OVER (PARTITION BY p.doc_id ORDER BY p.k) AS nth
                   FROM p JOIN g ON p.k = g.k AND p.shard = g.shard WHERE g.shard_bytes <= {sharding.LIMIT} OR g.shard_rows = 1)
        SELECT doc_id, n_bytes, shard, k AS depth, shard_bytes, shard_rows FROM f WHERE nth = 1""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"))


def _merkle_sql(levels: int = 14, top: int = 4) -> str:
    """Trees with up to 3^levels leaves a source and 3^top sources, a level a step; a tree of one node stays as it is."""
    field = lambda c, v=None: f"coalesce(concat(octet_length(encode(CAST({v or c} AS VARCHAR))), ':', {v or c}), '-')"
    before = ", ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    crc = (
        "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda s, b: "
        "list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))"
    )
    tampered = f"CASE WHEN xor({crc}, 4294967295::BIGINT) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
    steps = [
        f"""l AS (SELECT doc_id, source, sha256(concat({before}, {field("text")})) AS leaf, sha256(concat({before}, {field("text", tampered)})) AS fold FROM documents)""",
        """s0 AS (SELECT *, leaf AS d, '' AS proof, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                  count(*) OVER (PARTITION BY source) AS n FROM l)""",
    ]

    def climb(was: str, now: str, group: str) -> list[str]:
        # the runs of one level, then every row's siblings in its run; a row repeats for each leaf below a node
        return [
            f"n{now} AS (SELECT DISTINCT {group}, pos, d FROM {was} WHERE n > 1)",
            f"""r{now} AS (SELECT {group}, pos // 3 AS run, list(d ORDER BY pos) AS ds, sha256(string_agg(d, '' ORDER BY pos)) AS h FROM n{now} GROUP BY {group}, pos // 3)""",
            f"""{now} AS (SELECT w.* EXCLUDE (d, proof, pos, n, fold), coalesce(r.h, w.d) AS d, w.pos // 3 AS pos, (w.n + 2) // 3 AS n,
                   CASE WHEN w.n > 1 THEN concat(proof, array_to_string(ds[1:w.pos % 3], ''), array_to_string(ds[w.pos % 3 + 2:3], '')) ELSE proof END AS proof,
                   CASE WHEN w.n > 1 THEN sha256(concat(array_to_string(ds[1:w.pos % 3], ''), fold, array_to_string(ds[w.pos % 3 + 2:3], ''))) ELSE fold END AS fold
                 FROM {was} w LEFT JOIN r{now} r ON w.n > 1 AND w.{group} IS NOT DISTINCT FROM r.{group} AND w.pos // 3 = r.run)""",
        ]

    for k in range(levels):
        steps += climb(f"s{k}", f"s{k + 1}", "source")
    steps.append(
        f"""t0 AS (SELECT * EXCLUDE (pos, n), d AS subroot, 1 AS one, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS pos,
               (SELECT count(*) FROM (SELECT DISTINCT source FROM l)) AS n FROM s{levels})"""
    )
    for k in range(top):
        steps += climb(f"t{k}", f"t{k + 1}", "one")
    return (
        "WITH " + ",\n".join(steps) + f"""
        SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = d AS verified FROM t{top}"""
    )


@query("op11_merkle_proofs", _merkle_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(table(spark, sf_dir, "documents"))


@query("op12_ngram_join")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))
