import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from evalgate.llm import sharding

from .helpers import frame, odd_rows, rows_of


def brute(rows, limit):
    """Split one bucket after the other, from the root."""
    bits = lambda d: bin(int(hashlib.md5(str("" if d is None else d).encode()).hexdigest()[:15], 16))[2:].zfill(60)
    items = [(r[0], len((r[1] or "").encode()), bits(r[0])) for r in rows]
    todo, out = [("", items)], []
    while todo:
        name, held = todo.pop()
        size = sum(i[1] for i in held)
        if size <= limit or len(held) == 1:
            out += [(d, n, name, len(name), size, len(held)) for d, n, _ in held]
            continue
        parts = defaultdict(list)
        for i in held:
            parts[i[2][: len(name) + 1]].append(i)
        todo += list(parts.items())
    return sorted(out, key=repr)


def test_equals_one_split_after_the_other(spark):
    rows = [(i, "x" * (i * 37 % 400)) for i in range(700)] + [(1000, "y" * 9000), (1001, None), (1002, "é" * 700)]
    for limit in (10**9, 4000, 700):
        assert rows_of(sharding.sharded(frame(spark, rows), limit)) == brute(rows, limit)


def test_hot_key_odd_rows_and_empty(spark):
    rows = [(7, "same id " * 20)] * 60 + [(None, "no id " * 20)] * 30 + odd_rows()
    docs = frame(spark, rows)
    got = sharding.sharded(docs, 1000).collect()
    assert len(got) == len(rows) and all(r["shard_bytes"] <= 1000 or r["shard_rows"] == 1 for r in got)
    assert max(r["depth"] for r in got) > sharding.KEY_BITS
    assert sharding.sharded(docs.limit(0)).count() == 0
    clash = docs.selectExpr("*", "1 AS bits", "2 AS prefix", "3 AS shard", "4 AS n_bytes")
    assert rows_of(sharding.sharded(clash, 10**6)) == rows_of(sharding.sharded(docs, 10**6))


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i} " * 30) for i in range(100)]
    sharding.write(frame(spark, rows), str(tmp_path / "out"), 3000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["doc_id"] for r in back.collect()) == list(range(100)) and len(list((tmp_path / "out").glob("shard=*"))) > 5


def test_rows_of_one_id_or_none_are_written_once(spark, tmp_path):
    rows = [(None, f"no id {i} " * 30) for i in range(40)] + [(7, f"same id {i} " * 30) for i in range(40)] + [(8, "twice")] * 2
    sharding.write(frame(spark, rows), str(tmp_path / "out"), 3000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows_of(back.select("doc_id", "text")) == sorted(rows, key=repr) and "__row" not in back.columns
    assert all(r["n"] <= 3000 for r in back.groupBy(F.regexp_extract(F.input_file_name(), "shard=([^/]*)", 1)).agg(F.sum(F.octet_length("text")).alias("n")).collect())


def test_write_with_a_shard_column(spark, tmp_path):
    docs = frame(spark, odd_rows()).selectExpr("*", "'x' AS shard", "1 AS __row")
    sharding.write(docs, str(tmp_path / "out"), 20_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and {r["shard"] for r in back.collect()} == {"x"} and "shard_" in back.columns
