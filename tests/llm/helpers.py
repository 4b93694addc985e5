"""Small tables with every odd case, and plain Python versions of the contracts."""

import re

import pandas as pd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Documents from (doc_id, text[, source]) rows."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, odd white space and letters outside ASCII."""
    long = " ".join(f"w{i % 97} v{i % 89}" for i in range(6000))
    return [
        (1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "Hello World", "b"), (5, "hello world", "b"), (5, "hello world", "b"),
        (6, "ÀB c d", "c"), (7, "àb c d", "c"), (8, long, "a"), (9, long + " x", "a"), (10, "one two three four five\x0bsix\x0cseven", None),
        (11, "x" * 5000, "d"), (12, "a b   c", "d"), (None, "no id here at all", "d"), (13, "one two three four five\x0bsix\x0cseven", None),
    ]


def documents(sf="sf0.001"):
    return pd.read_parquet(f"/root/testdata/{sf}/documents.parquet")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
