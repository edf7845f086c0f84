"""Small documents with every awkward case: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string, fp string, copies int, kept string, key string, size int, stats string, digest string, doc long, _row long, _copies int, _copy string, _stay_id long, _gone_id long, _chosen string, _own0 int, _key0 string"
LONG = "a very long line of words " * 40_000


def row(doc_id, text, source="a", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), 0.5, "x", "y", 9, "z", "k", 3, "s", "d", 7, 77, 5, "c", 8, 9, "h", 1, "o")


AWKWARD = [
    row(1, "one two three four five six seven"),
    row(2, "one two three four five six seven"),
    row(3, None),
    row(4, ""),
    row(5, "   \t\n "),
    row(6, LONG, "b"),
    row(7, "A shared line of text\nown words here\n  a SHARED line of text  ", None),
    row(8, "a shared line of text\nshort\nother own words", "b"),
    row(9, "short\n\nshort", None, None),
    row(10, "Ünïcode çà et là 🙂 naïve text with accents\x0b\x1c and odd blanks", "b"),
    row(10, "same id, other text"),
    row(11, "twice the same row"),
    row(11, "twice the same row"),
    row(None, "no id at all in this row"),
    row(12, "one two three four five six eight"),
]


def awkward(spark, rows=AWKWARD):
    return spark.createDataFrame(rows, SCHEMA)


def as_counter(df):
    from collections import Counter

    return Counter(map(tuple, df.collect()))
