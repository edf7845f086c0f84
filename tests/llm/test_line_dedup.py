import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from terrajobs.llm import line_dedup as op

from .common import AWKWARD, awkward


def brute(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    order = lambda i: -(1 << 63) if i is None else i
    least = defaultdict(lambda: 1 << 63)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            least[key(line)] = min(least[key(line)], order(r[0]))
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or least[key(x)] == order(r[0])]
        out.append((r[0], len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def through_bitmaps(spark, docs):
    from pyspark.sql import functions as F

    maps = op.keep_bitmaps(docs)
    out = op._keyed(docs, "doc_id", "text").join(maps, ["doc", "text_key"])
    out = out.select(F.when(F.col("doc") != op.NULL_ID, F.col("doc")), "n_lines", "n_dropped", op._kept_sha256("text", "keep_bitmap"))
    return sorted(map(tuple, out.collect()), key=str)


def test_against_brute_force(spark):
    assert through_bitmaps(spark, awkward(spark)) == brute(AWKWARD)


def test_one_line_in_every_document(spark):
    rows = [(i, f"the line that all share\nmine {i} alone in here\nthe line that all share", *AWKWARD[0][2:]) for i in range(500)]
    assert through_bitmaps(spark, awkward(spark, rows)) == brute(rows)


def test_empty_table(spark):
    assert op.keep_bitmaps(awkward(spark, [])).count() == 0


@pytest.mark.parametrize("cuts", [[3], [1, 2, 3], [5, 9], []])
def test_ranges_that_break_a_hash(cuts):
    """However the sorted rows are cut into ranges and batches, edges and open runs decide as one range would."""
    rows = [(h, h, doc, 0, pos) for h, doc, pos in [(1, 1, 0), (1, 1, 4), (1, 2, 0), (1, 3, 0), (2, 5, 0), (3, 1, 0), (3, 4, 1), (3, 4, 2), (3, 9, 0), (4, 2, 2), (4, 3, 0)]]
    bounds = [0, *cuts, len(rows)]
    dropped, heads, edges = set(), [], defaultdict(lambda: 1 << 62)
    for a, b in zip(bounds, bounds[1:]):
        part = rows[a:b]
        batches = [pa.RecordBatch.from_arrays([pa.array(np.array(c, dtype="i8")) for c in zip(*part[i : i + 2])], names=op.KEYS.names) for i in range(0, len(part), 2)]
        for out in op._first_occurrences(iter(batches)):
            for r in out.to_pylist():
                if r["kind"] == 2:
                    edges[r["h1"]] = min(edges[r["h1"]], r["doc"])
                elif r["kind"] == 1:
                    heads.append(r)
                else:
                    dropped.add((r["doc"], r["h1"], r["pos"]))
    dropped |= {(r["doc"], r["h1"], r["pos"]) for r in heads if r["doc"] != edges[r["h1"]]}
    first = {}
    for h, _, doc, _, _ in rows:
        first[h] = min(first.get(h, doc), doc)
    assert dropped == {(doc, h, pos) for h, _, doc, _, pos in rows if doc != first[h]}
