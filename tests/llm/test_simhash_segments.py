from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from terrajobs.llm import simhash_segments as op

from .common import AWKWARD, SMALL, awkward


def plain_fingerprint(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def components(fps, radius):
    """Smallest member index by union-find over all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    f = np.array(fps, dtype="u8")
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i + 1 :] ^ f[i]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def brute(rows):
    fps = [plain_fingerprint(r[1]) for r in rows]
    groups = components(fps, op.RADIUS)
    least = {}
    for g, r in zip(groups, rows):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return Counter((r[0], f"{fp:016x}", least.get(g)) for r, fp, g in zip(rows, fps, groups))


def answers(df):
    return Counter(map(tuple, df.select("doc_id", op.fp_hex("fp"), "component_id").collect()))


def test_against_brute_force(spark):
    assert answers(op.near_duplicates(awkward(spark))) == brute(AWKWARD)


def test_query_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert Counter(map(tuple, op.op4_simhash_near_dedup(spark, SMALL).collect())) == brute(rows)


def test_empty_table(spark):
    assert op.near_duplicates(awkward(spark, [])).count() == 0


def test_representatives_keep_columns(spark):
    docs = awkward(spark)
    stay = op.keep_representatives(docs)
    assert stay.columns == docs.columns
    assert {r["doc_id"] for r in stay.select("doc_id").collect()} >= {1, 3, 6}


def near_family(n, seed=0):
    """Fingerprints around a few centres, some chained by four bits at a time."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 5, dtype="u8")
    out = [c for c in centres]
    while len(out) < n:
        f = out[rng.integers(0, len(out))]
        for _ in range(rng.integers(1, 6)):
            f = f ^ (np.uint64(1) << np.uint64(rng.integers(0, 64)))
        out.append(f)
    return np.unique(np.array(out, dtype="u8"))


@pytest.mark.parametrize("segment_bits", [1, 2, 4, 8])
@pytest.mark.parametrize("radius", [1, 3, 4, 7])
def test_grid_loses_no_link(radius, segment_bits):
    fps = near_family(300)
    cells, rows = op.grid_cells(fps, radius, segment_bits)
    filed = {}
    for c, r in zip(cells.tolist(), rows.tolist()):
        filed.setdefault(c, []).append(r)
    met = {(a, b) for members in filed.values() for a in members for b in members if a < b}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    assert {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)))} <= met


def test_manhattan_is_a_lower_bound():
    fps = near_family(200, 3)
    for w in (1, 2, 4, 8):
        t = op.thermometers(fps, w)
        assert (np.bitwise_count(t[:, None] ^ t[None, :]) <= np.bitwise_count(fps[:, None] ^ fps[None, :])).all()


@pytest.mark.parametrize("block", [1, 5, 50, 4096])
def test_hot_grid_points_in_blocks(spark, block):
    """A dense family fills grid points far beyond a block; components stay the same."""
    fps = near_family(400, 1)
    df = spark.createDataFrame([(int(f.view("i8")),) for f in fps], "fp long")
    links = op.fingerprint_links(df, block=block).collect()
    want = components(fps.tolist(), op.RADIUS)
    at = {int(f.view("i8")): i for i, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in links:
        assert bin(int(fps[at[r["src"]]]) ^ int(fps[at[r["dst"]]])).count("1") <= 64
        a, b = find(at[r["src"]]), find(at[r["dst"]])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == want


def test_streams_cut_anywhere():
    """The run of a cell may cross batches, and a hot cell may cross many."""
    fps = near_family(200, 2)
    cells = np.repeat(np.arange(8, dtype="u8"), 25)[: len(fps)]
    for size in (1, 7, 60, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(cells[i : i + size].view("i8")), pa.array(fps[i : i + size].view("i8"))], names=op.CELLS.names) for i in range(0, len(cells), size)]
        n = sum(b.num_rows for b in batches)
        hot = sum(out.num_rows for out in op._meet(op.RADIUS, 2, 10)(iter(batches)) if out["hot"][0].as_py() == 1)
        assert hot == n - (n % 25 if n % 25 <= 10 else 0)
