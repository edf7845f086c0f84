import hashlib
import random

import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from terrajobs.llm import bpe_trie as op

from .common import AWKWARD, awkward

PATH = op.vocabulary_path()
WANT, ENCODER = Tokenizer.from_file(PATH), op.TrieEncoder(PATH)


def ids(text):
    return [i for part in ENCODER.encode(text) for i in part]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="ab c\t\n\x0b\x1c\x85\xa0　'sdlvret1²é🙂<|endoftext|>", max_size=80))
def test_same_ids_as_the_library(text):
    want = WANT.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert ENCODER.decode(want).decode("utf-8", "replace") == WANT.decode(want, skip_special_tokens=False)


def test_every_code_point():
    points = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 8192):
        for text in ("".join(points[i : i + 8192]), " a".join(points[i : i + 8192 : 3])):
            assert ids(text) == WANT.encode(text, add_special_tokens=False).ids


def test_neighbours_stay_whole_as_merging_says():
    rng, tokens = random.Random(5), [i for i in ENCODER.tokens if i not in ENCODER.special.values()]
    for _ in range(5000):
        a, b = rng.choice(tokens), rng.choice(tokens)
        parts = [ENCODER.ids[bytes([x])] for x in ENCODER.tokens[a] + ENCODER.tokens[b]]
        assert ENCODER._stays_whole(a, b) == (ENCODER.merge(parts) == [a, b])


def brute(rows):
    out = []
    for r in rows:
        got = WANT.encode(r[1] or "", add_special_tokens=False).ids
        text = WANT.decode(got, skip_special_tokens=False)
        out.append((r[0], len(got), hashlib.sha256(",".join(map(str, got)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("long_text", [op.LONG_TEXT, 50])
def test_against_the_library(spark, monkeypatch, long_text):
    rows = [*AWKWARD, (20, "a<|endoftext|>b <|endoftext|><|endoftext|>", *AWKWARD[0][2:])]
    monkeypatch.setattr(op, "LONG_TEXT", long_text)
    if long_text == 50:  # in this process, where the limits hold: texts are walked a slice at a time
        monkeypatch.setattr(op, "SLICE", 7)
        import pyarrow as pa

        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["doc_id", "text"])
        got = [tuple(x.values()) for out in op._digests(PATH)(iter([batch])) for x in out.to_pylist()]
    else:
        got = list(map(tuple, op.encode_digests(awkward(spark, rows), PATH).collect()))
    assert sorted(got, key=str) == brute(rows)


def test_memory_that_starts_anew(monkeypatch):
    monkeypatch.setattr(op, "REMEMBERED", 5)
    text = " ".join(f"word{i}" for i in range(40))
    assert ids(text) == WANT.encode(text, add_special_tokens=False).ids


def test_arrays_round_trip(spark):
    docs = awkward(spark)
    out = docs.select("text", op.encode_ids(PATH)("text").alias("ids")).select("text", "ids", op.decode_ids(PATH)("ids").alias("back")).collect()
    assert all((r["text"] or "") == r["back"] for r in out)
    assert op.encode_digests(awkward(spark, []), PATH).count() == 0
