"""BPE encoding by a depth-first walk over the trie of distinct words, and decoding.

For every prefix of a word the encoding ends in one token, and that last token together with the encoding of the
prefix before it is the whole encoding. A token t ending at a prefix is the last one exactly if the prefix before
it ends in a token that stays whole beside t, i.e. if BPE of the two tokens' bytes gives the two tokens back. So the
last tokens of a word follow from those of its prefixes, and words that share a prefix share that work: sorted words
are met in the trie's depth-first order, and a stack holds the states of the current path. The tokens that may end at a
prefix are those that an Aho-Corasick automaton of the vocabulary finds there.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import ahocorasick
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Splits text into words before the merges: fixed by the vocabulary. White space is Unicode's White_Space. Letters and digits come
#: before contractions, which begin with an apostrophe and so never compete with them.
WORDS = r" ?\p{L}+| ?\p{N}+|'(?:[stmd]|re|ve|ll)| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same words of a text that is all ASCII, which the plainer engine finds faster.
ASCII_WORDS = r" ?[A-Za-z]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\x20\x09-\x0DA-Za-z0-9]+|[\x20\x09-\x0D]+(?![^\x20\x09-\x0D])|[\x20\x09-\x0D]+"
#: Words whose encodings a task remembers; beyond that it starts anew.
REMEMBERED = 600_000
#: Words of a text handled at a time, and code points above which a text is walked instead of split at once.
SLICE = 1 << 16
LONG_TEXT = 1 << 20

ENCODED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file, by letter.

    Bytes that print stand for themselves; the others take the code points from 256 on, in order.
    """
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class TrieEncoder:
    """Encodes texts as the vocabulary file says; remembers distinct words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_bytes = lambda word: bytes(letters[c] for c in word)
        self.ids = {to_bytes(w): i for w, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.tokens = {i: w for w, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.split_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words, self.ascii_words = regex.compile(WORDS), re.compile(ASCII_WORDS)
        #: rank of the merge of two tokens; the rank that made a token (-1: a byte) and the tokens it was made of
        self.ranks: dict[tuple[int, int], int] = {}
        self.made, self.left, self.right = {i: -1 for i in self.tokens}, {}, {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = map(to_bytes, merge if isinstance(merge, list) else merge.split(" "))
            token = self.ids[a + b]
            self.ranks.setdefault((self.ids[a], self.ids[b]), rank)
            if token not in self.left:
                self.made[token], self.left[token], self.right[token] = rank, self.ids[a], self.ids[b]
        self.numeral = {i: str(i) for i in self.tokens}
        #: tells of a word's bytes, as code points, each token (length, id) that ends at each place
        self.ending = ahocorasick.Automaton()
        for word, i in self.ids.items():
            self.ending.add_word(word.decode("latin-1"), (len(word), i))
        self.ending.make_automaton()
        #: of each word remembered, its ids in decimal and the bytes that they decode to
        self.numerals: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}
        self.stays_whole = lru_cache(maxsize=1 << 20)(self._stays_whole)

    def _stays_whole(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a and b as they are side by side (a of -1: b alone).

        Undo the merges that made the tokens at the boundary, latest first. At each point the two that touch must
        not have a merge that comes before the one just undone; of equal merges the left one comes first.
        """
        if a < 0:
            parts = [self.ids[bytes([x])] for x in self.tokens[b]]
            return self.merge(parts) == [b]
        ranks, made, before = self.ranks, self.made, 1 << 60
        while True:
            if ranks.get((a, b), before) < before:
                return False
            if made[a] > made[b]:
                before, a = made[a], self.right[a]
            elif made[b] >= 0:
                before, b = made[b] + 1, self.left[b]
            else:
                return True

    def merge(self, parts: list[int]) -> list[int]:
        """Plain BPE: merge the pair of least rank, leftmost first, until none is left."""
        parts = list(parts)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [self.ids[self.tokens[parts[at]] + self.tokens[parts[at + 1]]]]
        return parts

    def learn(self, words: set[str]) -> None:
        """Insert words into the trie and walk it depth first. The stack holds, for each prefix of the current
        path, its last token and where that token begins. All of ``words`` are remembered then."""
        new = words.difference(self.numerals)
        if len(self.numerals) + len(new) > REMEMBERED:
            self.numerals, self.decoded, new = {}, {}, words
        path, last = b"", [(-1, 0)]
        found, stays_whole, numeral = self.ending.iter, self.stays_whole, self.numeral
        for data, text in sorted((w.encode("utf-8", "replace"), w) for w in new):
            shared, limit = 0, min(len(path), len(data))
            while shared < limit and path[shared] == data[shared]:
                shared += 1
            del last[shared + 1 :]
            for end, (size, token) in found(data.decode("latin-1")):
                # One token alone may be the last of a prefix; what has its state is passed over.
                if end + 1 == len(last) and stays_whole(last[end + 1 - size][0], token):
                    last.append((token, end + 1 - size))
            path = data
            out, end = [], len(data)
            while end:
                token, end = last[end]
                out.append(token)
            out.reverse()
            self.numerals[text] = ",".join([numeral[t] for t in out])
            self.decoded[text] = self.decode(out)

    def pieces(self, text: str) -> Iterator[str | int]:
        """Stretches of ordinary text and ids of special tokens, in order."""
        at = 0
        for m in self.split_special.finditer(text) if self.split_special else ():
            if m.start() > at:
                yield text[at : m.start()]
            yield self.special[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:] if at else text

    def slices(self, text: str) -> Iterator[list[str] | int]:
        """The words of a text, some at a time, and its special tokens, in order."""
        for piece in self.pieces(text):
            if isinstance(piece, int):
                yield piece
                continue
            pattern = self.ascii_words if piece.isascii() else self.words
            if len(piece) <= LONG_TEXT:
                yield pattern.findall(piece)
            else:
                walk = (m[0] for m in pattern.finditer(piece))
                while some := list(islice(walk, SLICE)):
                    yield some

    def encoded(self, words: list[str] | int) -> tuple[str, bytes]:
        """The ids of words, or of a special token, in decimal joined by commas, and the bytes they decode to."""
        if isinstance(words, int):
            return self.numeral[words], self.tokens[words]
        try:
            numerals = ",".join(map(self.numerals.__getitem__, words))
        except KeyError:
            self.learn(set(words))
            numerals = ",".join(map(self.numerals.__getitem__, words))
        return numerals, b"".join(map(self.decoded.__getitem__, words))

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, a slice at a time, so that a very long text needs little more memory than its own."""
        for words in self.slices(text):
            if numerals := self.encoded(words)[0]:
                yield list(map(int, numerals.split(",")))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for; special tokens give their text."""
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    """One encoder a worker process and vocabulary."""
    return TrieEncoder(path)


def encode_ids(path: str):
    """Pandas UDF: text -> array of ids. The general form; a text's ids are held whole."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        enc = encoder(path)
        return pd.Series([[] if t is None else list(chain.from_iterable(enc.encode(t))) for t in texts], dtype=object)

    return run


def decode_ids(path: str):
    """Pandas UDF: array of ids -> text; broken UTF-8 gives the replacement character, null null."""
    @F.pandas_udf(T.StringType())
    def run(ids: pd.Series) -> pd.Series:
        enc = encoder(path)
        return pd.Series([None if x is None else enc.decode(list(x)).decode("utf-8", "replace") for x in ids], dtype=object)

    return run


def _digests(path: str):
    def groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
        """Rows of some of the texts at a time, long ones by themselves."""
        start, texts, size = 0, [], 0
        for i, text in enumerate(batch["text"]):
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size > LONG_TEXT // 2:
                yield start, texts
                start, texts, size = i + 1, [], 0
        if texts:
            yield start, texts

    def digest(enc: TrieEncoder, slices: Iterator) -> tuple[int, str, str]:
        n, ids_hash, decoded = 0, hashlib.sha256(), Decoded()
        for words in slices:
            numerals, data = enc.encoded(words)
            if numerals:
                ids_hash.update(("," * bool(n) + numerals).encode())
                n += numerals.count(",") + 1
                decoded.update(data)
        return n, ids_hash.hexdigest(), decoded.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for start, texts in groups(batch):
                # Short texts are split once and their new words enter the trie together.
                split = [list(enc.slices(t)) if len(t) <= LONG_TEXT else enc.slices(t) for t in texts]
                enc.learn(set(chain.from_iterable(w for x in split if isinstance(x, list) for w in x if isinstance(w, list))))
                n, a, b = zip(*(digest(enc, x) for x in split), strict=True)
                ids = batch["doc_id"].slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=ENCODED.names)

    return run


class Decoded:
    """SHA-256 of decoded text in UTF-8, fed with bytes that may break off within a character."""

    def __init__(self):
        self.text = codecs.getincrementaldecoder("utf-8")("replace")
        self.hash = hashlib.sha256()

    def update(self, data: bytes) -> None:
        self.hash.update(self.text.decode(data).encode("utf-8"))

    def hexdigest(self) -> str:
        self.hash.update(self.text.decode(b"", True).encode("utf-8"))
        return self.hash.hexdigest()


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row.

    Null counts as empty: no tokens, digests of the empty string. Special tokens' strings in a text are encoded as
    those tokens. Repeated rows and null ids come through each; no rows give no rows. No shuffle: a
    task meets the distinct words of its own texts, which repeat far more often than they differ.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_digests(path), ENCODED)


def op9_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of every document."""
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or vocabulary_path())
