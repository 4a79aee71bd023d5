"""Byte-level BPE: whole texts to token ids and back, with the merges of a tokenizer file.

A text is cut at added tokens and, between them, into words by the byte-level pattern. The merges
of a word go by a segment tree: a leaf for every pair of neighbours holds the pair's rank and
place, every node the least of the two below, so the root is the leftmost pair of lowest rank. A
merge writes the ids of the new pairs into two leaves, clears the one that went, and mends the
nodes above; it ends when the root holds no rank. A word of n bytes takes n log n steps at most.
Words' ids are kept in a cache of bounded size on every worker. decode() joins the bytes that the
ids stand for; bytes that are no UTF-8 become U+FFFD.

Letters and numbers are told apart as the tokenizer's own pre-tokenizer does: where the pattern
library knows a later Unicode, the character stands as one of the right class while words are cut.

Defined cases: a null text is empty and has no ids; added tokens' strings in a text are their ids;
a null doc_id stays null; equal pairs merge from the left; repeated rows each get their ids; an
empty table gives no rows; other columns are ignored, whatever their names; texts are whole at any
length: they are cut into words some 64 K characters at a time, where a space follows another
character. A file with a normalizer, a prefix space, dropout or tokens that strip is refused.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cached, map_arrow, table, text_or_empty

#: Words whose ids a worker keeps in each of two generations, and the longest of them in characters; when the
#: younger is full, it becomes the older one, so that frequent words stay.
CACHE_WORDS, CACHE_CHARS = 300_000, 64
#: Characters that are cut into words at a time, and rows of a result batch.
WORK_CHARS, ROWS = 65_536, 128

#: Fixed value: how byte-level vocabularies cut words.
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_BORDER = regex.compile(r"(?<=\S)\s")
#: A character of each class, which no alternative of the pattern names, and the pattern of the class.
_CLASSES = [("z", regex.compile(r"\p{L}")), ("1", regex.compile(r"\p{N}")), ("!", regex.compile(r"[^\s\p{L}\p{N}]"))]
NONE = 1 << 62


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def merged(ids: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """ids after all merges; ranks has the rank of left << 20 | right, made the id that a rank's merge gives."""
    last = len(ids) - 1
    if last < 1:
        return ids
    bits = last.bit_length()
    place, size = (1 << bits) - 1, 1 << (last - 1).bit_length()
    tree = [NONE] * (2 * size)
    for i in range(last):
        rank = ranks.get(ids[i] << 20 | ids[i + 1])
        if rank is not None:
            tree[size + i] = rank << bits | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, last + 2)), list(range(-1, last))
    while (root := tree[1]) != NONE:
        i = root & place
        gone = after[i]
        ids[i], ids[gone] = made[root >> bits], -1
        right, left = after[gone], before[i]
        after[i] = right
        changes = []
        if right <= last:
            before[right] = i
            rank = ranks.get(ids[i] << 20 | ids[right])
            changes = [(gone, NONE), (i, NONE if rank is None else rank << bits | i)]
        else:
            changes = [(i, NONE)]
        if left >= 0:
            rank = ranks.get(ids[left] << 20 | ids[i])
            changes.append((left, NONE if rank is None else rank << bits | left))
        for leaf, value in changes:
            k = size + leaf
            if tree[k] == value:
                continue
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                k >>= 1
                if other < value:
                    value = other
                if tree[k] == value:
                    break
                tree[k] = value
    return [t for t in ids if t >= 0]


class Coder(dict):
    """word -> its ids as little-endian uint32, filled on demand; encode() and decode() of whole texts."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = all(not t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"] or model.get("dropout") or model.get("ignore_merges") or len(model["vocab"]) >= 1 << 20 or not plain:
            raise ValueError(f"{path} holds no plain byte-level BPE")
        vocabulary: dict[str, int] = model["vocab"]
        symbols = byte_symbols()
        self.first = [vocabulary[c] for c in symbols]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocabulary[a] << 20 | vocabulary[b]] = rank
            self.made.append(vocabulary[a + b])
        byte_of = {c: b for b, c in enumerate(symbols)}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocabulary.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"] if t["content"]}
        self.bytes_of |= {i: token.encode() for token, i in self.added.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.older: dict[str, bytes] = {}
        self.settled: set[str] = set(map(chr, range(128)))
        self.stand_in: dict[int, str] = {}

    def _settle(self, fresh: set[str]) -> None:
        """Notes which character stands for each of these while words are cut, where the pattern takes it for another class."""
        for c in fresh:
            ours = next((k for k, pattern in _CLASSES if pattern.match(c)), None)
            theirs = next((k for k, _ in _CLASSES if len(self.pre.pre_tokenize_str(k + c)) == 1), None)
            if ours != theirs:
                self.stand_in[ord(c)] = theirs or " "
        self.settled |= fresh

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return _WORD.findall(text)
        held = set(text)
        if not held <= self.settled:
            self._settle(held - self.settled)
        if self.stand_in and not self.stand_in.keys().isdisjoint(map(ord, held)):
            return [text[m.start() : m.end()] for m in _WORD.finditer(text.translate(self.stand_in))]
        return _WORD.findall(text)

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > WORK_CHARS:
            border = _BORDER.search(text, at + WORK_CHARS)
            if not border:
                break
            yield text[at : border.start()]
            at = border.start()
        yield text[at:] if at else text

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            out = array("I", merged([self.first[b] for b in word.encode()], self.ranks, self.made)).tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out

    def _plain(self, text: str) -> bytes:
        return b"".join([b"".join(map(self.__getitem__, self.words(piece))) for piece in self._pieces(text)])

    def encode(self, text: str) -> bytes:
        """The ids of a text, little-endian uint32."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), self.added[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The text that ids stand for; ids of no token are left out."""
        numbers = iter(memoryview(ids).cast("I"))
        known = self.bytes_of
        parts = iter(lambda: b"".join([known.get(i, b"") for i in islice(numbers, WORK_CHARS)]), b"")
        return b"".join(chain(parts)).decode("utf-8", "replace")


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The coder of this Python worker; it outlives tasks of this module."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
        cached(__name__, _CODERS.clear)
    return _CODERS[path]


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = coder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                ids = [known.encode(text.as_py()) for text in rows.column("text")]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_arrow(plain, run, "doc_id long, n_tokens long, ids binary")


def decode(coded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text they stand for, of every row of encode()'s kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = coder(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                text = pa.array([known.decode(x.as_py()) for x in rows.column("ids")], pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns, text], names=["doc_id", "n_tokens", "ids", "text"])

    plain = coded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n_tokens"), F.coalesce("ids", F.unhex(F.lit(""))).alias("ids"))
    return map_arrow(plain, run, "doc_id long, n_tokens long, ids binary, text string")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13_bpe(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    path = tokenizer_path or default_tokenizer()
    back = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
