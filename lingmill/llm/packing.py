"""Packing by concatenating and cutting: one token stream, cut every 4096 tokens.

Pass one tokenises every document (null: empty) once and writes ids with the running count
inside its section: its partition, or a part of a file where the documents' order in their
files is to be the stream's. The sections' totals, one row each, are prefix-summed to the
global offset of every section. Pass two cuts the stream at multiples of the window: a document
that crosses a border leaves one record on either side. Only the last sequence is padded.

Defined cases: an empty text is its end token alone; rows keep the order of the input's
sections (so there are no ties), repeated rows are packed again, long texts are whole; an empty table gives no pieces; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cached, map_arrow, stage, table, text_or_empty

WINDOW_TOKENS = 4096
END_ID = 2
#: Distinct words, and runs of letters, whose ids a worker keeps; beyond, it starts anew.
CACHE_WORDS, CACHE_RUNS = 600_000, 300_000
#: Totals (about 200 bytes each, one per section) up to this many rows are broadcast.
BROADCAST_SECTIONS = 200_000


class WordIds(dict):
    """UTF-8 word -> its ids as little-endian uint32, filled on demand.

    Words hold no ASCII white space, which the tokenizer drops and never merges across, so
    the ids of a text are those of its words in order. Runs of Latin letters, and runs with a
    tail of ASCII punctuation, go straight to the model's merges through a second cache;
    every other word is encoded by the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.runs: dict[str, bytes] = {}
        self.plain = _plain_lowercase(self.tokenizer)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.symbols = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _run(self, run: str) -> bytes:
        ids = self.runs.get(run)
        if ids is None:
            symbols = run if run.isascii() else run.encode().decode("latin-1").translate(self.symbols)
            ids = np.array([t.id for t in self.model.tokenize(symbols)], "<u4").tobytes()
            if len(self.runs) >= CACHE_RUNS:
                self.runs.clear()
            self.runs[run] = ids
        return ids

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        ids = None
        if self.plain and (text.isascii() or max(text) < "Ā"):
            low = text.lower()
            if low.isalpha():
                ids = self._run(low)
            else:
                head = low.rstrip("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
                if head.isalpha() and "ª" not in head and "º" not in head and not (low[len(head) :].startswith("<|")):
                    ids = self._run(head) + self._run(low[len(head) :])
        if ids is None:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids
        return ids


def _plain_lowercase(tokenizer) -> bool:
    """Whether the short path gives what the tokenizer gives, tried on a few words."""
    for word in ("Thé,", "naïve***", "ONE!!", "x.", "straße;"):
        whole = tokenizer.encode(word, add_special_tokens=False).tokens
        again = tokenizer.encode(word.lower(), add_special_tokens=False).tokens
        if whole != again or not whole or not any(t.endswith("</w>") for t in whole):
            return False
    return True


_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The cache of this Python worker; it outlives tasks of this module."""
    if path not in _IDS:
        _IDS[path] = WordIds(path)
        cached(__name__, _IDS.clear)
    return _IDS[path]


def encode(ids: WordIds, text: bytes) -> bytes:
    return b"".join(map(ids.__getitem__, text.split()))


#: The column in which in_file_order() names the part of a file that a row was read from.
SECTION = "__section"


def in_file_order(docs: DataFrame) -> DataFrame:
    """docs, read from files, with SECTION: the part of a file that a row was read from; for pack() with that section.

    Sections sort as the files' names do (longer names last, so that numbers in them count up)
    and, in a file, as its parts; rows of a part come in order. Readers deal parts to tasks by
    size, so partitions alone don't keep the order that the files were written in.
    """
    file = docs.metadataColumn("_metadata")
    section = F.format_string("%08d %s %020d", F.length(file["file_path"]), file["file_path"], file["file_block_start"])
    return docs.select(F.col("doc_id"), F.col("text"), section.alias(SECTION))


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, section: str | None = None) -> DataFrame:
    """section, before, doc_id, doc_tokens, ids (little-endian uint32, with the end token).

    A section is a partition, or a value of the column of that name, whose rows come one after another.
    """
    end = np.array([end_id], "<u4").tobytes()
    named = F.col(section) if section else F.format_string("%012d", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, last, before = word_ids(tokenizer_path), None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                coded = [encode(ids, text.as_buffer().to_pybytes() if text.is_valid else b"") + end for text in rows.column("text").cast(pa.large_binary())]
                count = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
                names = rows.column("section").to_pylist()
                start = np.cumsum(count) - count
                fresh = [k for k, name in enumerate(names) if name != (names[k - 1] if k else last)]
                for lo, hi in zip([0, *fresh], [*fresh, len(names)], strict=True):
                    if hi > lo:
                        start[lo:hi] += (before if names[lo] == last else 0) - start[lo]
                        last, before = names[lo], int(start[hi - 1] + count[hi - 1])
                yield pa.RecordBatch.from_arrays([rows.column("section"), pa.array(start), rows.column("doc_id"), pa.array(count), pa.array(coded, pa.binary())], names=["section", "before", "doc_id", "doc_tokens", "ids"])

    plain = docs.select(named.alias("section"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return map_arrow(plain, run, "section string, before long, doc_id long, doc_tokens long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW_TOKENS, end_id: int = END_ID, section: str | None = None) -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, ids (their own)."""
    tokens = stage(tokenise(docs, tokenizer_path, end_id, section), "tokens")
    totals = tokens.groupBy("section").agg(F.sum("doc_tokens").alias("total"))
    base = totals.select("section", (F.sum("total").over(Window.orderBy("section")) - F.col("total")).alias("base"))
    if totals.count() <= BROADCAST_SECTIONS:
        base = F.broadcast(base)
    placed = tokens.join(base, "section").withColumn("first", F.col("base") + F.col("before")).withColumn("last", F.col("first") + F.col("doc_tokens") - 1)
    cut = placed.withColumn("sequence_id", F.explode(F.expr(f"sequence(first div {window}, last div {window})")))
    lo = F.greatest("first", F.col("sequence_id") * window)
    hi = F.least(F.col("last") + 1, (F.col("sequence_id") + 1) * window)
    return (
        cut.withColumn("start", lo - F.col("first"))
        .withColumn("length", hi - lo)
        .withColumn("offset", lo - F.col("sequence_id") * window)
        .select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))").alias("ids"))
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences: sequence_id, n_tokens, the boundary records and the ids in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("p")).select(
        "sequence_id", "n_tokens", F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"), x["offset"].alias("offset"))).alias("boundaries"), F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids")
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path or default_tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
