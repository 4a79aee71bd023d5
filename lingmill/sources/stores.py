"""Stores and encoded files: model and frame stores in Parquet, compressed and paged input, encodings, list syntax."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from ..stages import _hadoop, exists
from .files import binary, text_lines, tidy_lines, word_list

#: Bytes that open a file, and what they say of it.
MARKS = (("EFBBBF", "utf-8"), ("0000FEFF", "utf-32-be"), ("FFFE0000", "utf-32-le"), ("FEFF", "utf-16-be"), ("FFFE", "utf-16-le"))
BOM = {"utf-8": "EFBBBF", "utf-16-be": "FEFF", "utf-16-le": "FFFE"}
#: The version of a model store, and the oldest that is read.
STORE_VERSION, OLDEST_VERSION = 5, 4


# models


def save_models(model: DataFrame, path: str) -> None:
    """Models (lang, n, gram, cnt, weight) as a store; the version stands in every row group's partition."""
    model.withColumn("version", F.lit(STORE_VERSION)).write.partitionBy("version").parquet(path)


def find_store(spark: SparkSession, *paths: str) -> str:
    """The first of the paths that there is: as given, in the home folder, here."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"no store at {', '.join(paths)}")


def load_models(spark: SparkSession, *paths: str) -> DataFrame:
    """The models of the first store found; a store of a version not known is refused."""
    rows = spark.read.parquet(find_store(spark, *paths))
    odd = rows.filter(~F.col("version").between(OLDEST_VERSION, STORE_VERSION)).limit(1).count()
    if odd:
        raise ValueError("the store is of another version")
    return rows.drop("version")


def save_counts(counted: DataFrame, path: str) -> None:
    """Counts (lang, gram, cnt), a folder for each language; zeros are not kept."""
    counted.filter("cnt <> 0").write.partitionBy("lang").parquet(path)


def load_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("lang", "gram", "cnt")


# lists


def word_lists(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """lang, freq, word of one weighted word list for each language."""
    out = None
    for lang, path in paths.items():
        one = word_list(spark, path).select(F.lit(lang).alias("lang"), "freq", "word")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no word lists are given")
    return out


def abbreviations(spark: SparkSession, *paths: str) -> DataFrame:
    """The abbreviations of lists with one on a line, each once, without their points."""
    return tidy_lines(spark, *paths).select(F.regexp_replace("line", "\\.+$", "").alias("word")).filter("word <> ''").distinct()


def desired_characters(spark: SparkSession, path: str) -> str:
    """The range list of a file: its first line, empty where it has none."""
    row = text_lines(spark, path, delimiter="\n").select("line").first()
    return row.line.strip() if row else ""


def cognate_classes(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Letters that cognates exchange, a class on a line, blanks between them allowed; a short file by definition."""
    rows = tidy_lines(spark, path).filter(~F.col("line").rlike("^[;#]")).select(F.regexp_replace("line", "\\s+", "").alias("letters"))
    found = rows.filter(F.char_length("letters") > 1).limit(10_001).collect()
    if len(found) > 10_000:
        raise ValueError(f"{path} is no list of letters")
    return tuple(sorted(r.letters for r in found))


# bytes


def paged(files: DataFrame, page: int, margin: int, content: str = "content", key: str = "path") -> DataFrame:
    """key, page_start, bytes: pages of a content with the margin behind each, which strings may run into."""
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(content) - 1, F.lit(0)), F.lit(page))
    cut = F.transform(starts, lambda s: F.struct(s.alias("page_start"), F.substring(F.col(content), s + 1, F.lit(page + margin)).alias("bytes")))
    return files.filter(F.octet_length(content) > 0).select(key, F.explode(cut).alias("p")).select(key, "p.*")


def file_type(content: Column) -> Column:
    """empty, a byte order mark's encoding, ascii, utf-8, utf-16 without a mark, or binary."""
    head, size = F.hex(F.substring(content, 1, 4)), F.octet_length(content)
    out = F.when(size == 0, "empty")
    for mark, name in MARKS:
        out = out.when(head.startswith(mark), name)
    digits = F.hex(content)
    # Units of two bytes from the start on: those that are ASCII stay, all others go.
    zero_first, zero_last = (F.length(F.regexp_replace(digits, f"({ascii})|.{{4}}", "$1")) / 4 for ascii in ("00[0-7].", "[0-7].00"))
    wide = size >= 4
    plain = ~digits.rlike("^(?:..)*0[0-8BEF]") & ~digits.rlike("^(?:..)*1[0-9A-F]")
    return (
        out.when(F.is_valid_utf8(content.cast("string")) & ~digits.rlike("^(?:..)*(?:00|[89A-F])") & plain, "ascii")
        .when(F.is_valid_utf8(content.cast("string")) & ~digits.rlike("^(?:..)*00"), "utf-8")
        .when(wide & (size % 2 == 0) & (zero_first * 4 >= size) & (zero_first > zero_last), "utf-16-be")
        .when(wide & (size % 2 == 0) & (zero_last * 4 >= size), "utf-16-le")
        .otherwise("binary")
    )


def encoded(lines: Column, encoding: str = "utf-8", mark: bool = False, crlf: bool = False) -> Column:
    """The bytes of a file of these lines: in the encoding, with a byte order mark and with \\r\\n where asked for."""
    end = "\r\n" if crlf else "\n"
    text = F.concat(F.array_join(lines, end), F.when(F.size(lines) > 0, end).otherwise(""))
    body = F.encode(text, {"utf-8": "UTF-8", "utf-16-be": "UTF-16BE", "utf-16-le": "UTF-16LE"}[encoding])
    return F.concat(F.unhex(F.lit(BOM[encoding])), body) if mark else body


def decoded(content: Column, kind: Column) -> Column:
    """The text of a content whose file_type() is kind, without its byte order mark; null of binary ones."""
    marked = F.hex(F.substring(content, 1, 4))
    body = lambda n: F.substring(content, n + 1, 2147483647)
    read = lambda name, mark, charset: F.when((kind == name) & marked.startswith(mark), F.decode(body(len(mark) // 2), charset)).when(kind == name, F.decode(content, charset))
    wide_be, wide_le = read("utf-16-be", "FEFF", "UTF-16BE"), read("utf-16-le", "FFFE", "UTF-16LE")
    utf8 = F.when(kind.isin("utf-8", "ascii"), F.when(marked.startswith("EFBBBF"), body(3).cast("string")).otherwise(content.cast("string")))
    return F.coalesce(wide_be, wide_le, utf8, F.when(kind == "empty", ""))


def compressed_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """path, line of text files, packed as .gz or .bz2 (read by Spark) or as .xz (unpacked whole, a file a row), or plain."""
    xz = [p for p in paths if p.endswith(".xz")]
    rest = [p for p in paths if not p.endswith(".xz")]
    out = text_lines(spark, *rest, delimiter="\n") if rest else None
    if xz:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import lzma

            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    lines = lzma.decompress(content).decode("utf-8", "replace").split("\n")
                    lines = lines[:-1] if lines[-1] == "" else lines
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array(lines, pa.string())], names=["path", "line"])

        ship_package(spark)
        more = binary(spark, *xz).select("path", "content").mapInArrow(run, "path string, line string")
        out = more if out is None else out.unionByName(more)
    return out


# frames


class Conflict(RuntimeError):
    """Another writer committed first."""


class FrameStore:
    """Frames (frame, slot, facet, pos, filler) in generations: every commit writes one, older ones stay readable.

    A generation is a folder of its own, so a commit that fails leaves the last one as it was.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def generations(self) -> list[int]:
        """Numbers of the generations that are whole, in order."""
        folder, files = _hadoop(self.spark, self.path)
        if not files.exists(folder):
            return []
        named = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n[2:]) for n in named if re.fullmatch("g=[0-9]+", n) and exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def read(self, generation: int = -1) -> DataFrame:
        """All frames of the generation of this number, or counted from the last one on if negative."""
        return self.spark.read.parquet(f"{self.path}/g={generation if generation >= 0 else self.generations()[generation]}")

    def frame(self, name: str, generation: int = -1) -> DataFrame:
        return self.read(generation).filter(F.col("frame") == name)

    def names(self, generation: int = -1) -> DataFrame:
        return self.read(generation).select("frame").distinct()

    def commit(self, frames: DataFrame, base: int | None = None) -> int:
        """Writes frames as the next generation and returns its number.

        They are written to a folder of their own first and renamed to the generation in one step. Of two
        writers the first to rename has it; the other takes the next number. With base, the generation that
        frames were made from, a commit is refused (Conflict) when a generation after it exists by then.
        """
        target, files = _hadoop(self.spark, f"{self.path}/new-{uuid.uuid4().hex}")
        frames.select("frame", "slot", "facet", "pos", "filler").write.parquet(target.toString())
        n = max(self.generations(), default=-1) + 1 if base is None else base + 1
        stale = base is not None and self.generations()[-1:] != [base]
        while stale or not self._claimed(files, target, n):
            if base is not None:
                files.delete(target, True)
                raise Conflict(f"generation {base} is not the last one, or another writer claimed the next")
            n += 1
        return n

    def _claimed(self, files, target, n: int) -> bool:
        """Whether the written folder became generation n.

        A claim, a file that is made only where there is none, goes before the rename, as a folder
        can be renamed into one that exists. Making it is one step on HDFS; local files are looked up first.
        """
        claim, _ = _hadoop(self.spark, f"{self.path}/g={n}.claimed")
        try:
            files.create(claim, False).close()
        except Py4JJavaError:
            # For any other reason than that the file is there, the error stands.
            if not files.exists(claim):
                raise
            return False
        place, _ = _hadoop(self.spark, f"{self.path}/g={n}")
        if not files.rename(target, place):
            files.delete(claim, False)
            raise OSError(f"{target.toString()} could not be renamed")
        return True

    def release(self, n: int) -> bool:
        """Takes back the claim of a writer that died before its generation was there; whether there was one."""
        claim, files = _hadoop(self.spark, f"{self.path}/g={n}.claimed")
        return n not in self.generations() and files.exists(claim) and bool(files.delete(claim, False))

    def update(self, change: Callable[[DataFrame], DataFrame], tries: int = 8) -> int:
        """Commits change(last generation); where another writer came first, makes the change again from its generation."""
        for left in reversed(range(tries)):
            base = self.generations()[-1]
            try:
                return self.commit(change(self.read(base)), base)
            except Conflict:
                if not left:
                    raise
        raise ValueError("an update takes one try at least")

    def create(self, frames: DataFrame) -> int:
        """Adds frames; one that is there already keeps what it has."""
        return self.update(lambda old: old.unionByName(frames.join(old.select("frame").distinct(), "frame", "left_anti").select(*old.columns)))

    def delete(self, *names: str) -> int:
        return self.update(lambda rows: rows.filter(~F.col("frame").isin(*names)))

    def rename(self, old: str, new: str) -> int:
        """The frame under its new name, in fillers too."""
        named = lambda c: F.when(F.col(c) == old, new).otherwise(F.col(c)).alias(c)
        return self.update(lambda rows: rows.select(named("frame"), "slot", "facet", "pos", named("filler")))

    def copy(self, old: str, new: str) -> int:
        return self.update(lambda rows: rows.filter(F.col("frame") != new).unionByName(rows.filter(F.col("frame") == old).withColumn("frame", F.lit(new))))

    def revert(self, generation: int) -> int:
        """The frames of an older generation as a new one."""
        return self.commit(self.read(generation))


# list syntax

_FORM = re.compile(r"""\s*(?:(?P<open>[(\[])|(?P<close>[)\]])|"(?P<text>(?:[^"\\]|\\.)*)"|(?P<atom>[^\s()\[\]"]+))""")


def read_form(text: str) -> list | str | int | float | None:
    """The first object of a text in list syntax: lists, "strings", numbers and symbols; None where there is none."""
    stack: list[list] = [[]]
    for m in _FORM.finditer(text):
        if m["open"]:
            stack.append([])
        elif m["close"]:
            if len(stack) > 1:
                done = stack.pop()
                stack[-1].append(done)
        elif m["text"] is not None:
            stack[-1].append({"text": re.sub(r"\\(.)", r"\1", m["text"])})
        else:
            atom = m["atom"]
            stack[-1].append(int(atom) if re.fullmatch(r"[+-]?[0-9]+", atom) else float(atom) if re.fullmatch(r"[+-]?[0-9]*\.[0-9]+(?:[eE][+-]?[0-9]+)?", atom) else atom)
        if len(stack) == 1 and stack[0]:
            return stack[0][0]
    return None


def print_form(value) -> str:
    """The text of an object of read_form()."""
    if isinstance(value, list):
        return f"({' '.join(map(print_form, value))})"
    if isinstance(value, dict):
        return '"' + value["text"].replace("\\", "\\\\").replace('"', '\\"') + '"'
    return str(value)


def forms_to_json(rows: DataFrame, text: str, key: str) -> DataFrame:
    """key, form: the first object of each text, as JSON; null where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [None if t is None else read_form(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if g is None else json.dumps(g, ensure_ascii=False) for g in got], pa.string())], names=[key, "form"])

    ship_package(rows.sparkSession)
    return rows.select(key, text).mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, form string")


def frame_lines(frames: DataFrame) -> DataFrame:
    """frame, value: each frame on a line of list syntax, [name [slot [facet filler ...]] ...]."""
    quoted = F.when(F.col("filler").rlike("^[A-Za-z_][A-Za-z0-9_-]*$"), F.col("filler")).otherwise(F.concat(F.lit('"'), F.replace(F.replace("filler", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    in_order = lambda what: F.transform(F.sort_array(F.collect_list(what)), lambda x: x["v"])
    facets = frames.groupBy("frame", "slot", "facet").agg(F.concat(F.lit("["), F.concat_ws(" ", F.array(F.col("facet")), in_order(F.struct("pos", quoted.alias("v")))), F.lit("]")).alias("v"))
    slots = facets.groupBy("frame", "slot").agg(F.concat(F.lit("["), F.concat_ws(" ", F.array(F.col("slot")), in_order(F.struct("facet", "v"))), F.lit("]")).alias("v"))
    return slots.groupBy("frame").agg(F.concat(F.lit("["), F.concat_ws(" ", F.array(F.col("frame")), in_order(F.struct("slot", "v"))), F.lit("]")).alias("value"))


def frames_of_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Frames (frame, slot, facet, pos, filler) of lines in list syntax."""
    names = ["frame", "slot", "facet", "pos", "filler"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                form = read_form(text or "")
                if not isinstance(form, list) or not form:
                    continue
                for slot, *facets in (s for s in form[1:] if isinstance(s, list) and s):
                    for facet, *fillers in (f for f in facets if isinstance(f, list) and f):
                        rows += [(str(form[0]), str(slot), str(facet), k, x["text"] if isinstance(x, dict) else print_form(x)) for k, x in enumerate(fillers)]
            kinds = [pa.string()] * 3 + [pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    ship_package(lines.sparkSession)
    return lines.select(value).mapInArrow(run, "frame string, slot string, facet string, pos int, filler string")
