"""Readable strings in texts and bytes: runs, filters, confidence, charset sniffs and extraction."""

from __future__ import annotations

import bisect
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

ALPHA_RUN = "[\\p{L}\\p{N} \\t]+"
CAP = 99.999
#: Charsets by the letters that GNU strings takes.
LETTERS = {"s": "ascii", "S": "latin-1", "b": "utf-16-be", "l": "utf-16-le", "B": "utf-32-be", "L": "utf-32-le", "e": "euc-jp", "u": "utf-8"}


def runs(text: Column, least: int) -> Column:
    """Maximal runs of printable characters of at least this length."""
    return F.regexp_extract_all(text, F.lit(f"[\\p{{L}}\\p{{N}}\\p{{P}}\\p{{S}} \\t]{{{least},}}"), F.lit(0))


def squared_runs(text: Column, pattern: str = ALPHA_RUN) -> Column:
    """The sum of squares of the lengths of all runs over 1."""
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.char_length)
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda s, n: s + F.when(n > 1, n.cast("long") * n).otherwise(0))


def alpha_ratio(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[\\p{L}\\p{N}]")) / F.char_length(text)


def confidence(text: Column, language: Column | None = None, covered: Column | None = None, desired: str = ALPHA_RUN) -> Column:
    """From runs of letters and of desired characters, coverage by known words and a language score.

    With a dictionary 2 (2 cov)^2 + 2 runs, else 4 runs, times half the root of the length;
    with a language score the mean of that and 8 scores; within 0 and 99.999.
    """
    n = F.char_length(text).cast("long")  # its square passes 32 bits
    share = (squared_runs(text) + squared_runs(text, desired)) / (n * n)
    base = 4 * share if covered is None else 2 * F.pow(2 * covered, F.lit(2)) + 2 * share
    own = F.greatest(base * 0.5 * F.sqrt(n), F.lit(0.0))
    if language is not None:
        own = F.when(language >= 0, (own + 8 * language) / 2).otherwise(own)
    return F.when(n == 0, 0.0).otherwise(F.least(own, F.lit(CAP)))


def confidence_floor(given: float | None, bare: bool = False, automatic: bool = False) -> float:
    """The least confidence of a string: as given, 10 for a bare switch, 7 where charset and language are found, and never under 0.1."""
    floor = given if given is not None else 10.0 if bare else 7.0 if automatic else 0.0
    return floor if floor > 0 else 0.1


def after_newlines(text: Column) -> Column:
    """Without the ends of line and zeros that a string's end leaves."""
    return F.regexp_replace(text, "^[\\s\\x00]+", "")


#: Letters beyond a to z that the languages' sets desire.
DESIRED = {
    "english": "", "french": "éèêëàâçîïôûùœæ", "german": "äöüß", "spanish": "áéíóúñü", "italian": "àèéìòù", "portuguese": "áâãàçéêíóôõú", "swedish": "åäö", "danish": "æøå", "norwegian": "æøå",
    "finnish": "äö", "dutch": "ëïé", "polish": "ąćęłńóśźż", "czech": "áčďéěíňóřšťúůýž", "hungarian": "áéíóöőúüű", "turkish": "çğıöşü", "romanian": "ăâîșț",
}
#: Ranges of the scripts that other sets desire.
SCRIPTS = {"greek": "0x370-0x3FF,0x1F00-0x1FFF", "cyrillic": "0x400-0x52F", "hebrew": "0x590-0x5FF", "arabic": "0x600-0x6FF,0x750-0x77F", "devanagari": "0x900-0x97F", "thai": "0xE00-0xE7F", "georgian": "0x10A0-0x10FF", "hangul": "0xAC00-0xD7AF,0x1100-0x11FF", "japanese": "0x3040-0x30FF,0x4E00-0x9FFF", "chinese": "0x4E00-0x9FFF", "armenian": "0x530-0x58F"}


def language_class(name: str) -> str:
    """The desired characters of a language or script by name, as a class of a regular expression; name may stand behind an encoding and a colon."""
    from ..sources.files import range_class

    name = name.rsplit(":", 1)[-1].lower()
    if name in DESIRED:
        return f"[a-zA-Z{DESIRED[name]}{DESIRED[name].upper().replace('SS', '')}]"
    if name in SCRIPTS:
        return range_class(SCRIPTS[name])
    raise KeyError(f"no set of characters is named {name}")


def blended(conf: Column, raw: Column, size: Column) -> Column:
    """Confidence mixed with ten times the raw language score, by length."""
    part = F.when(size <= 8, 1 / 4).when(size <= 20, 1 / 3).when(size <= 40, 1 / 2).when(size <= 60, 2 / 3).when(size <= 80, 4 / 5).otherwise(7 / 8)
    return F.least(conf * (1 - part) + 10 * raw * part, F.lit(CAP))


def skip_repeats(text: Column) -> Column:
    """Without runs of twelve or more equal pairs of characters."""
    return F.regexp_replace(text, "(?s)(..)\\1{11,}", "")


def sniff_utf8(data: bytes) -> bool:
    """Whether bytes look like UTF-8: valid multi-byte forms, or letters enough for the length."""
    valid = multi = i = 0
    while i < len(data):
        b = data[i]
        n = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if b < 0xF0 and b >= 0xE0 else 4 if 0xF0 <= b < 0xF5 else 0
        if n > 1 and i + n <= len(data) and all(c & 0xC0 == 0x80 for c in data[i + 1 : i + n]):
            multi += 1
            valid += n
            i += n
            continue
        valid += n == 1 and (chr(b).isalnum() or b in b" \t\n")
        i += 1
    return (valid > 60 or multi > 4) and valid >= len(data) / 24


def sniff_ascii16(data: bytes) -> bool:
    """Whether every second byte is an ASCII letter beside a zero often enough."""
    hits = sum(1 for i in range(0, len(data) - 1, 2) if (data[i] == 0) != (data[i + 1] == 0) and chr(data[i] or data[i + 1]).isalnum())
    return hits > 6 and hits >= len(data) / 64


def rank_charsets(data: bytes) -> list[str]:
    """Candidates in order of trial: UTF-8 if it looks so, wide forms, ASCII, Latin-1."""
    out = ["utf-8"] if sniff_utf8(data) else []
    if sniff_ascii16(data):
        big = sum(1 for b in data[::2] if b == 0) > sum(1 for b in data[1::2] if b == 0)
        out.append("utf-16-be" if big else "utf-16-le")
    return [*out, "ascii", "latin-1"]


#: What a string is made of, in any charset.
_PRINTED = regex.compile(r"[\p{L}\p{M}\p{N}\p{P}\p{S} \t\r\n]+")
_WORDLIKE = regex.compile(r"[\p{L}\p{N}]")
_WIDE = {"utf-16-be": 2, "utf-16-le": 2, "utf-32-be": 4, "utf-32-le": 4}


def _decoded(data: bytes, charset: str, shift: int) -> tuple[str, np.ndarray]:
    """The text of data from the byte shift on, undecodable bytes as unprintable characters, and where each character begins."""
    wide = _WIDE.get(charset, 1)
    body = data[shift:]
    if wide > 1:
        text = body[: len(body) // wide * wide].decode(charset, "replace")
        units = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.where(units > 0xFFFF, 4, 2) if wide == 2 else np.full(len(units), 4)
        text = text.replace("\ufffd", "\0")
    elif charset == "latin-1" or charset == "ascii":
        text = body.decode("latin-1") if charset == "latin-1" else body.decode("latin-1").translate(_NOT_ASCII)
        size = np.ones(len(text), np.int64)
    else:
        text = body.decode(charset, "surrogateescape")
        units = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if charset == "utf-8":
            size = 1 + (units > 0x7F).astype(np.int64) + (units > 0x7FF) + (units > 0xFFFF)
            size[(units >= 0xDC80) & (units <= 0xDCFF)] = 1
        else:
            size = np.array([len(c.encode(charset, "surrogateescape")) for c in text], np.int64)
    return text, shift + np.append(0, np.cumsum(size))


_NOT_ASCII = {c: 0 for c in range(128, 256)}


@functools.cache
def _printed() -> np.ndarray:
    """Whether a string may hold a character, by code point."""
    out = np.zeros(0x110000, bool)
    for m in _PRINTED.finditer("".join(map(chr, range(0x110000)))):
        out[m.start() : m.end()] = True
    return out


class _Runs:
    """The printable runs (start, end, text) of a content in one charset, found once; wide ones at every shift."""

    def __init__(self, data: bytes, charset: str, least: int, gap: int) -> None:
        self.least, self.texts, self.rows = least, [], []
        far = regex.compile(rf"[^\p{{L}}\p{{N}} \t\n]{{{gap + 1},}}")
        for shift in range(_WIDE.get(charset, 1) if len(data) else 0):
            text, at = _decoded(data, charset, shift)
            self.texts.append((text, at))
            units = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            edges = np.flatnonzero(np.diff(_printed()[units], prepend=False, append=False))
            begin, stop = edges[::2], edges[1::2]
            enough = at[stop] - at[begin] >= least  # a cut run is shorter still
            for first, end in zip(begin[enough].tolist(), stop[enough].tolist(), strict=True):
                lo = first
                for hole in (*(far.finditer(text, first, end) if end - first > gap else ()), None):
                    hi = end if hole is None else hole.start() + gap
                    if hi > lo:
                        self.rows.append((int(at[lo]), int(at[hi]), len(self.texts) - 1, lo, hi))
                    lo = hi if hole is None else hole.end()
        self.rows.sort()
        self.starts = [r[0] for r in self.rows]
        self.longest = max((r[1] - r[0] for r in self.rows), default=0)

    def between(self, at: int, stop: int) -> Iterator[tuple[int, int, str]]:
        """Runs of enough bytes with a letter or digit that start from at to stop, and what is left of those that at cuts."""
        k = bisect.bisect_left(self.starts, at - self.longest)
        while k < len(self.rows) and self.rows[k][0] < stop:
            start, end, which, lo, hi = self.rows[k]
            k += 1
            if end <= at:
                continue
            text, places = self.texts[which]
            if start < at:
                lo = lo + int(np.searchsorted(places[lo : hi + 1], at))
                start = int(places[lo])
            if end - start >= self.least and start < stop and _WORDLIKE.search(text, lo, hi):
                yield start, end, text[lo:hi]


def _apart(found: list[tuple[int, int, str, int]]) -> list[tuple[int, int, str, int]]:
    """Of overlapping ones the longest, of equal ones the first charset, then the most ASCII characters; in order of start."""
    starts: list[int] = []
    kept: list[tuple[int, int, str, int]] = []
    for row in sorted(found, key=lambda x: (x[0] - x[1], x[3], -len(x[2].encode("ascii", "ignore")), x[0])):
        k = bisect.bisect_left(starts, row[0])
        if (k == 0 or kept[k - 1][1] <= row[0]) and (k == len(kept) or kept[k][0] >= row[1]):
            starts.insert(k, row[0])
            kept.insert(k, row)
    return kept


def best_strings(data: bytes, charsets: list[str], least: int = 4, gap: int = 1000) -> list[dict]:
    """Strings in order of offset; of overlapping ones the longest, of equal ones the first charset.

    Charsets of several bytes a character are tried at every alignment.
    """
    found = [(o, e, t, k) for k, c in enumerate(charsets) for o, e, t in _Runs(data, c, least, gap).between(0, len(data))]
    return [{"offset": o, "length": e - o, "encoding": charsets[k], "text": t} for o, e, t, k in _apart(found)]


#: Bytes whose charsets are ranked at once, and from which strings start before they are ranked again.
SCAN, STEP = 384, 256


def sniffed_order(block: bytes, before: list[str]) -> list[str]:
    """Charsets to try on a block: what the sniffs say, and of the earlier ones UTF-8, and a wide form where zeros are a quarter."""
    own = rank_charsets(block)
    wide = 4 * block.count(0) >= len(block)
    return [*own[:-2], *(c for c in before[:-2] if c not in own and (c == "utf-8" or wide)), *own[-2:]]


def sniffed_strings(data: bytes, least: int = 4, gap: int = 1000, order: Callable[[bytes, list[str]], list[str]] = sniffed_order) -> list[dict]:
    """Strings in order of offset, with the charsets ranked again for every block of the scan.

    A string may run past its block; the next block starts where it ends. order gives the charsets
    of a block, from its bytes and those of the block before.
    """
    out: list[dict] = []
    at = end = 0
    charsets: list[str] = []
    runs: dict[str, _Runs] = {}
    while at < len(data):
        charsets = order(data[at : at + SCAN], charsets)
        for c in charsets:
            if c not in runs:
                runs[c] = _Runs(data, c, least, gap)
        found = [(o, e, t, k) for k, c in enumerate(charsets) for o, e, t in runs[c].between(at, min(at + STEP, len(data)))]
        for o, e, t, k in _apart(found):
            if o >= end:
                out.append({"offset": o, "length": e - o, "encoding": charsets[k], "text": t})
                end = e
        at = max(at + STEP, end)
    return out


STRING = "struct<offset:long,length:int,encoding:string,text:string>"


def extract(files: DataFrame, content: str = "content", key: str = "path", charsets: list[str] | None = None, least: int = 4) -> DataFrame:
    """key, offset, length, encoding, text of the strings in binary contents; charsets None: sniffed block by block."""
    kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int32()), ("encoding", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(best_strings(b, charsets, least) if charsets else sniffed_strings(b, least)) if b else [] for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=[key, "found"])

    ship_package(files.sparkSession)
    source = files.select(key, F.col(content).alias("content"))
    typed = f"{key} {source.schema[0].dataType.simpleString()}, found array<{STRING}>"
    return source.mapInArrow(run, typed).select(key, F.explode("found").alias("f")).select(key, "f.*")


def sniffed(files: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """key, is_utf8, is_ascii16, charsets: what the sniffs say of whole contents, and the charsets to try in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [b or b"" for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sniff_utf8(b) for b in data]), pa.array([sniff_ascii16(b) for b in data]), pa.array([rank_charsets(b) for b in data], pa.list_(pa.string()))], names=[key, "is_utf8", "is_ascii16", "charsets"])

    ship_package(files.sparkSession)
    source = files.select(key, F.col(content).alias("content"))
    return source.mapInArrow(run, f"{key} {source.schema[0].dataType.simpleString()}, is_utf8 boolean, is_ascii16 boolean, charsets array<string>")


#: Strings of so many bytes and a raw score above the guess threshold may change their charset.
CONFLICT_BYTES, CONFLICT_SCORE = 12, 0.2


def reextracted(strings: DataFrame, reliable: tuple[str, ...] = ("UTF-8",)) -> DataFrame:
    """strings (text, encoding, length, score, charset of the best language) with text and encoding of that charset, and switched.

    A string of an unreliable charset, long and sure enough, is read again from its bytes when
    its best language is written in another one; a null language charset leaves it.
    """
    conflict = (F.col("length") >= CONFLICT_BYTES) & (F.col("score") > CONFLICT_SCORE) & ~F.col("encoding").isin(*reliable) & F.col("charset").isNotNull() & (F.col("charset") != F.col("encoding"))
    again = F.when((F.col("encoding") == "ISO-8859-1") & (F.col("charset") == "UTF-8"), F.decode(F.encode("text", "ISO-8859-1"), "UTF-8"))
    again = again.when((F.col("encoding") == "UTF-8") & (F.col("charset") == "ISO-8859-1"), F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"))
    again = again.when((F.col("encoding") == "UTF-16LE") & (F.col("charset") == "UTF-16BE"), F.decode(F.encode("text", "UTF-16LE"), "UTF-16BE")).when((F.col("encoding") == "UTF-16BE") & (F.col("charset") == "UTF-16LE"), F.decode(F.encode("text", "UTF-16BE"), "UTF-16LE"))
    other = [c for c in strings.columns if c not in ("text", "encoding")]
    switched = F.coalesce(conflict & again.isNotNull(), F.lit(False))
    return strings.select(*other, F.when(switched, again).otherwise(F.col("text")).alias("text"), F.when(switched, F.col("charset")).otherwise(F.col("encoding")).alias("encoding"), switched.alias("switched"))


def byte_range(content: Column, start: int, end: int | None = None) -> Column:
    """Bytes from start to end, clamped to what there is."""
    stop = F.octet_length(content) if end is None else F.least(F.octet_length(content), F.lit(end))
    return F.substring(content, F.lit(start + 1), F.greatest(stop - start, F.lit(0)))


def formatted(path: Column, offset: Column, conf: Column, langs: Column, encoding: Column, text: Column, radix: int = 16) -> Column:
    """An output row: file, offset in the radix and confidence, languages, encoding, text."""
    at = F.conv(offset.cast("string"), 10, radix)
    return F.concat_ws("\t", F.concat(path, F.lit(":")), F.concat(F.lpad(at, 8, " "), F.format_string(" %6.3f", conf)), langs, encoding, text)


def feature_row(path: Column, offset: Column, lang: Column, score: Column, text: Column) -> Column:
    """path.offset, language with a question mark when unsure, text with NUL, comma and backslash escaped."""
    safe = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\x5C")), F.lit(","), F.lit("\\x2C")), F.lit("\0"), F.lit("\\x00"))
    return F.concat_ws("\t", F.concat_ws(".", path, offset.cast("string")), F.concat(lang, F.when(score < 1.2, "?").otherwise("")), safe)
