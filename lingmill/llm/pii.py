"""Personal data: patterns for four kinds, and terms that give a protected entity away.

The patterns' spans are the base. The method adds terms by information content. One event space
holds all counts: the units of the corpus, its sentences (a sentence ends at a line's end or at
. ! ? before white space, and after 64 words at the latest). Protected entities are every value
itself, what it shares with others of its holder (user and host of an address, network of an ip,
a phone's area, a card's issuer) and its kind. With N units, n(e) of them with the entity, n(t)
with the term and n(e, t) with both, the term discloses the entity where its smoothed pointwise
mutual information log2(N n(e, t) / (n(e) (n(t) + 1))) comes near the entity's own information
content log2(N / n(e)), that is where meeting the term all but tells that the entity is there.
Terms at 0.9 of it are generalised, at 0.98 removed, wherever they stand in the corpus.

Copies are no evidence, nor do they hide any: equal units with a value count once in all four
numbers (other units count as often as they stand), and a pair needs three sources. Sources of kinds and shared parts are distinct
values. Those of one value are the origins of its units: the least hash of their other words,
which near copies share unless that very word was edited. Sources times information must pass
log2(pairs / 0.01), one percent over all pairs that are tried.

A term can also name its owner by itself: a run of 20 letters, digits and low lines or more, with
four letters and four digits at least, that carries 80 bits by the entropy of its own characters,
is a secret (a key, a token); it is removed, and is a protected value as the others are.

Links reach Spark as hashes of terms and entities, never as texts, and are added up before they
are dealt. The terms that are tried are screened by a bit map of fixed size while the corpus is
counted. Disclosing terms go to the workers up to a bound; beyond it, they are joined.

Defined cases: a null text is empty and has no spans; repeated rows count as copies do; spans that begin together go by kind, terms by place; overlapping spans of different
kinds all stay; an empty table gives no rows; other columns are ignored; long texts are whole, and
every pattern runs in linear time.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesets import SPACE, Words, code_points, slices, utf8
from .common import keep, map_arrow, scope, sized, stage, table, text_or_empty

#: The base kinds, in the order of spans that begin together, and those the method adds.
KINDS = ("email", "ip", "card", "phone", "term", "secret")
BASE_KINDS, TERM, SECRET = 4, 4, 5
UNIT_WORDS = 64
MIN_SOURCES = 3
#: The chance, over all pairs that are tried, of taking one that is none.
CHANCE = 0.01
GENERALISE, REMOVE = 0.9, 0.98
SECRET_BITS = 80
#: Bits of the screen, 2 MB at any size of input.
SCREEN_BITS = 24
#: Counts that a task holds before it adds them up.
HELD_COUNTS = 1_000_000
#: Rows for terms (16 bytes each) up to this many are broadcast; beyond, they are joined by shuffle.
BROADCAST_TERMS = 1_000_000
#: Texts with terms (a few hundred bytes each) up to this many are broadcast.
BROADCAST_MARKS = 100_000

#: Bytes between terms: all of ASCII but letters and digits.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
ENDS = np.zeros(256, bool)
ENDS[[33, 46, 63]] = True
HINT = np.zeros(256, bool)
HINT[[64, *range(48, 58)]] = True

_LEFT = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"[A-Za-z0-9_]{20,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each ends its left part at an @, as no such part holds one."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LEFT:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start and kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def secrets(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans like base_spans() of the terms that name their owner by themselves; none overlaps base."""
    out = []
    for m in _SECRET.finditer(text):
        count, n = Counter(m[0]), len(m[0])
        digits, letters = sum(k for c, k in count.items() if c.isdigit()), sum(k for c, k in count.items() if c.isalpha())
        if digits >= 4 and letters >= 4 and sum(k * log2(n / k) for k in count.values()) >= SECRET_BITS and all(b <= m.start() or a >= m.end() for a, _, b in base):
            out.append((m.start(), SECRET, m.end()))
    return out


def _own(text: str) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted(base + secrets(text, base))


def _name(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) >> 1


def _value(kind: int, text: str) -> int:
    """A name for a protected value, whatever its spelling."""
    plain = text.lower() if kind == 0 else "".join(c for c in text if c.isdigit() or c == "." and kind == 1) if kind < BASE_KINDS else text
    return _name(f"{kind}:{plain}".encode())


def entities(kind: int, text: str) -> list[tuple[int, bool]]:
    """(name, whether it is the value itself) of what a protected value stands for."""
    digits = "".join(c for c in text if c.isdigit())
    shared = [f"kind:{kind}"]
    if kind == 0:
        user, _, host = text.lower().partition("@")
        shared += [f"user:{user}", f"host:{host}"]
    elif kind == 1:
        shared.append(f"net:{text.rpartition('.')[0]}")
    elif kind == 2:
        shared.append(f"issuer:{digits[:6]}")
    elif kind == 3:
        shared.append(f"area:{digits[:-4]}")
    return [*((_name(x.encode()), False) for x in shared), (_value(kind, text), True)]


SPAN = "struct<start:int,kind:int,end:int>"
LINKS = ["entity", "own", "term", "source", "unit", "fresh"]
#: The term under which links count an entity's units whatever their terms, and the entity that is in every unit with a value.
ANY, EVERY = -1, -2


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and its name, of every row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return plain.withColumn("name", F.unhex(F.md5(F.col("text").cast("binary"))))


class _Slice:
    """Some rows of a batch: their bytes, and their terms with hashes where asked for."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        self.data, self.at, self._words = data, at, None

    def terms(self) -> tuple[Words, np.ndarray]:
        if self._words is None:
            words = Words(self.data, self.at, BETWEEN)
            self._words = words, (words.hashes(lower=True) >> np.uint64(1)).astype(np.int64)
        return self._words

    def units(self) -> np.ndarray:
        """The unit of every word, counted through the slice."""
        words, _ = self.terms()
        after = np.ones(len(self.data), bool)
        after[:-1] = SPACE[self.data[1:]]
        ends = np.zeros(len(self.data) + 1, np.int32)
        np.cumsum((self.data == 10) | ENDS[self.data] & after, out=ends[1:], dtype=np.int32)
        fresh = np.ones(len(words.start), bool)
        fresh[1:] = np.diff(ends[words.start]) > 0
        fresh[words.row[:-1][words.row[:-1] < len(fresh)]] = True
        first = np.flatnonzero(fresh)
        place = np.arange(len(fresh)) - np.repeat(first, np.diff(np.append(first, len(fresh))))
        return np.cumsum(place % UNIT_WORDS == 0) - 1

    def hinted(self) -> np.ndarray:
        """The rows with any byte that a pattern needs."""
        hits = np.zeros(len(self.data) + 1, np.int32)
        np.cumsum(HINT[self.data], out=hits[1:], dtype=np.int32)
        return np.flatnonzero(hits[self.at[1:]] > hits[self.at[:-1]])

    def text(self, r: int) -> str:
        return self.data[self.at[r] : self.at[r + 1]].tobytes().decode()

    def free(self, r: int, which: np.ndarray, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends, in code points of row r, of the row's words at these places, and which overlap no span."""
        words, _ = self.terms()
        points = code_points(self.data[self.at[r] : self.at[r + 1]])
        starts, ends = points[words.start[which] - self.at[r]], points[words.end[which] - self.at[r]]
        out = np.ones(len(which), bool)
        for a, _, b in spans:
            out[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b, side="left")] = False
        return starts, ends, out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, _Slice]]:
    for batch in batches:
        data, off = utf8(batch.column("text"))
        for i, j in slices(off):
            yield batch.slice(i, j - i), _Slice(data[off[i] : off[j]], off[i : j + 1] - off[i])


def links(docs: DataFrame) -> DataFrame:
    """entity, own, term, source, unit, fresh: the terms in the units of every protected entity, of every row.

    Terms that overlap a value are none. A unit is named by its words. It counts once for an
    entity (fresh is 0 for its other values there), under the term ANY also where it has no terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _slices(batches):
            flat: list[list] = [[] for _ in LINKS]
            unit = None
            for r in part.hinted().tolist():
                text = part.text(r)
                spans = _own(text)
                if not spans:
                    continue
                words, hashed = part.terms()
                unit = part.units() if unit is None else unit
                lo, hi = int(words.row[r]), int(words.row[r + 1])
                _, ends, free = part.free(r, np.arange(lo, hi), spans)
                own_units, met = unit[lo:hi], set()
                for a, kind, b in spans:
                    u = own_units[min(int(np.searchsorted(ends, a, side="right")), hi - lo - 1)]
                    i, j = int(np.searchsorted(own_units, u)), int(np.searchsorted(own_units, u, side="right"))
                    terms = np.unique(hashed[lo + i : lo + j][free[i:j]]).tolist()
                    least = terms[:2] + [0, 0]
                    value = _value(kind, text[a:b])
                    unit_name = _name(hashed[lo + i : lo + j].tobytes())
                    for name, own in [(EVERY, False), *entities(kind, text[a:b])]:
                        fresh = int((u, name) not in met)
                        met.add((u, name))
                        n = len(terms) + 1
                        flat[0] += [name] * n
                        flat[1] += [own] * n
                        flat[2] += [ANY, *terms]
                        flat[3] += [least[0], *(least[1] if t == least[0] else least[0] for t in terms)] if own else [value] * n
                        flat[4] += [unit_name] * n
                        flat[5] += [fresh] * n
            if flat[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.bool_() if k == 1 else pa.int64()) for k, x in enumerate(flat)], names=LINKS)

    return map_arrow(docs.select(text_or_empty().alias("text")), run, "entity long, own boolean, term long, source long, unit long, fresh long")


def screen(terms: DataFrame) -> np.ndarray:
    """A bit for each place that the hash of any of the terms has modulo 2^24; what reaches the driver is of fixed size."""
    slot = F.pmod(F.col("term"), F.lit(1 << SCREEN_BITS)) + 1
    maps = terms.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(1 << (SCREEN_BITS - 3), np.uint8)
    for r in maps:  # 512 rows of 4 KB at most
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _passing(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    slot = hashed & ((1 << SCREEN_BITS) - 1)
    return np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)


def unit_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, holders: in how many units of docs each of the terms stands, and under ANY all units; some others slip through the screen."""
    bits = screen(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for _, part in _slices(batches):
            _, hashed = part.terms()
            if not len(hashed):
                continue
            if sum(len(t) for t, _ in held) > HELD_COUNTS:
                held = [_added(held)]
                if len(held[0][0]) > HELD_COUNTS // 2:
                    yield from _counts(*held.pop())
            unit = part.units()
            at = _passing(bits, hashed)
            name, doc = hashed[at], unit[at]
            order = np.lexsort((doc, name))
            name, doc = name[order], doc[order]
            fresh = np.ones(len(name), bool)
            fresh[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
            term, count = np.unique(name[fresh], return_counts=True)
            held.append((np.append(term, ANY), np.append(count, unit[-1] + 1)))
        if held:
            yield from _counts(*_added(held))

    met = map_arrow(docs.select(text_or_empty().alias("text")), run, "term long, holders long")
    return met.groupBy("term").agg(F.sum("holders").alias("holders"))


def _added(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the same terms as one."""
    term, count = (np.concatenate(x) for x in zip(*counts, strict=True))
    term, place = np.unique(term, return_inverse=True)
    return term, np.bincount(place, count, len(term)).astype(np.int64)


def _counts(term: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(term), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(term[at : at + 50_000]), pa.array(count[at : at + 50_000])], names=["term", "holders"])


def disclosing(docs: DataFrame) -> DataFrame | None:
    """entity, term, both, holders, holding, ratio = PMI / IC of the terms that give an entity away; None if there is none."""
    each = links(docs).groupBy(*LINKS[:-1]).agg(F.max("fresh").alias("once"), F.sum("fresh").alias("rows"))
    met = stage(each.groupBy("entity", "own", "term", "source").agg(F.sum("once").alias("units"), F.sum(F.col("rows") - F.col("once")).alias("copies")), "links")
    pairs = met.filter(f"entity <> {EVERY} AND term <> {ANY}").groupBy("entity", "own", "term").agg(F.sum("units").alias("both"), F.count(F.lit(1)).alias("sources"))
    together = stage(pairs.filter(F.col("sources") >= MIN_SOURCES), "together")
    tried = together.count()
    if not tried:
        return None
    terms = stage(together.select("term").distinct(), "terms")
    copies = met.filter(f"entity = {EVERY}").groupBy("term").agg(F.sum("copies").alias("copies"))
    counted = unit_counts(docs, terms).join(copies, "term", "left").select("term", (F.col("holders") - F.coalesce("copies", F.lit(0))).alias("holders"))
    holders = stage(counted, "holders")
    n = float(holders.filter(F.col("term") == ANY).first()["holders"])
    holding = met.filter(F.col("term") == ANY).groupBy("entity").agg(F.sum("units").alias("holding"))
    pmi = F.log2(F.lit(n) * F.col("both") / (F.col("holding") * (F.col("holders") + 1)))
    ic = F.log2(F.lit(n) / F.col("holding"))
    every = together.join(holders, "term").join(holding, "entity").filter(F.col("holding") < n).withColumn("pmi", pmi)
    told = every.filter((F.col("pmi") >= GENERALISE * ic) & (F.col("sources") * F.col("pmi") >= log2(tried / CHANCE)))
    return told.select("entity", "term", "both", "holders", "holding", (F.col("pmi") / ic).alias("ratio"))


def places(docs: DataFrame, told: DataFrame) -> DataFrame:
    """name, marks (start, end, gone): where the terms stand outside of other spans, of each text that has any."""
    bits = screen(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in _slices(batches):
            words, hashed = part.terms()
            at = _passing(bits, hashed)
            first = np.searchsorted(at, words.row)
            rows, starts, ends = [], [], []
            for r in np.flatnonzero(np.diff(first)).tolist():
                mine = at[first[r] : first[r + 1]]
                own = part.data[part.at[r] : part.at[r + 1]]
                a, b, free = part.free(r, mine, _own(part.text(r)) if HINT[own].any() else [])
                rows.append(np.where(free, r, -1))
                starts.append(a)
                ends.append(b)
            if rows:
                row = np.concatenate(rows)
                some = row >= 0
                flat = [batch.column("name").take(pa.array(row[some])), *(pa.array(np.concatenate(x)[some].astype(np.int32)) for x in (starts, ends)), pa.array(hashed[np.concatenate([at[first[r] : first[r + 1]] for r in np.flatnonzero(np.diff(first))])][some])]
                yield pa.RecordBatch.from_arrays(flat, names=["name", "start", "end", "term"])

    met = map_arrow(_texts(docs).select("text", "name"), run, "name binary, start int, end int, term long").join(sized(told, BROADCAST_TERMS), "term")
    one = met.select("name", "start", "end", (F.col("ratio") >= REMOVE).alias("gone")).distinct()
    return one.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("start", "end", "gone"))).alias("marks"))


def sanitise(text: str, spans: list[tuple[int, int, int]], gone: set[int]) -> str:
    """The text with values and generalised terms replaced by their kind; secrets and terms that start in gone are left out."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], "" if kind == SECRET or kind == TERM and a in gone else f"[{KINDS[kind].upper()}]"]
        elif b <= at:
            continue
        at = b
    return "".join([*out, text[at:]])


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base, all (with terms and secrets), remove (starts of the terms that go) and the sanitised text of every row."""
    with scope():
        told = disclosing(docs)
        best = None if told is None else stage(told.groupBy("term").agg(F.max("ratio").alias("ratio")), "told")
        few = best is None or best.count() <= BROADCAST_TERMS
        known = _known(best) if few else None
        marks = None if few else keep(places(docs, best), "marks")
    texts = _texts(docs)
    none = F.expr("cast(array() as array<struct<start:int,end:int,gone:boolean>>)")
    if marks is None:
        texts = texts.withColumn("marks", none)
    else:
        texts = texts.join(sized(marks.withColumnRenamed("name", "of"), BROADCAST_MARKS), F.col("name") == F.col("of"), "left").withColumn("marks", F.coalesce("marks", none))
    some = F.lit(True) if known else F.col("text").rlike("[0-9@]") | (F.size("marks") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in _slices(batches):
            base, every, remove, clean = [], [], [], []
            found = _told(part, known.value) if known else {}
            for r, marked in enumerate(batch.column("marks").to_pylist()):
                text = part.text(r)
                own = _own(text) if HINT[part.data[part.at[r] : part.at[r + 1]]].any() else []
                if r in found:
                    at, gone = found[r]
                    a, b, free = part.free(r, at, own)
                    marked = [{"start": x, "end": y, "gone": z} for x, y, z in zip(a[free].tolist(), b[free].tolist(), gone[free].tolist(), strict=True)]
                base.append([x for x in own if x[1] < BASE_KINDS])
                every.append(sorted([*own, *((m["start"], TERM, m["end"]) for m in marked)]))
                remove.append([m["start"] for m in marked if m["gone"]])
                clean.append(sanitise(text, every[-1], set(remove[-1])) if every[-1] else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _spans(base), _spans(every), pa.array(remove, pa.list_(pa.int32())), pa.array(clean, pa.string())], names=["doc_id", "base", "all", "remove", "sanitised"])

    found = map_arrow(texts.filter(some).select("doc_id", "text", "marks"), run, f"doc_id long, base array<{SPAN}>, all array<{SPAN}>, remove array<int>, sanitised string")
    if known:
        return found
    empty = F.expr(f"cast(array() as array<{SPAN}>)")
    plain = texts.filter(~some).select("doc_id", empty.alias("base"), empty.alias("all"), F.expr("cast(array() as array<int>)").alias("remove"), F.col("text").alias("sanitised"))
    return found.unionByName(plain)


def _known(best: DataFrame | None):
    """The terms of best, sorted, and which of them go, on every worker; None if there are none."""
    if best is None:
        return None
    got = best.select("term", (F.col("ratio") >= REMOVE).alias("gone")).toArrow().sort_by("term")
    if not got.num_rows:
        return None
    return best.sparkSession.sparkContext.broadcast((got["term"].to_numpy(), got["gone"].to_numpy()))


def _told(part: _Slice, known: tuple[np.ndarray, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The places of known terms, and which of them go, of each row that has any."""
    words, hashed = part.terms()
    terms, gone = known
    slot = np.minimum(np.searchsorted(terms, hashed), len(terms) - 1)
    at = np.flatnonzero(terms[slot] == hashed)
    first = np.searchsorted(at, words.row)
    return {r: (at[first[r] : first[r + 1]], gone[slot[at[first[r] : first[r + 1]]]]) for r in np.flatnonzero(np.diff(first)).tolist()}


def _spans(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
    off = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.array([x for row in rows for x in row], np.int32).reshape(-1, 3)
    return pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "kind", "end"]))


def written(spans_column: str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    count_all = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")
    return got.select(
        "doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(BASE_KINDS)), F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("all").alias("spans"),
        F.size("all").cast("long").alias("n_spans"), count_all(TERM).alias("n_terms"), F.size("remove").cast("long").alias("n_removed_terms"), F.sha2(F.col("sanitised").cast("binary"), 256).alias("sanitised_sha256"),
    )
