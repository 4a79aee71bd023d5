"""Near-duplicate groups: an n-gram Jaccard join by rare-first prefix filtering.

A document's set is its distinct 5-word shingles. Two sets link when 100 |x & y| >= 80 |x | y|.
Sets that link share a token among the first n - ceil(0.8 n) + 1 of each under any common
order of tokens. The order used: a fixed quarter of all tokens (by hash) comes first, ordered
by document frequency, rarest first; the others follow by hash. As a prefix is a fifth of a
set, it nearly always lies in that quarter, so only a quarter of all tokens is ever counted
or shuffled; where it does not, the set's lowest other tokens are added, and nothing is lost.
Tokens of one document alone open the prefix and cannot match: a document with a fifth of such
tokens leaves at once.

Pairs are filtered by length, by position of the shared token and by a suffix bound (what
follows is divided by hash into 512 cells: every token of one set alone flips the parity of
one, so the cells that differ bound the Hamming distance), then verified once on whole sets.

Large groups: equal sets are one set from the start. Then each token's members meet only a few
pivots drawn by hash; verified links make components, and pairs in one component need no
further look. What remains are sets with a prefix token that another component has too. For
these all tokens are counted, and the order begins anew: tokens that one component alone has
cannot be common to two, so they come first, and positions are exact. Other pivots join what
they can; then all pairs of different components meet. By its position a token bounds the size
of any partner that it could be the first to share, so members of a token are dealt by size and
meet only in sizes that both admit: where a template is on many pages that differ enough, no
pair is made at all. A pair that was tried is not tried again.

Defined cases: null, empty and blank texts have no tokens and link with nothing; texts under
five words are one shingle; a null doc_id is never the smallest of a component while another
is there; repeated rows are equal sets; an empty table gives no rows; other columns are
ignored; long texts are whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesets import U64, Words, mix, shingle_sets, slices, utf8
from .common import drop_stage, keep, map_arrow, packed_row, scope, sized, stage, table, text_or_empty

#: One token in so many (by hash) is ordered by frequency; more than a prefix's share must be.
HEAD_ONE_IN = 4
#: Cells of the parity signature, 64 to a column.
CELLS = 512
SIGNATURE = [f"s{k}" for k in range(CELLS // 64)]
PIVOTS = 3
#: Ids (8 bytes each) up to this many are broadcast; beyond, the texts are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Sets (40 bytes each) up to this many are broadcast to the texts that they are found in again.
BROADCAST_SETS = 300_000
SET_SCHEMA = "n int, d1 long, d2 long"


def prefix_length(n):
    return n - (4 * n + 4) // 5 + 1


def _digest(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Two 64-bit sums over mixed tokens: the identity of a set beside its size."""
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    out = []
    for salt in (U64(0x2545F4914F6CDD1D), U64(0x8CB92BA72F3D8DD7)):
        run = np.zeros(len(flat) + 1, U64)
        np.cumsum(mix(flat ^ salt), out=run[1:])
        out.append((run[ends] - run[ends - size]).view(np.int64))
    return out


def _lists(values: list[np.ndarray]) -> pa.Array:
    size = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=size[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(size), pa.array(flat.astype(np.int64)))


def _head(s: np.ndarray) -> tuple[np.ndarray, int]:
    """The tokens a set is found by: frequency-ordered ones, and others where they are too few.

    A token is 48 bits of its hash and one that says whether it is of the others.
    """
    first = s % U64(HEAD_ONE_IN) == 0
    head = (s[first] >> U64(16)) << U64(1)
    need = prefix_length(len(s)) - len(head) if len(s) else 0
    if need > 0:
        return np.concatenate([head, ((s[~first][:need] >> U64(16)) << U64(1)) | U64(1)]), len(head)
    return head, len(head)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, the set's size and digest, its head tokens, how many of these are ordered by
    frequency, and its parity signature."""
    schema = f"doc_id long, {SET_SCHEMA}, head array<long>, n_first int, " + ", ".join(f"{c} long" for c in SIGNATURE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for i, j in slices(off):
                sets = list(shingle_sets(Words(data[off[i] : off[j]], off[i : j + 1] - off[i])))
                d1, d2 = _digest(sets)
                heads = [_head(s) for s in sets]
                odd = np.stack([np.bincount((s >> U64(8)).astype(np.int64) & (CELLS - 1), minlength=CELLS) & 1 for s in sets]).astype(np.uint8)
                signature = np.packbits(odd, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array([len(s) for s in sets], pa.int32()), pa.array(d1), pa.array(d2), _lists([h for h, _ in heads]), pa.array([k for _, k in heads], pa.int32()), *(pa.array(signature[:, k]) for k in range(len(SIGNATURE)))],
                    names=["doc_id", "n", "d1", "d2", "head", "n_first", *SIGNATURE],
                )

    return map_arrow(_texts(docs), run, schema)


def whole_sets(docs: DataFrame) -> DataFrame:
    """Size, digest and all tokens of every row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for i, j in slices(off):
                sets = list(shingle_sets(Words(data[off[i] : off[j]], off[i : j + 1] - off[i])))
                d1, d2 = _digest(sets)
                yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in sets], pa.int32()), pa.array(d1), pa.array(d2), _lists([s.view(np.int64) for s in sets])], names=["n", "d1", "d2", "tokens"])

    return map_arrow(_texts(docs), run, f"{SET_SCHEMA}, tokens array<long>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def postings(sets: DataFrame) -> DataFrame:
    """token, sid, n, own and pos: the prefix tokens of every set that another set also has.

    own is the share of its counted tokens that no other set has.

    Only (token, sid) is shuffled for every token. Tokens of one set alone precede the shared
    ones of the first class; among the others they are not counted, so a position there is a
    lower bound, which the filters may use as well.
    """
    each = sets.select("sid", F.explode("head").alias("token"))
    frequency = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    late = F.col("token") % 2
    shared = each.join(frequency, "token").withColumn("key", F.struct(late.alias("late"), F.when(late == 0, F.col("df")).otherwise(0).alias("df"), "token"))
    ordered = shared.groupBy("sid").agg(F.sort_array(F.collect_list("key")).alias("keys")).join(sets.select("sid", "n", "n_first"), "sid")
    alone = F.col("n_first") - F.size(F.filter("keys", lambda k: k["late"] == 0))
    placed = ordered.withColumn("alone", alone).select(
        "sid", "n", (F.col("alone") / F.greatest("n_first", F.lit(1))).alias("own"), F.explode(F.transform("keys", lambda k, i: F.struct(k["token"].alias("token"), (F.col("alone") + i).alias("pos")))).alias("t")
    )
    return placed.select("t.token", "sid", "n", "own", "t.pos").filter(F.col("pos") < F.col("n") - F.expr("(4 * n + 4) div 5") + 1)


def _fits(one: str, two: str) -> F.Column:
    """Length and positional filters for a token that two rows of postings share.

    A pair that links has a first common token, and all its common tokens are that one and
    later ones; so the pair passes by that token at least, and by others it need not.
    """
    c = lambda which, name: F.col(f"{which}{name}")
    length = (5 * c(one, "n") >= 4 * c(two, "n")) & (5 * c(two, "n") >= 4 * c(one, "n"))
    return length & (9 * F.least(c(one, "n") - c(one, "pos"), c(two, "n") - c(two, "pos")) >= 4 * (c(one, "n") + c(two, "n")))


def _alike(one: str, two: str) -> F.Column:
    """The suffix filter, by the signatures of two rows."""
    apart = F.lit(0)
    for s in SIGNATURE:
        apart = apart + F.bit_count(F.col(one + s).bitwiseXOR(F.col(two + s)))
    return apart <= F.col(f"{one}n") + F.col(f"{two}n") - 2 * F.expr(f"(4 * ({one}n + {two}n) + 8) div 9")


def _plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) that pass the suffix filter."""
    side = lambda s: sets.select(F.col("sid").alias(s), F.col("n").alias(f"{s}n"), *(F.col(c).alias(s + c) for c in SIGNATURE))
    return pairs.join(side("x"), "x").join(side("y"), "y").filter(_alike("x", "y")).select("x", "y")


def _as(df: DataFrame, which: str, *columns: str) -> DataFrame:
    """token and the columns under another first letter."""
    return df.select("token", *(F.col(c).alias(f"{which}{c}") for c in columns))


def verify(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The linked ones of the pairs (x, y), on whole sets; sets of no pair are left out before any shuffle."""
    pairs = stage(pairs, "pairs")
    ids = stage(pairs.select(F.col("x").alias("sid")).unionByName(pairs.select(F.col("y").alias("sid"))).distinct(), "ids")
    some = full.join(sized(ids, BROADCAST_IDS), "sid", "left_semi")
    both = pairs.join(some.select(F.col("sid").alias("x"), F.col("tokens").alias("tx")), "x").join(some.select(F.col("sid").alias("y"), F.col("tokens").alias("ty")), "y")
    sizes = F.size("tx") + F.size("ty")
    common = F.size(F.array_intersect("tx", "ty"))
    return both.withColumn("common", common).filter(F.col("common") * 180 >= 80 * sizes).select("x", "y")


def components(edges: DataFrame) -> DataFrame:
    """sid and comp, the smallest sid reachable, of every node of the edges (x, y).

    Each round takes the least label among neighbours and then the label's own label; rounds
    stop when no label changes.
    """
    both = stage(edges.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(edges.select(F.col("y").alias("a"), F.col("x").alias("b"))), "edges")
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "sid"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("sid", "b"), "b").select(F.col("a").alias("sid"), "comp")
        least = near.unionByName(labels).groupBy("sid").agg(F.min("comp").alias("comp"))
        jump = labels.select(F.col("sid").alias("comp"), F.col("comp").alias("next"))
        moved = stage(
            least.join(jump, "comp").join(labels.withColumnRenamed("comp", "was"), "sid").select("sid", F.least("comp", "next").alias("comp"), "was"), "labels"
        )
        still = moved.filter("comp != was").limit(1).count() == 0
        drop_stage(labels)
        labels = moved.drop("was")
        labels._stage_path = moved._stage_path
        if still:
            drop_stage(both)
            return labels


def near_groups(docs: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    with scope():
        return keep(_near_groups(docs, pivots), "near")


def _near_groups(docs: DataFrame, pivots: int) -> DataFrame:
    keys = ["n", "d1", "d2"]
    every = stage(sketches(docs), "sketches")
    firsts = (F.first(c).alias(c) for c in ("head", "n_first", *SIGNATURE))
    sets = stage(every.filter("n > 0").groupBy(*keys).agg(F.min("doc_id").alias("rep"), *firsts).withColumn("sid", F.monotonically_increasing_id()), "sets")
    heads, every = every, stage(every.select("doc_id", *keys), "identities")
    drop_stage(heads)
    prefix = stage(postings(sets), "postings")
    shared = stage(prefix.groupBy("token").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("token"), "shared")
    first, prefix = prefix, stage(prefix.join(shared, "token"), "postings")
    drop_stage(first)
    full = _full_sets(docs, sets, prefix)

    # pivots: the member with the least of its own, which of copies is their origin, and others by draw
    rows = prefix.withColumn("comp", F.col("sid"))
    tried = stage(_star(rows, F.col("own"), pivots, 0), "tried")
    edges = stage(verify(_plausible(tried, sets), full), "links")
    comps = components(edges)

    rows = crossings(prefix, full, comps, sets)
    again = stage(_star(rows, F.lit(0.0), pivots, pivots, suffix=True).join(tried, ["x", "y"], "left_anti"), "tried")
    more = stage(verify(again, full), "links")
    if more.limit(1).count():
        edges = stage(edges.unionByName(more), "links")
        comps = components(edges)
    more = stage(verify(between(rows, comps).join(tried.unionByName(again), ["x", "y"], "left_anti"), full), "links")
    if more.limit(1).count():
        comps = components(edges.unionByName(more))
    smallest = comps.join(sets.select("sid", "rep"), "sid").groupBy("comp").agg(F.min("rep").alias("least"))
    named = sets.select(*keys, "sid", "rep").join(comps.join(smallest, "comp").select("sid", "least"), "sid", "left").select(*keys, F.coalesce("least", "rep").alias("component_id"))
    linked = every.filter("n > 0").select("doc_id", *keys).join(stage(named, "named"), keys)
    alone = every.filter("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").unionByName(alone)


def open_sets(prefix: DataFrame, comps: DataFrame) -> DataFrame:
    """sid and comp of the sets with a prefix token that sets of another component have too, of sizes that both admit."""
    member = prefix.select("token", "sid", "n", "pos").join(comps, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    most = F.least(F.expr("5 * n div 4"), F.expr("(9 * (n - pos) - 4 * n) div 4"))
    own, wanted = _coarse_class(F.col("n")), F.explode(F.sequence(_coarse_class(F.expr("(4 * n + 4) div 5")), _coarse_class(most)))
    member = member.filter(5 * most >= 4 * F.col("n")).select("token", "sid", "comp", own.alias("own"), wanted.alias("wanted"))
    member = stage(member.select("sid", "comp", F.xxhash64("token", "own", "wanted").alias("has"), F.xxhash64("token", "wanted", "own").alias("seeks")), "members")
    there = stage(member.groupBy("has", "seeks").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")), "classes")
    facing = there.select(F.col("seeks").alias("has"), F.col("has").alias("seeks"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    met = stage(there.join(facing, ["has", "seeks"]).filter(F.least("lo", "lo2") != F.greatest("hi", "hi2")).select("has", "seeks"), "met")
    return member.join(met, ["has", "seeks"]).select("sid", "comp").distinct()


def _star(rows: DataFrame, own: F.Column, pivots: int, salt: int, suffix: bool = False) -> DataFrame:
    """Pairs (x, y) of each token's members with a few of them, of different components and passing the filters."""
    row = ["sid", "comp", "n", "pos", *(SIGNATURE if suffix else [])]
    drawn = [F.min(F.struct((own if k == 0 else F.lit(0.0)).alias("own"), F.xxhash64("sid", F.lit(k + salt)).alias("draw"), *row)).alias(f"p{k}") for k in range(pivots)]
    chosen = rows.groupBy("token").agg(*drawn).select("token", F.explode(F.array(*(f"p{k}" for k in range(pivots)))).alias("p"))
    chosen = stage(chosen.select("token", *(F.col(f"p.{c}").alias(f"p{c}") for c in row)).dropDuplicates(["token", "psid"]), "pivots")
    met = _as(rows, "m", *row).join(chosen, "token").filter((F.col("mcomp") != F.col("pcomp")) & _fits("m", "p"))
    met = met.filter(_alike("m", "p")) if suffix else met
    return met.select(F.least("msid", "psid").alias("x"), F.greatest("msid", "psid").alias("y")).distinct()


def crossings(prefix: DataFrame, full: DataFrame, comps: DataFrame, sets: DataFrame) -> DataFrame:
    """token, sid, comp, n, pos, most and signature: the exact prefix of every open set, of tokens that two components have.

    With r tokens of n from one on, a pair that shares it first has r in common at most, and a
    link needs 4 (n + m) / 9 of them where the partner has m; so m is most = (9 r - 4 n) / 4.
    """
    each = full.join(sized(stage(open_sets(prefix, comps), "open"), BROADCAST_SETS), "sid").select("sid", "comp", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    crossing = stage(each.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("df")).filter("lo != hi").select("token", "df"), "crossing")
    ranked = each.join(crossing, "token").groupBy("sid").agg(F.first("comp").alias("comp"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("keys"))
    place = F.col("n") - F.size("keys")
    rows = ranked.join(sets.select("sid", *SIGNATURE), "sid").select("sid", "comp", "n", *SIGNATURE, F.explode(F.transform("keys", lambda k, i: F.struct(k["token"].alias("token"), (place + i).alias("pos")))).alias("t"))
    rows = rows.select("t.token", "sid", "comp", "n", "t.pos", F.expr("(9 * (n - t.pos) - 4 * n) div 4").alias("most"), *SIGNATURE)
    return stage(rows.filter((F.col("pos") < F.col("n") - F.expr("(4 * n + 4) div 5") + 1) & (5 * F.col("most") >= 4 * F.col("n"))), "crossings")


def between(rows: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs (x, y) of different components that share a token of crossings() and pass its filters.

    The larger of a pair looks for its partners in the classes of size from 4 n / 5 to most.
    """
    now = rows.drop("comp").join(comps, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    row = ["sid", "comp", "n", "pos", *SIGNATURE]
    x = _as(now, "x", *row, "most").withColumn("size", F.explode(F.sequence(_size_class(F.expr("(4 * xn + 4) div 5")), _size_class(F.least("xn", "xmost")))))
    y = _as(now.filter("most >= n"), "y", *row).withColumn("size", _size_class(F.col("yn")))
    later = (F.col("yn") < F.col("xn")) | (F.col("yn") == F.col("xn")) & (F.col("ysid") < F.col("xsid"))
    pairs = x.join(y, ["token", "size"]).filter((F.col("xcomp") != F.col("ycomp")) & later & _fits("x", "y") & _alike("x", "y"))
    return pairs.select(F.least("xsid", "ysid").alias("x"), F.greatest("xsid", "ysid").alias("y")).distinct()


def _coarse_class(n: F.Column) -> F.Column:
    """Sizes in steps of a quarter, as far as a partner's may be off."""
    return F.floor(F.log(n.cast("double")) / float(np.log(1.25))).cast("int")


def _size_class(n: F.Column) -> F.Column:
    """Sizes in steps of a twentieth."""
    return F.floor(F.log(n.cast("double")) / float(np.log(1.05))).cast("int")


def _full_sets(docs: DataFrame, sets: DataFrame, prefix: DataFrame) -> DataFrame:
    """sid and tokens of the sets that have a candidate; their texts are read again."""
    alive = stage(prefix.select("sid").distinct().join(sets.select("sid", "n", "d1", "d2", "rep"), "sid"), "alive")
    ids = stage(alive.select("rep").distinct(), "ids")
    some = docs.select("doc_id", "text").join(sized(ids, BROADCAST_IDS), F.col("doc_id").cast("long").eqNullSafe(F.col("rep")), "left_semi")
    found = stage(whole_sets(some).join(sized(alive, BROADCAST_SETS), ["n", "d1", "d2"]).select("sid", "tokens"), "whole")
    if found.count() == alive.count():
        return found
    return stage(found.groupBy("sid").agg(F.first("tokens").alias("tokens")), "whole")  # rows that repeat a doc_id and its set


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with one document of each group: the smallest doc_id.

    Rows that repeat that doc_id with another text of the same group stay with it.
    """
    groups = near_groups(docs).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select(packed_row(docs).alias("row"), F.col("doc_id").cast("long").alias("own_id"))
    return rows.join(groups, F.col("own_id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT shingle FROM s GROUP BY shingle HAVING count(*) > 1), t AS (SELECT s.* FROM s SEMI JOIN k USING (shingle)),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS met FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * met >= 80 * (a.n + b.n - met)), u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(x, y) AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) c ON d.doc_id = c.x
"""
