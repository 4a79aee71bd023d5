"""Exact duplicates by deterministic block naming, in DataFrame functions alone.

A text (null: empty) is lower-cased A-Z and cut into blocks of a fixed number of UTF-8 bytes.
The distinct blocks are sorted, by a 64-bit hash and then by content, and numbered in that
order: equal blocks get equal integers. Then adjacent pairs of integers are sorted and
numbered again, halving every document, until each has one integer. Equal (rounds, integer)
means equal text, without collisions: a name stands for its content by construction, and it is
a place in a global order, which no number of partitions changes. Where no two distinct blocks
share a hash, which is counted over the whole dictionary, the hash alone is the sort key and
what occurrences meet their names by; else the contents themselves are.

Defined cases: nulls are empty texts, all empty texts form one group; a null doc_id sorts
below every number; of repeated rows exactly one is kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, numbered, packed_row, scope, stage, table, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    """A-Z to a-z and nothing else; the fast lower() serves texts of ASCII alone."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _blocks(size: int, each: str) -> Column:
    return F.expr(
        f"transform(sequence(0, greatest(octet_length(body) - 1, 0) div {size}),"
        f" i -> {each.format(block=f'substring(body, cast(i * {size} + 1 as int), {size})')})"
    )


def _route(bits: int, block: str) -> str:
    return f"xxhash64({block})" if bits >= 64 else f"pmod(xxhash64({block}), {1 << bits})"


def name_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES, route_bits: int = 64) -> DataFrame:
    """rid, doc_id, text_sha256 and the identity (rounds, name) of every row.

    route_bits is smaller in tests alone, to force shared routing hashes.
    """
    body = docs.select(F.col("doc_id"), normalised(text_or_empty()).alias("norm")).withColumn("body", F.col("norm").cast("binary"))
    route = _route(route_bits, "block")
    dictionary = body.select(F.explode(_blocks(block_bytes, "{block}")).alias("block")).distinct().select("block", F.expr(route).alias("route"))
    routes = stage(dictionary.select("route"), "routes")
    shared = routes.groupBy("route").count().filter("count > 1").limit(1).count() > 0
    if shared:
        names = numbered(dictionary, ["route", "block"], "name").select(F.col("block").alias("key"), "name")
    else:
        names = numbered(routes, ["route"], "name").select(F.col("route").alias("key"), "name")
    occurrence = body.withColumn("rid", F.monotonically_increasing_id()).withColumn("text_sha256", F.sha2("body", 256))
    key = _blocks(block_bytes, "{block}" if shared else _route(route_bits, "{block}"))
    placed = occurrence.select("rid", "doc_id", "text_sha256", F.posexplode(key).alias("pos", "key"))
    named = placed.join(names, "key")
    state = stage(_gather(named.withColumn("text_sha256", F.when(F.col("pos") == 0, F.col("text_sha256")))), "level")
    done = [_finished(state, 0)]
    left, level = state.agg(F.max(F.size("names"))).first()[0] or 0, 0
    while left > 1:
        level += 1
        pairs = state.filter(F.size("names") > 1).select(
            "rid",
            "doc_id",
            "text_sha256",
            F.posexplode(F.expr("transform(sequence(0, size(names) - 1, 2), i -> struct(names[i] as a, coalesce(get(names, i + 1), -1L) as b))")).alias("pos", "pair"),
        ).select("rid", "doc_id", "text_sha256", "pos", "pair.a", "pair.b")
        names = numbered(pairs.select("a", "b").distinct(), ["a", "b"], "name")
        state = stage(_gather(pairs.join(names, ["a", "b"])), "level")
        done.append(_finished(state, level))
        left = (left + 1) // 2
    return reduce(DataFrame.unionByName, done)


def _gather(named: DataFrame) -> DataFrame:
    """One row per document: its names in order."""
    return named.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("text_sha256").alias("text_sha256"),
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"),
    )


def _finished(state: DataFrame, level: int) -> DataFrame:
    return state.filter(F.size("names") == 1).select("rid", "doc_id", "text_sha256", F.lit(level).alias("rounds"), F.col("names")[0].alias("name"))


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES, route_bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest doc_id of each identity is kept. Groups are combined before they
    are shuffled and written; rows then meet them in a join of two tables, whose large
    partitions Spark splits.
    """
    with scope():
        named = stage(name_documents(docs, block_bytes, route_bits), "named")
        top = named.groupBy("rounds", "name").agg(F.max(F.struct("doc_id", "rid")).alias("top"), F.count(F.lit(1)).alias("group_size"))
        groups = stage(top, "groups")
        return keep(
            named.join(groups, ["rounds", "name"]).select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("top.rid")).alias("kept"), "text_sha256"),
            "exact",
        )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with one row of each group of equal texts.

    Kept rows are found again by doc_id and the digest of their text; only where rows repeat
    both, which is looked up first, are they reduced to one.
    """
    groups = exact_groups(docs)
    kept = groups.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    digest = F.sha2(normalised(text_or_empty()).cast("binary"), 256)
    rows = docs.select(packed_row(docs).alias("row"), F.col("doc_id").alias("own_id"), digest.alias("own_sha"))
    out = rows.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_sha") == F.col("kept_sha")), "left_semi")
    if groups.groupBy("doc_id", "text_sha256").count().filter("count > 1").limit(1).count():
        out = out.dropDuplicates(["own_id", "own_sha"])
    return out.select("row.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
