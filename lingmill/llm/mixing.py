"""Mixing sources to target weights along a time-varying curriculum.

Sizes are words. Each source's target is its share of all words by weight, at most three
times what the source has; what exceeds that is shared again by weight until no source is
above. A source's documents, in a fixed pseudo-random order, form a stream that is read again
from its start until the target is reached; the last document is read as far as needed.

The schedule moves every source's rate linearly from its start rate at time 0 to its end rate
at time 1. Its integral is the source's cumulative demand; inverted at a document's place in
the stream it gives the training position, and documents are sorted by range of position.

No source is a task: documents are sorted by range of (source, draw) and the sorted partitions
cut into blocks of a fixed number of rows. Running sums go in three levels: inside blocks, over
the blocks of a partition, and over the partitions of a source.

Defined cases: null texts have no words and are taken zero times; the null source is one
source, last in order; ties in the order of a source are broken by all that is known of the
row (repeated rows are alike, so any order of them is the same result); a doc_id that a third
of the rows repeat is dealt over partitions like any others; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, numbered, packed_row, scope, stage, table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]++"
#: Rows for sources, and for blocks and sources, up to this many (under 100 bytes each) are broadcast.
BROADCAST_ROWS = 100_000
#: Rows of a block of the running sums.
BLOCK_ROWS = 512
#: Rate of a source at time 0 relative to its mean, by its place in the repeating weights.
START_RATES = (1.5, 1.0, 0.5)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """From (source, source_size): place, weight and target of every source.

    A capped source has cap * size; the others share the rest by weight. Rounds take out the
    sources above their share of what is then left, which only raises that share, until none
    is; each is an aggregate of two numbers, in whole numbers throughout.
    """
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    ranked = stage(ranked.withColumn("weight", weight), "sources")
    wide = lambda c: c.cast("decimal(38,0)")
    total, free = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, capped = total or 0, F.lit(False)
    while free:
        capped = F.col("weight") * wide(F.lit(rest)) > F.col("source_size") * wide(F.lit(cap * free))
        taken, left = ranked.agg(F.coalesce(F.sum(F.when(capped, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        if left == free:
            break
        rest, free = total - cap * taken, left
    shared = (F.col("weight") * F.lit(rest)).cast("double") / F.lit(free or 1)
    return ranked.select("source", "source_size", "place", "weight", F.when(capped, (F.col("source_size") * cap).cast("double")).otherwise(shared).alias("target"))


def _running(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with start: the sum of size of all rows of the same place before each in the given order, place first."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    at = F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33)
    ordered = stage(dealt.withColumn("at", at).withColumn("block", F.expr(f"at div {BLOCK_ROWS}")), "ordered")
    blocks = ordered.groupBy("place", "part", "block").agg(F.sum("size").alias("total"))
    blocks = stage(blocks.withColumn("in_part", F.sum("total").over(Window.partitionBy("place", "part").orderBy("block")) - F.col("total")), "blocks")
    parts = blocks.groupBy("place", "part").agg(F.sum("total").alias("part_total"))
    parts = parts.select("place", "part", (F.sum("part_total").over(Window.partitionBy("place").orderBy("part")) - F.col("part_total")).alias("of_part"))
    bases = stage(blocks.join(parts, ["place", "part"]).select("place", "part", "block", (F.col("in_part") + F.col("of_part")).alias("base")), "bases")
    inside = Window.partitionBy("part", "block", "place").orderBy("at")
    summed = ordered.withColumn("within", F.sum("size").over(inside) - F.col("size"))
    met = summed.join(F.broadcast(bases) if bases.count() <= BROADCAST_ROWS else bases, ["place", "part", "block"])
    return met.withColumn("start", F.col("within") + F.col("base")).drop("part", "at", "block", "within", "base")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS, start_rates: tuple[float, ...] = START_RATES) -> DataFrame:
    """rid, doc_id, source, tie, size, source_size, target, taken and positions of every row.

    positions has the training time of each whole lap; of the lap that the target cuts, where
    at least half of the document is taken.
    """
    with scope():
        sized = stage(
            docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("draw"), F.xxhash64("text").alias("tie")),
            "sizes",
        ).withColumn("rid", F.monotonically_increasing_id())
        plan = stage(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "targets")
        named = plan.select(*[F.col(c).alias(f"t_{c}") for c in plan.columns])
        named = F.broadcast(named) if plan.count() <= BROADCAST_ROWS else named
        met = sized.join(named, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source").withColumnRenamed("t_place", "place")
        order = ["place", "draw", "size", "tie", "rid"]
        placed = _running(met, order).withColumn("goal", F.round("t_target").cast("long"))
        size, total, goal, start = F.col("size"), F.col("t_source_size"), F.col("goal"), F.col("start")
        laps = F.when(total > 0, F.expr("goal div t_source_size")).otherwise(0)
        last = F.when(total > 0, F.least(size, F.greatest(F.lit(0), goal - laps * total - start))).otherwise(0)
        rate = F.element_at(F.array(*map(F.lit, start_rates)), (F.col("place") % len(start_rates) + 1).cast("int"))
        whole = F.when(size > 0, laps + F.when(2 * last >= size, 1).otherwise(0)).otherwise(0).cast("int")
        at = lambda lap: invert_demand(F.least((lap * total + start + size / 2) / F.greatest(goal, F.lit(1)), F.lit(1.0)), rate)
        return keep(
            placed.select(
                "rid", "doc_id", "source", "tie", "size", total.alias("source_size"), F.col("t_target").alias("target"), (laps * size + last).cast("long").alias("taken"),
                F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), at)).otherwise(F.expr("cast(array() as array<double>)")).alias("positions"),
            ),
            "mixed",
        )


def invert_demand(share: Column, rate: Column) -> Column:
    """The time by which a source has supplied this share of its target.

    Its rate is rate + 2 (1 - rate) t, so the supply by time t is rate t + (1 - rate) t^2.
    """
    bend = 1 - rate
    root = F.sqrt(rate * rate + 4 * bend * share)
    return F.when(bend == 0, share).otherwise(2 * share / (rate + root))


def repeated(docs: DataFrame) -> DataFrame:
    """The columns of docs in training order, each document as often as the mix takes it.

    Every lap has a position of its own. Rows are sorted by range of position; the texts are
    joined to their positions by doc_id and a hash, so rows that repeat both get the larger of
    their numbers of laps each.
    """
    laps = mix(docs).groupBy("doc_id", "tie").agg(F.max(F.struct(F.size("positions").alias("n"), "positions")).alias("p"))
    taken = laps.select(F.col("doc_id").alias("taken_id"), F.col("tie").alias("taken_tie"), F.explode("p.positions").alias("position"))
    rows = docs.select(packed_row(docs).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_tie"))
    met = rows.join(taken, F.col("own_id").eqNullSafe(F.col("taken_id")) & (F.col("own_tie") == F.col("taken_tie")))
    order = ["position", "own_id", "own_tie"]
    return met.repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix in training order: rows sorted by range of their first position, those without one last."""
    mixed = mix(table(spark, sf_dir, "documents")).withColumn("position", F.get("positions", F.lit(0))).withColumn("late", F.col("position").isNull())
    order = ["late", "position", "doc_id", "rid"]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "size", "source_size", "target", "taken", "position", F.size("positions").cast("long").alias("whole_laps"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
p AS (SELECT source, n, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s),
c AS (SELECT *, sum(n) OVER ()::BIGINT AS total,
  coalesce(sum(n) OVER (ORDER BY n / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 3 AS used,
  sum(w) OVER (ORDER BY n / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS wl FROM p),
f AS (SELECT *, w * (total - used) > n * 3 * wl AS capped FROM c),
t AS (SELECT source, n, k, CASE WHEN capped THEN (3 * n)::DOUBLE
  ELSE (w * (total - 3 * sum(CASE WHEN capped THEN n ELSE 0 END) OVER ()))::BIGINT::DOUBLE / (sum(CASE WHEN capped THEN 0 ELSE w END) OVER ())::BIGINT END AS target FROM f),
o AS (SELECT d.doc_id, size, n AS source_size, k, target, round(target)::BIGINT AS goal,
  (sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
l AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE goal // source_size END AS laps, CASE WHEN source_size = 0 THEN 0 ELSE least(size, greatest(0, goal % source_size - start)) END AS last,
  least((start + size / 2) / greatest(goal, 1), 1.0::DOUBLE) AS share, ([1.5::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE])[((k - 1) % 3 + 1)::INT] AS rate FROM o),
w AS (SELECT *, CASE WHEN size > 0 THEN laps + CASE WHEN 2 * last >= size THEN 1 ELSE 0 END ELSE 0 END AS whole FROM l)
SELECT doc_id, size, source_size, target, (laps * size + last)::BIGINT AS taken, whole::BIGINT AS whole_laps,
  CASE WHEN whole > 0 THEN CASE WHEN rate = 1 THEN share ELSE 2 * share / (rate + sqrt(rate * rate + 4 * (1 - rate) * share)) END END AS position FROM w
"""
