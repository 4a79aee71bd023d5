"""Entity-attribute-value frames as rows (frame, slot, facet, pos, filler), with inheritance.

Relations are rows (src, dst). Ancestors are found by doubling paths to a fixed point; depth
keeps the nearest value. Relations and frames are joined by shuffle: as files they look small enough for a
broadcast, which would pass all their rows through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stages import drop_stage, stage


def ancestors(edges: DataFrame) -> DataFrame:
    """src, dst, depth of every node's transitive parents, the least depth of each, at any depth.

    Paths double in every round: least lengths of up to 2^k steps are joined with themselves,
    until a round changes nothing. Each round is a stage table.
    """
    reach = stage(edges.select("src", "dst").distinct().withColumn("depth", F.lit(1)), "reach")
    while True:
        far = reach.select(F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("depth").alias("more"))
        longer = reach.join(far.hint("merge"), "dst").select("src", F.col("end").alias("dst"), (F.col("depth") + F.col("more")).alias("depth"))
        wider = stage(reach.unionByName(longer).groupBy("src", "dst").agg(F.min("depth").alias("depth")), "reach")
        if wider.count() == reach.count():
            return reach
        drop_stage(reach)
        reach = wider


def is_a(closure: DataFrame, src: str, dst: str) -> bool:
    return src == dst or closure.filter((F.col("src") == src) & (F.col("dst") == dst)).limit(1).count() > 0


def with_inverse(edges: DataFrame) -> DataFrame:
    """Both directions of a relation, each once."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def inherited(frames: DataFrame, closure: DataFrame) -> DataFrame:
    """Fillers of every frame: its own, or of a slot it lacks, those of the nearest ancestor."""
    own = frames.withColumn("depth", F.lit(0))
    up = closure.join(frames.withColumnRenamed("frame", "dst").hint("merge"), "dst").select(F.col("src").alias("frame"), "slot", "facet", "pos", "filler", "depth")
    every = own.unionByName(up)
    w = Window.partitionBy("frame", "slot", "facet")
    return every.withColumn("near", F.min("depth").over(w)).filter(F.col("depth") == F.col("near")).drop("near")


def push(frames: DataFrame, more: DataFrame) -> DataFrame:
    """New fillers behind those a facet has; ones it has already, or that come twice, are left out."""
    key = ["frame", "slot", "facet"]
    fresh = more.groupBy(*key, "filler").agg(F.min("pos").alias("pos")).join(frames.select(*key, "filler"), [*key, "filler"], "left_anti")
    end = frames.groupBy(*key).agg((F.max("pos") + 1).alias("end"))
    w = Window.partitionBy(*key).orderBy("pos", "filler")
    placed = fresh.withColumn("k", F.row_number().over(w) - 1).join(end, key, "left").select(*key, (F.coalesce("end", F.lit(0)) + F.col("k")).cast("int").alias("pos"), "filler")
    return frames.unionByName(placed)


def erase(frames: DataFrame, gone: DataFrame) -> DataFrame:
    return frames.join(gone, gone.columns, "left_anti")


def collected(frames: DataFrame) -> DataFrame:
    """One row per facet: its fillers in order."""
    return frames.groupBy("frame", "slot", "facet").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "filler"))), lambda x: x["filler"]).alias("fillers"))


#: Ways to inherit fillers: not at all, from parents by is-a or part-of edges, nearest first or
#: along the first path, and the same for values alone.
MODES = ("none", "simple", "dfs", "bfs", "part-dfs", "part-bfs", "local-dfs", "local-bfs")


def paths(edges: DataFrame) -> DataFrame:
    """src, dst, depth, path of the first path (by order of parents' names) to every ancestor, depth first.

    Paths double as in ancestors(); of two paths the one whose names come first wins, so a parent's
    own ancestors come before the next parent. Cycles are left where they close.
    """
    reach = stage(edges.select("src", "dst").distinct().withColumn("path", F.array("dst")), "paths")
    while True:
        far = reach.select(F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("path").alias("more"))
        longer = reach.join(far.hint("merge"), "dst").filter(~F.arrays_overlap("path", "more") & ~F.array_contains("more", F.col("src"))).select("src", F.col("end").alias("dst"), F.concat("path", "more").alias("path"))
        wider = stage(reach.unionByName(longer).groupBy("src", "dst").agg(F.min("path").alias("path")), "paths")
        if not wider.join(reach.hint("merge"), ["src", "dst", "path"], "left_anti").limit(1).count():
            return reach.select("src", "dst", F.size("path").alias("depth"), "path")
        drop_stage(reach)
        reach = wider


def inherited_by(frames: DataFrame, is_a_edges: DataFrame, part_edges: DataFrame, mode: str, known: dict[tuple[bool, bool], DataFrame] | None = None) -> DataFrame:
    """Fillers of every frame under one of MODES; local modes take from ancestors only facets named VALUE.

    known keeps ancestors for calls with other modes of the same relations.
    """
    if mode == "none":
        return frames.withColumn("depth", F.lit(0))
    if mode == "simple":
        return inherited(frames, is_a_edges.select("src", "dst").distinct().withColumn("depth", F.lit(1)))
    edges = part_edges if mode.startswith("part") else is_a_edges
    source = frames.filter(F.col("facet") == "VALUE") if mode.startswith("local") else frames
    known, way = {} if known is None else known, (mode.startswith("part"), mode.endswith("dfs"))
    if way not in known:
        known[way] = paths(edges) if way[1] else ancestors(edges)
    closure = known[way]
    if mode.endswith("dfs"):
        return _first_path(frames, source, closure)
    return inherited(frames, closure) if source is frames else _nearest(frames, source, closure)


def _nearest(frames: DataFrame, source: DataFrame, closure: DataFrame) -> DataFrame:
    up = closure.join(source.withColumnRenamed("frame", "dst").hint("merge"), "dst").select(F.col("src").alias("frame"), "slot", "facet", "pos", "filler", "depth")
    every = frames.withColumn("depth", F.lit(0)).unionByName(up)
    return every.withColumn("near", F.min("depth").over(Window.partitionBy("frame", "slot", "facet"))).filter(F.col("depth") == F.col("near")).drop("near")


def _first_path(frames: DataFrame, source: DataFrame, closure: DataFrame) -> DataFrame:
    none = F.expr("cast(array() as array<string>)")
    up = closure.join(source.withColumnRenamed("frame", "dst").hint("merge"), "dst").select(F.col("src").alias("frame"), "slot", "facet", "pos", "filler", "depth", "path")
    every = frames.withColumn("depth", F.lit(0)).withColumn("path", none).unionByName(up)
    return every.withColumn("first", F.min("path").over(Window.partitionBy("frame", "slot", "facet"))).filter(F.col("path") == F.col("first")).drop("first", "path")


def collected_slots(frames: DataFrame, closure: DataFrame) -> DataFrame:
    """frame, slots: all slots of a frame and of its ancestors, each once, by name."""
    up = closure.join(frames.select(F.col("frame").alias("dst"), "slot").distinct().hint("merge"), "dst").select(F.col("src").alias("frame"), "slot")
    return frames.select("frame", "slot").unionByName(up).groupBy("frame").agg(F.sort_array(F.collect_set("slot")).alias("slots"))


def with_subclasses(frames: DataFrame, closure: DataFrame, names: DataFrame) -> DataFrame:
    """The fillers of the named frames (frame) and of all that descend from them."""
    below = closure.join(names.select(F.col("frame").alias("dst")), "dst", "left_semi").select(F.col("src").alias("frame"))
    return frames.join(names.select("frame").unionByName(below).distinct(), "frame", "left_semi")


def popped(frames: DataFrame) -> DataFrame:
    """Without the last filler of every facet."""
    last = F.max("pos").over(Window.partitionBy("frame", "slot", "facet"))
    return frames.withColumn("__last", last).filter(F.col("pos") < F.col("__last")).drop("__last")


def replaced(frames: DataFrame, changes: DataFrame) -> DataFrame:
    """Fillers (frame, slot, facet, old, new) exchanged where they stand."""
    met = frames.join(changes.select("frame", "slot", "facet", F.col("old").alias("filler"), "new"), ["frame", "slot", "facet", "filler"], "left")
    return met.select("frame", "slot", "facet", "pos", F.coalesce("new", "filler").alias("filler"))
