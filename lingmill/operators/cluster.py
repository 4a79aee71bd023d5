"""Clustering: centroids, nearest centroid, grow-seeds, k-means, and in-memory methods.

Vectors are rows (vec_id, v). Relational steps broadcast centroids, k rows by parameter. The
order-dependent and spectral methods ask for all pairs or one order of their vectors, which one
task holds: they cluster a basis of at most BASIS vectors, drawn by the MD5 of their ids (all of
them where there are no more), and every other vector takes the nearest centroid of the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship_package
from ..stages import stage


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors; 0 where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def centroids(assigned: DataFrame) -> DataFrame:
    """cluster, c: the sum of the members' vectors, coordinate by coordinate."""
    parts = assigned.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"))
    return parts.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))


def assign(vectors: DataFrame, centres: DataFrame, limit: int = 10_000) -> DataFrame:
    """vec_id, cluster, sim: the most similar centroid, the first of ties.

    The centroids travel as one array beside each vector where they are few; else they are
    joined in blocks and the best of the blocks taken.
    """
    rows = centres.count()
    blocks = max(1, -(-rows // limit))
    packed = centres.withColumn("b", F.pmod(F.xxhash64("cluster"), F.lit(blocks))).groupBy("b").agg(F.sort_array(F.collect_list(F.struct("cluster", "c"))).alias("cs"))
    met = vectors.crossJoin(F.broadcast(packed)) if blocks == 1 else vectors.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed, "b")
    each = F.transform("cs", lambda c: F.struct(F.round(cosine(F.col("v"), c["c"]), 9).alias("sim"), c["cluster"].alias("cluster")))
    best = F.aggregate(each, F.struct(F.lit(-2.0).alias("sim"), F.get(F.col("cs"), F.lit(0))["cluster"].alias("cluster")), lambda m, x: F.when(x["sim"] > m["sim"], x).otherwise(m))
    got = met.select("vec_id", best.alias("m"))
    if blocks > 1:
        got = got.groupBy("vec_id").agg(F.max_by("m", F.struct(F.col("m.sim"), -F.col("m.cluster"))).alias("m"))
    return got.select("vec_id", "m.cluster", "m.sim")


def k_means(vectors: DataFrame, seeds: DataFrame, rounds: int = 10) -> DataFrame:
    """vec_id, cluster after so many rounds or when nothing moves; seeds are (cluster, c)."""
    centres, last = seeds, None
    for _ in range(rounds):
        now = stage(assign(vectors, centres).select("vec_id", "cluster"), "assigned")
        if last is not None and not now.join(last, ["vec_id", "cluster"], "left_anti").limit(1).count():
            return now
        centres = centroids(vectors.join(now, "vec_id"))
        last = now
    return last


def grow_seeds(vectors: DataFrame, seeds: DataFrame, least: float) -> DataFrame:
    """Unlabelled vectors take the nearest seed of at least this similarity, the first of ties."""
    return assign(vectors, seeds).filter(F.col("sim") >= least)


#: Vectors of a block of neighbours(), and the most that an in-memory method clusters.
BLOCK, BASIS = 1024, 4000


def neighbours(vectors: DataFrame, k: int) -> DataFrame:
    """vec_id, other, sim: the k nearest of the same cluster.

    A cluster is dealt into blocks, every two of which meet in a task of their own; of each the
    k best are kept, and of these the k best of all.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, y = (np.array(rows.tolist(), float) for rows in (left["v"], right["w"]))
            x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
            one, two = left["vec_id"].to_numpy(), right["other"].to_numpy()
            for at in range(0, len(x), 256):
                s = x[at : at + 256] @ y.T
                s[one[at : at + 256, None] == two[None, :]] = -2
                for r, best in enumerate(np.argsort(-s, axis=1, kind="stable")[:, :k]):
                    out += [(one[at + r], two[c], s[r, c]) for c in best if s[r, c] > -2]
        return pd.DataFrame(out, columns=["vec_id", "other", "sim"])

    ship_package(vectors.sparkSession)
    blocks = stage(vectors.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "blocks")
    dealt = vectors.join(F.broadcast(blocks) if blocks.count() <= 100_000 else blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = dealt.select("cluster", F.col("own").alias("i"), every.alias("j"), "vec_id", "v").groupBy("cluster", "i", "j")
    right = dealt.select(F.col("cluster").alias("c2"), every.alias("i2"), F.col("own").alias("j2"), F.col("vec_id").alias("other"), F.col("v").alias("w")).groupBy("c2", "i2", "j2")
    met = left.cogroup(right).applyInPandas(run, "vec_id long, other long, sim double")
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("sim"), "other"))
    return met.withColumn("place", place).filter(F.col("place") <= k).drop("place")


def _together(vectors: DataFrame, run, schema: str = "vec_id long, cluster int", basis: int = BASIS) -> DataFrame:
    """run on a basis of the vectors in one task; the others by the nearest of its centroids."""
    ship_package(vectors.sparkSession)
    draw = F.md5(F.col("vec_id").cast("string").cast("binary"))
    some = vectors.orderBy(draw, "vec_id").limit(basis)
    done = stage(some.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(run, schema), "basis")
    rest = vectors.join(F.broadcast(done.select("vec_id")), "vec_id", "left_anti")
    if not rest.limit(1).count():
        return done
    centres = stage(centroids(vectors.join(F.broadcast(done), "vec_id")), "centres")
    return done.unionByName(assign(rest, centres).select("vec_id", "cluster"))


def _matrix(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = rows.sort_values("vec_id")
    x = np.array(rows["v"].tolist(), float)
    return rows["vec_id"].to_numpy(), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _frame(ids: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    _, cluster = np.unique(label, return_inverse=True)
    return pd.DataFrame({"vec_id": ids, "cluster": cluster.astype(np.int32)})


def group_average(vectors: DataFrame, least: float, limit: int, passes: int = 1) -> DataFrame:
    """One pass in id order: join the best cluster of at least this similarity, else open one.

    At the limit of clusters a vector joins the best one regardless, as the method asks; forced()
    tells how many these are. With two passes the first runs at 0.9 of the threshold and its
    centroids are kept for the second.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, x = _matrix(rows)
        centre: list[np.ndarray] = []
        label = np.zeros(len(ids), int)
        for k in range(passes):
            bar = least * (0.9 if passes > 1 and k == 0 else 1.0)
            for i, v in enumerate(x):
                if centre:
                    c = np.array(centre)
                    s = c @ v / np.maximum(np.linalg.norm(c, axis=1), 1e-300)
                    best = int(np.argmax(s))
                    if s[best] >= bar or len(centre) >= limit:
                        label[i] = best
                        if k == 0:
                            centre[best] = centre[best] + v
                        continue
                label[i] = len(centre)
                centre.append(v.copy())
        return _frame(ids, label)

    return _together(vectors, run)


def agglomerative(vectors: DataFrame, wanted: int, linkage: str = "average") -> DataFrame:
    """From single vectors, merge the most similar two clusters until so many are left.

    Linkages: average, rms, nearest, furthest, centroid.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, x = _matrix(rows)
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        size, label, alive, centre = np.ones(len(ids)), np.arange(len(ids)), np.ones(len(ids), bool), x.copy()
        while alive.sum() > wanted:
            i, j = sorted(np.unravel_index(int(np.argmax(s)), s.shape))
            if not np.isfinite(s[i, j]):
                break
            if linkage == "nearest":
                new = np.maximum(s[i], s[j])
            elif linkage == "furthest":
                new = np.minimum(s[i], s[j])
            elif linkage == "centroid":
                centre[i] += centre[j]
                new = np.where(alive, centre @ centre[i] / np.maximum(np.linalg.norm(centre, axis=1) * np.linalg.norm(centre[i]), 1e-300), -np.inf)
            elif linkage == "rms":
                new = np.sqrt((size[i] * s[i] ** 2 + size[j] * s[j] ** 2) / (size[i] + size[j]))
            else:
                new = (size[i] * s[i] + size[j] * s[j]) / (size[i] + size[j])
            size[i] += size[j]
            alive[j] = False
            label[label == j] = i
            new = np.where(alive, new, -np.inf)
            s[i], s[:, i] = new, new
            s[j], s[:, j] = -np.inf, -np.inf
            s[i, i] = -np.inf
        return _frame(ids, label)

    return _together(vectors, run)


def spectral(vectors: DataFrame, k: int, rounds: int = 50) -> DataFrame:
    """Rows of the leading eigenvectors of the normalised affinity, clustered by k-means."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, x = _matrix(rows)
        a = np.maximum(x @ x.T, 0)
        d = 1 / np.sqrt(np.maximum(a.sum(1), 1e-300))
        _, vectors_ = np.linalg.eigh(a * d[:, None] * d[None, :])
        y = vectors_[:, -k:]
        y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
        return _frame(ids, _lloyd(y, k, rounds))

    return _together(vectors, run)


def _lloyd(x: np.ndarray, k: int, rounds: int, seed: int = 0) -> np.ndarray:
    """k-means with far-apart first centres."""
    k = min(k, len(x))
    draw = np.random.default_rng(seed)
    centre = [x[draw.integers(len(x))]]
    while len(centre) < k:
        far = np.min([((x - c) ** 2).sum(1) for c in centre], axis=0)
        centre.append(x[int(np.argmax(far))])
    c, label = np.array(centre), None
    for _ in range(rounds):
        now = np.argmin(((x[:, None] - c[None]) ** 2).sum(2), axis=1)
        if label is not None and (now == label).all():
            break
        label = now
        for j in range(k):
            if (label == j).any():
                c[j] = x[label == j].mean(0)
    return label


def tight(vectors: DataFrame, k: int, samples: int = 10, share: float = 0.7, least: float = 0.6) -> DataFrame:
    """Clusters of vectors that fall together in repeated k-means over random parts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, x = _matrix(rows)
        n, met, seen = len(ids), np.zeros((len(ids),) * 2), np.zeros((len(ids),) * 2)
        for t in range(samples):
            part = np.random.default_rng(t).choice(n, max(k, int(n * share)), replace=False) if n > k else np.arange(n)
            label = _lloyd(x[part], k, 20, t)
            seen[np.ix_(part, part)] += 1
            met[np.ix_(part, part)] += label[:, None] == label[None, :]
        together = met >= least * np.maximum(seen, 1)
        label = np.arange(n)
        for i in range(n):
            if label[i] == i:
                label[(label >= i) & together[i] & (label == np.arange(n))] = i
        return _frame(ids, label)

    return _together(vectors, run)


def average_linkage(assigned: DataFrame) -> DataFrame:
    """one, two, linkage: the mean cosine over all pairs of members of every two clusters.

    The mean of products is the product of sums, so no pair of members is formed: unit vectors
    are added up by cluster, and only clusters meet, by coordinate.
    """
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    size = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    parts = assigned.select("cluster", norm.alias("norm"), F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.sum(F.col("x") / F.col("norm")).alias("x")).join(size, "cluster")
    one, two = (parts.select("i", F.col("cluster").alias(name), (F.col("x") / F.col("n")).alias(f"x_{name}")) for name in ("one", "two"))
    return one.join(two, "i").filter("one < two").groupBy("one", "two").agg(F.sum(F.col("x_one") * F.col("x_two")).alias("linkage"))


def hierarchical_seeds(vectors: DataFrame, k: int) -> DataFrame:
    """cluster, c: the centroids of the k largest of 3k agglomerated clusters, seeds for k_means().

    The vectors given are merged in one task; callers pass a bounded set of them.
    """
    groups = stage(vectors.join(agglomerative(vectors, 3 * k), "vec_id"), "groups")
    largest = groups.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster").limit(k).select("cluster")
    return centroids(groups.join(largest, "cluster", "left_semi"))


def forced(vectors: DataFrame, assigned: DataFrame, least: float) -> DataFrame:
    """vec_id, cluster, sim of the vectors whose own centroid is less like them than the threshold."""
    centres = centroids(vectors.join(assigned, "vec_id"))
    met = vectors.join(assigned, "vec_id").join(centres, "cluster").select("vec_id", "cluster", cosine(F.col("v"), F.col("c")).alias("sim"))
    return met.filter(F.col("sim") < least)


def vector_linkage(vectors: DataFrame, assigned: DataFrame, linkage: str = "average") -> DataFrame:
    """vec_id, cluster, sim: how alike each vector and each cluster are, by its members or its centroid.

    nearest and furthest are over the root of the larger size, which is the cluster's. Members
    are broadcast, so callers pass clusters of a bounded number of vectors.
    """
    member = assigned.select("cluster", F.col("vec_id").alias("member"), F.col("v").alias("w"))
    if linkage == "centroid":
        return vectors.crossJoin(F.broadcast(centroids(assigned))).select("vec_id", "cluster", cosine(F.col("v"), F.col("c")).alias("sim"))
    met = vectors.crossJoin(F.broadcast(member)).withColumn("s", cosine(F.col("v"), F.col("w")))
    size = F.sqrt(F.count(F.lit(1)))
    form = {"average": F.avg("s"), "rms": F.sqrt(F.avg(F.col("s") * F.col("s"))), "nearest": F.max("s") / size, "furthest": F.min("s") / size}[linkage]
    return met.groupBy("vec_id", "cluster").agg(form.alias("sim"))


def merged_equivalent(assigned: DataFrame, names: DataFrame) -> DataFrame:
    """Clusters of one seed name as one cluster, the first of them; names are (cluster, name)."""
    first = names.withColumn("to", F.min("cluster").over(Window.partitionBy("name"))).select("cluster", "to")
    return assigned.join(F.broadcast(first), "cluster", "left").withColumn("cluster", F.coalesce("to", "cluster")).drop("to")


#: Names by which dispatch() knows the methods; any beginning that fits one alone will do.
METHODS = ("agglomerative", "group-average", "k-means", "seeded-k-means", "spectral", "tight", "two-pass")
LINKAGES = ("average", "centroid", "furthest", "nearest", "rms")


def parameters(spec: str) -> dict[str, str]:
    """`method=k-m,linkage=far` as a mapping, names completed; a bare word is the method."""
    out: dict[str, str] = {}
    for part in filter(None, spec.split(",")):
        key, _, value = part.partition("=") if "=" in part else ("method", "", part)
        key, value = key.strip().lower(), value.strip()
        known = {"method": METHODS, "linkage": LINKAGES}.get(key)
        if known:
            fits = [m for m in known if m.startswith(value.lower())]
            if len(fits) != 1:
                raise ValueError(f"{value} is no beginning of one {key} alone")
            value = fits[0]
        out[key] = value
    return out


def dispatch(vectors: DataFrame, spec: str, singletons: bool = True) -> DataFrame:
    """vec_id, cluster by the method that spec names; without singletons those of one vector are left out."""
    p = parameters(spec)
    k, least, limit = int(p.get("k", 10)), float(p.get("least", 0.5)), int(p.get("limit", 1000))
    method = p.get("method", "k-means")
    if method == "agglomerative":
        out = agglomerative(vectors, k, p.get("linkage", "average"))
    elif method in ("group-average", "two-pass"):
        out = group_average(vectors, least, limit, 2 if method == "two-pass" else 1)
    elif method == "spectral":
        out = spectral(vectors, k)
    elif method == "tight":
        out = tight(vectors, k)
    elif method == "seeded-k-means":
        out = k_means(vectors, hierarchical_seeds(vectors, k))
    else:
        draw = F.md5(F.col("vec_id").cast("string").cast("binary"))
        seeds = stage(vectors.orderBy(draw, "vec_id").limit(k).select((F.row_number().over(Window.orderBy("vec_id")) - 1).alias("cluster"), F.col("v").alias("c")), "seeds")
        out = k_means(vectors, seeds)
    if singletons:
        return out
    return out.join(out.groupBy("cluster").count().filter("count > 1").select("cluster"), "cluster", "left_semi").select("vec_id", "cluster")
