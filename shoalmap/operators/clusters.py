"""Clusters of species by their score-weighted coefficients."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalmap.operators.blocks import paired_blocks
from shoalmap.operators.numbering import running
from shoalmap.session import cut

# Fixed values of the density clustering: L1 radius and neighbours of a core point.
EPS = 10.0
MIN_POINTS = 5
# Clusters left at which one task goes on with the merges.
FINISH = 1024


def coef_vectors(species_coef: DataFrame, names: list[str]) -> DataFrame:
    """(species, features) with a place per variable, standardised over species by the population
    deviation; a constant variable is 0."""
    cells = [F.coalesce(F.max(F.when(F.col("var") == n, F.col("coef"))), F.lit(0.0)) for n in names]
    wide = species_coef.groupBy("species").agg(F.array(*cells).alias("raw"))
    sizes = [f(F.col("raw")[i]) for i in range(len(names)) for f in (F.avg, F.stddev_pop)]
    stats = wide.agg(*[c.alias(f"s{i}") for i, c in enumerate(sizes)]).first()
    scaled = [(F.col("raw")[i] - F.lit(stats[2 * i] or 0.0)) / F.lit(stats[2 * i + 1] or 1.0) for i in range(len(names))]
    return wide.select("species", array_to_vector(F.array(*scaled)).alias("features"))


def cluster_species(vectors: DataFrame, method: str = "kmeans", k: int = 2, seed: int = 0) -> DataFrame:
    """(species, cluster). `agglomerative` merges bottom up by Ward's distance, `bisecting` is top-down
    k-means; `dbscan` marks noise with -1."""
    if method == "kmeans":
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vectors)
    elif method == "agglomerative":
        return cut_tree(vectors, ward_merges(vectors), k)
    elif method == "bisecting":
        model = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vectors)
    elif method == "dbscan":
        return dbscan(vectors)
    else:
        raise ValueError(method)
    return model.transform(vectors).select("species", "cluster")


def _near(eps: float):
    """Neighbour counts, and per point the smallest label among core neighbours, of one block pair."""

    def part(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if d.empty:
            return pd.DataFrame({"species": q["species"], "near": 0, "low": None})
        a, b = np.array(q["xs"].tolist(), dtype=float), np.array(d["xs"].tolist(), dtype=float)
        dist = np.zeros((len(a), len(b)))
        for f in range(a.shape[1]):
            dist += np.abs(a[:, None, f] - b[None, :, f])
        close = dist <= eps
        labels, counts = d["label"].to_numpy(dtype=object), d["n"].to_numpy()
        order = np.argsort(np.array(["" if v is None else v for v in labels]), kind="stable")
        core = np.array([labels[j] is not None for j in order])
        low = []
        for row in close[:, order]:
            hit = np.flatnonzero(row & core)
            low.append(labels[order[hit[0]]] if len(hit) else None)
        return pd.DataFrame({"species": q["species"], "near": close @ counts, "low": low})

    return part


def dbscan(vectors: DataFrame, eps: float = EPS, min_points: int = MIN_POINTS) -> DataFrame:
    """Density clusters under the L1 distance.

    Neighbours are only counted and reduced to the smallest label, block by block; no pair is
    emitted. Labels spread among core points until none changes, each round written once. A label names
    a point, and every round takes over that point's own label as well, so rounds grow with the log of
    the longest chain. Clusters are numbered by their smallest species.
    """
    points = vectors.select("species", vector_to_array("features").alias("xs"))
    schema = "species string, near long, low string"

    def reach(labels: DataFrame) -> DataFrame:
        donors = labels.groupBy("xs").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n"))
        parts = paired_blocks(points, donors, [], ["species"], ["xs"], _near(eps), schema)
        return parts.groupBy("species").agg(F.sum("near").alias("near"), F.min("low").alias("low"))

    counts = reach(points.withColumn("label", F.lit(None).cast("string")))
    core = cut(points.join(counts.filter(F.col("near") >= min_points).select("species"), "species", "left").join(
        counts.select("species", (F.col("near") >= min_points).alias("core")), "species"
    ))
    labels = core.withColumn("label", F.when(F.col("core"), F.col("species")))
    while True:
        step = reach(labels)
        after = cut(labels.join(step.select("species", "low"), "species").withColumn(
            "new", F.when(F.col("core"), F.least("label", "low"))
        ))
        changed = after.filter(F.col("new") != F.col("label")).limit(1).count()
        jump = after.select(F.col("species").alias("new"), F.col("new").alias("up"))
        labels = cut(after.join(jump, "new", "left").select("species", "xs", "core", F.coalesce("up", "new").alias("label")))
        if not changed:
            break
    final = reach(labels).select("species", "low")
    return _numbered(final)


def _numbered(labels: DataFrame) -> DataFrame:
    """(species, cluster) of (species, low): clusters in the order of their smallest species, -1 without one."""
    names = labels.filter(F.col("low").isNotNull()).select("low").distinct()
    numbered = running(names, [], ["low"], at=("row", None))
    joined = labels.join(numbered, "low", "left")
    return joined.select("species", F.coalesce(F.col("at") - 1, F.lit(-1)).cast("int").alias("cluster"))


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers, one to one."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _closest(q: pd.DataFrame, d: pd.DataFrame, rows: int = 256) -> pd.DataFrame:
    """Each cluster's nearest other one among `d` by Ward's distance.

    Of equally near ones a hash of the pair decides, which is the same seen from both sides; so many of
    a tie's pairs choose each other in a round, not one.
    """
    a, b = (np.array(t["xs"].tolist(), dtype=float).reshape(len(t), -1) for t in (q, d))
    na, nb = q["n"].to_numpy(float), d["n"].to_numpy(float)
    ha, hb = q["h"].to_numpy(np.int64).view(np.uint64), d["h"].to_numpy(np.int64).view(np.uint64)
    mine, theirs = q["species"].to_numpy(object), d["species"].to_numpy(object)
    parts = []
    for lo in range(0, len(q), rows):
        at = slice(lo, lo + rows)
        dist = np.zeros((len(a[at]), len(b)))
        for f in range(a.shape[1]):
            dist += (a[at, None, f] - b[None, :, f]) ** 2
        dist *= 2 * na[at, None] * nb[None] / (na[at, None] + nb[None])
        dist[mine[at, None] == theirs[None]] = np.inf
        low = dist.min(axis=1)
        tie = np.where(dist == low[:, None], (_mixed(ha[at, None] ^ hb[None]) >> np.uint64(1)).astype(np.int64), np.iinfo(np.int64).max)
        best = tie.argmin(axis=1)
        parts.append(pd.DataFrame({"species": mine[at], "d": low, "tie": tie[np.arange(len(best)), best], "other": theirs[best]}))
    out = pd.concat(parts)
    return out[np.isfinite(out["d"])]


def _nearest(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
    return _closest(q, d) if len(d) else pd.DataFrame(columns=["species", "d", "tie", "other"])


_MERGES = "round int, left string, right string, height double, n long"


def _finish(start: int):
    """The remaining merges of at most `FINISH` clusters, by the same rounds."""

    def run(state: pd.DataFrame) -> pd.DataFrame:
        merges, at = [], start
        state = state.sort_values("species").reset_index(drop=True)
        while len(state) > 1:
            near = _closest(state, state).set_index("species")
            place = {name: i for i, name in enumerate(state["species"])}
            n, height, xs = state["n"].tolist(), state["height"].tolist(), [np.array(x, dtype=float) for x in state["xs"]]
            gone = []
            for left, d, other in zip(near.index, near["d"], near["other"], strict=True):
                if left < other and near.at[other, "other"] == left:
                    i, j = place[left], place[other]
                    height[i] = max(height[i], height[j], float(np.sqrt(d)))
                    xs[i] = (xs[i] * n[i] + xs[j] * n[j]) / (n[i] + n[j])
                    n[i] += n[j]
                    gone.append(j)
                    merges.append((at, left, other, height[i], n[i]))
            state = state.assign(n=n, height=height, xs=xs).drop(index=gone).reset_index(drop=True)
            at += 1
        return pd.DataFrame(merges, columns=[c.split()[0] for c in _MERGES.split(", ")])

    return run


def ward_merges(vectors: DataFrame, finish: int = FINISH) -> DataFrame:
    """The Ward tree over distinct vectors: round, left, right (names of the merged clusters, the smallest
    species of each; the left one lives on), height (root of twice the growth of the squares) and n (species).

    In a round all pairs of clusters that are each other's nearest merge. Ward's distance only
    grows by merges of others, so this gives the tree of merging the nearest pair of all each time.
    Clusters are kept as centres and sizes: no table of pairs exists, and the nearest
    are found block by block. Equal vectors are one cluster from the start and make no merge. At most
    `finish` clusters go through one task at the end.
    """
    points = vectors.select("species", vector_to_array("features").alias("xs"))
    state = points.groupBy("xs").agg(F.min("species").alias("species"), F.count(F.lit(1)).alias("n"))
    state = cut(state.select("species", "n", F.lit(0.0).alias("height"), F.xxhash64("species").alias("h"), "xs"))
    merges, at = None, 0
    while state.count() > finish:
        near = paired_blocks(state, state, [], ["species"], ["species"], _nearest, "species string, d double, tie long, other string")
        best = cut(near.groupBy("species").agg(F.min(F.struct("d", "tie", "other")).alias("b")).select("species", "b.d", "b.other"))
        back = best.select(F.col("species").alias("other"), F.col("other").alias("species"))
        pairs = cut(best.join(back, ["species", "other"]).filter("species < other").select(F.col("species").alias("left"), F.col("other").alias("right"), "d"))
        old = state.select(F.col("species").alias("right"), F.col("n").alias("m"), F.col("height").alias("low"), F.col("xs").alias("ys"))
        # A cluster is on one side of one pair at most.
        left = state.join(pairs.join(old, "right").withColumnRenamed("left", "species"), "species", "left")
        left = left.join(pairs.select(F.col("right").alias("species")), "species", "left_anti")
        joined = F.col("right").isNotNull()
        # The share of the right cluster has a column of its own: names in a lambda may mean the new columns.
        left = left.withColumn("share", F.col("m") / (F.col("n") + F.col("m")))
        left = left.withColumn("centre", F.zip_with("xs", "ys", lambda x, y: x * (1 - F.col("share")) + y * F.col("share")))
        size = F.col("n") + F.coalesce("m", F.lit(0))
        height = F.when(joined, F.greatest("height", "low", F.sqrt("d"))).otherwise(F.col("height"))
        after = cut(left.select("species", "right", size.alias("n"), height.alias("height"), "h", F.when(joined, F.col("centre")).otherwise(F.col("xs")).alias("xs")))
        done = after.filter(joined).select(F.lit(at).alias("round"), F.col("species").alias("left"), "right", "height", "n")
        merges = done if merges is None else merges.unionByName(done)
        state, at = after.drop("right"), at + 1
    last = state.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_finish(at), _MERGES)
    return cut(last if merges is None else merges.unionByName(last))


def cut_tree(vectors: DataFrame, merges: DataFrame, k: int) -> DataFrame:
    """(species, cluster) of the `k` clusters left when the highest k - 1 merges are undone, numbered by
    their smallest species; of equally high merges the later rounds are undone first.
    Equal vectors stay together, so there are no more clusters than distinct vectors."""
    kept = merges.count() - (k - 1)
    order = running(merges, [], ["height", "round", "left"], at=("row", None))
    up = cut(order.filter(F.col("at") <= kept).select(F.col("right").alias("name"), F.col("left").alias("up")))
    points = vectors.select("species", vector_to_array("features").alias("xs"))
    names = points.groupBy("xs").agg(F.min("species").alias("name"))
    # A cluster's name is taken over once at most, so the names form a forest; paths halve each round.
    while True:
        above = up.select(F.col("name").alias("up"), F.col("up").alias("top"))
        step = cut(up.join(above, "up", "left").select("name", "top", F.coalesce("top", "up").alias("up")))
        up = step.drop("top")
        if not step.filter("top IS NOT NULL").limit(1).count():
            break
    labels = points.join(names, "xs").join(up, "name", "left").select("species", F.coalesce("up", "name").alias("low"))
    return _numbered(labels)
