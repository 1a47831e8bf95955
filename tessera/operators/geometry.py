"""Points: affine maps, nearest neighbours, interpolation, parcels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Sites of a leaf; leaves of the tree at most, and sampled sites a leaf it is split by; points of a task.
LEAF, LEAVES, SAMPLED, TASK_POINTS = 2_000, 1 << 15, 32, 100_000
AFFINE = {
    "to_average": [[1.0022, 0.0071, -0.0177, 0.0528], [-0.0146, 0.9990, 0.0027, -1.5519], [0.0129, 0.0094, 1.0027, -1.2012]],
    "to_mni": [[0.9975, -0.0073, 0.0176, -0.0429], [0.0146, 1.0009, -0.0024, 1.5496], [-0.0130, -0.0093, 0.9971, 1.1840]],
}


def affine(df: DataFrame, which: str) -> DataFrame:
    """Coordinates x, y, z through one of the two fixed maps."""
    m = AFFINE[which]
    return df.withColumns({c: sum((F.col(k) * v for k, v in zip("xyz", r)), F.lit(0.0)) + r[3] for c, r in zip("xyz", m)})


class Tree:
    """Sites in the leaves of a tree of median splits, in a heap: node i has the children 2 i + 1 and 2 i + 2. Box and count of each node."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.leaves, self.axis, self.at = leaves, np.zeros(leaves - 1, np.int64), np.zeros(leaves - 1)
        held = {0: sample}
        for i in range(leaves - 1):
            x = held.pop(i)
            if len(x):
                self.axis[i] = np.argmax(np.ptp(x, axis=0))
                self.at[i] = np.median(x[:, self.axis[i]])
            right = x[:, self.axis[i]] > self.at[i]
            held[2 * i + 1], held[2 * i + 2] = x[~right], x[right]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.leaves.bit_length() - 1):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.axis[node]] > self.at[node])
        return node - (self.leaves - 1)

    def fill(self, rows: list) -> None:
        """rows: (leaf, count, least and greatest x, y, z)."""
        n = 2 * self.leaves - 1
        self.count, self.low, self.high = np.zeros(n, np.int64), np.full((n, 3), np.inf), np.full((n, 3), -np.inf)
        for r in rows:
            i = r[0] + self.leaves - 1
            self.count[i], self.low[i], self.high[i] = r[1], r[2:5], r[5:8]
        for i in range(self.leaves - 2, -1, -1):
            a, b = 2 * i + 1, 2 * i + 2
            self.count[i], self.low[i], self.high[i] = self.count[a] + self.count[b], np.minimum(self.low[a], self.low[b]), np.maximum(self.high[a], self.high[b])
        self.chunks = -(-self.count[self.leaves - 1 :] // (4 * LEAF))

    def bound(self, x: np.ndarray, need: int) -> np.ndarray:
        """A distance within which each point has need sites: the far corner of the smallest node about it that has so many."""
        node = self.leaf(x) + self.leaves - 1
        while (few := (self.count[node] < need) & (node > 0)).any():
            node = np.where(few, (node - 1) // 2, node)
        far = np.sqrt((np.maximum(np.abs(x - self.low[node]), np.abs(x - self.high[node])) ** 2).sum(1))
        return np.where(self.count[node] < need, np.inf, far)

    def visits(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a point and a leaf that may hold sites within its bound."""
        points, leaves, todo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [(0, np.arange(len(x)))]
        while todo:
            node, i = todo.pop()
            if not len(i) or not self.count[node]:
                continue
            near = np.sqrt((np.maximum(0, np.maximum(self.low[node] - x[i], x[i] - self.high[node])) ** 2).sum(1))
            i = i[near <= bound[i] * (1 + 1e-9)]
            if node >= self.leaves - 1:
                points.append(i)
                leaves.append(np.full(len(i), node - (self.leaves - 1)))
            else:
                todo += [(2 * node + 1, i), (2 * node + 2, i)]
        return np.concatenate(points), np.concatenate(leaves)


def _xyz(t: pa.Table | pa.RecordBatch, names: str) -> np.ndarray:
    return np.stack([t.column(c).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t.column(c).to_numpy() for c in names.split()], axis=1)


def _known(df: DataFrame, *names: str) -> DataFrame:
    """Rows whose coordinates are neither null nor NaN."""
    for c in names:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(c))
    return df


def neighbours(points: DataFrame, sites: DataFrame, k: int, reach: float = float("inf"), itself: bool = True) -> DataFrame:
    """(id, site, value, d, r): of each point (id, x, y, z) the k nearest sites (site, sx, sy, sz, value) within reach, r from 1, the smaller
    number at ties; exact at any number of either. Without itself, a point's own number is no site of it.

    Sites lie in the leaves of a tree. A point is first sought in its own leaf; its k-th distance there bounds which leaves it must visit.
    Large leaves are cut in chunks, and the points of a chunk in tasks, so that no task's memory grows with the tables. Points or sites without
    coordinates have no neighbours."""
    p = _known(points.select("id", *[F.col(c).cast("double").alias(c) for c in "xyz"]), *"xyz")
    s = _known(sites.select("site", *[F.col(f"s{c}").cast("double").alias(f"s{c}") for c in "xyz"], F.col("value").cast("double").alias("value")), "sx", "sy", "sz")
    ids, names = p.schema["id"].dataType.simpleString(), s.schema["site"].dataType.simpleString()
    n = s.count()
    need = k if itself else k + (s.groupBy("site").count().agg(F.max("count")).first()[0] or 0)
    leaves = 1
    while leaves < LEAVES and n > leaves * max(LEAF, 4 * need):
        leaves *= 2
    sample = s.select("sx", "sy", "sz")
    if leaves > 1:
        sample = sample.sample(min(1.0, SAMPLED * leaves / n)).collect()
    tree = Tree(np.array(sample if leaves > 1 else [], float).reshape(-1, 3), leaves)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.leaf(_xyz(b, "sx sy sz")), pa.int64())], [*b.schema.names, "leaf"])

    s = s.mapInArrow(homes, f"site {names}, sx double, sy double, sz double, value double, leaf long")
    tree.fill([tuple(r) for r in s.groupBy("leaf").agg(F.count("*"), *[f(f"s{c}") for f in (F.min, F.max) for c in "xyz"]).collect()])
    if (tree.chunks > 1).any():
        cut = s.sparkSession.createDataFrame([(i, int(c)) for i, c in enumerate(tree.chunks) if c > 1], "leaf long, chunks long")
        s = s.join(F.broadcast(cut), "leaf", "left").withColumn("chunk", F.expr("pmod(xxhash64(site, sx, sy, sz, value), coalesce(chunks, 1))")).drop("chunks")
    else:
        s = s.withColumn("chunk", F.lit(0).cast("long"))

    def search(p: DataFrame, home: bool) -> DataFrame:
        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _xyz(b, "x y z")
                bound = np.minimum(np.minimum(b.column("bound").to_numpy(zero_copy_only=False), reach), tree.bound(x, need) * (1 + 1e-9))
                i, leaf = (np.arange(len(x)), tree.leaf(x)) if home else tree.visits(x, bound)
                times = tree.chunks[leaf]
                chunk = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                i, leaf = np.repeat(i, times), np.repeat(leaf, times)
                for a in range(0, len(i), 50_000):
                    c = slice(a, a + 50_000)
                    at = pa.array(i[c])
                    yield pa.RecordBatch.from_arrays([*(b.column(f).take(at) for f in ("id", "x", "y", "z")), pa.array(bound[i[c]]), pa.array(leaf[c]), pa.array(chunk[c])], ["id", "x", "y", "z", "bound", "leaf", "chunk"])

        def seek(points: pa.Table, sites: pa.Table) -> pa.Table:
            sites = sites.sort_by("site")
            x, y = _xyz(points, "x y z"), _xyz(sites, "sx sy sz")
            bound, m = points.column("bound").to_numpy(), min(k, len(y))
            own = None if itself else (points.column("id").to_numpy(), sites.column("site").to_numpy())
            found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
            for a in range(0, len(x) if m else 0, 256):
                e = x[a : a + 256]
                d = np.sqrt(sum(((e[:, None, c] - y[None, :, c]) ** 2 for c in range(3)), 0.0))
                if own:
                    d[own[0][a : a + 256, None] == own[1][None]] = np.inf
                d[d > bound[a : a + 256, None] * (1 + 1e-9)] = np.inf
                i, j = np.nonzero((d <= np.partition(d, m - 1, axis=1)[:, m - 1 : m]) & np.isfinite(d))
                v = d[i, j]
                order = np.lexsort((j, v, i))
                i, j, v = i[order], j[order], v[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < k
                for f, new in zip(found, (i[best] + a, j[best], v[best])):
                    f.append(new)
            i, j, v = map(np.concatenate, found)
            return pa.table([points.column("id").take(pa.array(i)), sites.column("site").take(pa.array(j)), sites.column("value").take(pa.array(j)), pa.array(v)], names=["id", "site", "value", "d"])

        v = p.mapInArrow(visit, f"id {ids}, x double, y double, z double, bound double, leaf long, chunk long")
        most = v.groupBy("leaf", "chunk").count().agg(F.max("count")).first()[0] or 0
        tasks = -(-most // TASK_POINTS)
        t = s
        if tasks > 1:
            v, t = v.withColumn("task", F.expr(f"pmod(xxhash64(id, x, y, z), {tasks})")), s.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)).cast("array<bigint>")))
        keys = ["leaf", "chunk", *["task"] * (tasks > 1)]
        near = v.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInArrow(seek, f"id {ids}, site {names}, value double, d double")
        return near.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("d", "site"))).filter(F.col("r") <= k)

    p = p.withColumn("bound", F.lit(float("inf")))
    if leaves > 1:
        own = search(p, True).filter(F.col("r") == k).select(F.col("id").alias("_id"), F.col("d").alias("_d"))
        p = p.join(own, F.col("id").eqNullSafe(F.col("_id")), "left").select("id", *"xyz", F.coalesce("_d", "bound").alias("bound"))
    return search(p, False)


def nearest(points: DataFrame, sites: DataFrame, itself: bool = True) -> DataFrame:
    """(id, site, d): each point's nearest site, the smaller number at ties."""
    return neighbours(points, sites, 1, itself=itself).select("id", "site", "d")


def interpolate(points: DataFrame, sites: DataFrame, k: int = 10, reach: float = 10.0, itself: bool = True) -> DataFrame:
    """(id, value): inverse-distance mean of the k nearest sites' values within reach."""
    near = neighbours(points, sites, k, reach, itself).filter(F.col("d") <= reach)
    w = 1 / (F.col("d") + 1e-10)
    return near.groupBy("id").agg((F.sum(w * F.col("value")) / F.sum(w)).alias("value"))


def parcellate(df: DataFrame, value: str = "x", label: str = "label") -> DataFrame:
    """Each row's value becomes its label's mean: one aggregate, then a join to its few rows."""
    m = df.groupBy(label).agg(F.avg(value).alias("_m"))
    return df.join(m, label).withColumn(value, F.col("_m")).drop("_m")
