"""Near-duplicate embeddings by cross-polytope hashing.

A vector is padded to a power of two, and rotated by three rounds of random signs and the fast Hadamard transform; its
hash is the nearest vertex of the cross-polytope (the largest coordinate and its sign). A bucket is the vertices of some rotations; there
are independent tables. In each table a vector lies in its own bucket and asks also in the next ones (probes), which change to further
vertices where the coordinates' gap is least. Vectors of one label that meet are candidates; each pair is verified once by its cosine in
double precision. A label with more vectors takes more rotations, so that buckets stay small and candidates follow the number of vectors;
tables and probes by rotations (`PLANS`) were chosen by measured recall.

Equal vectors of a label form a class, which takes part once with its number of copies. Rows carry a vector's buckets in all tables,
so that a pair which shares several makes a candidate in the first alone. Buckets are joined by equality; none is
gathered in a task, and adaptive joins split a crowded one.

Recall is measured in the tests against brute force: with the production parameters above 0.995 of pairs at the threshold itself.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do those whose label
is null; vectors of different lengths don't link. Repeated rows, also of one vec_id, are vectors of their own, and
equal ones link. A null vec_id gives its row and doesn't count as smallest. Other columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import lean_alone, lean_udf, settle, table, written
from tessera.llm.graph import components

THRESHOLD, SEED = 0.93, 17
#: Tables and probes by the number of rotations.
PLANS = {2: (5, 7), 3: (6, 24), 4: (8, 32)}
#: Vectors of a label that a vector is expected to meet in its buckets, were vectors spread evenly; beyond that, another rotation.
MEET = 100


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows, whose length is a power of two, scaled to keep norms."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotated(x: np.ndarray, seed: list[int]) -> np.ndarray:
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, x.shape[1]))
    for s in signs:
        x = hadamard(x * s)
    return x


def buckets(x: np.ndarray, tables: int, rotations: int, probes: int, seed: int) -> np.ndarray:
    """(rows, tables, 1 + probes) buckets of unit vectors: the own one first, then the nearest others."""
    d = 1 << max(1, int(x.shape[1] - 1).bit_length())
    x = np.concatenate([x, np.zeros((len(x), d - x.shape[1]))], 1)
    most = min(2 * d, probes + 1)
    out = np.zeros((len(x), tables, probes + 1), np.int64)
    for t in range(tables):
        codes, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for r in range(rotations):
            y = rotated(x, [seed, t, r])
            vertices = np.concatenate([y, -y], 1)
            top = np.argsort(-vertices, 1, kind="stable")[:, :most]
            gap = vertices[np.arange(len(x))[:, None], top]
            gap = gap[:, :1] - gap
            codes = (codes[:, :, None] * (2 * d) + top[:, None, :]).reshape(len(x), -1)
            loss = (loss[:, :, None] + (gap**2)[:, None, :]).reshape(len(x), -1)
            best = np.argsort(loss, 1, kind="stable")[:, : probes + 1]
            codes, loss = np.take_along_axis(codes, best, 1), np.take_along_axis(loss, best, 1)
        out[:, t, : codes.shape[1]] = codes
        out[:, t, codes.shape[1] :] = codes[:, :1]
    return out


def usable(v: list | None) -> np.ndarray | None:
    """The vector in double precision, if it can link."""
    if not v or any(x is None for x in v):
        return None
    a = np.asarray(v, np.float64)
    return a if np.isfinite(a).all() and a.any() and np.isfinite(a @ a) and a @ a > 0 else None


def prepared(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, key, label, vector): vector packed in double precision; key names equal vectors of a label, null if it can't link."""
    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, raw = [], []
            for label, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                a = usable(v) if label is not None else None
                raw.append(None if a is None else (a + 0.0).tobytes())
                keys.append(None if a is None else xxhash.xxh3_128_digest(label.encode() + b"\0" + raw[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), b.column(1), pa.array(raw, pa.binary())], ["vec_id", "key", "label", "vector"])

    return src.mapInArrow(lean_alone(run), f"vec_id {kind}, key binary, label string, vector binary")


def rotations_of(n: int | Column, vertices: int | Column) -> Column:
    """Rotations for n vectors of one label whose polytope has so many vertices."""
    n, vertices = (x if isinstance(x, Column) else F.lit(x) for x in (n, vertices))
    few = F.lit(max(PLANS))
    for r in sorted(PLANS, reverse=True)[1:]:
        few = F.when(n * PLANS[r][0] * (PLANS[r][1] + 1) <= MEET * F.pow(vertices.cast("double"), r), r).otherwise(few)
    return few.cast("int")


def hashed(classes: DataFrame, seed: int) -> DataFrame:
    """(key, label, own array<long>, places array<long>): own buckets by table; places: all probes by table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2).to_pylist()
            size, turns = np.array([len(r) for r in raw], np.int64), b.column(3).to_numpy()
            own, places = [None] * len(raw), [None] * len(raw)
            for s, r in {*zip(size.tolist(), turns.tolist())}:
                rows = np.flatnonzero((size == s) & (turns == r))
                x = np.stack([np.frombuffer(raw[i], np.float64) for i in rows])
                x = x / np.abs(x).max(1)[:, None]
                got = buckets(x / np.sqrt((x * x).sum(1))[:, None], PLANS[r][0], r, PLANS[r][1], seed) * 1024 + s // 8 % 1024
                for i, g in zip(rows, got):
                    own[i], places[i] = g[:, 0], g.reshape(-1)
            lists = lambda m: pa.array(m, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists(own), lists(places)], ["key", "label", "own", "places"])

    sized = classes.select("key", "label", "vector", F.octet_length("vector").alias("size"))
    most = sized.groupBy("label", "size").agg(F.count("*").alias("n"))
    vertices = 2 * F.pow(F.lit(2), F.greatest(F.lit(1), F.ceil(F.log2(F.col("size") / 8))))
    turned = sized.join(most, ["label", "size"]).select("key", "label", "vector", rotations_of(F.col("n"), vertices).alias("turns"))
    return turned.mapInArrow(lean_alone(run), "key binary, label string, own array<long>, places array<long>")


def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """-1 for vectors of different lengths."""
    size, other = a.str.len().to_numpy(np.int64), b.str.len().to_numpy(np.int64)
    out = np.full(len(a), -1.0)
    for s in np.unique(size):
        rows = np.flatnonzero((size == s) & (other == s))
        u, v = (np.frombuffer(b"".join(c.iloc[rows]), np.float64).reshape(len(rows), -1) for c in (a, b))
        dot = lambda x, y: np.einsum("ij,ij->i", x, y)
        out[rows] = dot(u, v) / np.sqrt(dot(u, u)) / np.sqrt(dot(v, v))
    return pd.Series(out)


cosines = lean_udf(cosine, T.DoubleType())


def candidates(classes: DataFrame, seed: int = SEED) -> DataFrame:
    """Pairs (a, b), a < b, of classes (key, label, vector) that meet in a bucket, each once."""
    at = written(hashed(classes, seed), "buckets")
    base = at.select("key", "label", "own", F.posexplode("own").alias("t", "bucket"))
    each = (F.size("places") / F.size("own")).cast("int")
    asks = at.select("key", "label", "own", each.alias("each"), F.posexplode("places").alias("i", "bucket")).withColumn("t", F.expr("cast(i div each as int)")).drop("i", "each").distinct()
    met = asks.select(F.col("key").alias("x"), "label", "t", "bucket", F.col("own").alias("ox")).join(base.select(F.col("key").alias("y"), "label", "t", "bucket", F.col("own").alias("oy")), ["label", "t", "bucket"]).filter("x != y")
    shared = F.exists(F.zip_with("ox", "oy", lambda p, q: p == q), lambda e: e)
    first = F.array_position(F.zip_with("ox", "oy", lambda p, q: p == q), True) - 1
    # vectors that share own buckets make their candidate in the first of them, once; others where a probe finds them
    once = (shared & (first == F.col("t")) & (F.col("x") < F.col("y")) & (F.element_at("ox", F.col("t") + 1) == F.col("bucket"))) | ~shared
    return met.filter(once).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def links_of(classes: DataFrame, threshold: float, seed: int) -> DataFrame:
    """Links (a, b, cosine), a < b, between classes (key, label, vector)."""
    one, two = (classes.select(F.col("key").alias(k), F.col("vector").alias(f"v{k}")) for k in "ab")
    found = candidates(classes, seed).join(one, "a").join(two, "b").withColumn("cosine", cosines("va", "vb"))
    return written(found.filter(F.col("cosine") >= threshold).select("a", "b", "cosine"), "near")


def deduplicated(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, seed: int = SEED) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept) of all rows of df."""
    settle(df.sparkSession)
    rows = written(prepared(df, id_col, vector_col, label_col), "vectors")
    classes = written(rows.filter("key is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("vec_id").alias("first")), "classes")
    links = links_of(classes, threshold, seed)
    both = links.select("a", "b").union(links.select("b", "a"))
    others = both.join(classes.select(F.col("key").alias("b"), "copies"), "b").groupBy(F.col("a").alias("key")).agg(F.sum("copies").alias("others"))
    labels = components(links).select(F.col("v").alias("key"), F.col("label").alias("root"))
    least = labels.join(classes.select("key", "first"), "key").groupBy("root").agg(F.min("first").alias("component"))
    linked = others.join(labels, "key").join(least, "root").select("key", "others", "component")
    facts = classes.join(linked, "key", "left").select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), F.coalesce("component", "first").alias("component"))
    return (
        rows.select("vec_id", "key").join(facts, "key", "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
with v as (
  select row_number() over () as r, vec_id, label, cast(embedding as double[]) as e,
    label is not null and embedding is not null and len(embedding) > 0
      and not list_bool_or(list_transform(embedding, lambda x: x is null or isnan(x) or isinf(x)))
      and list_bool_or(list_transform(embedding, lambda x: x is not null and x <> 0)) as ok
  from embeddings),
u as (select r, vec_id, label, e, len(e) as n, sqrt(list_dot_product(e, e)) as norm from v where ok),
l as (select a.r as a, b.r as b from u a join u b on a.label = b.label and a.n = b.n and a.r <> b.r
  where list_dot_product(a.e, b.e) / a.norm / b.norm >= 0.93),
reach as (
  with recursive t(v, w) as (select r, r from v union select t.v, l.b from t join l on l.a = t.w) select * from t),
comp as (select reach.v, min(v.vec_id) as component_id from reach join v on v.r = reach.w group by 1),
deg as (select a, count(*) as n_links from l group by 1)
select vec_id, cast(coalesce(n_links, 0) as bigint) as n_links, component_id, coalesce(vec_id = component_id, true) as kept
from v left join comp on comp.v = v.r left join deg on deg.a = v.r
"""
