"""Exact Jaccard similarity join of documents' shingle sets in their metric space.

A document's set holds 64-bit hashes of its distinct 5-word shingles (ASCII lower case, ASCII white space); with fewer
words, the whole sequence as one. Documents with equal sets form a class, which takes part once, with its number of
copies. The Jaccard distance 1 - J is a metric; classes link at a distance of at most theta (0.1).

1. Pivots are one-shingle sets. A set is nearest to the pivots it holds, all at the distance 1 - 1/n; ties go to the
   first in one order of all shingles, rare ones first. A set's home region is that of its first pivot. A neighbour
   within theta misses at most n - ceil(0.9 n) of its shingles, so every neighbour holds one of the first
   n - ceil(0.9 n) + 1: to these regions the set is copied (its boundary window). Linked sets meet in the region of the
   first shingle they share. The order decides how large regions get, not what is found:
   shingles that many documents share are counted, and the most frequent ones, a bounded list, come last.
2. A large region is split again around a document of its own: each set goes to the band of its distance to that pivot
   and to the following bands that the window of theta reaches, by the triangle inequality; bands that stay large are split
   in turn.
3. Within a region sets meet by size (a step of a logarithmic scale and the next), and what sizes and the places of the
   shared shingle allow becomes a candidate. Candidates from all regions, each once, are verified exactly, by the
   differences of their sets to a pivot that they have in common.

Defined cases: null or empty text, or one of white space only: an empty set, n_shingles 0, linked with nothing, its
component is its own doc_id. Repeated rows, also with one doc_id, are documents of their own. A null doc_id gives its row;
it doesn't count as smallest while another id is in the component. Other columns are not read.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import drop, fresh, lean_alone, lean_udf, settle, table, unused, written
from tessera.llm.graph import components

SHINGLE, PERCENT = 5, 90
#: Shingles that come last in the order: those counted most often, and how often in some bytes of sets counts.
HOT, HOT_LOCAL, HOT_BYTES = 500_000, 3, 8 << 20
#: Regions of more sets are split around documents of their own, while that leaves at most this share of a region's sets together.
REGION, SHRINK = 256, 0.8
#: Most class keys in a table that is broadcast for filtering sets (32 MB); larger tables are joined by shuffle.
BROADCAST_ROWS = 1_000_000
CACHED = 200_000
#: Parts of all shingles in a set's profile.
PROFILE = 128
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


class Shingles:
    """Sets of texts; words' hashes are remembered."""

    def __init__(self, k: int = SHINGLE):
        self.k, self.memory = k, {}

    def of(self, text: str) -> np.ndarray:
        """Sorted distinct hashes."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.memory) > CACHED:
            self.memory.clear()
        if new := set(words).difference(self.memory):
            one = xxhash.xxh3_64_intdigest
            self.memory.update((w, one(w)) for w in new)
        h = np.fromiter(map(self.memory.__getitem__, words), np.uint64, len(words))
        if len(h) < self.k:
            return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
        n = len(h) - self.k + 1
        with np.errstate(over="ignore"):
            s = np.zeros(n, np.uint64)
            for i in range(self.k):
                s = (s ^ h[i : i + n]) * ODD[i % 5]
                s ^= s >> np.uint64(31)
        return np.unique(s)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least number of its n shingles that a linked set shares."""
    return -(-percent * n // 100)


def sets_of(df: DataFrame, id_col: str, text_col: str, k: int = SHINGLE) -> DataFrame:
    """(doc_id, key, n, hashes): key is a 128-bit digest of the set, null if it is empty; hashes are packed 64-bit numbers."""
    settle(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Shingles(k)
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, len(texts), 1000):
                sets = [maker.of(t or "") for t in texts.slice(at, 1000).to_pylist()]
                raw = [s.tobytes() for s in sets]
                keys = [xxhash.xxh3_128_digest(r) if r else None for r in raw]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1000), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(raw, pa.binary())], ["doc_id", "key", "n", "hashes"])

    return df.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(lean_alone(run), f"doc_id {kind}, key binary, n int, hashes binary")


def hot_shingles(sets: DataFrame) -> np.ndarray:
    """The HOT most frequent shingles, ascending in frequency, by counts over some HOT_BYTES of sets in which they come HOT_LOCAL times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            v, c = np.unique(np.frombuffer(b"".join(held), np.uint64), return_counts=True)
            often = c >= HOT_LOCAL
            return pa.RecordBatch.from_arrays([pa.array(v[often].view(np.int64)), pa.array(c[often])], ["s", "c"])

        for b in batches:
            new = [r for r in b.column(0).to_pylist() if r]
            held += new
            size += sum(map(len, new))
            if size > HOT_BYTES:
                yield counted()
                held, size = [], 0
        yield counted()

    rows = sets.select("hashes").mapInArrow(lean_alone(run), "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "s").limit(HOT).select("s")
    found = np.concatenate([c.to_numpy() for c in rows.toArrow()["s"].chunks] or [np.zeros(0, np.int64)]).view(np.uint64)
    return found[::-1].copy()


def windows(sets: DataFrame, hot: np.ndarray, percent: int) -> DataFrame:
    """(key, n, window, profile): the first shingles of each set in the order, to whose regions it goes, and how many of its
    shingles lie in each of PROFILE parts of all shingles."""
    spark = sets.sparkSession
    order = np.argsort(hot)
    shared = spark.sparkContext.broadcast((hot[order], order.astype(np.int64)))  # at most HOT numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rank = shared.value
        for b in batches:
            n = b.column(1).to_numpy()
            raw = b.column(2).to_pylist()
            flat = np.frombuffer(b"".join(raw), np.uint64)
            at = np.minimum(np.searchsorted(names, flat), max(0, len(names) - 1))
            place = np.where(names[at] == flat, rank[at] + 1, 0) if len(names) else np.zeros(len(flat), np.int64)
            cuts, out, profiles = np.concatenate([[0], np.cumsum(n)]), [], []
            for i, size in enumerate(n):
                s, p = flat[cuts[i] : cuts[i + 1]], place[cuts[i] : cuts[i + 1]]
                take = int(size - needed(size, percent) + 1)
                profiles.append(np.minimum(np.bincount((s % np.uint64(PROFILE)).astype(np.int64), minlength=PROFILE), 65535).astype(np.uint16).tobytes())
                if p.any():
                    s = s[np.argsort(p, kind="stable")]  # shingles of one rank stay ascending
                out.append(s[:take].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*out, np.zeros(0, np.int64)]))), pa.array(profiles, pa.binary())], ["key", "n", "window", "profile"])

    return sets.select("key", "n", "hashes").filter("key is not null").mapInArrow(lean_alone(run), "key binary, n int, window array<long>, profile binary")


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """1 - J of two sorted sets."""
    both = shared(a, b)
    return 1.0 - both / (len(a) + len(b) - both)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def sets_in(c: pd.Series) -> Iterator[np.ndarray]:
    return (np.frombuffer(x, np.uint64) for x in c)


distances = lean_udf(lambda a, b: pd.Series([distance(x, y) for x, y in zip(sets_in(a), sets_in(b))], dtype="float64"), T.DoubleType())
overlaps = lean_udf(lambda a, b: pd.Series([shared(x, y) for x, y in zip(sets_in(a), sets_in(b))], dtype="int32"), T.IntegerType())
differences = lean_udf(lambda a, b: pd.Series([np.setxor1d(x, y, assume_unique=True).tobytes() for x, y in zip(sets_in(a), sets_in(b))]), T.BinaryType())


def profile_gaps(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = (np.frombuffer(b"".join(c), np.uint16).reshape(-1, PROFILE).astype(np.int32) for c in (a, b))
    return pd.Series(np.abs(x - y).sum(1, dtype=np.int64))


gaps = lean_udf(profile_gaps, T.LongType())


def kept_sets(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, hashes) of the classes in keys, each once. Few keys are broadcast to filter the sets where they are read; beyond
    BROADCAST_ROWS both sides are shuffled."""
    keys = written(keys.distinct(), "keys")
    few = keys.count() <= BROADCAST_ROWS
    met = sets.select("key", "hashes").join(F.broadcast(keys) if few else keys, "key", "left_semi")
    return met.groupBy("key").agg(F.first("hashes").alias("hashes"))


def split_regions(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (region, key, n, pos) with regions of more than REGION sets split around a document of theirs.

    A region's pivot is its smallest key. Its sets go to the band of their distance to the pivot, and to the following
    bands as far as theta reaches: two sets within theta of each other differ by theta at most in that distance, so they
    meet. Bands that are still large are split again around their own pivots, until they are small or a split leaves more than SHRINK of
    them together: such sets lie all about as far from each other, and are left to sizes, places and profiles."""
    theta = 1 - percent / 100
    done, rows = [], rows.withColumn("before", F.lit(1 << 62))
    while True:
        crowd = rows.groupBy("region").agg(F.count("*").alias("m"), F.min("key").alias("pivot"), F.min("before").alias("before"))
        large = written(crowd.filter((F.col("m") > REGION) & (F.col("m") <= F.col("before") * SHRINK)), "regions")
        if large.isEmpty():
            break
        done.append(rows.join(large.select("region"), "region", "left_anti"))
        inside = rows.drop("before").join(large.select("region", "pivot", "m"), "region")
        held = written(kept_sets(sets, inside.select("key")), "region-sets")
        to = held.select(F.col("key").alias("pivot"), F.col("hashes").alias("q"))
        near = inside.select("key", "pivot").distinct().join(held, "key").join(to, "pivot").select("key", "pivot", distances("hashes", "q").alias("d"))
        first, last = F.floor(F.col("d") / theta), F.floor((F.col("d") + theta + 1e-9) / theta)
        split = inside.join(near, ["key", "pivot"]).select(F.explode(F.sequence(first, last)).alias("band"), "region", "pivot", "key", "n", "pos", "m")
        rows = written(split.select(F.xxhash64("region", "pivot", "band").alias("region"), "key", "n", "pos", F.col("m").alias("before")), "regions")
        drop(held)
    for d in done:
        rows = rows.unionByName(d)
    return rows.drop("before")


def candidates(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, that may link: they share a region and their sizes and places in the order allow it."""
    rows = classes.select("key", "n", F.posexplode("window").alias("pos", "region"))
    # most regions hold one set: they are counted by their hashes alone, and only the others' sets are read again
    crowded = written(rows.groupBy("region").agg(F.count("*").alias("m")).filter("m > 1").select("region"), "crowded")
    few = crowded.count() <= BROADCAST_ROWS
    inner = split_regions(written(rows.join(F.broadcast(crowded) if few else crowded, "region"), "members"), sets, percent)
    # sizes that link lie within one step of this scale (a little wider than the threshold): a set meets its own step and the next
    inner = inner.withColumn("step", F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100.0) * 1.000001)))
    left = inner.select("region", F.explode(F.array("step", F.col("step") + 1)).alias("step"), *[F.col(c).alias(f"{c}_a") for c in ("key", "n", "pos")])
    right = inner.select("region", "step", *[F.col(c).alias(f"{c}_b") for c in ("key", "n", "pos")])
    pairs = left.join(right, ["region", "step"]).filter((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("key_a") < F.col("key_b"))))
    least = F.ceil((F.col("n_a") + F.col("n_b")) * F.lit(percent) / F.lit(100.0 + percent) - 1e-9)
    most = F.least("pos_a", "pos_b") + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    ok = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (most >= least)
    return pairs.filter(ok).select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct()


def links_of(sets: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between classes, a < b, and the classes (key, n, window). sets: a written table of sets_of()."""
    hot = hot_shingles(sets)
    classes = written(windows(sets, hot, percent).groupBy("key").agg(F.first("n").alias("n"), F.first("window").alias("window"), F.first("profile").alias("profile")), "classes")
    pairs = written(possible(candidates(classes, sets, percent), classes, percent), "candidates")
    unused(sets.sparkSession)
    links = written(verified(pairs, sets, percent), "similar")
    drop(pairs)
    return links, classes


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that the distances of their sets to the empty one, part by part of all shingles, allow to link: in each part
    the triangle inequality bounds the difference of the sets from below, and the parts' bounds add up."""
    one, two = (classes.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("profile").alias(f"p{k}")) for k in "ab")
    apart = gaps("pa", "pb")
    met = pairs.join(one, "a").join(two, "b").withColumn("s", apart)
    return met.filter((F.col("na") + F.col("nb") - F.col("s")) * 100 >= (F.col("na") + F.col("nb") + F.col("s")) * percent).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link.

    Every component of candidates has a pivot, its smallest key, and each of its sets is written once as its symmetric difference
    to the pivot, which for near copies is short. The difference of two sets is the difference of those two differences,
    and its size is bounded by theirs (the triangle inequality), so that many pairs are ruled out or in before any is compared."""
    named = components(pairs).select(F.col("v").alias("key"), F.col("label").alias("pivot"))
    held = written(kept_sets(sets, named.select("key")), "candidate-sets")
    to = held.select(F.col("key").alias("pivot"), F.col("hashes").alias("q"))
    moved = written(held.join(named, "key").join(to, "pivot").select("key", (F.octet_length("hashes") / 8).cast("long").alias("n"), differences("hashes", "q").alias("d")), "differences")
    size = lambda c: (F.octet_length(c) / 8).cast("long")
    one, two = (moved.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), size("d").alias(f"m{k}")) for k in "ab")
    # with an intersection i and a difference s of the sets: 2 i = n_a + n_b - s, and the union is i + s
    link = lambda s: (F.col("na") + F.col("nb") - s) * 100 >= (F.col("na") + F.col("nb") + s) * percent
    measured = pairs.join(one, "a").join(two, "b").filter(link(F.abs(F.col("ma") - F.col("mb"))))
    sure = link(F.col("ma") + F.col("mb"))
    open_ = measured.filter(~sure)
    da, db = (moved.select(F.col("key").alias(k), F.col("d").alias(f"d{k}")) for k in "ab")
    apart = F.col("ma") + F.col("mb") - 2 * overlaps("da", "db")
    found = open_.join(da, "a").join(db, "b").withColumn("s", apart).filter(link(F.col("s")))
    return measured.filter(sure).select("a", "b").unionByName(found.select("a", "b"))


def component_facts(sets: DataFrame, percent: int) -> DataFrame:
    """(key, similar, component, root, copies) of each class: links of one of its documents, the smallest id and a name of its component."""
    links, _ = links_of(sets, percent)
    classes = sets.filter("key is not null").groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    both = links.union(links.select("b", "a"))
    linked = both.join(classes.select(F.col("key").alias("b"), "copies"), "b").groupBy(F.col("a").alias("key")).agg(F.sum("copies").alias("others"))
    labels = components(links).select(F.col("v").alias("key"), F.col("label").alias("root"))
    firsts = labels.join(classes.select("key", "first"), "key")
    least = firsts.groupBy("root").agg(F.min("first").alias("component"))
    linked = linked.join(labels, "key").join(least, "root").select("key", "others", "component", "root")
    return classes.join(linked, "key", "left").select("key", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("similar"), F.coalesce("component", "first").alias("component"), F.coalesce("root", "key").alias("root"), "copies")


def joined(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, n_shingles, n_similar, component_id, class_size) of all rows of df."""
    sets = written(sets_of(df, id_col, text_col, k), "sets")
    facts = component_facts(sets, percent)
    return sets.select("doc_id", "key", "n").join(facts, "key", "left").select(
        F.col("doc_id").alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("similar", F.lit(0)).cast("long").alias("n_similar"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("class_size"),
    )


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """One row of each component of df, with its columns: that of the smallest id (one without an id only where no other has
    one; of rows with one id that of the smallest key, then any, as their sets are equal). Rows without words all stay.

    Texts aren't shuffled: what goes is filtered out by its id, broadcast up to BROADCAST_ROWS; only rows whose id is null
    or not unique are told apart by their sets again."""
    sets = written(sets_of(df, id_col, text_col, k), "sets")
    facts = written(component_facts(sets, percent).select("key", "root"), "components")
    rows = sets.filter("key is not null").select("doc_id", "key").join(facts, "key")
    stays = written(rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("x")).select("x.doc_id", "x.key"), "stays")
    many = sets.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    twice = written(many.filter("n > 1").select("doc_id"), "twice")
    goes = written(many.filter("n = 1 and key is not null").join(stays.select("doc_id"), "doc_id", "left_anti").select("doc_id").union(twice), "goes")
    cheap = goes.count() <= BROADCAST_ROWS
    (i, key) = fresh(df, "row_id", "row_key")
    ids = goes.select(F.col("doc_id").alias(i))
    clear = df.filter(F.col(id_col).isNotNull()).join(F.broadcast(ids) if cheap else ids, df[id_col] == F.col(i), "left_anti")
    few = twice.count() <= BROADCAST_ROWS
    named = twice.select(F.col("doc_id").alias(i))
    odd = df.filter(F.col(id_col).isNotNull()).join(F.broadcast(named) if few else named, df[id_col] == F.col(i), "left_semi").unionByName(df.filter(F.col(id_col).isNull()))

    def key_of(text: pd.Series) -> pd.Series:
        maker = Shingles(k)
        return pd.Series([xxhash.xxh3_128_digest(s.tobytes()) if len(s := maker.of(t or "")) else None for t in text])

    keyed = odd.withColumn(key, lean_udf(key_of, "binary")(F.col(text_col)))
    chosen = stays.select(F.col("doc_id").alias(i), F.col("key").alias("key_"))
    one = keyed.filter(F.col(key).isNotNull()).dropDuplicates([id_col, key]).join(chosen, keyed[id_col].eqNullSafe(F.col(i)) & (keyed[key] == F.col("key_")), "left_semi")
    return clear.unionByName(one.select(*df.columns)).unionByName(keyed.filter(F.col(key).isNull()).select(*df.columns))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
with w as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents),
s as (
  select r, doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
    else list_distinct([array_to_string(words[i:i + 4], ' ') for i in generate_series(1, len(words) - 4)]) end as set_
  from w),
c as (select list_sort(set_) as set_, min(doc_id) as first_, count(*) as copies, any_value(len(set_)) as n, row_number() over () as id from s where len(set_) > 0 group by 1),
e as (select id, n, md5_number_lower(unnest(set_)) as h from c),
p as (select a.id as a, b.id as b, count(*) as i, any_value(a.n) as na, any_value(b.n) as nb from e a join e b on a.h = b.h and a.id < b.id and 100 * a.n >= 90 * b.n and 100 * b.n >= 90 * a.n group by 1, 2),
l as (select a, b from p where 100 * i >= 90 * (na + nb - i)),
both_ as (select a, b from l union all select b, a from l),
reach as (
  with recursive t(v, u) as (select id, id from c union select t.v, both_.b from t join both_ on both_.a = t.u) select * from t),
comp as (select v, min(c.first_) as component_id from reach join c on c.id = reach.u group by v),
deg as (select a as v, sum(copies) as others from both_ join c on c.id = both_.b group by a)
select s.doc_id, cast(len(s.set_) as bigint) as n_shingles, cast(coalesce(c.copies - 1 + coalesce(deg.others, 0), 0) as bigint) as n_similar,
  coalesce(comp.component_id, s.doc_id) as component_id, cast(coalesce(c.copies, 1) as bigint) as class_size
from s left join c on list_sort(s.set_) = c.set_ left join comp on comp.v = c.id left join deg on deg.v = c.id
"""
