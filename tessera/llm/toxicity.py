"""Toxicity by a factorization machine over hashed terms.

A text's features are the distinct hashed terms in it: its words in lower case without outer punctuation, and the
words' first four and five characters, each hashed to one of `BUCKETS`. The machine scores
w0 + sum w_i + sum_{i<j} <v_i, v_j>: the factors learn pairs of terms that mean more together than their weights add
up to. It is fitted by Adagrad on log-loss in one task, on a bounded sample of at most `sample` labelled rows (the
first by hash of the id), over terms
whose log-likelihood ratio with the label is at least `EVIDENCE` (0.1 %). The model's size is bounded by BUCKETS; it is broadcast.

Defined cases: null and empty texts have no terms and score as the bias says. With no labelled rows, or with one
label only, the score is the share of label 1 (0 without rows). Null labels are not learned; of several labels of one id
each counts. Repeated rows and null ids give one row each; other columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, fresh, held, lean, lean_udf, settle

BUCKETS, SAMPLE, MIN_DF, FACTORS, EPOCHS = 1 << 20, 20_000, 4, 4, 8
#: Least log-likelihood ratio of a term with the label; L1 weight; rate of learning.
EVIDENCE, LASSO, RATE = 10.8, 0.2, 0.15
CACHED = 150_000
EDGE = ".,;:!?\"'()[]{}|-_*#<>=/\\…«»“”„’`~"


def terms(word: str) -> tuple[int, int, int]:
    w = word.lower().strip(EDGE)
    if not w:
        return -1, -1, -1
    h = lambda x: xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass")) % BUCKETS
    return h("w" + w), h("p" + w[:4]) if len(w) > 4 else -1, h("q" + w[:5]) if len(w) > 5 else -1


class Terms:
    """Remembers words' buckets; gives the distinct buckets of a text, without those that stay out (mapped to -1)."""

    def __init__(self, place: np.ndarray | None = None):
        self.place, self.memory, self.rows = place, {}, np.zeros((1024, 3), np.int32)

    def of(self, text: str) -> np.ndarray:
        words = set(text.split())
        if len(self.memory) > CACHED:
            self.memory.clear()
        if new := list(words.difference(self.memory)):
            first = len(self.memory)
            while first + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            got = np.array([terms(w) for w in new], np.int32)
            if self.place is not None:
                got = np.where(got >= 0, self.place[got], -1)
            self.rows[first : first + len(new)] = got
            self.memory.update(zip(new, range(first, first + len(new))))
        found = np.unique(self.rows[np.fromiter(map(self.memory.__getitem__, words), np.int64, len(words))])
        return found[1:] if len(found) and found[0] < 0 else found


class Machine:
    def __init__(self, place: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.place, self.w0, self.w, self.v = place, w0, w, v
        self.terms = Terms(place)

    def score(self, text: str) -> float:
        x = self.terms.of(text)
        z = self.w0 + self.w[x].sum() + 0.5 * ((self.v[x].sum(0) ** 2).sum() - (self.v[x] ** 2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def dump(self) -> bytes:
        b = io.BytesIO()
        np.savez_compressed(b, place=self.place, w0=self.w0, w=self.w, v=self.v)
        return b.getvalue()

    @staticmethod
    def load(blob: bytes) -> Machine:
        with np.load(io.BytesIO(blob)) as z:
            return Machine(z["place"], float(z["w0"]), z["w"], z["v"])


def trained(x: list[np.ndarray], y: np.ndarray, seed: int = 5) -> Machine:
    """Adagrad over mini-batches; x: distinct buckets of each text. Terms without evidence in either direction stay out."""
    n, share = len(y), y.mean() if len(y) else 0.0
    count = lambda rows: np.bincount(np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64), minlength=BUCKETS).astype(float)
    df, pos = count(x), count([a for a, b in zip(x, y) if b])
    neg, expected = df - pos, df * share
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = 2 * (np.where(pos > 0, pos * np.log(pos / expected), 0) + np.where(neg > 0, neg * np.log(neg / (df - expected)), 0))
    kept = np.flatnonzero((df >= MIN_DF) & (df < 0.5 * n) & (evidence >= EVIDENCE))
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), FACTORS))
    if not 0 < share < 1:
        return Machine(place, float(np.log(max(share, 1e-13) / max(1 - share, 1e-13))), w, v * 0)
    w0 = float(np.log(share / (1 - share)))
    gw, gv, g0, order = np.full(len(kept), 1e-2), np.full(len(kept), 1e-2), 1e-2, [q[q >= 0] for q in (place[r] for r in x)]
    for _ in range(EPOCHS):
        turn = rng.permutation(n)
        for at in range(0, n, 128):
            rows = turn[at : at + 128]
            size = np.fromiter((len(order[r]) for r in rows), np.int64, len(rows))
            idx, row, m = np.concatenate([order[r] for r in rows]), np.repeat(np.arange(len(rows)), size), len(rows)
            vi = v[idx]
            s = np.stack([np.bincount(row, vi[:, k], m) for k in range(FACTORS)], 1)
            z = w0 + np.bincount(row, w[idx], m) + 0.5 * ((s**2).sum(1) - np.bincount(row, (vi**2).sum(1), m))
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * np.where(y[rows] > 0, min(4.0, (1 - share) / share), 1.0)
            one, inverse = np.unique(idx, return_inverse=True)
            if len(one):
                grad = np.bincount(inverse, d[row])
                gw[one] += grad**2
                step = RATE / np.sqrt(gw[one])
                moved = w[one] - step * grad
                w[one] = np.sign(moved) * np.maximum(np.abs(moved) - step * LASSO, 0)
                part = d[row, None] * (s[row] - vi)
                gradv = np.stack([np.bincount(inverse, part[:, k]) for k in range(FACTORS)], 1) + 1e-2 * v[one]
                gv[one] += (gradv**2).mean(1)
                v[one] -= 0.02 * gradv / np.sqrt(gv[one])[:, None]
            g0 += d.sum() ** 2
            w0 -= RATE * d.sum() / np.sqrt(g0)
    return Machine(place, w0, w, v)


def worker_machine(blob: bytes) -> Machine:
    return held(("machine", blob), lambda: Machine.load(blob))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes:
    """A machine from labelled documents: docs (doc_id, text), labels (doc_id, toxic)."""
    settle(docs.sparkSession)
    chosen = labels.select("doc_id", "toxic").filter("toxic is not null and doc_id is not null").withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), F.lit("fm"))).orderBy("h", "doc_id", "toxic").limit(sample).drop("h")
    texts = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Terms()
        for b in batches:
            x = [t.of(text).tolist() for text in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.int32())), b.column(1)], ["x", "toxic"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [], []
        for b in batches:
            c = b.column(0)
            flat, cuts = c.values.to_numpy(), c.offsets.to_numpy()
            x += [flat[i:j].copy() for i, j in zip(cuts, cuts[1:])]
            y += b.column(1).to_pylist()
        order = sorted(range(len(y)), key=lambda i: (len(x[i]), x[i].tobytes(), y[i]))  # the same machine whatever order rows come in
        yield pa.RecordBatch.from_arrays([pa.array([trained([x[i] for i in order], np.asarray([y[i] for i in order], float)).dump()])], ["blob"])

    return texts.mapInArrow(lean(features), "x array<int>, toxic int").repartition(1).mapInArrow(lean(train), "blob binary").first().blob


def scored(df: DataFrame, blob: bytes, text_col: str = "text", name: str = "score") -> DataFrame:
    """df with the score of each text in one more column (underscores are added while the name is taken)."""
    settle(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(blob)  # bounded by BUCKETS

    def score(text: pd.Series) -> pd.Series:
        m = worker_machine(model.value)
        return pd.Series([m.score(t or "") for t in text], dtype="float64")

    (out,) = fresh(df, name)
    return df.withColumn(out, lean_udf(score, "double")(F.col(text_col)))


def contract(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    rule = crc_mod("doc_id", 5)
    blob = fit(docs.select("doc_id", "text"), labels.filter(f"{rule} != 0"), sample)
    return scored(docs.select("doc_id", "text"), blob).select(
        "doc_id", F.expr(f"{rule} = 0").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
