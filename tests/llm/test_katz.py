import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import katz

rng = random.Random(11)


class Brute:
    """The model of the docstring over dictionaries."""

    def __init__(self, texts):
        self.uni, self.bi, self.h = Counter(), Counter(), Counter()
        for t in texts:
            x = [None, *words(t)]
            self.uni.update(x[1:])
            self.h.update(x[:-1])
            self.bi.update(zip(x, x[1:]))
        count = lambda c: np.array([sum(v == r for v in c.values()) for r in range(katz.K + 2)])
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.d1, self.d2 = katz.Discounts(count(self.uni)), katz.Discounts(count(self.bi))
        n = count(self.uni)
        self.unseen = (1 - sum(self.d1.kept(np.array([c]))[0] for c in self.uni.values()) / self.n) / max(1, n[1] ** 2 / (2 * max(1, n[2]))) if self.n else 1.0
        self.m = max(1, n[1] ** 2 / (2 * max(1, n[2]))) if self.n else 1.0
        self.after = defaultdict(list)
        for (h, w), c in self.bi.items():
            self.after[h].append((w, c))

    def p1(self, w):
        return self.d1.kept(np.array([self.uni[w]]))[0] / self.n if self.uni[w] else self.unseen

    def p2(self, w, h):
        if self.bi[h, w]:
            return self.d2.kept(np.array([self.bi[h, w]]))[0] / self.h[h]
        return self.alpha(h) * self.p1(w)

    def alpha(self, h):
        if not self.after[h]:
            return 1.0
        left = 1 - sum(self.d2.kept(np.array([c]))[0] / self.h[h] for _, c in self.after[h])
        return left / (1 - sum(self.p1(w) for w, _ in self.after[h]))


def words(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def corpus(n):
    vocabulary = [f"w{i}" for i in range(60)]
    out = [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(60)], k=rng.randint(0, 40))).upper() + (" é É" if i % 5 == 0 else "")) for i in range(n)]
    return out + [(None, None), (1, out[1][1]), (1, out[1][1]), (n, ""), (n + 1, " \t\n"), (n + 2, "new words only " * 300), (n + 3, None)]


@pytest.mark.parametrize("n,tokens,keys", [(60, 200, 50), (300, 100_000, 1000), (4, 10, 10)])
def test_equals_brute_force(spark, n, tokens, keys):
    rows = corpus(n)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, held_out int")
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    got = sorted((tuple(r) for r in katz.scored(df, F.expr(katz.crc_mod("doc_id", 7) + " = 2"), block_tokens=tokens, partition_keys=keys).collect()), key=str)
    model = Brute([t for i, t in rows if not held(i)])
    want = []
    for i, t in rows:
        x = [None, *words(t)]
        base = sum(math.log10((model.uni[w] + 1) / (model.n + model.v + 1)) for w in x[1:])
        want.append((i, held(i), len(x) - 1, sum(model.uni[w] > 0 for w in x[1:]), model.n, base, sum(math.log10(model.p2(w, h)) for h, w in zip(x, x[1:]))))
    want.sort(key=str)
    assert len(got) == len(want)
    for key in (lambda r: (str(r[0]), r[2], r[5]),):
        for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
            assert g[:5] == w[:5] and np.allclose(g[5:], w[5:], rtol=1e-5, atol=1e-5)
    # exactly normalised, in every history
    for h in [None, *list(model.uni)[:20], b"never"]:
        assert math.isclose(sum(model.p2(w, h) for w in model.uni) + model.m * model.p2(b"never seen", h), 1, rel_tol=1e-9)


def test_without_training_and_empty(spark):
    df = spark.createDataFrame([(2, "a b"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in katz.scored(df, F.lit(True)).collect()}
    assert (out[2].n_tokens, out[2].n_known, out[2].train_tokens, out[2].base_score, out[2].score) == (3, 0, 0, 0.0, 0.0)
    assert katz.scored(df.limit(0), F.lit(True)).count() == 0


def test_better_than_the_base_on_held_out_texts(spark):
    p = katz.op6(spark, "/root/testdata/sf0.01").toPandas()
    h = p[p.held_out]
    assert len(p) == 1000 and h.score.sum() > h.base_score.sum() and p.train_tokens.nunique() == 1


class Trigrams(Brute):
    """As Brute, with the order above."""

    def __init__(self, texts):
        super().__init__(texts)
        self.tri, self.after2 = Counter(), defaultdict(list)
        for t in texts:
            x = [None, *words(t)]
            self.tri.update(zip(x, x[1:], x[2:]))
        self.d3 = katz.Discounts(np.array([sum(v == r for v in self.tri.values()) for r in range(katz.K + 2)]))
        for (u, v, w), c in self.tri.items():
            self.after2[u, v].append((w, c))

    def seen3(self, c, u, v):
        return self.d3.kept(np.array([c]))[0] / self.bi[u, v]

    def p3(self, w, u, v):
        if self.tri[u, v, w]:
            return self.seen3(self.tri[u, v, w], u, v)
        if not self.bi[u, v]:
            return self.p2(w, v)
        left = 1 - sum(self.seen3(c, u, v) for _, c in self.after2[u, v])
        return left / (1 - sum(self.p2(x, v) for x, _ in self.after2[u, v])) * self.p2(w, v)


@pytest.mark.parametrize("n,tokens,keys", [(60, 200, 50), (300, 1000, 1000), (4, 10, 10), (60, 100_000, 100_000)])
def test_trigrams_equal_brute_force(spark, n, tokens, keys):
    rows = corpus(n)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    got = [tuple(r) for r in katz.scored(df, F.expr(katz.crc_mod("doc_id", 7) + " = 2"), block_tokens=tokens, partition_keys=keys, order=3).collect()]
    model = Trigrams([t for i, t in rows if not held(i)])
    want = []
    for i, t in rows:
        x = [None, *words(t)]
        want.append((i, len(x) - 1, math.log10(model.p2(x[1], None)) + sum(math.log10(model.p3(w, u, v)) for u, v, w in zip(x, x[1:], x[2:]))))
    key = lambda r: (str(r[0]), r[1], r[2])
    for g, w in zip(sorted(((r[0], r[2], r[6]) for r in got), key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and math.isclose(g[2], w[2], rel_tol=1e-5, abs_tol=1e-5)
    for u, v in [(None, b"w0"), *list(model.bi)[:20]]:
        if v != b"\n":
            assert math.isclose(sum(model.p3(w, u, v) for w in model.uni) + model.m * model.p3(b"never seen", u, v), 1, rel_tol=1e-9)


def test_production_uses_two_words_of_context(spark, tmp_path):
    rows = [(i, "a b c " * 3 + "x b d " * 3) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    two = katz.scored(spark.createDataFrame(rows, "doc_id long, text string"), F.expr(katz.crc_mod("doc_id", 7) + " = 2")).agg(F.sum("score")).first()[0]
    assert katz.op6(spark, str(tmp_path)).agg(F.sum("score")).first()[0] > two + 1


def cpu(f):
    """CPU seconds of the best of three runs."""
    out = []
    for _ in range(3):
        began = time.process_time()
        f()
        out.append(time.process_time() - began)
    return min(out)


@pytest.fixture
def make_blocks(spark, monkeypatch):
    """blocks_of() in this process: (ids, texts, block_tokens, rows of a batch) to the rows of its blocks."""
    df = spark.createDataFrame([], "doc_id long, text string, held_out boolean")
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())

    def make(ids, texts, block_tokens, rows):
        with monkeypatch.context() as m:
            m.setattr(type(df), "mapInArrow", lambda self, f, schema: f)
            run = katz.blocks_of(df, "doc_id", "text", F.col("held_out"), block_tokens)
        batches = [pa.RecordBatch.from_arrays([pa.array(ids[i : i + rows], pa.int64()), pa.array(texts[i : i + rows], pa.string()), pa.array([k % 7 == 2 for k in ids[i : i + rows]])], ["id", "text", "held"]) for i in range(0, len(ids), rows)]
        return [r for b in run(iter(batches)) for r in b.to_pylist()]

    return make


@pytest.mark.parametrize("tokens,rows", [(50, 7), (50, 1000), (1, 3), (100_000, 5)])
def test_blocks_hold_the_words_of_their_texts(make_blocks, tokens, rows):
    odd = ["", " ", "\n", "  A\tb\x0b\x0cB\r\n c ", "é É ÀÉ", "\x1c x\x1d", "a\x85b \xa0c", "x" * 3000, "\0 \0a", "a " * 200]
    texts = [t or "" for _, t in corpus(80)] + odd + [""] * 3
    left = list(enumerate(texts))
    for b in make_blocks(list(range(len(texts))), texts, tokens, rows):
        mine = []
        while left and sum(len(words(t)) for _, t in mine) < tokens:  # the text that fills a block is its last
            mine.append(left.pop(0))
        assert b["ids"] == [i for i, _ in mine] and b["held"] == [i % 7 == 2 for i, _ in mine] and b["sizes"] == [len(words(t)) for _, t in mine]
        x = [h for _, t in mine for h in (katz.START, *(xxhash.xxh3_64_intdigest(w) for w in words(t)))]
        w = katz.unpacked_keys(b["words"])
        assert w.tolist() == sorted(set(x)) and w[katz.unpacked(b["tokens"], np.int32)].tolist() == x
        assert (b["n_words"], b["n_pairs"], b["n_tokens"]) == (len(w), len(set(zip(x, x[1:]))), sum(b["sizes"]))
    assert not left


@pytest.mark.parametrize("large", ["false", "true"])
def test_words_are_bytes_valid_or_not(spark, large):
    before = spark.conf.get("spark.sql.execution.arrow.useLargeVarTypes")
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", large)
    try:
        df = spark.sql("select id as doc_id, if(id % 2 = 0, cast(X'ff2041fe20' as string), 'b c') as text from range(20)")
        got = {r.doc_id: r for r in katz.scored(df, F.lit(False), order=3).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", before)
    assert len(got) == 20 and all((r.n_tokens, r.n_known, r.train_tokens) == (3, 3, 60) for r in got.values())
    assert math.isclose(got[0].score, got[1].score) and math.isclose(got[0].base_score, got[1].base_score)


def test_cpu_of_blocks(make_blocks):
    r = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in r.zipf(1.15, 500) % 200_000) for _ in range(1200)]
    split = cpu(lambda: [t.encode().lower().split() for t in texts])
    assert cpu(lambda: make_blocks(list(range(len(texts))), texts, 10**9, 100)) < 10 * split


def test_cpu_of_ranking():
    keys = np.random.default_rng(5).integers(0, 2**64, 1_000_000, np.uint64)
    assert cpu(lambda: katz.ranking(keys)) < 0.7 * cpu(lambda: np.argsort(keys, kind="stable"))


@pytest.mark.parametrize("case", range(7))
def test_ranking_is_the_stable_argsort(case):
    r = np.random.default_rng(case)
    keys = [
        lambda: r.integers(0, 2**64, 100_000, np.uint64),
        lambda: r.integers(2**63, 2**63 + 2**50, 100_000, np.uint64),
        lambda: r.integers(0, 2**64, 500, np.uint64)[r.integers(0, 500, 30_000)],
        lambda: r.integers(0, 2**10, 50_000, np.uint64) << np.uint64(54) | r.integers(0, 2**6, 50_000, np.uint64),  # alike in their leading bits
        lambda: np.array([2**64 - 1, 0, 2**64 - 1, 1, 0], np.uint64),
        lambda: np.full(9, 2**64 - 1, np.uint64),
        lambda: np.zeros(0, np.uint64),
    ][case]()
    assert (katz.ranking(keys) == np.argsort(keys, kind="stable")).all()
    for got, want in zip(katz.numbered(keys), np.unique(keys, return_inverse=True)):
        assert (got == want).all()
