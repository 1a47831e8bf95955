import zlib

import numpy as np

from tessera.llm import language_id, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    p = queries.op5(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    assert len(p) == 1000 and (p.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in p.doc_id]).all()
    assert (p.lang == p.lang_pred)[p.held_out].mean() > 0.98
    assert p.score.between(0, 1).all() and p.rejected.mean() < 0.01


def test_kneser_ney_sums_to_one():
    from collections import Counter

    words = Counter("abba cab a abc abcabc bb".split())
    arrays = language_id.Models.fitted({"x": words, "y": Counter(["zz", "abz"])})
    m = language_id.Models(arrays)
    for start in ("", "a", "ab", "abc", "zz", "qq"):
        # words that share a start: the next character or the end; what is left goes to characters never seen
        total = np.zeros(2)
        for c in "abcz":
            total += np.exp(m.log_probs([start + c])[0][0] - ends(m, start + c) - prefix(m, start))
        total += np.exp(ends(m, start))
        assert (total < 1 + 1e-9).all() and (total > 0.6).all()
        unseen = np.exp(m.log_probs([start + "一"])[0][0] - ends(m, start + "一") - prefix(m, start))
        assert np.allclose(total + unseen, 1)


def ends(m, w):
    """log p(end | w)."""
    return m.log_probs([w])[0][0] - prefix(m, w)


def prefix(m, w):
    """log p of the characters of w without the end, by the model's own rows, one character at a time."""
    out = np.zeros(len(m.langs))
    _, hashes, contexts = language_id.grams([w])
    for i in range(len(w)):
        p, k = None, language_id.ORDER - 1
        carried = np.zeros(len(m.langs))
        while k >= 0:
            at, there = language_id.find(m.a[f"keys{k}"], hashes[k][i : i + 1])
            if there[0]:
                p = m.a[f"logp{k}"][at[0]] + carried
                break
            at, there = language_id.find(m.a[f"ctx{k}"], contexts[k][i : i + 1])
            carried = carried + (m.a[f"logw{k}"][at[0]] if there[0] else 0)
            k -= 1
        out += carried + m.a["floor"][0] if p is None else p
    return out


def test_language_edges(spark):
    rows = [(1, "the house of the", "en", 1), (2, "das haus der", "de", 1), (None, None, "en", 0), (None, None, None, 0), (3, "", "en", 0), (4, "123 !? --", "en", 0), (5, "the " * 50_000, None, 0), (2, "das haus der", "de", 1), (6, "Σσς 日本", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, Score int")
    blob = language_id.fit(df)
    got = language_id.identified(df, blob)
    assert got.columns == ["doc_id", "text", "lang", "Score", "lang_pred", "score_", "entropy", "rejected"]
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score_, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in ("en", "de")
    assert {r.lang_pred for r in out if r.doc_id == 2} == {"de"} and next(r.lang_pred for r in out if r.doc_id == 5) == "en"
    none = language_id.fit(df.limit(0))
    assert {r.lang_pred for r in language_id.identified(df, none).collect()} == {"und"}
    assert language_id.contract(df.limit(0)).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    p = queries.op4(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    h = p[p.held_out]
    assert (h.predicted == h.toxic).mean() > 0.97 and h.predicted[h.toxic == 1].mean() > 0.85
    assert p.score.between(0, 1).all() and (p.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in p.doc_id]).all()


def test_machine_learns_a_pair():
    """Neither term alone is toxic, both together are: additive weights can't tell, the factors can."""
    rng = np.random.default_rng(1)
    x, y = [], []
    for _ in range(4000):
        a, b = rng.random(2) < 0.4
        noise = rng.choice(np.arange(100, 400), 8, replace=False)
        x.append(np.unique(np.concatenate([[1] * int(a), [2] * int(b), noise])).astype(np.int32))
        y.append(float(a and b))
    m = toxicity.trained(x, np.array(y))
    z = lambda t: (p := m.place[np.array(t)], m.w0 + m.w[p].sum() + 0.5 * ((m.v[p].sum(0) ** 2).sum() - (m.v[p] ** 2).sum()))[1]
    pair = z([1, 2]) - z([1]) - z([2]) + m.w0
    assert z([1, 2]) > 0 > max(z([1]), z([2])) and abs(pair - m.v[m.place[1]] @ m.v[m.place[2]]) < 1e-9


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(i, "you idiot fool" if i % 2 else "kind words here", 1.5) for i in range(40)] + [(None, None, 0.0), (40, "", 0.0), (41, "idiot " * 40_000, 0.0), (1, "you idiot fool", 1.5)], "doc_id long, text string, SCORE double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None), (5, 1)], "doc_id long, toxic int")
    out = toxicity.contract(docs, labels).collect()
    assert len(out) == 44 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.scored(docs, toxicity.fit(docs, labels)).columns == ["doc_id", "text", "SCORE", "score_"]
    assert {r.predicted for r in toxicity.contract(docs, labels.limit(0)).collect()} == {0}
    assert {r.predicted for r in toxicity.contract(docs, labels.filter("toxic = 1")).collect()} == {1}
    assert toxicity.contract(docs.limit(0), labels).count() == 0


def test_machine_equals_sum_over_pairs(spark):
    """The score of every text of a table, by a double loop over the pairs of its terms."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    blob = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    m = toxicity.Machine.load(blob)
    for r in toxicity.scored(docs, blob).collect():
        buckets = {b for w in (r.text or "").split() for b in toxicity.terms(w) if b >= 0}
        x = sorted(int(m.place[b]) for b in buckets if m.place[b] >= 0)
        z = m.w0 + sum(m.w[i] for i in x) + sum(float(m.v[i] @ m.v[j]) for n, i in enumerate(x) for j in x[n + 1 :])
        assert np.isclose(r.score, 1 / (1 + np.exp(-np.clip(z, -30, 30))), rtol=1e-9, atol=1e-12)


class Dictionary:
    """Interpolated Kneser-Ney over strings: no hashes, no arrays."""

    def __init__(self, counts, alphabet):
        from collections import Counter, defaultdict

        top = Counter()
        for w, n in counts.items():
            padded = "\x02\x02\x02" + w + "\x03"
            for i in range(3, len(padded)):
                top[padded[i - 3 : i + 1]] += n
        self.c = {4: top}
        for k in (3, 2, 1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.floor, self.d, self.total, self.kinds = 1 / (len(alphabet) + 1), {}, {}, {}
        for k, c in self.c.items():
            n1, n2 = (sum(v == r for v in c.values()) for r in (1, 2))
            self.d[k] = min(0.95, max(0.1, n1 / max(1, n1 + 2 * n2)))
            self.total[k], self.kinds[k] = defaultdict(int), defaultdict(int)
            for g, v in c.items():
                self.total[k][g[:-1]] += v
                self.kinds[k][g[:-1]] += 1

    def p(self, gram, k=4):
        if k == 0:
            return self.floor
        low, g = self.p(gram, k - 1), gram[-k:]
        total = self.total[k].get(g[:-1], 0)
        if not total:
            return low
        return (max(self.c[k][g] - self.d[k], 0) if self.c[k][g] else 0) / total + self.d[k] * self.kinds[k][g[:-1]] / total * low

    def log_p(self, w):
        padded = "\x02\x02\x02" + w + "\x03"
        return sum(np.log(self.p(padded[i - 3 : i + 1])) for i in range(3, len(padded)))


def test_kneser_ney_equals_dictionary():
    from collections import Counter

    texts = {"a": "the house of the thin man in the hat those these them he", "b": "das haus der dünnen männer in dem hut diese jene den er", "c": "la maison de l homme mince au chapeau ces celles ils"}
    counts = {k: Counter(v.split()) for k, v in texts.items()}
    m = language_id.Models(language_id.Models.fitted(counts))
    alphabet = {"\x03"}.union(*(set(v.replace(" ", "")) for v in texts.values()))
    brute = {k: Dictionary(v, alphabet) for k, v in counts.items()}
    words = [*" ".join(texts.values()).split(), "thus", "zebra", "ümlaut", "x", "日本", "hhhhhh"]
    got, sizes = m.log_probs(words)
    assert np.allclose(got, [[brute[k].log_p(w) for k in m.langs] for w in words], rtol=1e-9) and (sizes == [len(w) + 1 for w in words]).all()


def test_foreign_texts_are_rejected_and_clean_ones_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    blob = language_id.fit(docs)
    foreign = [
        "Tämä on pitkä suomenkielinen teksti, jossa kerrotaan siitä, miten ihmiset kävelevät metsässä ja katselevat järven tyyntä pintaa.",
        "Ten tekst został napisany po polsku, żeby sprawdzić, czy program potrafi odrzucić języki, których nigdy wcześniej nie widział.",
        "Эта строка написана по-русски и не похожа ни на один из изученных языков, поэтому её следует отвергнуть.",
        "これは日本語で書かれた長い文章であり、学習された言語のどれにも似ていません。",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(foreign)], "doc_id long, text string")
    assert all(r.rejected for r in language_id.identified(df, blob).collect())
    marks = spark.createDataFrame([(1, "\u0301\u0302 \u0303"), (2, "1 \u0301 ?"), (3, None)], "doc_id long, text string")
    assert {(r.lang_pred, r.score, r.rejected) for r in language_id.identified(marks, blob).collect()} == {("und", 0.0, True)}
    assert language_id.identified(docs, blob).filter("rejected and lang is not null").count() < 0.01 * docs.count()


def test_a_rare_language_takes_the_others_threshold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(-1, "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt", "xx")], docs.schema)
    m = language_id.Models.load(language_id.fit(docs.union(rare)))
    assert "xx" in m.langs and np.isfinite(m.limits).all()
    assert m.limits[m.langs.index("xx")] == max(x for n, x in zip(m.langs, m.limits) if n != "xx")
