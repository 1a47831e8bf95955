"""Language identification with interpolated Kneser-Ney character models.

Each language has a character 4-gram model over the words of its training texts (lower case, letters only, with word
borders), with interpolated Kneser-Ney smoothing: absolute discounts per order estimated from counts of counts, and
continuation counts below the highest order. The models of all languages lie in sorted arrays of 64-bit n-gram hashes,
one for each order, whose rows hold the interpolated log-probability in each language; contexts have arrays of their
backoff weights. A text's cross-entropy in a language is the mean over its characters and word ends. The lowest wins.
A text is rejected if it has no letter, or if its cross-entropy lies above its language's threshold, which is
calibrated on training texts that the models have not seen (a high quantile and a margin); a language with fewer than `FEW` such texts
takes the highest threshold of those that have enough, or that of all texts together.

The models are fitted on a bounded sample: each language's texts are taken by hash of the id at a rate that gives
`per_lang` texts in expectation, a quarter more for calibration. Texts are used whole, in fitting and predicting.

Marks count with the letters of their word; a word of marks alone has no letter. Texts of a language that would all fall to calibration
are all learned from instead.

Defined cases: null text or one without letters: `und`, score 0, rejected. Ties go to the language first in order.
With no training rows every text is `und`. Repeated rows and null ids give one row each; other columns are not read.
"""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, fresh, held, lean, lean_udf, settle

ORDER, PER_LANG, QUANTILE, MARGIN = 4, 800, 0.999, 0.35
CACHED = 150_000
#: Calibration texts that a language needs for a threshold of its own.
FEW = 5
#: What a text of fewer characters may exceed the threshold by, in nats per root of its length.
SLACK = 6.0
NOT_LETTER = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
MIX = np.uint64(0x9E3779B97F4A7C15)


def letters(word: str) -> str:
    if word.isalpha():
        return word.lower()
    bare = NOT_LETTER.sub("", word.lower())
    return bare if LETTER.search(bare) else ""


def grams(words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each character and word end of the words: the word's index, and hashes of the n-grams ending there, by order."""
    text = np.frombuffer("".join(f"\x02\x02\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), n + 4)
    at = np.arange(len(text)) - np.repeat(np.cumsum(n + 4) - (n + 4), n + 4)
    keep = np.flatnonzero(at >= 3)
    with np.errstate(over="ignore"):
        # the hash of an n-gram is a function of its characters and length, so a context's hash is that of the shorter gram before it
        out, acc = [], np.zeros(len(keep), np.uint64)
        for k in range(ORDER):
            acc = spread(text[keep - k] + np.uint64(k + 1) * MIX) ^ acc
            out.append(acc)
        contexts, acc = [np.zeros(len(keep), np.uint64)], np.zeros(len(keep), np.uint64)
        for k in range(ORDER - 1):
            acc = spread(text[keep - 1 - k] + np.uint64(k + 1) * MIX) ^ acc
            contexts.append(acc)
    return word[keep], out, contexts


def spread(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Models:
    """All languages' models, as arrays: for order k, keys[k] sorted with logp[k] (rows by language), contexts[k] with logw[k]."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        self.langs = [str(x) for x in arrays["langs"]]
        self.limits = arrays["limits"]
        self.memory: dict[str, int] = {}
        self.sums = np.zeros((1024, len(self.langs)))
        self.sizes = np.zeros(1024)

    @staticmethod
    def fitted(counts: dict[str, Counter]) -> dict[str, np.ndarray]:
        """Arrays from each language's counts of letter words."""
        langs = sorted(counts)
        per: list[list[tuple]] = []
        alphabet: set[str] = {"\x03"}
        for lang in langs:
            words = list(counts[lang])
            alphabet.update(*words)
            word, hashes, contexts = grams(words)
            weight = np.fromiter(counts[lang].values(), np.float64, len(words))[word]
            top, first, inverse = np.unique(hashes[-1], return_index=True, return_inverse=True)
            rows = [(top, contexts[-1][first], np.bincount(inverse, weight), first)]
            for k in range(ORDER - 2, -1, -1):  # continuation counts: how many distinct longer grams end in this one
                longer = rows[0][3]
                keys, f, inv = np.unique(hashes[k][longer], return_index=True, return_inverse=True)
                rows.insert(0, (keys, contexts[k][longer[f]], np.bincount(inv).astype(float), longer[f]))
            per.append([(keys, ctx, c, [hashes[j][at] for j in range(ORDER)]) for keys, ctx, c, at in rows])
        out: dict[str, np.ndarray] = {"langs": np.array(langs), "limits": np.full(len(langs), np.inf), "floor": np.array([-np.log(len(alphabet) + 1)])}
        for k in range(ORDER):
            keys = np.unique(np.concatenate([p[k][0] for p in per]))
            ctx = np.unique(np.concatenate([p[k][1] for p in per]))
            direct, logw = np.zeros((len(keys), len(langs))), np.zeros((len(ctx), len(langs)))
            for i, p in enumerate(per):
                own, context, c, _ = p[k]
                n1, n2 = (c == 1).sum(), (c == 2).sum()
                d = min(0.95, max(0.1, n1 / max(1, n1 + 2 * n2)))
                where = np.searchsorted(ctx, context)
                total, kinds = np.bincount(where, c, len(ctx)), np.bincount(where, minlength=len(ctx))
                direct[np.searchsorted(keys, own), i] = (c - d) / total[where]
                logw[:, i] = np.log(np.where(total > 0, d * kinds / np.maximum(total, 1e-300), 1.0))
            # the context and the next shorter gram of each key, from whichever language has it
            contexts, shorter = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
            for p in per:
                at = np.searchsorted(keys, p[k][0])
                contexts[at] = p[k][1]
                shorter[at] = p[k][3][k - 1] if k else 0
            w = np.exp(logw[np.searchsorted(ctx, contexts)])
            if k:
                at, there = find(out[f"keys{k - 1}"], shorter)
                low = np.exp(out[f"logp{k - 1}"][at])
                assert there.all()
            else:
                low = np.exp(out["floor"][0])
            out |= {f"keys{k}": keys, f"logp{k}": np.log(direct + w * low), f"ctx{k}": ctx, f"logw{k}": logw}
        return out

    def log_probs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's log-probability in each language, and its characters and end."""
        word, hashes, contexts = grams(words)
        total = np.zeros((len(words), len(self.langs)))
        left, carried = np.arange(len(word)), np.zeros((len(word), len(self.langs)))
        for k in range(ORDER - 1, -1, -1):
            at, there = find(self.a[f"keys{k}"], hashes[k][left])
            hit = left[there]
            p = self.a[f"logp{k}"][at[there]] + carried[there]
            for i in range(len(self.langs)):
                total[:, i] += np.bincount(word[hit], p[:, i], len(words))
            left, carried = left[~there], carried[~there]
            if not len(left):
                break
            at, there = find(self.a[f"ctx{k}"], contexts[k][left])
            carried = carried + np.where(there[:, None], self.a[f"logw{k}"][at], 0.0)
        if len(left):
            for i in range(len(self.langs)):
                total[:, i] += np.bincount(word[left], carried[:, i] + self.a["floor"][0], len(words))
        return total, np.fromiter(map(len, words), np.float64, len(words)) + 1

    def entropy(self, text: str) -> tuple[np.ndarray, float]:
        """Cross-entropy of the text in each language and its length; length 0 if it has no letter."""
        pieces = text.split()
        if len(self.memory) > CACHED:
            self.memory.clear()
        if new := list(set(pieces).difference(self.memory)):
            first = len(self.memory)
            while first + len(new) > len(self.sizes):
                self.sums, self.sizes = np.concatenate([self.sums, np.zeros_like(self.sums)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            bare = [letters(w) for w in new]
            some = [i for i, w in enumerate(bare) if w]
            self.sums[first : first + len(new)], self.sizes[first : first + len(new)] = 0, 0
            if some:
                sums, sizes = self.log_probs([bare[i] for i in some])
                where = first + np.asarray(some)
                self.sums[where], self.sizes[where] = sums, sizes
            self.memory.update(zip(new, range(first, first + len(new))))
        at = np.fromiter(map(self.memory.__getitem__, pieces), np.int64, len(pieces))
        n = self.sizes[at].sum()
        return (-self.sums[at].sum(0) / n if n else np.zeros(len(self.langs))), float(n)

    def predict(self, text: str) -> tuple[str, float, float | None, bool]:
        """Language, score, cross-entropy, rejected."""
        if not self.langs:
            return "und", 0.0, None, True
        h, n = self.entropy(text)
        if not n:
            return "und", 0.0, None, True
        best = int(np.argmin(h))
        score = float(1 / np.exp((h[best] - h) * min(n, 200.0) / 4).sum())
        return self.langs[best], score, float(h[best]), bool(h[best] > self.limits[best] + SLACK / np.sqrt(n))

    def dump(self) -> bytes:
        b = io.BytesIO()
        np.savez_compressed(b, **self.a)
        return b.getvalue()

    @staticmethod
    def load(blob: bytes) -> Models:
        with np.load(io.BytesIO(blob)) as z:
            return Models(dict(z))


def worker_models(blob: bytes) -> Models:
    return held(("languages", blob), lambda: Models.load(blob))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> bytes:
    """Models of all languages of df (rows with a text and a language), as bytes; their size is bounded by the sample."""
    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    sizes = {r.lang: r["count"] for r in src.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return Models({"langs": np.array([], "U1"), "limits": np.array([])}).dump()
    rate = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 1.25 * per_lang / n)))])
    draw = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit("fit")), F.lit(1_000_003)) / 1_000_003.0
    sample = src.filter(draw < rate[F.col("lang")]).withColumn("part", F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit("part")), F.lit(5)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {lang: Counter() for lang in sizes}
        held: list[tuple[str, str]] = []
        for b in batches:
            for text, lang, part in zip(*(b.column(i).to_pylist() for i in range(3))):
                if part:
                    counts[lang].update(text.split())
                else:
                    held.append((lang, text))
        for lang, text in held:
            if not any(map(letters, counts[lang])):
                counts[lang].update(text.split())
        by = {}
        for lang, c in counts.items():
            bare: Counter = Counter()
            for w, n in c.items():
                if w := letters(w):
                    bare[w] += n
            if bare:
                by[lang] = bare
        if not by:
            yield pa.RecordBatch.from_arrays([pa.array([Models({"langs": np.array([], "U1"), "limits": np.array([])}).dump()])], ["blob"])
            return
        m = Models(Models.fitted(by))
        own = {lang: [x[0][i] for name, text in held if name == lang and (x := m.entropy(text))[1] >= 50] for i, lang in enumerate(m.langs)}
        enough = {lang: np.quantile(h, QUANTILE) + MARGIN for lang, h in own.items() if len(h) >= FEW}
        pooled = [x for h in own.values() for x in h]
        rest = max(enough.values()) if enough else np.quantile(pooled, QUANTILE) + MARGIN if pooled else np.inf
        m.limits[:] = [enough.get(lang, rest) for lang in m.langs]
        yield pa.RecordBatch.from_arrays([pa.array([m.dump()])], ["blob"])

    return sample.select("text", "lang", "part").repartition(1).mapInArrow(lean(run), "blob binary").first().blob


def identified(df: DataFrame, blob: bytes, text_col: str = "text", names: tuple[str, ...] = ("lang_pred", "score", "entropy", "rejected")) -> DataFrame:
    """df with four more columns; names already taken get underscores."""
    settle(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(blob)  # bounded by the sample it was fitted on

    def predict(text: pd.Series) -> pd.DataFrame:
        m = worker_models(model.value)
        return pd.DataFrame([m.predict(t or "") for t in text], columns=["lang_pred", "score", "entropy", "rejected"])

    out = fresh(df, *names)
    (p,) = fresh(df, "prediction")
    inner = ("lang_pred", "score", "entropy", "rejected")
    return df.withColumn(p, lean_udf(predict, "lang_pred string, score double, entropy double, rejected boolean")(F.col(text_col))).select(*df.columns, *[F.col(p)[i].alias(o) for i, o in zip(inner, out)])


def contract(df: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    held: Column = F.expr(crc_mod("doc_id", 3) + " = 1")
    blob = fit(df.filter(~held), per_lang=per_lang)
    return identified(df.select("doc_id", "text"), blob).select("doc_id", held.alias("held_out"), "lang_pred", "score", "entropy", "rejected")
