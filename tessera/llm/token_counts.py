"""Token counts by overlap resynchronisation.

Documents of at most `chunk_chars` characters are counted in one piece from remembered counts of their pre-tokens.
A longer one becomes overlapping chunks in different tasks. Each is encoded by the library with offsets. A place is
stable if a token starts there in both encodings and nothing that the library does reaches across it: the character before it is
ASCII white space and the one at it printable ASCII; or both are letters or digits of scripts that the normaliser leaves as they are
(`PLAIN`: no marks, nothing that composes) and the pre-tokenizer puts a border there wherever it stands. The tokens on each side then
depend on that side alone. Neighbours are spliced at the first such place in their overlap. Where an overlap holds none, it is widened:
the text from the last place that both sides of an earlier join proved (or from the chunk's start) to a window of the following chunk is
encoded again, twice as long each time, until the alignment holds or the text ends. Only texts of overlaps, and of chunks beside an overlap
that holds no place, travel to the join.

Defined cases: null text counts as empty, which has no tokens and no bytes; rows that repeat give one row each, with
null ids too; other columns of the input are not read. Special strings inside texts count as the library's default
does: as one special token.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import unicodedata
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held, lean, settle

LIMIT = 2048
CHUNK_CHARS, OVERLAP = 32_768, 512
CACHED = 150_000
SPACE = frozenset(" \t\n\r\x0b\x0c")


class WordBPE:
    """Counts of the word-end BPE of one vocabulary file (NFC, white space dropped, lower case)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.find = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")).findall
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.margin = 1 + max(map(len, self.special), default=0)  # a special string at a stable place is seen whole on both sides
        self.memory: dict[str, int] = {}

    def plain(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # the library lowers each character by itself: no final form
                text = text.replace("Σ", "σ")
        pieces = self.find(text.lower())
        if len(self.memory) > CACHED:
            self.memory.clear()
        if new := list(set(pieces).difference(self.memory)):
            self.memory.update(zip(new, self.counts(new)))
        return sum(map(self.memory.__getitem__, pieces))

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token. Apart by spaces they are encoded in one call, which numbers the words of its tokens."""
        words = self.tok.encode(" ".join(pieces), add_special_tokens=False).word_ids
        n = np.bincount(np.asarray(words, np.int64), minlength=len(pieces))
        if len(n) == len(pieces) and n.all():
            return n.tolist()
        return [len(e.ids) for e in self.tok.encode_batch(pieces, add_special_tokens=False)]

    def count(self, text: str) -> int:
        if self.split and any(s in text for s in self.special):
            parts = self.split.split(text)
            return sum(map(self.plain, parts)) + len(parts) - 1
        return self.plain(text)

    def starts(self, text: str) -> list[int]:
        """Start of each token in the text, by the library with offsets."""
        return [a for a, _ in self.tok.encode(text, add_special_tokens=False).offsets]


class PieceBPE:
    """Counts of a sentencepiece model; it is encoded whole, as its white space is part of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str) -> int:
        return len(self.sp.encode(text))


def worker_bpe(path: str) -> WordBPE | PieceBPE:
    os.environ["RAYON_NUM_THREADS"] = "1"
    return held(("counts", path), lambda: PieceBPE(path) if path.endswith(".model") else WordBPE(path))


@lru_cache(1 << 16)
def side(c: str) -> str:
    """The pre-tokenizer's class of a character that normalising leaves alone and that joins no neighbour: l, n or o; else nothing."""
    kind = unicodedata.category(c)
    if kind[0] in "MZC" or len(c.lower()) != 1 or unicodedata.normalize("NFC", c) != c or "\u1100" <= c <= "\u11ff":
        return ""
    return kind[0].lower() if kind[0] in "LN" else "o"


def border(text: str, p: int) -> bool:
    """Whether a pre-token starts at p whatever stands around, unless a special string reaches across it."""
    y = side(text[p])
    if text[p - 1] in SPACE:
        return y != ""
    x = side(text[p - 1])
    return x != "" and y != "" and (x != y or y == "n") and not (y == "l" and text[p - 1] == "'")


def stable(text: str, starts: list[int], base: int, low: int, high: int) -> list[tuple[int, int]]:
    """(place in the document, tokens before it in this chunk) of the stable places from low to before high."""
    out = []
    for p in range(max(1, low - base), min(len(text), high - base)):
        if border(text, p) and (k := bisect_left(starts, p)) < len(starts) and starts[k] == p:
            out.append((p + base, k))
    return out


def last_stable(text: str, starts: list[int], base: int, low: int, high: int) -> tuple[int, int] | None:
    """The last of stable()."""
    for end in range(high, low, -256):
        if found := stable(text, starts, base, max(low, end - 256), end):
            return found[-1]
    return None


def splice(bpe: WordBPE, parts: list[dict]) -> int:
    """Tokens of a document from its chunks, which are in order: base, n, head and tail (stable places in the overlaps), last (the last one before
    the overlap), margin, and text where an overlap has no stable place."""
    done, i, grow = 0, 1, 1
    current = parts[0]
    skip, at = 0, current["base"]  # tokens of the current chunk that are counted, and where the next one starts
    while i < len(parts):
        ahead = dict(parts[i]["head"])
        if common := next(((p, k) for p, k in current["tail"] if p in ahead and k >= skip), None):
            done += common[1] - skip
            current, at, skip = parts[i], common[0], ahead[common[0]]
            i, grow = i + 1, 1
            continue
        m = 1  # widened: from the last proven place to the end of one, two, four... chunks that hang together
        while m < grow and i + m < len(parts) and not parts[i + m]["head"]:
            m += 1
        if current["last"] and current["last"][1] >= skip and current["last"][0] > at:
            done += current["last"][1] - skip
            at, skip = current["last"]
        pieces, end = [current["text"][at - current["base"] :]], current["base"] + len(current["text"])
        for f in parts[i : i + m]:
            pieces.append(f["text"][end - f["base"] :])
            end = f["base"] + len(f["text"])
        text = "".join(pieces)
        starts = bpe.starts(text)
        i, grow = i + m, grow * 2
        overlap = parts[i]["base"] if i < len(parts) else end
        current = {"base": at, "text": text, "n": len(starts), "tail": stable(text, starts, at, overlap + bpe.margin, end - bpe.margin), "last": last_stable(text, starts, at, at + 1, min(overlap, end - bpe.margin))}
        skip = 0
    return done + current["n"] - skip


def counted(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Rows (id_col, n_bytes, n_tokens, over_limit) of all rows of df."""
    settle(df.sparkSession)
    key = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {key}, n_bytes long, n_tokens long"

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([bpe.count(t) for t in b.column(2).to_pylist()], pa.int64())], ["id", "n_bytes", "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key_, size, text in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                bases = range(0, max(1, len(text) - overlap), chunk_chars)
                n, same = len(bases), xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key_.as_py()] * n, batch.schema.field(0).type), pa.array([size] * n, pa.int64()), pa.array([same] * n), pa.array(bases, pa.int64()), pa.array([text[a : a + chunk_chars + overlap] for a in bases], pa.string())],
                    ["id", "n_bytes", "same", "base", "piece"],
                )

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for b in batches:
            out, kept = [], []
            for base, text in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                starts = bpe.starts(text)
                head = stable(text, starts, base, base + bpe.margin, base + overlap - bpe.margin) if base else []
                tail = stable(text, starts, base, base + chunk_chars + bpe.margin, base + len(text) - bpe.margin) if len(text) >= chunk_chars + overlap else []
                bad = bool((base and not head) or (len(text) > chunk_chars and not tail))
                out.append(json.dumps({"n": len(starts), "head": head, "tail": tail, "last": last_stable(text, starts, base, base + (bpe.margin if base else 1), base + min(chunk_chars, len(text) - bpe.margin)) if bad else None}))
                kept.append(text if bad else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out), pa.array(kept, pa.string())], ["id", "n_bytes", "same", "base", "spans", "piece"])

    def join(t: pa.Table) -> pa.Table:
        """All chunks of one text, as often as it stands with the same id."""
        d = t.to_pydict()
        parts = {b: json.loads(s) | {"base": b, "text": p} for b, s, p in zip(d["base"], d["spans"], d["piece"])}
        n = splice(worker_bpe(path), [parts[b] for b in sorted(parts)])
        times = d["base"].count(0)
        return pa.table({"id": pa.array([d["id"][0]] * times, t.schema.field("id").type), "n_bytes": pa.array([d["n_bytes"][0]] * times, pa.int64()), "n_tokens": pa.array([n] * times, pa.int64())})

    sized = src.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    if path.endswith(".model"):
        out = sized.mapInArrow(lean(short), schema)
    else:
        long = F.length("text") > chunk_chars + overlap
        chunk = f"id {key}, n_bytes long, same string, base long"
        spans = sized.filter(long).mapInArrow(lean(cut), f"{chunk}, piece string").repartition(F.col("same"), F.col("base")).mapInArrow(lean(leaves), f"{chunk}, spans string, piece string")
        out = sized.filter(~long).mapInArrow(lean(short), schema).unionByName(spans.groupBy("id", "same").applyInArrow(join, schema))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
