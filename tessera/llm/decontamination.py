"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with runs of white space as one space. An item of m characters is found in a text
where a part of it lies within floor(`RATE` * m) edits of the item. With k edits allowed the item is split into k + 1 pieces; k
edits leave one of them whole, so exact hits of pieces (an automaton over all items' pieces, one scan of the text) name
every place that is possible. Around the hits Myers' bit-parallel algorithm computes the least distance at each end; a second run
backwards gives the start. Each item yields its matches that don't overlap, best first.

The items are a stated query set, taken in blocks of at most about `BLOCK_CHARS` characters; each block is broadcast and meets all rows.

Defined cases: null and empty texts and items (also of white space only) match nothing. Repeated documents and items give
their rows each. Null ids give rows with null ids. Other columns are not read by leaks(); clean() returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, held, lean, lean_udf, settle, table

RATE, BLOCK_CHARS = 0.05, 2_000_000


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def places(text: str) -> list[int]:
    """For each character of plain(text), and one past its end, the place in text that it comes from."""
    out, gap, start = [], False, True
    for i, c in enumerate(text):
        if c.isspace():
            gap = True
            continue
        if gap and not start:
            out.append(i - 1)
        out += [i] * len(c.lower())
        gap, start = False, False
    return [*out, len(text.rstrip())]


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their offsets."""
    n = len(item)
    cuts = [i * n // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def budget(item: str, rate: float) -> int:
    return min(int(rate * len(item)), max(0, len(item) - 1))


def ends(item: str, text: str, k: int, anchored: bool = False) -> Iterator[tuple[int, int]]:
    """(end, distance) of each end in text where a part of it is within k edits of the item (Myers). anchored: parts start at 0."""
    m = len(item)
    mask, top, eq = (1 << m) - 1, 1 << (m - 1), {}
    for i, c in enumerate(item):
        eq[c] = eq.get(c, 0) | 1 << i
    pv, mv, score = mask, 0, m
    for j, c in enumerate(text):
        e = eq.get(c, 0)
        xv = e | mv
        xh = ((((e & pv) + pv) ^ pv) | e) & mask
        ph, mh = mv | (~(xh | pv) & mask), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1 | anchored) & mask, mh << 1 & mask
        pv, mv = mh | (~(xv | ph) & mask), ph & xv
        if score <= k:
            yield j + 1, score


def matches(item: str, text: str, spans: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
    """(start, end, distance) of the matches within the spans of text, best first where they overlap, in order."""
    found = []
    for low, high in spans:
        part = text[low:high]
        for end, d in ends(item, part, k):
            found.append((d, low + end))
    out: list[tuple[int, int, int]] = []
    for d, end in sorted(found):
        if any(a < end <= b for a, b, _ in out):
            continue
        back = text[max(0, end - len(item) - k) : end][::-1]
        start = end - min((n for n, x in ends(item[::-1], back, k, True) if x == d), default=len(item))
        if not any(a < end and start < b for a, b, _ in out):
            out.append((start, end, d))
    return sorted(out)


class Finder:
    def __init__(self, items: list[tuple], rate: float):
        import ahocorasick

        self.items, by = [], {}
        for ident, text in items:
            if t := plain(text or ""):
                k = budget(t, rate)
                for at, piece in pieces(t, k):
                    by.setdefault(piece, []).append((len(self.items), at))
                self.items.append((ident, t, k))
        self.automaton = ahocorasick.Automaton()
        for piece, where in by.items():
            self.automaton.add_word(piece, (len(piece), where))
        if by:
            self.automaton.make_automaton()

    def find(self, raw: str) -> list[tuple]:
        """(item's id, start, end, distance) in places of the raw text."""
        if not self.items:
            return []
        text, windows = plain(raw), {}
        for last, (size, where) in self.automaton.iter(text):
            for i, at in where:
                _, t, k = self.items[i]
                start = last + 1 - size - at
                windows.setdefault(i, []).append((max(0, start - k), min(len(text), start + len(t) + k)))
        out = []
        for i, spans in windows.items():
            ident, t, k = self.items[i]
            merged: list[tuple[int, int]] = []
            for a, b in sorted(set(spans)):
                if merged and a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
            out += [(ident, *m) for m in matches(t, text, merged, k)]
        if out:
            at = places(raw)
            out = [(ident, at[a], at[b - 1] + 1, d) for ident, a, b, d in out]
        return out


def worker_finder(items: tuple, rate: float) -> Finder:
    return held(("finder", items, rate), lambda: Finder(list(items), rate))


def blocks_of(items: DataFrame, item_text: str, block_chars: int) -> Iterator[tuple]:
    """The items' distinct plain-cased texts, in blocks of about block_chars characters."""
    texts = items.select(F.lower(item_text).alias("t")).filter(F.trim("t") != "").distinct()
    total = texts.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    for k in range(blocks):
        mine = texts.filter(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k) if blocks > 1 else texts
        yield tuple(sorted((r.t, r.t) for r in mine.collect()))  # a block of bounded size: texts are distinct, so hashing spreads them


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (doc_id, item_id, start, end, distance): start and end are code points of the document's text. Ids of any type; items that repeat are
    sought once."""
    spark = docs.sparkSession
    settle(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = None
    for block in blocks_of(items, item_text, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = worker_finder(shared.value, rate)
            for b in batches:
                found = [(i, *m) for i, text in enumerate(b.column(1).to_pylist()) for m in finder.find(text)]
                at, *columns = list(zip(*found)) or [[]] * 5
                types = [pa.string(), pa.int64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(list(at), pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, types))], ["doc_id", "t", "start", "end", "distance"])

        part = src.mapInArrow(lean(run), f"doc_id {kind}, t string, start long, end long, distance int")
        out = part if out is None else out.unionByName(part)
    named = items.select(F.col(item_col).alias("item_id"), F.lower(item_text).alias("t"))
    return out.join(named, "t").select("doc_id", "item_id", "start", "end", "distance")


def flagged(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS, name: str = "n_leaks") -> DataFrame:
    """docs with one more column: the number of matches of any distinct item in the row's text (underscores are added while the name is taken)."""
    spark = docs.sparkSession
    settle(spark)
    total = F.lit(0)
    for block in blocks_of(items, item_text, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def count(text: pd.Series, shared=shared) -> pd.Series:
            finder = worker_finder(shared.value, rate)
            return pd.Series([len(finder.find(t or "")) for t in text], dtype="int32")

        total = total + lean_udf(count, "int")(F.col(text_col))
    (out,) = fresh(docs, name)
    return docs.withColumn(out, total)


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no item is found, with their columns."""
    marked = flagged(docs, items, **options)
    return marked.filter(F.col(marked.columns[-1]) == 0).select(*docs.columns)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
