"""Language-model scoring by Katz backoff over word n-grams, up to trigrams in production.

Seen n-grams get Good-Turing discounted counts; what discounting takes away goes to unseen continuations through backoff
weights that are computed exactly, from the sums over each history's seen continuations:

    P(w | h) = d(c) c(h, w) / c(h)                 if c(h, w) > 0
    P(w | h) = a(h) P(w | h'),  a(h) = (1 - sum of seen P(. | h)) / (1 - sum of their P(. | h')),  h' = h without its first word   else
    P(w)     = d(c) c(w) / N                       if c(w) > 0
    P(w)     = (1 - sum of the above) / M          else, M: unseen words as Chao's estimate has them

d(c) follows Good-Turing up to K, with Katz's renormalisation; where the counts of counts don't give a discount between 0 and 1,
and above K, an absolute discount stands in, so that each history has mass left. A text is its words and one end; the first
word's history is the start, the second's the start and the first word, and so on: no n-gram begins before the start. a(h) = 1 where h
isn't seen. Each order has discounts of its own. All training texts are counted, all n-grams kept.

Layout. Documents are packed into blocks (rows of a table in the shared folder: each block's distinct words and its
texts as numbers of them). Blocks pre-aggregate, and send distinct keys with their counts to hash partitions of the model's
tables as sorted, packed 64-bit keys; a partition adds up and answers each block with totals for its keys. Keys are spread by hash of the
whole n-gram, and each block sends a key once, so that frequent words or histories crowd no partition; the number of partitions
follows the number of keys. Sums over histories are made the same way: one block owns each distinct n-gram and adds it up.
Answers also say which n-grams no other block has. Longer n-grams that hold such a one are in no other block either: the block counts
them by itself, and sums over such a history by itself. From trigrams on, only the others are asked for. Blocks aren't shuffled: where a
block's answers arrive, it is read from its file.

Defined cases: null text counts as empty, which is one token, the end. With no training text all words are unknown: N = V = 0
and P(w) = 1. Words are bytes, valid UTF-8 or not. Repeated rows and null ids give one row each; a null id counts as the empty text in the
fold. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod, drop, lean_alone, settle, table, trim, unused, written

K = 7
BLOCK_TOKENS, PARTITION_KEYS = 2_000_000, 2_000_000
START, END = (xxhash.xxh3_64_intdigest(x) for x in (b"\r", b"\n"))  # no word holds white space


def packed(a: np.ndarray) -> bytes:
    """An array by byte planes, compressed."""
    a = np.ascontiguousarray(a)
    return zstandard.ZstdCompressor(1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def unpacked(b: bytes, kind: type) -> np.ndarray:
    raw, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1) if len(raw) else np.zeros(0, kind)


def packed_keys(sorted_keys: np.ndarray) -> bytes:
    return packed(np.diff(sorted_keys, prepend=np.uint64(0)))


def unpacked_keys(b: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unpacked(b, np.uint64), dtype=np.uint64)


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit keys of bigrams from the words' hashes."""
    with np.errstate(over="ignore"):
        x = h * np.uint64(0x9E3779B97F4A7C15) ^ w
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ranking(keys: np.ndarray) -> np.ndarray:
    """The stable argsort of unsigned 64-bit keys. Their leading bits are sorted together with their places, as numbers, which takes a fraction of
    the time; what those bits leave open is settled by a sort of what is almost sorted."""
    if not len(keys):
        return np.zeros(0, np.int64)
    x, places = keys - keys.min(), (len(keys) - 1).bit_length()
    cut = max(0, int(x.max()).bit_length() + places - 64)
    x >>= np.uint64(cut)
    x <<= np.uint64(places)
    x |= np.arange(len(x), dtype=np.uint64)
    x.sort()
    x &= np.uint64((1 << places) - 1)
    order = x.view(np.int64)
    if cut:
        ranked = keys[order]
        if (ranked[1:] < ranked[:-1]).any():
            order = order[np.argsort(ranked, kind="stable")]
    return order


def firsts(ranked: np.ndarray) -> np.ndarray:
    """Where another value begins among sorted ones."""
    out = np.ones(len(ranked), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=out[1:])
    return out


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.unique(keys, return_inverse=True)."""
    order = ranking(keys)
    ranked = keys[order]
    first = firsts(ranked)
    inverse = np.empty(len(keys), np.int32)
    inverse[order] = np.cumsum(first, dtype=np.int32) - 1
    return ranked[first], inverse


def cut_by_partition(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    """Borders of the n ranges of 64-bit keys."""
    edges = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_keys, edges), [len(sorted_keys)]]).astype(np.int64)


class Discounts:
    """d(c) from the counts of counts n[1..K+1]."""

    def __init__(self, n: np.ndarray):
        d = np.ones(K + 1)
        a = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
        for r in range(1, K + 1):
            x = ((r + 1) * n[r + 1] / (r * n[r]) - a) / (1 - a) if n[r] and a < 1 else 0.0
            d[r] = x if 0.01 < x < 0.995 else (r - 0.5) / r
        self.d, self.above = d, min(0.9, max(0.05, K * (1 - d[K])))

    def kept(self, c: np.ndarray) -> np.ndarray:
        """d(c) c."""
        c = c.astype(np.float64)
        return np.where(c <= K, self.d[np.minimum(c, K).astype(np.int64)] * c, c - self.above)


class Unigrams:
    """P(w) from N, V and the counts of counts."""

    def __init__(self, total: int, types: int, n: np.ndarray):
        self.total, self.types, self.discounts = total, types, Discounts(n)
        r = np.arange(K + 1)
        low = np.where(r, n[: K + 1], 0).astype(float)
        mass = (low * self.discounts.kept(r)).sum() + (total - (low * r).sum()) - self.discounts.above * (types - low.sum())
        self.unseen = (1 - mass / total if total else 1.0) / max(1.0, n[1] ** 2 / (2.0 * max(1, n[2])) if types else 1.0)

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.discounts.kept(c) / max(1, self.total), self.unseen)


def tokenised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words' hashes (the start's and the end's first); each text as numbers of them, one text after the other, with its start and end; its number of
    tokens, which are its words (ASCII letters in lower case, parted by ASCII white space) and its end."""
    lists = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts))
    bounds = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    raw = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
    words, codes = coded.dictionary.cast(raw).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if b"" in words:  # beside white space at the ends
        keep = codes != words.index(b"")
        bounds, codes = np.concatenate([[0], np.cumsum(keep)])[bounds - bounds[0]], codes[keep]
    sizes = np.diff(bounds) + 1
    ends = np.cumsum(sizes + 1)
    out, inner = np.empty(len(codes) + 2 * len(sizes), np.int32), np.ones(len(codes) + 2 * len(sizes), bool)
    out[ends - 1], out[ends - sizes - 1] = 1, 0
    inner[ends - 1] = inner[ends - sizes - 1] = False
    out[inner] = codes + 2
    return np.concatenate([np.array([START, END], np.uint64), hashes]), out, sizes.astype(np.int32)


def joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of several tokenised() as one: the hashes of their words in order, numbers of them, sizes."""
    words, number = numbered(np.concatenate([h for h, _, _ in parts]))
    begins = np.cumsum([0, *(len(h) for h, _, _ in parts)])
    tokens = np.concatenate([number[begin : begin + len(h)][c] for begin, (h, c, _) in zip(begins, parts)])
    used = np.zeros(len(words), bool)
    used[tokens] = True
    if not used.all():  # the batch had texts for another block too
        tokens = (np.cumsum(used, dtype=np.int32) - 1)[tokens]
    return words[used], tokens, np.concatenate([s for _, _, s in parts])


BLOCK = "block string, n_words long, n_pairs long, n_tokens long, words binary, tokens binary, sizes array<int>, held array<boolean>"


def blocks_of(df: DataFrame, id_col: str, text_col: str, held: Column, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents in blocks (BLOCK and ids array)."""
    settle(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, seq = TaskContext.get().partitionId(), 0
        ids, held, parts, total = [], [], [], 0

        def block(key_type: pa.DataType) -> pa.RecordBatch:
            nonlocal seq
            words, tokens, sizes = joined(parts)
            pairs = np.sort(tokens[:-1].astype(np.int64) * len(words) + tokens[1:])
            seq += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{at}-{seq}"]), pa.array([len(words)]), pa.array([int(firsts(pairs).sum())]), pa.array([total]), pa.array([packed_keys(words)]), pa.array([packed(tokens)]), pa.array([sizes], pa.list_(pa.int32())), pa.array([held], pa.list_(pa.bool_())), pa.array([ids], pa.list_(key_type))],
                ["block", "n_words", "n_pairs", "n_tokens", "words", "tokens", "sizes", "held", "ids"],
            )

        for batch in batches:
            key_type = batch.schema.field(0).type
            keys, hold = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            hashes, codes, sizes = tokenised(batch.column(1))
            ends, i = np.cumsum(sizes), 0
            while i < len(keys):
                done = int(ends[i - 1]) if i else 0
                z = min(len(keys), int(np.searchsorted(ends, done + block_tokens - total)) + 1)  # the text that fills the block is its last
                parts.append((hashes, codes[done + i : int(ends[z - 1]) + z], sizes[i:z]))  # each text has a start besides
                ids += keys[i:z]
                held += hold[i:z]
                total += int(ends[z - 1]) - done
                i = z
                if total >= block_tokens:
                    yield block(key_type)
                    ids, held, parts, total = [], [], [], 0
        if parts:
            yield block(key_type)

    return src.mapInArrow(lean_alone(run), f"{BLOCK}, ids array<{kind}>")


class Grams:
    """The distinct n-grams of one order in a block, sorted by key: histories and suffixes (numbers among those of the order below), last
    words, training counts; `at`: the tokens that have words enough before them, `of`: their n-grams."""

    def __init__(self, block: "Block", below: "Grams | None"):
        self.order = below.order + 1 if below else 2
        if below:
            self.at = np.flatnonzero(block.position >= self.order - 2).astype(np.int32)
            of = np.full(len(block.w), -1, np.int32)
            of[below.at] = below.of
            h, s, n = of[self.at - 1], of[self.at], len(below.keys)
        else:
            self.at, h, s, n = np.arange(len(block.w), dtype=np.int32), block.h, block.w, len(block.words)
        code, inverse = numbered(h.astype(np.uint64) * np.uint64(n) + s.astype(np.uint64))
        h, s = (code // n).astype(np.int32), (code % n).astype(np.int32)
        last = below.last[s] if below else s
        keys = pair_keys((below.keys if below else block.words)[h], block.words[last])
        order = ranking(keys)
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        self.of = back[inverse]
        self.keys, self.h, self.s, self.last = keys[order], h[order], s[order], last[order]
        self.counts = np.bincount(self.of[block.train[self.at]], minlength=len(order))


class Block:
    """A row of the table of blocks, unpacked."""

    def __init__(self, words: bytes, tokens: bytes, sizes: list[int], held: list[bool]):
        self.words, tokens = unpacked_keys(words), unpacked(tokens, np.int32)
        self.sizes, self.held = np.asarray(sizes, np.int64), np.asarray(held, bool)
        ends = np.cumsum(self.sizes + 1)
        keep = np.ones(len(tokens), bool)
        keep[ends - self.sizes - 1] = False  # the starts are no tokens
        self.w = tokens[keep]
        last = np.ones(len(tokens), bool)
        last[ends - 1] = False
        self.h = tokens[last]
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.position = (np.arange(len(self.w)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)).astype(np.int32)
        self.train = ~self.held[self.doc]

    def unigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and training counts of all words; the start has the number of training texts."""
        c = np.bincount(self.w[self.train], minlength=len(self.words))
        c[np.searchsorted(self.words, np.uint64(START))] = (~self.held).sum()
        return self.words, c


def told_of(told: pa.Table, order: int) -> np.ndarray:
    """The answers of one order, in the order of the keys."""
    t = told.filter(pa.compute.equal(told["order"], order))
    return np.concatenate([np.zeros(0, np.int64), *(unpacked(b, np.int64) for _, b in sorted(zip(t["part"].to_pylist(), t["totals"].to_pylist())))])


def known(block: Block, told: pa.Table, order: int) -> Iterator[tuple[Grams | None, np.ndarray, np.ndarray, np.ndarray]]:
    """(n-grams, totals, whether the block owns them, whether no other block has them), of words and each order to the given one."""
    code, g = told_of(told, 1), None
    alone = (code & 2) > 0
    yield None, code >> 2, (code & 1) > 0, alone
    for m in range(2, order + 1):
        g = Grams(block, g)
        code = told_of(told, m)
        if m > 2:
            asked, new = ~(alone[g.h] | alone[g.s]), g.counts * 4 + 3
            new[asked] = code
            code = new
        alone = (code & 2) > 0
        yield g, code >> 2, (code & 1) > 0, alone


REQUEST = "part int, block string, keys binary, counts binary"


def cut_rows(name: str, keys: np.ndarray, counts: np.ndarray, partitions: int) -> list[tuple]:
    cuts = cut_by_partition(keys, partitions)
    return [(i, name, packed_keys(keys[a:z]), packed(counts[a:z].astype(np.int64))) for i, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]


def request_table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.binary(), pa.binary()))], names=["part", "block", "keys", "counts"])


def requests(blocks: DataFrame, pairs: bool, partitions: int) -> DataFrame:
    """Each block's keys and training counts, cut by partition of the model's table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, *state in zip(*(c.to_pylist() for c in b.columns)):
                block = Block(*state)
                if pairs:
                    g = Grams(block, None)
                    keys, counts = g.keys, g.counts
                else:
                    keys, counts = block.unigrams()
                yield from request_table(cut_rows(name, keys, counts, partitions)).to_batches()

    return blocks.select("block", "words", "tokens", "sizes", "held").mapInArrow(lean_alone(run), REQUEST)


def open_requests(blocks: DataFrame, tables: list[DataFrame], partitions: int) -> DataFrame:
    """Of the order above the tables', the keys that another block may have, as requests() has them; the statistics of the others lie at
    partition -1."""
    order = len(tables) + 1

    def run(told: pa.Table) -> pa.Table:
        name, block = opened(told)
        for below, _, _, alone in known(block, told, order - 1):
            pass
        g = Grams(block, below)
        closed = alone[g.h] | alone[g.s]
        rows = cut_rows(name, g.keys[~closed], g.counts[~closed], partitions)
        out = request_table([*rows, (-1, name, None, packed(tallied(g.counts[closed])))])
        trim()
        return out

    return all_told(blocks, tables).groupBy("block").applyInArrow(run, REQUEST)


def all_told(blocks: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """The answers of the orders from 1 on, by block, and at order 0 the file that holds the block: only answers are shuffled, the block is read
    from the shared folder where its answers arrive."""
    parts = [t.filter("block is not null").select("block", "part", "totals", F.lit(m).alias("order")) for m, t in enumerate(tables, 1)]
    files = blocks.select("block", F.lit(0).alias("part"), F.input_file_name().cast("binary").alias("totals"), F.lit(0).alias("order"))
    return reduce(DataFrame.unionByName, parts, files)


def opened(told: pa.Table) -> tuple[str, Block]:
    """The name of the block that these answers are for, and the block."""
    from pyarrow import fs, parquet

    row = told.filter(pa.compute.equal(told["order"], 0)).slice(0, 1).to_pylist()[0]
    store, path = fs.FileSystem.from_uri(row["totals"].decode())
    state = parquet.read_table(path, filesystem=store, columns=["words", "tokens", "sizes", "held"], filters=[("block", "=", row["block"])]).to_pylist()[0]
    return row["block"], Block(**state)


def tallied(totals: np.ndarray) -> np.ndarray:
    """Sum of counts, keys with a count, counts of counts from 0 to K + 1."""
    return np.array([totals.sum(), (totals > 0).sum(), *np.bincount(np.minimum(totals, K + 2).astype(np.int64), minlength=K + 3)[: K + 2]], np.int64)


ANSWER = "part int, block string, totals binary, stats array<long>"


def answers(asked: DataFrame) -> DataFrame:
    """For each request the totals of its keys, four times over, plus one where the block owns the key, plus two where no other block has
    it; and, with a null block, each partition's statistics (tallied, without the start)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        part, names = t.column("part")[0].as_py(), t.column("block").to_pylist()
        if part < 0:
            stats = sum(unpacked(c, np.int64) for c in t.column("counts").to_pylist()).tolist()
            return pa.table({"part": pa.array([part], pa.int32()), "block": pa.array([None], pa.string()), "totals": pa.array([None], pa.binary()), "stats": pa.array([stats], pa.list_(pa.int64()))})
        keys = [unpacked_keys(k) for k in t.column("keys").to_pylist()]
        counts = np.concatenate([unpacked(c, np.int64) for c in t.column("counts").to_pylist()])
        sizes = np.array([len(k) for k in keys])
        flat = np.concatenate(keys)
        del keys
        order = ranking(flat)
        ranked = flat[order]
        first = firsts(ranked)
        totals = np.add.reduceat(counts[order], np.flatnonzero(first))
        stats = tallied(totals[ranked[first] != np.uint64(START)]).tolist()
        code = np.empty(len(flat), np.int64)
        code[order] = totals[np.cumsum(first) - 1] * 4 + (first & np.r_[first[1:], True]) * 2 + first
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        blobs = [packed(code[a:z]) for a, z in zip(cuts, cuts[1:])]
        n = len(names)
        return pa.table({"part": pa.array([part] * (n + 1), pa.int32()), "block": pa.array([*names, None], pa.string()), "totals": pa.array([*blobs, None], pa.binary()), "stats": pa.array([None] * n + [stats], pa.list_(pa.int64()))})

    return asked.groupBy("part").applyInArrow(run, ANSWER)


def statistics(answered: DataFrame) -> np.ndarray:
    """The sum of all partitions' statistics."""
    rows = answered.filter("stats is not null").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    out = np.zeros(K + 4, np.int64)
    for r in rows:
        out[r.pos] = r.n
    return out


SCORED = "kind string, order int, part int, block string, docs array<struct<i:int,n_tokens:long,n_known:long,base:double,score:double>>, keys binary, left binary, seen binary, doc binary, n binary"


def block_scores(blocks: DataFrame, tables: list[DataFrame], one: Unigrams, discounts: list[Discounts], partitions: list[int]) -> DataFrame:
    """Of each block: its texts' scores without the backoff weights of histories that other blocks have too (`docs`); what its own n-grams
    take from and leave to such histories (`sums`); and where its texts need their weights (`needs`). discounts and partitions: of each
    order from 2 on, partitions of its histories."""
    top = len(tables)

    def run(told: pa.Table) -> pa.Table:
        name, block = opened(told)
        n = len(block.sizes)
        out: list[tuple] = []
        below_p = below_c = below_alone = below_keys = value = weights = None
        for g, c, owner, alone in known(block, told, top):
            if g is None:
                p = one.p(c)
                value, weights = np.log10(p)[block.w], np.zeros(n)
                base = np.bincount(block.doc, np.log10((c[block.w] + 1) / (one.total + one.types + 1)), n)
                known_ = np.bincount(block.doc[c[block.w] > 0], minlength=n)
                below_p, below_c, below_alone, below_keys = p, c, alone, block.words
                continue
            d, parts = discounts[g.order - 2], partitions[g.order - 2]
            seen, c_h = c > 0, np.maximum(below_c[g.h], 1)
            kept = d.kept(c)
            mine = np.flatnonzero(owner & seen)
            took = np.bincount(g.h[mine], c[mine] - kept[mine], len(below_c))  # few distinct values, which pack well; counts of histories go apart
            left_ = took / np.maximum(below_c, 1)
            seen_ = np.bincount(g.h[mine], below_p[g.s[mine]], len(below_c))
            with_ = np.flatnonzero((left_ > 0) & ~below_alone)
            keys = below_keys[with_]
            cuts = cut_by_partition(keys, parts)
            out += [("sums", g.order, i, name, None, packed_keys(keys[a:z]), packed(took[with_[a:z]]), packed(seen_[with_[a:z]]), None, packed(below_c[with_[a:z]].astype(np.int64))) for i, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]
            p = np.where(seen, kept / c_h, 1.0)
            value[g.at] = np.where(seen[g.of], np.log10(p)[g.of], value[g.at])
            lacking = np.flatnonzero(~seen[g.of] & (below_c[g.h] > 0)[g.of])
            h, doc = g.h[g.of[lacking]], block.doc[g.at[lacking]]
            here = below_alone[h]
            weights += np.bincount(doc[here], np.log10(left_[h[here]]) - np.log10(np.maximum(1 - seen_[h[here]], 1e-12)), n)
            code, times = np.unique(h[~here].astype(np.int64) * n + doc[~here], return_counts=True)
            keys, doc = below_keys[code // n], code % n  # ascending in key: the order below is sorted by it
            cuts = cut_by_partition(keys, parts)
            out += [("needs", g.order, i, name, None, packed_keys(keys[a:z]), None, None, packed(doc[a:z].astype(np.int32)), packed(times[a:z].astype(np.int32))) for i, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]
            below_p, below_c, below_alone, below_keys = p, c, alone, g.keys
        score = np.bincount(block.doc, value, n) + weights
        docs = [{"i": i, "n_tokens": int(s), "n_known": int(k), "base": float(b), "score": float(x)} for i, (s, k, b, x) in enumerate(zip(block.sizes, known_, base, score))]
        out.append(("docs", None, None, name, docs, *[None] * 5))
        doc_type = pa.list_(pa.struct([("i", pa.int32()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]))
        types = [pa.string(), pa.int32(), pa.int32(), pa.string(), doc_type, *[pa.binary()] * 5]
        made = pa.table({f: pa.array(list(col), t) for f, col, t in zip(["kind", "order", "part", "block", "docs", "keys", "left", "seen", "doc", "n"], list(zip(*out)), types)})
        trim()
        return made

    return all_told(blocks, tables).groupBy("block").applyInArrow(run, SCORED)


def backoff(rows: DataFrame) -> DataFrame:
    """(block, i, backoff): the sum of log10 a(h) over the tokens of text i that back off."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("kind", "ascending"), ("block", "ascending")])
        d = t.select(["kind", "block", "keys", "left", "seen", "doc", "n"]).to_pylist()
        sums = [r for r in d if r["kind"] == "sums"]
        keys = np.concatenate([np.zeros(0, np.uint64), *(unpacked_keys(r["keys"]) for r in sums)])
        one, inverse = numbered(keys)
        count = np.ones(len(one))
        count[inverse] = np.concatenate([np.zeros(0, np.int64), *(unpacked(r["n"], np.int64) for r in sums)])
        left = np.bincount(inverse, np.concatenate([np.zeros(0), *(unpacked(r["left"], np.float64) for r in sums)]), len(one)) / count
        seen = np.bincount(inverse, np.concatenate([np.zeros(0), *(unpacked(r["seen"], np.float64) for r in sums)]), len(one))
        weight = np.log10(left) - np.log10(np.maximum(1 - seen, 1e-12))
        out = []
        for r in d:
            if r["kind"] == "needs":
                k, doc, n = unpacked_keys(r["keys"]), unpacked(r["doc"], np.int32), unpacked(r["n"], np.int32)
                at = np.searchsorted(one, k)
                i, back = np.unique(doc, return_inverse=True)
                out.append(pd.DataFrame({"block": r["block"], "i": i, "backoff": np.bincount(back, weight[at] * n)}))
        schema = pa.schema([("block", pa.string()), ("i", pa.int32()), ("backoff", pa.float64())])
        return pa.Table.from_pandas(pd.concat(out), schema, preserve_index=False) if out else schema.empty_table()

    parts = rows.filter("kind != 'docs'").select("order", "part", "kind", "block", "keys", "left", "seen", "doc", "n")
    return parts.groupBy("order", "part").applyInArrow(run, "block string, i int, backoff double").groupBy("block", "i").agg(F.sum("backoff").alias("backoff"))


def scored(df: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, partition_keys: int = PARTITION_KEYS, order: int = 2) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); held: rows that are scored, but not learned from; order: of the
    longest n-grams, 2 at least."""
    if order < 2:
        raise ValueError("order must be 2 at least")
    blocks = written(blocks_of(df, id_col, text_col, held, block_tokens), "blocks")
    size = blocks.agg(F.sum("n_words").alias("words"), F.sum("n_pairs").alias("pairs"), F.sum("n_tokens").alias("tokens")).first()
    few, many, most = (max(1, -(-int(n or 0) // partition_keys)) for n in size)
    tables = [written(answers(requests(blocks, False, few)), "unigrams"), written(answers(requests(blocks, True, many)), "bigrams")]
    for m in range(3, order + 1):
        unused(df.sparkSession)
        tables.append(written(answers(open_requests(blocks, tables, most)), f"{m}-grams"))
    s1, *more = map(statistics, tables)
    one = Unigrams(int(s1[0]), int(s1[1]), s1[2:])
    unused(df.sparkSession)
    rows = written(block_scores(blocks, tables, one, [Discounts(s[2:]) for s in more], [few, many, *[most] * order]), "block-scores")
    names = blocks.select("block", F.posexplode(F.arrays_zip("ids", "held")).alias("i", "x")).select("block", "i", F.col("x.ids").alias("id"), F.col("x.held").alias("held_out"))
    names = written(names, "names")
    drop(blocks, *tables)
    docs = rows.filter("kind = 'docs'").select("block", F.inline("docs"))
    return (
        names.join(docs, ["block", "i"])
        .join(backoff(rows), ["block", "i"], "left")
        .select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(s1[0])).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), (F.col("score") + F.coalesce("backoff", F.lit(0.0))).alias("score"))
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), F.expr(crc_mod("doc_id", 7) + " = 2"), order=3)
