"""BPE encoding and decoding by tree concatenation.

Byte-level BPE as the tokenizers library does it with a vocabulary file whose pre-tokenizer is ByteLevel
(use_regex, no prefix space) and which has no normalizer. A text is cut at pre-token borders, which no merge
crosses. Short pre-tokens are encoded once per worker and remembered. What stays unsplit and is long is encoded
as a tree: halves are encoded apart, and at each join a window that takes in more and more tokens of both sides is
encoded again until its first and its last token agree with both sides. A sequence of BPE tokens is the encoding
of its bytes exactly if every two neighbours are the encoding of their bytes, and after agreement each pair of
neighbours lies in one of three sequences that are encodings; so the result is exact.

Documents longer than `chunk_chars` become rows of chunks that are encoded in different tasks. Chunks end where
the pre-tokenizer must split whatever stands around (before white space after other characters, or where a run of
letters or digits ends); a run longer than a chunk is cut inside, and the chunks' tokens are joined by windows too.

Defined cases: a null text counts as empty; an empty text has no tokens and decodes to the empty text; rows that
repeat, also with null or repeated ids, give one output row each; other columns of the input are not read.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held, lean, settle

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FIND = regex.compile(PATTERN).findall
#: Places where the pre-tokenizer splits in any context: white space after something else, the end of letters or digits.
BORDER = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])")
LONG = 256
CACHED = 150_000
CHUNK_CHARS = 32_768


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBPE:
    """The vocabulary, ranks of merges and the memory of pre-tokens of one worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_chars().items()}
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if token not in self.special else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_id = [vocab[byte_chars()[b]] for b in range(256)]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merge[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.tok = Tokenizer.from_file(path)
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.memory: dict[str, bytes] = {}
        self.core = self.ranked(vocab)

    def ranked(self, vocab: dict[str, int]):
        """The rank-merging encoder of the same vocabulary, or None where it isn't proven equal.

        It merges any two neighbours whose bytes are a token, lowest id first. That is the same as following the list
        of merges if ids rise with their ranks and each token's own bytes encode to that token: inside a span whose
        borders are token borders the merges are those of the span alone, which ends in that token by its listed pair."""
        import tiktoken

        ids = [new for _, new in sorted(self.merge.values())]
        if ids != sorted(ids) or len(set(ids)) != len(ids) or (ids and max(self.byte_id) > ids[0]):
            return None
        if any(self.merged(self.bytes_of[i]) != [i] for i in ids):
            return None
        ranks = {self.bytes_of[i]: i for i in [*self.byte_id, *ids]}
        return tiktoken._tiktoken.CoreBPE(ranks, {}, PATTERN)

    def merged(self, raw: bytes) -> list[int]:
        """BPE of bytes that are not split: always the merge of lowest rank, leftmost first."""
        ids = [self.byte_id[b] for b in raw]
        n, get = len(ids), self.merge.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i] if i < n else n
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := get((new, ids[k])):
                    heapq.heappush(heap, (m[0], i, new, ids[k], m[1]))
            if (h := before[i]) >= 0 and (m := get((ids[h], new))):
                heapq.heappush(heap, (m[0], h, ids[h], new, m[1]))
        return [x for x in ids if x >= 0]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of the bytes of left and right, both encodings, by growing windows around the join."""
        if not left or not right:
            return left + right
        k = 4
        while True:
            a, b = left[-k:], right[:k]
            window = self.merged(b"".join(map(self.bytes_of.__getitem__, a + b)))
            # agreement with a side: the window starts (ends) with the token that stands there, or takes in the whole side
            if (len(a) == len(left) or window[0] == a[0]) and (len(b) == len(right) or window[-1] == b[-1]):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2

    def tree(self, raw: bytes, leaf: int = LONG) -> list[int]:
        """Halves apart, then joined; level by level, so that depth and memory stay small."""
        level = [self.merged(raw[i : i + leaf]) for i in range(0, len(raw), leaf)]
        while len(level) > 1:
            level = [self.joined(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def learn(self, pieces: Iterable[str]) -> None:
        """Encodings of pre-tokens not yet remembered."""
        new = set(pieces).difference(self.memory)
        if not new:
            return
        short = [p for p in new if len(p) <= LONG]
        if self.core:
            one = self.core.encode_single_piece
            for p in short:
                ids = one(p.encode("utf-8", "surrogatepass"))
                self.memory[p] = pack(f"{len(ids)}i", *ids)
        else:
            for p, e in zip(short, self.tok.encode_batch(short, add_special_tokens=False)):
                self.memory[p] = pack(f"{len(e.ids)}i", *e.ids)
        for p in new:
            if len(p) > LONG:
                self.memory[p] = np.asarray(self.tree(p.encode("utf-8", "surrogatepass")), np.int32).tobytes()

    def plain(self, text: str) -> bytes:
        pieces = FIND(text)
        if len(self.memory) > CACHED:
            self.memory.clear()
        self.learn(pieces)
        return b"".join(map(self.memory.__getitem__, pieces))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, special strings as their ids (the library's default)."""
        if self.split and any(s in text for s in self.special):
            parts = [np.asarray([self.special[p]], np.int32).tobytes() if p in self.special else self.plain(p) for p in self.split.split(text)]
            return np.frombuffer(b"".join(parts), np.int32)
        return np.frombuffer(self.plain(text), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


def worker_bpe(path: str) -> ByteBPE:
    os.environ["RAYON_NUM_THREADS"] = "1"
    return held(("bpe", path), lambda: ByteBPE(path))


def chunks(text: str, size: int, special: Iterable[str] = ()) -> list[tuple[str, bool]]:
    """Pieces of about size characters, each with whether it must be joined to the one before by windows.

    A piece ends at a border of pre-tokens that holds in any context; where there is none within size characters, the
    run of one class is cut in its middle. Special strings are never cut."""
    out, at, hard, n = [], 0, False, len(text)
    taken = [(m.start(), m.end()) for m in regex.finditer("|".join(map(regex.escape, special)), text)] if special and any(s in text for s in special) else []
    while n - at > size:
        cut, next_hard = -1, False
        for m in BORDER.finditer(text, at + size // 2, min(n, at + size)):
            if m.start() > at and not any(a < m.start() < b for a, b in taken):
                cut = m.start()
        if cut < 0:
            cut, next_hard = inner_cut(text, at, at + size, taken)
            if cut < 0:
                break
        out.append((text[at:cut], hard))
        at, hard = cut, next_hard
    out.append((text[at:], hard))
    return out


def kind(c: str) -> str:
    return "s" if regex.match(r"\s", c) else "l" if regex.match(r"\p{L}", c) else "n" if regex.match(r"\p{N}", c) else "o"


def inner_cut(text: str, at: int, goal: int, taken: list[tuple[int, int]]) -> tuple[int, bool]:
    """A cut inside one pre-token with four characters of its class on both sides; else the next border; else none (-1)."""
    for cut in range(goal, at + 8, -1):
        around = text[cut - 4 : cut + 5]
        if len(around) == 9 and len({kind(c) for c in around}) == 1 and not any(a < cut + 5 and cut - 4 < b for a, b in taken):
            return cut, True
    for m in BORDER.finditer(text, goal):
        if not any(a < m.start() < b for a, b in taken):
            return m.start(), False
    return -1, False


def encoded(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Rows (id, ids array<int>, decoded string) of all rows of df: the token ids of the text, and the ids decoded again."""
    settle(df.sparkSession)
    kind_of = df.schema[id_col].dataType.simpleString()
    src = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {kind_of}, ids array<int>, decoded string"

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield from rows(part.column(0), (bpe.encode(t) for t in part.column(1).to_pylist()), bpe)

    def rows(keys: pa.Array, encodings: Iterable[np.ndarray], bpe: ByteBPE) -> Iterator[pa.RecordBatch]:
        """Batches of some 300,000 tokens, whatever the length of texts."""
        start, found, texts, total = 0, [], [], 0
        for ids in encodings:
            found.append(ids)
            texts.append(bpe.decode(ids))
            total += len(ids)
            if total > 300_000:
                yield packed(keys.slice(start, len(found)), found, texts)
                start, found, texts, total = start + len(found), [], [], 0
        if found:
            yield packed(keys.slice(start, len(found)), found, texts)

    def packed(keys: pa.Array, found: list[np.ndarray], texts: list[str]) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
        return pa.RecordBatch.from_arrays([keys, ids, pa.array(texts, pa.string())], ["id", "ids", "decoded"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = tuple(worker_bpe(path).special)
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1).to_pylist()):
                pieces = chunks(text, chunk_chars, special)
                n, same = len(pieces), xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * n, batch.schema.field(0).type), pa.array([same] * n), pa.array(range(n), pa.int32()), pa.array([h for _, h in pieces]), pa.array([p for p, _ in pieces], pa.string())],
                    ["id", "same", "seq", "hard", "piece"],
                )

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for b in batches:
            ids = [bpe.encode(t).tobytes() for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ids, pa.binary())], ["id", "same", "seq", "hard", "tokens"])

    def join(t: pa.Table) -> pa.Table:
        """All chunks of one text, as often as it stands with the same id: the rows that repeat give as many rows."""
        bpe = worker_bpe(path)
        d = t.select(["seq", "hard", "tokens"]).to_pydict()
        found = {s: (h, np.frombuffer(x, np.int32)) for s, h, x in zip(d["seq"], d["hard"], d["tokens"])}
        times = d["seq"].count(0)
        runs: list[list[np.ndarray]] = []  # of chunks that hang together by cuts inside a pre-token
        for s in sorted(found):
            hard, ids = found[s]
            runs[-1].append(ids) if hard and runs else runs.append([ids])
        done = []
        for run in runs:
            level = [x for x in run]
            while len(level) > 1:
                level = [joined_tail(bpe, level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            done.append(level[0])
        ids = np.concatenate(done)
        return pa.Table.from_batches([packed(t.column("id").combine_chunks().slice(0, 1), [ids], [bpe.decode(ids)])] * times)

    long = F.length("text") > chunk_chars
    near = src.filter(~long).mapInArrow(lean(short), schema)
    pieces = src.filter(long).mapInArrow(lean(cut), f"id {kind_of}, same string, seq int, hard boolean, piece string")
    far = (
        pieces.repartition(F.col("same"), F.col("seq"))
        .mapInArrow(lean(leaves), f"id {kind_of}, same string, seq int, hard boolean, tokens binary")
        .groupBy("id", "same")
        .applyInArrow(join, schema)
    )
    return near.unionByName(far)


def joined_tail(bpe: ByteBPE, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The join of two chunks cut inside one pre-token: only the tokens of that pre-token on both sides take part."""

    def inside(ids: np.ndarray, last: bool) -> int:
        """How many tokens at that end belong to the pre-token at the end."""
        pieces = FIND(bpe.decode(ids))
        return len(bpe.encode(pieces[-1] if last else pieces[0]))

    a, b = inside(left, True), inside(right, False)
    return np.concatenate([left[: len(left) - a], np.asarray(bpe.joined(left[len(left) - a :].tolist(), right[:b].tolist()), np.int32), right[b:]])


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Rows (id_col, ids)."""
    return encoded(df, path, id_col, text_col, chunk_chars).select(F.col("id").alias(id_col), "ids")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id_col, text): ids as text, special tokens kept; null ids give a null text."""
    kind_of = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for b in batches:
            texts = [None if x is None else bpe.decode(np.asarray(x, np.int32)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(lean(run), f"`{id_col}` {kind_of}, text string")


def digests(df: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """The contract's row of each document, from encoded()."""
    return encoded(df, path, chunk_chars=chunk_chars).select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
