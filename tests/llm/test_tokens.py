"""BPE and token counts against the library itself."""

import hashlib
import random
import time

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, token_counts

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
rng = random.Random(7)
ALPHABETS = ["abc de", "aé ñ'st\n", " \t\n\r\x0b", "!?.'-s", "0123 a", "日本語 テキスト", "ΑΣς σ", "éä ", "İi ſK", "   x", "\x1c\x1d\x1e\x1f a", "👍🏽 👨‍👩‍👧 a"]


def texts():
    out = ["", " ", "  ", "a", "<|endoftext|>", "x <|endoftext|> y<|startoftext|>", "it's we'll 'S 've''s", "a" * 3000, " " * 2000 + "x", "ab" * 1500, "1" * 999, "!" * 900 + "'s", "'s" * 700, "é" * 1200, "日" * 700]
    out += ["".join(rng.choice(a) for _ in range(rng.randint(1, 400))) for a in ALPHABETS for _ in range(25)]
    out += ["".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randint(1, 600))) for _ in range(100)]
    return out


@pytest.fixture(scope="module")
def frame(spark):
    t = texts()
    return t, spark.createDataFrame([(i, x, i) for i, x in enumerate(t)] + [(-1, None, 0), (5, t[5], 1), (7, t[7], 1), (None, t[7], 1), (None, t[7], 1)], "doc_id long, text string, ids int")


@pytest.mark.parametrize("size", [64, 257, 100_000])
def test_bpe_equals_library(spark, frame, size):
    t, df = frame
    tok = Tokenizer.from_file(BYTE)
    rows = bpe.encoded(df, BYTE, chunk_chars=size).collect()
    assert len(rows) == df.count()
    for r in rows:
        x = t[7] if r.id is None else "" if r.id < 0 else t[r.id]
        want = tok.encode(x, add_special_tokens=False).ids
        assert r.ids == want, (x[:80], size)
        assert r.decoded == tok.decode(want, skip_special_tokens=False)


def test_bpe_digests_and_decode(spark, frame):
    t, df = frame
    tok = Tokenizer.from_file(BYTE)
    for r in bpe.digests(df.filter("doc_id >= 0"), BYTE).collect():
        ids = tok.encode(t[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, BYTE), BYTE).collect()}
    assert all(back[i] == x for i, x in enumerate(t))


def test_tree_joins(spark):
    b = bpe.ByteBPE(BYTE)
    for _ in range(60):
        raw = "".join(rng.choice(rng.choice(["aeiou", "the", "én", "ing"])) for _ in range(rng.randint(1, 900))).encode()
        for leaf in (1, 3, 64):
            assert b.tree(raw, leaf) == b.merged(raw)
        i = rng.randint(0, len(raw))
        assert b.joined(b.merged(raw[:i]), b.merged(raw[i:])) == b.merged(raw)


@pytest.mark.parametrize("size,over", [(40, 10), (64, 30), (300, 20), (100_000, 512)])
def test_counts_equal_library(spark, frame, size, over):
    t, df = frame
    tok = Tokenizer.from_file(WORD)
    rows = token_counts.counted(df, WORD, limit=50, chunk_chars=size, overlap=over).collect()
    assert len(rows) == df.count()
    for r in rows:
        x = t[7] if r.doc_id is None else "" if r.doc_id < 0 else t[r.doc_id]
        n = len(tok.encode(x, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(x.encode()), n > 50), (x[:80], size)


@pytest.mark.parametrize("unit", ["日本語テキスト、これは長い文です。", "aGVsbG8gd29ybGQ0MTI3", "abcdefghij", "กขคงจฉชซ", "x<|endoftext|>", "한국어", "é́", "1"])
def test_long_texts_without_white_space(spark, unit):
    """Many chunks whose overlaps hold no white space: counted as the library does, in time that grows with the text."""
    bpe = token_counts.worker_bpe(WORD)
    seconds = []
    for n in (20_000, 160_000):
        text = unit * (n // len(unit))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        row = token_counts.counted(df, WORD, chunk_chars=2500, overlap=128).first()
        assert row.n_tokens == len(bpe.tok.encode(text, add_special_tokens=False).ids)
        parts, size = [], 2500
        for base in range(0, max(1, len(text) - 128), size):
            t = text[base : base + size + 128]
            starts = bpe.starts(t)
            head = token_counts.stable(t, starts, base, base + bpe.margin, base + 128 - bpe.margin) if base else []
            tail = token_counts.stable(t, starts, base, base + size + bpe.margin, base + len(t) - bpe.margin)
            parts.append({"base": base, "text": t, "n": len(starts), "head": head, "tail": tail, "last": token_counts.last_stable(t, starts, base, base + bpe.margin, base + min(size, len(t) - bpe.margin))})
        began = time.process_time()
        assert token_counts.splice(bpe, parts) == row.n_tokens
        seconds.append(time.process_time() - began)
    assert seconds[1] < 40 * max(seconds[0], 0.02)


def test_sentencepiece_and_empty(spark, frame):
    import sentencepiece

    t, df = frame
    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in token_counts.counted(df.filter("doc_id >= 0"), path).collect():
        assert r.n_tokens == len(sp.encode(t[r.doc_id]))
    none = df.limit(0)
    assert token_counts.counted(none, WORD).count() == bpe.encoded(none, BYTE).count() == 0
