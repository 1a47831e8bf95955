import hashlib

import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import decontamination, jaccard_join, language_id, toxicity
from tests.llm.test_jaccard import brute, corpus

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "toxicity", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding"]
    step = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in step.select("doc_id").collect()}
        out = corpus_pipeline.written(f(spark, step, SF), "t")
        assert out.columns == docs.columns
        kept = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= before
        if name == "language ID":
            m = language_id.Models.load(language_id.fit(step))
            assert set(kept) == {i for i in before if not m.predict(text[i])[3]} and len(kept) > 0.98 * len(before)
        elif name == "toxicity":
            m = toxicity.Machine.load(toxicity.fit(step, spark.read.parquet(f"{SF}/labels.parquet")))
            assert set(kept) == {i for i in before if m.score(text[i]) < 0.5}
        elif name == "n-gram Jaccard join":
            assert set(kept) == {c for *_, c in brute([(i, text[i]) for i in sorted(before)])} and len(kept) < len(before)
        else:
            items = [decontamination.plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            gone = before - set(kept)
            assert gone >= {i for i in before if any(t in decontamination.plain(text[i]) for t in items)} and gone
        step = out
    last = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in step.collect())
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in last:
        assert r.ids == tok.encode(text[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_representatives_of_odd_rows(spark, monkeypatch):
    rows = corpus(60)
    df = spark.createDataFrame([(*r, "k", i) for i, r in enumerate(rows)], "doc_id long, text string, row_key string, ROW_ID int")
    for limit in (1_000_000, 0):
        monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", limit)
        out = jaccard_join.representatives(df)
        assert out.columns == df.columns
        got = out.collect()
        empty = [r for r in rows if not (r[1] or "").split()]
        want = {c for (i, n, s, c) in brute(rows) if n}
        assert len(got) == len(empty) + len({r.doc_id for r in got if (r.text or "").split()}) and {r.doc_id for r in got if (r.text or "").split()} == want


def test_empty_and_null_documents(spark, tmp_path):
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for name, f in corpus_pipeline.STAGES:
        for rows in ([], [(None, None, None, None, None), (1, "", None, None, 0), (2, "a few words of text", "en", "s", 5), (2, "a few words of text", "en", "s", 5)]):
            f(spark, spark.createDataFrame(rows, schema), str(tmp_path)).collect()
