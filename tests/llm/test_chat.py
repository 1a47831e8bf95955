import hashlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from tessera.llm import chat

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = sorted(con.execute(chat.OP2_SQL).fetchall())
    got = sorted(tuple(r) for r in chat.op2(spark, SF).collect())
    assert got == want and len(got) > 3 and any(r[0] == -7 for r in got)


def test_parts_and_escapes(spark):
    hard = [chat.HARD, "####", "\\\\###</turn>\n<|image:1|>", "", None, "a\\", "é👍 </turn></turn>", "\\: x"]
    rows = [(i // 3, i % 3, ["user", "assistant", "a: b\\"][i % 3], t) for i, t in enumerate(hard)] + [(None, None, None, "x"), (None, None, None, "x"), (9, 1, "assistant", "b"), (9, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, head int").withColumn("parts", chat.text_parts(F.col("text")))
    back = chat.read_back(chat.formatted(df))
    assert sorted((str(r.conv_id), str(r.turn), r.role, r.text) for r in back.collect()) == sorted((str(c), str(t), r or "", x or "") for c, t, r, x in rows)
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    got = {r.conv_id: r for r in chat.conversation_digests(back).collect()}
    assert set(got) == set(groups)
    for c, rs in groups.items():
        rs.sort(key=lambda r: (r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in rs if r[2] == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rs).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversation_digests(chat.read_back(chat.formatted(df.limit(0)))).count() == 0


def test_attachments(spark):
    p = [("text", "see <|image:1|>", None, None, None, None, None), ("image", None, "i.png", 28, 15, None, None), ("audio", None, "a.wav", None, None, 1.01, None), ("text", "and", None, None, None, None, None), ("document", None, "d.pdf", None, None, None, 3), ("video", None, "v", None, None, None, None), (None,) * 7]
    df = spark.createDataFrame([(1, 0, "assistant", p), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    a, b = chat.formatted(df).orderBy("turn").collect()
    assert a.formatted == "### assistant: see \\<|image:1|><|image:1|><|audio:2|>and<|document:3|></turn>\n"
    assert [(x.kind, x.ref, x.n_tokens) for x in a.attachments] == [("image", "i.png", 4), ("audio", "a.wav", 26), ("document", "d.pdf", 1920), ("unknown", "v", 0), ("unknown", None, 0)]
    assert all(a.formatted[x.start :].startswith(f"<|{x.kind}:") for x in a.attachments[:3])
    assert [a.formatted[s.start : s.start + s.n] for s in a.loss] == ["see \\<|image:1|>", "and"]
    assert (b.formatted, b.loss, b.attachments) == ("### user: </turn>\n", [], [])
    assert chat.read_back(chat.formatted(df)).orderBy("turn").first().loss_text == "see <|image:1|>and"
