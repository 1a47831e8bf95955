r"""Chat formatting of typed content parts.

A turn is a role and an array of parts: struct(kind, text, ref, width, height, seconds, pages). A visitor walks the
parts in order: text is escaped and appended; an image, audio or document part becomes a placeholder such as
`<|image:2|>` (its number among the turn's attachments), and its reference, place and expanded token count are
recorded. A turn is written as `### role: content</turn>` and a line break. Control strings inside texts (`\`, `###`,
`</turn>`, `<|`, and `: ` in roles) get a backslash, which reading takes away again, so formatting can be undone
exactly. The loss mask covers the text parts of assistant turns, as spans of code points of the turn's output.

Each turn is formatted by itself with built-in expressions, without a shuffle, so a conversation of any length is
never held in one place; a conversation's text is its turns in order.

Defined cases: null text counts as empty, null role as the empty role, null parts as none; a part of another kind or
with a null kind contributes nothing and is recorded as an attachment of kind `unknown` without tokens. Turns with the same number are
ordered by role, then text (nulls first); null turn numbers come first; rows with a null conversation id form one
conversation. Repeated rows are repeated turns. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25.0, 640
CONTROL = r"(\\|###|</turn>|<\|)"
ROLE_CONTROL = r"(\\|###|</turn>|<\||: )"
END = "</turn>\n"


def escaped(c: Column, control: str = CONTROL) -> Column:
    return F.regexp_replace(c, control, r"\\$1")


def unescaped(c: Column, control: str = CONTROL) -> Column:
    return F.regexp_replace(c, r"\\" + control, "$1")


def text_parts(c: Column) -> Column:
    """One text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), c.alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages")))


def expanded(p: Column) -> Column:
    """Tokens that a part's placeholder stands for: image patches, audio frames, document pages."""
    return (
        F.when(p["kind"] == "image", F.ceil(F.coalesce(p["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(p["height"], F.lit(0)) / PATCH))
        .when(p["kind"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(p["kind"] == "document", F.coalesce(p["pages"], F.lit(0)) * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """Rows (conv_id, turn, role, formatted, loss, attachments), one for each input row.

    loss: array<struct<start, n>> in code points of formatted; attachments: array<struct<kind, ref, start, n_tokens>>."""
    span, att = "array<struct<start:int,n:int>>", "array<struct<kind:string,ref:string,start:int,n_tokens:long>>"
    head = F.concat(F.lit("### "), escaped(F.coalesce(F.col("role"), F.lit("")), ROLE_CONTROL), F.lit(": "))
    src = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"),
        F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).alias("parts"),
    ).withColumn("head", head)

    def visit(acc: Column, p: Column) -> Column:
        is_text = F.coalesce(p["kind"] == "text", F.lit(False))
        kind = F.when(p["kind"].isin("image", "audio", "document"), p["kind"]).otherwise("unknown")
        body = F.when(is_text, escaped(F.coalesce(p["text"], F.lit("")))).when(kind == "unknown", F.lit("")).otherwise(F.concat(F.lit("<|"), kind, F.lit(":"), (F.size(acc["atts"]) + 1).cast("string"), F.lit("|>")))
        start = F.char_length(acc["out"])
        return F.struct(
            F.concat(acc["out"], body).alias("out"),
            F.when(is_text, F.concat(acc["spans"], F.array(F.struct(start.alias("start"), F.char_length(body).alias("n"))))).otherwise(acc["spans"]).alias("spans"),
            F.when(is_text, acc["atts"]).otherwise(F.concat(acc["atts"], F.array(F.struct(kind.alias("kind"), p["ref"].alias("ref"), start.alias("start"), expanded(p).alias("n_tokens"))))).alias("atts"),
        )

    zero = F.struct(F.col("head").alias("out"), F.array().cast(span).alias("spans"), F.array().cast(att).alias("atts"))
    return src.withColumn("v", F.aggregate("parts", zero, visit)).select(
        "conv_id", "turn", "role",
        F.concat("v.out", F.lit(END)).alias("formatted"),
        F.when(F.col("role") == "assistant", F.col("v.spans")).otherwise(F.array().cast(span)).alias("loss"),
        F.col("v.atts").alias("attachments"),
    )


def read_back(out: DataFrame) -> DataFrame:
    """Role and text of each formatted turn and its text under the loss mask, from the output alone (formatted and loss)."""
    head = F.regexp_extract("formatted", r"^### ((?:\\(?:\\|###|</turn>|<\||: )|[^\\:]|:(?! ))*+): ", 0)
    n = F.char_length("head")
    return out.withColumn("head", head).select(
        "conv_id", "turn",
        unescaped(F.expr("substring(head, 5, char_length(head) - 6)"), ROLE_CONTROL).alias("role"),
        unescaped(F.expr("substring(formatted, char_length(head) + 1, char_length(formatted) - char_length(head) - 8)")).alias("text"),
        F.array_join(F.transform("loss", lambda s: unescaped(F.expr("formatted").substr(s["start"] + 1, s["n"]))), "").alias("loss_text"),
        F.char_length("formatted").cast("long").alias("chars"),
    )


def conversation_digests(turns: DataFrame) -> DataFrame:
    """The contract's row of each conversation from read_back(): turns stream in order through running digests.

    Sorted partitions are read turn by turn, so that a conversation of any length takes constant memory."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        current, state, done = object(), None, []

        def packed(key_type: pa.DataType) -> pa.RecordBatch:
            columns = zip(*done) if done else [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(list(c), key_type if i == 0 else types[i]) for i, c in enumerate(columns)], names)

        for b in batches:
            key_type = b.schema.field("conv_id").type
            for conv, role, text, loss, chars in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4, 5))):
                if state is None or conv != current:
                    if state:
                        done.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += chars
            yield packed(key_type)
            done = []
        if state:
            done.append((current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
            yield packed(key_type)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


HARD = r"\### Assistant: </turn> ok"


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], real.schema)
    turns = real.unionByName(hard).withColumn("parts", text_parts(F.col("text")))
    return conversation_digests(read_back(formatted(turns)))


OP2_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (
  select *, replace(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), '<|', '\<|') as esc,
    replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), '<|', '\<|'), ': ', '\: ') as erole
  from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(4 + length(erole) + 2 + length(esc) + 8) as bigint) as formatted_chars
from e group by conv_id
"""
