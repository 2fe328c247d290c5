r"""Event-sourced chat formatting: logs of events become final messages, and those become training text with a loss mask.

Events carry a conversation, a sequence number, a message, and what happened to it: ``message`` (opens it, with a role
and perhaps text), ``delta`` (adds text), ``edit`` (puts new text in place) or ``regenerate`` (drops its text, deltas
follow).  The fold works message by message, not conversation by conversation: the last opening, edit or regeneration
of a message counts, with the deltas after it.  So a conversation of any length is dealt out over as many keys as it has
messages, and a worker only ever holds one message's events.

Template of a message, in order of its first event::

    <s>role\ntext</s>\n

Control strings (``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``, ``<|im_start|>``,
``<|im_end|>``) and backslashes inside texts get a backslash before them, and line feeds inside roles too; reading back
drops them.  The loss mask covers the texts of assistant messages, as they stand in the output.

Reading back streams over the rendered messages, sorted within partitions, and keeps no more than a batch of them: the
digests of a conversation are sequential, its size isn't bounded by memory.

Sequence numbers are anything that can be ordered.  ``log_of_rows`` makes a log of finished messages, in which some are
streamed, some edited and some regenerated, all to the same final texts; its numbers are (pass, turn, step), as edits
and regenerations come after all messages have been opened.

Defined cases: a null text is empty, and so is a null role; events of a null conversation form one; events of a message
that no ``message`` event opens have an empty role; ties of sequence are broken by kind of event, role and text;
rows of one turn are messages of their own in ``log_of_rows``, in the order of role and text; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.llm.common import table

CONTROL = r"<</?SYS>>|</?s>|\[/?INST\]|<\|im_(?:start|end)\|>"
_READ = re.compile(r"\\(.)|<s>|</s>", re.S)


def log_of_rows(rows: DataFrame) -> DataFrame:
    """A log of events that folds to the rows (conv_id, turn, role, text), each of which is a message of its own.

    By a hash of the row its message comes whole, as an opening with deltas, as a draft that is edited, or as a draft
    that is regenerated in deltas.
    """
    some = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    # Numbers as text of one width are in the order of the numbers.
    named = some.withColumn("message_id", F.concat_ws(":", F.coalesce(F.col("turn").cast("string"), F.lit("")), F.lpad(nth.cast("string"), 20, "0")))
    half = F.floor(F.char_length("text") / 2).cast("int")
    left, right, draft = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.char_length("text")), F.lit("<s>draft</s>")

    def event(again: int, step: int, kind: str, text: Column) -> Column:
        seq = F.struct(F.lit(again).alias("pass"), F.col("turn"), F.lit(step).alias("step"))
        return F.struct(seq.alias("seq"), F.lit(kind).alias("event"), (F.col("role") if kind == "message" else F.lit(None).cast("string")).alias("role"), text.alias("text"))

    none = F.lit(None).cast("string")
    ways = [
        [event(0, 0, "message", F.col("text"))],
        [event(0, 0, "message", none), event(0, 1, "delta", left), event(0, 2, "delta", right)],
        [event(0, 0, "message", draft), event(1, 0, "edit", F.col("text"))],
        [event(0, 0, "message", none), event(0, 1, "delta", draft), event(1, 0, "regenerate", none), event(1, 1, "delta", left), event(1, 2, "delta", right)],
    ]
    way = F.pmod(F.xxhash64("conv_id", "message_id", "text"), F.lit(len(ways)))
    events = F.when(way == 0, F.array(*ways[0]))
    for i, w in enumerate(ways[1:], 1):
        events = events.when(way == i, F.array(*w))
    return named.select("conv_id", "message_id", F.explode(events).alias("e")).select("conv_id", "message_id", "e.seq", "e.event", "e.role", "e.text")


def folded(events: DataFrame) -> DataFrame:
    """(conv_id, seq, message_id, role, text): final messages, placed by their first event."""
    kind = F.when(F.col("event") == "message", 0).when(F.col("event") == "regenerate", 1).when(F.col("event") == "edit", 2).otherwise(3)
    at = F.struct(F.col("seq"), kind.alias("k"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = events.select("conv_id", "message_id", "seq", kind.alias("k"), at.alias("at"))
    whole = rows.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("first"),
        F.max(F.when(F.col("k") == 0, F.col("at"))).alias("opened"),
        F.max(F.when(F.col("k") < 3, F.col("at"))).alias("base"),
        F.sort_array(F.collect_list(F.when(F.col("k") == 3, F.col("at")))).alias("deltas"),
    )
    # Deltas before the last opening, edit or regeneration are gone.
    later = F.filter("deltas", lambda d: F.col("base").isNull() | (F.coalesce(d["seq"] >= F.col("base.seq"), F.lit(True))))
    start = F.when(F.coalesce(F.col("base.k") == 1, F.lit(False)), "").otherwise(F.coalesce("base.text", F.lit("")))
    return whole.select(
        "conv_id", F.col("first").alias("seq"), "message_id", F.coalesce("opened.role", F.lit("")).alias("role"),
        F.concat(start, F.array_join(F.transform(later, lambda d: d["text"]), "")).alias("text"),
    )


def escaped(text: Column, role: bool = False) -> Column:
    return F.regexp_replace(text, rf"(\\|{CONTROL}{'|\n' if role else ''})", r"\\$1")


def rendered(messages: DataFrame) -> DataFrame:
    """(conv_id, seq, message_id, formatted, loss_start, loss_end): pieces whose concatenation is the training text."""
    head = F.concat(F.lit("<s>"), escaped(F.col("role"), role=True), F.lit("\n"))
    body = escaped(F.col("text"))
    rows = messages.withColumns({"_head": head, "_body": body})
    assistant = F.col("role") == "assistant"
    start = F.char_length("_head")
    return rows.select(
        "conv_id", "seq", "message_id", F.concat("_head", "_body", F.lit("</s>\n")).alias("formatted"),
        F.when(assistant, start).cast("bigint").alias("loss_start"), F.when(assistant, start + F.char_length("_body")).cast("bigint").alias("loss_end"),
    )


def plain(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def parsed(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each message in a training text."""
    start = None
    for m in _READ.finditer(formatted):
        if m[0] == "<s>":
            start = m.end()
        elif m[0] == "</s>":
            if start is None:
                raise ValueError("an end without a start")
            inner = formatted[start : m.start()]
            cut = re.match(r"(?:\\.|[^\\\n])*", inner, re.S).end()
            yield plain(inner[:cut]), plain(inner[cut + 1 :])
            start = None


def read_back(pieces: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, from its rendered pieces alone."""
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message_id")
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def closed() -> tuple:
            conv, turns, th, loss, lh, chars = now
            return conv, turns, th.hexdigest(), loss, lh.hexdigest(), chars

        for batch in batches:
            for conv, text, a, b in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")]):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(closed())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parsed(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                if a is not None:
                    masked = plain(text[a:b])
                    now[3] += len(masked)
                    now[4].update(masked.encode())
                now[5] += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(closed(), types)], names)

    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(digest, schema)


def op4_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(rendered(folded(log_of_rows(rows.unionByName(tricky)))))


ORACLE = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length('<s>' || regexp_replace(role, '(\\|\n|<</?SYS>>|</?s>|\[/?INST\]|<\|im_(?:start|end)\|>)', '\\\1', 'g') || chr(10)
    || regexp_replace(text, '(\\|<</?SYS>>|</?s>|\[/?INST\]|<\|im_(?:start|end)\|>)', '\\\1', 'g') || '</s>' || chr(10)) AS chars FROM r
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
