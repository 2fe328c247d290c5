"""Training samples of prompts and targets, with memories of any kind, their counts, and their tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexweave.functions import text as tx
from lexweave.operators import linking, memory
from lexweave.sources import dataset

Tokenize = Callable[[list[str]], list[list[int]]]


def valid(source: Column | str, target: Column | str, language: Column | str) -> Column:
    """Whether a sample has all of a source, a target and a language."""
    return (tx.safe(source) != "") & (tx.safe(target) != "") & (tx.base_language(language) != "")


def samples(rows: DataFrame, mode: str = "plain", noise: str | None = None, target: str = "target") -> DataFrame:
    """(example_id, prompt, target, mode) of the valid rows (example_id, source, target, target_lang, and memory).

    mode: plain, or anything else for prompts with the memory; without a memory they are plain.  noise: a fault that the
    memory gets, for training against it.
    """
    language = tx.base_language("target_lang")
    some = rows.where(valid("source", target, "target_lang"))
    if mode == "plain":
        prompt, kind = memory.translation_prompt("source", language), F.lit("plain")
    else:
        block = memory.noisy("memory", noise) if noise else F.col("memory")
        text = F.when(F.col("memory").isNotNull(), memory.memory_text(block, language))
        prompt = memory.translation_prompt("source", language, text)
        kind = F.when(F.col("memory").isNull(), "plain").otherwise("noisy-memory" if noise else "entity-memory")
    return some.select("example_id", prompt.alias("prompt"), tx.safe(target).alias("target"), kind.alias("mode"))


def payload(rows: DataFrame, memory_text: Column | str | None = None, system: str | None = None) -> DataFrame:
    """Rows (source, target_lang, ...) with prompt_text and rendered_prompt; an error names what a row lacks."""
    missing = F.when(tx.safe("source") == "", "a source").when(tx.safe("target_lang") == "", "a target language")
    checked = F.when(missing.isNotNull(), F.raise_error(F.concat(F.lit("an example lacks "), missing))).otherwise(F.col("source"))
    text = memory.translation_prompt(checked, tx.base_language("target_lang"), memory_text)
    out = rows.withColumn("prompt_text", text)
    return out.withColumn("rendered_prompt", memory.rendered_chat(memory.chat_messages("prompt_text", F.lit(system) if system else None)))


def tokenized(rows: DataFrame, make: Callable[[], Tokenize], longest: int = 2048, eos: int | None = None) -> DataFrame:
    """Samples with prompt_ids and full_ids (prompt, line feed and target), cut to ``longest``; ``make`` loads a tokenizer once a worker.

    With ``eos`` also labels: -100 for what prompt and whole text share, null where that is everything.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = make()
        for batch in batches:
            prompts, targets = batch.column("prompt").to_pylist(), batch.column("target").to_pylist()
            ids = [tokenize(prompts), tokenize([f"{p}\n{t}" for p, t in zip(prompts, targets)])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([x[:longest] for x in i], pa.list_(pa.int32())) for i in ids]], [*batch.schema.names, "prompt_ids", "full_ids"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.mapInArrow(run, f"{fields}, prompt_ids array<int>, full_ids array<int>")
    return out if eos is None else out.withColumn("labels", memory.completion_labels("prompt_ids", "full_ids", eos, longest))


def sample_counts(rows: DataFrame) -> DataFrame:
    """One row of tokenized samples' counts: samples, kept, skipped (fully masked), tokens, target tokens, longest."""
    kept = F.col("labels").isNotNull()
    targets = F.size(F.filter("labels", lambda x: x != -100))
    return rows.agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("skipped"), F.coalesce(F.sum(F.when(kept, F.size("labels"))), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(kept, targets)), F.lit(0)).alias("target_tokens"), F.coalesce(F.max(F.when(kept, F.size("labels"))), F.lit(0)).alias("longest"),
    )


def batched(rows: DataFrame, size: int, ids: str = "full_ids", labels: str = "labels", key: str = "example_id", longest: int = 2048) -> DataFrame:
    """(batch, size, width, input_ids, attention_mask, batch_labels, keys): samples in batches of ``size`` of about the same length.

    Samples are numbered by length, then by the digest of their key, and a batch holds those of ``size`` numbers, so that
    little is padded; each is padded to its batch's longest: ids with 0, masks with 0 and labels with -100.  Samples
    without labels are left out; those of equal keys and lengths stand in the order of their ids.  The last batch may be
    smaller.

    Numbers come from counts by length (``longest`` different ones at most) and by the digest's first three digits within
    a length, so many samples of one length are numbered by many tasks.
    """
    return padded_batches(numbered(rows.where(F.col(labels).isNotNull() & F.col(ids).isNotNull()), ids, key), size, ids, labels, key)


def numbered(rows: DataFrame, ids: str = "full_ids", key: str = "example_id") -> DataFrame:
    """Rows with ``_at``, a number from 0 without gaps, by the length of their ids, then by the digest of their key."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    some = rows.withColumn("_length", F.size(ids)).withColumn("_digest", digest).withColumn("_part", F.substring("_digest", 1, 3))
    counts = some.groupBy("_length", "_part").agg(F.count(F.lit(1)).alias("n"))
    by_length = counts.groupBy("_length").agg(F.sum("n").alias("n"))
    # One row a length, and 4,096 rows of a length at most.
    before = by_length.select("_length", (F.sum("n").over(Window.orderBy("_length")) - F.col("n")).alias("_before"))
    within = counts.select("_length", "_part", (F.sum("n").over(Window.partitionBy("_length").orderBy("_part")) - F.col("n")).alias("_within"))
    starts = within.join(before, "_length").select("_length", "_part", (F.col("_before") + F.col("_within")).alias("_start"))
    nth = F.row_number().over(Window.partitionBy("_length", "_part").orderBy("_digest", F.col(ids)))
    placed = some.withColumn("_nth", nth).join(starts, ["_length", "_part"])
    return placed.withColumn("_at", F.col("_start") + F.col("_nth") - 1).drop("_digest", "_part", "_nth", "_start")


def padded_batches(rows: DataFrame, size: int, ids: str = "full_ids", labels: str = "labels", key: str = "example_id", pad: int = 0) -> DataFrame:
    """Numbered rows (``_at``, ``_length``) in batches of ``size`` numbers, each padded to its longest, with masks."""
    item = F.struct(F.col("_at").alias("at"), F.col(key).alias("k"), F.col(ids).alias("i"), F.col(labels).alias("l"))
    whole = rows.groupBy(F.floor(F.col("_at") / size).alias("batch")).agg(F.max("_length").alias("width"), F.sort_array(F.collect_list(item)).alias("items"))

    def filled(values: Column, value: int) -> Column:
        return F.concat(values, F.array_repeat(F.lit(value).cast("int"), F.greatest(F.col("width") - F.size(values), F.lit(0))))

    return whole.select(
        "batch", F.size("items").alias("size"), "width", F.transform("items", lambda x: filled(x["i"], pad)).alias("input_ids"),
        F.transform("items", lambda x: filled(F.transform(x["i"], lambda _: F.lit(1)), 0)).alias("attention_mask"), F.transform("items", lambda x: filled(x["l"], -100)).alias("batch_labels"), F.transform("items", lambda x: x["k"]).alias("keys"),
    )


def split_samples(tables: dataset.Tables, split: str | None, target_locale: str | None = None, source_locale: str | None = None, limit: int | None = None, kb: DataFrame | None = None, gold: bool = True, mode: str = "anchored", noise: str | None = None, require_references: bool = True, **more: object) -> DataFrame:
    """The training samples of a split: its examples are loaded, get a memory where there is a knowledge base, and are mapped to prompts and targets.

    Mentions aren't required of them.  gold: memories are those of the gold entities, as training has them; or else those of
    the candidate that ``mode`` chooses (more: as for ``linking.entity_memories``).
    """
    rows = dataset.load(tables, split, target_locale, source_locale, limit, require_references, require_mentions=False).withColumn("target_lang", tx.base_language("target_locale"))
    if kb is None:
        return samples(rows)
    if gold:
        remembered = linking.gold_memories(rows, kb, **more)
    else:
        remembered = rows.join(linking.entity_memories(rows.select("example_id", "source", "target_lang", "gold_qid"), kb, mode, **more).select("example_id", "memory"), "example_id", "left")
    return samples(remembered, "entity-memory", noise)


def templated(messages: Column | str, template: Mapping[str, tuple[str, str]], begin: str = "", answer: str = "") -> Column:
    """Messages (role, content) as one text by a chat template: what stands before and after the content of each role.

    begin: what the text begins with; answer: what opens the assistant's turn that is to be generated.  A role that the
    template lacks raises an error.
    """
    known = F.create_map(*[F.lit(x) for role, (before, after) in template.items() for x in (role, before, f"{role}/", after)])

    def turn(m: Column) -> Column:
        unknown = F.raise_error(F.concat(F.lit("the template lacks role "), m["role"])).cast("string")
        sign = lambda r: F.coalesce(F.try_element_at(known, r), unknown)
        return F.concat(sign(m["role"]), m["content"], sign(F.concat(m["role"], F.lit("/"))))

    return F.concat(F.lit(begin), F.array_join(F.transform(tx.col(messages), turn), ""), F.lit(answer))
