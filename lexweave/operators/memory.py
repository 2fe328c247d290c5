"""Entity memory, prompts, chat messages and training rows, as text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions import text as tx

# Headings and the system prompt.
MEMORY, NONE = "[ENTITY MEMORY]", "- None"
SYSTEM = "You are a professional translator for the SemEval EA-MT task. Return only the final translation in the target language."
NOISES = ("drop_alias", "drop_description", "replace_canonical_with_alias")


def budget_aliases(aliases: Column | str, label: Column | str, limit: int = 1) -> Column:
    """The first ``limit`` aliases (all below 0), then without the label and repetitions, then the first ``limit`` again."""
    some = tx.ordered_distinct(F.slice(tx.col(aliases), 1, limit) if limit >= 0 else tx.col(aliases))
    return F.filter(some, lambda a: a != tx.safe(label))


def memory_block(source: Column | str, span: Column | str, qid: Column | str, label: Column | str, aliases: Column | str, entity_type: Column | str, description: Column | str, alias_limit: int = 1, max_chars: int = 80) -> Column:
    """The memory of an example's best candidate; null if there is no candidate."""
    return F.when(
        tx.col(qid).isNotNull(),
        F.struct(
            tx.safe(source).alias("source_sentence"), tx.safe(span).alias("source_span"), tx.safe(qid).alias("qid"), tx.safe(label).alias("canonical_target"),
            F.coalesce(budget_aliases(aliases, label, alias_limit), F.array().cast("array<string>")).alias("alias_candidates"),
            tx.safe(entity_type).alias("entity_type"), tx.truncated(description, max_chars).alias("description"),
            F.lit("canonical_plus_alias" if alias_limit else "canonical_only").alias("memory_modes"),
        ),
    )


def _line(prefix: Column | str, value: Column) -> Column:
    return F.when(value != "", F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, value))


def memory_text(memory: Column | str, target_lang: Column | str) -> Column:
    """The memory as lines of text; empty parts make no line."""
    m = tx.col(memory)
    lines = F.concat_ws(
        "\n", F.lit(MEMORY), _line("- Source Sentence: ", m["source_sentence"]), _line("- Source Span: ", m["source_span"]), _line("  QID: ", m["qid"]),
        _line(F.concat(F.lit("  Target ("), tx.safe(target_lang), F.lit("): ")), m["canonical_target"]),
        _line("  Aliases: ", F.array_join(m["alias_candidates"], ", ")), _line("  Type: ", m["entity_type"]), _line("  Description: ", m["description"]),
    )
    return F.when(m.isNull(), f"{MEMORY}\n{NONE}").otherwise(lines)


def noisy(memory: Column | str, noise: str) -> Column:
    """The memory with a fault of one kind."""
    m = tx.col(memory)
    if noise == "drop_alias":
        return m.withField("alias_candidates", F.array().cast("array<string>"))
    if noise == "drop_description":
        return m.withField("description", F.lit(""))
    if noise == "replace_canonical_with_alias":
        return m.withField("canonical_target", F.coalesce(F.get(m["alias_candidates"], 0), m["canonical_target"]))
    raise ValueError(f"noise must be one of {', '.join(NOISES)}: {noise}")


def translation_prompt(source: Column | str, target_lang: Column | str, memory: Column | str | None = None) -> Column:
    """The prompt to translate a source; with a memory text it stands between the task and the source."""
    task = F.concat(F.lit("[TASK]\nTranslate the following sentence into "), tx.language_name(target_lang), F.lit(" naturally and accurately."))
    end = F.concat(F.lit("[SOURCE]\n"), tx.safe(source))
    simple = F.concat_ws("\n", task, F.lit(""), end)
    if memory is None:
        return simple
    text = tx.safe(memory)
    headed = F.when(F.startswith(text, F.lit(MEMORY)), text).otherwise(F.concat(F.lit(f"{MEMORY}\n"), text))
    return F.when(text == "", simple).otherwise(F.concat_ws("\n", task, F.lit(""), headed, F.lit(""), end))


def chat_messages(prompt: Column | str, system: Column | str | None = None, answer: Column | str | None = None) -> Column:
    """Array of (role, content): system and assistant only if they are given and not empty."""
    parts = [("system", system), ("user", prompt), ("assistant", answer)]
    found = [F.when(F.lit(role == "user") | (tx.safe(c) != ""), F.struct(F.lit(role).alias("role"), tx.safe(c).alias("content"))) for role, c in parts if c is not None]
    return F.filter(F.array(*found), lambda m: m.isNotNull())


def rendered_chat(messages: Column | str, open_answer: bool = True) -> Column:
    """Messages as text without a template; open_answer: ends with the assistant's heading."""
    lines = F.transform(tx.col(messages), lambda m: F.concat(F.lit("["), F.upper(m["role"]), F.lit("]\n"), m["content"]))
    return F.array_join(F.concat(lines, F.array(F.lit("[ASSISTANT]"))) if open_answer else lines, "\n\n")


def completion_labels(prompt_ids: Column | str, full_ids: Column | str, eos: int, longest: int) -> Column:
    """Labels of token ids (end token appended, cut to ``longest``): -100 where the prompt reaches; null if all are."""
    full = F.slice(F.when(F.coalesce(F.get(tx.col(full_ids), F.size(full_ids) - 1) == eos, F.lit(False)), tx.col(full_ids)).otherwise(F.concat(tx.col(full_ids), F.array(F.lit(eos).cast("int")))), 1, longest)
    labels = tx.let(tx.shared_prefix(prompt_ids, full_ids), lambda shared: F.transform(full, lambda t, i: F.when(i < shared, F.lit(-100)).otherwise(t)))
    return tx.let(labels, lambda x: F.when(F.exists(x, lambda y: y != -100), x))


def padded(ids: Column | str, width: int, value: int) -> Column:
    """An array with ``value`` added up to a width."""
    return F.concat(tx.col(ids), F.array_repeat(F.lit(value).cast("int"), F.greatest(F.lit(width) - F.size(ids), F.lit(0))))
