"""Golden cases of normalisation, n-grams, spans, alignment, features, memory and prompts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.operators import memory, rerank
from lexweave.operators.alignment import align, raw_match


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string' if not isinstance(v, int) else 'int'}" for k, v in values.items()) or "x int")
    return frame.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(("raw", "want"), [("Hello, World! ", "hello world"), ("U.S.", "us"), ("กั้", "ก"), (None, ""), ("a \tb", "a b"), ("İx", "i̇x")])
def test_normalize(spark, raw, want):
    assert one(spark, tx.normalize_surface("s"), s=raw) == want


def test_ngrams(spark):
    grams = one(spark, tx.ngrams(tx.tokens(tx.normalize_surface("s")), 1, 3), s="I visited New York City")
    assert len(grams) == 12 and "new york city" in grams
    assert one(spark, tx.ngrams(tx.tokens(tx.normalize_surface("s")), 2, 1), s="one") == []
    assert one(spark, tx.candidate_spans("s", 1, 2, 2), s="7 2024 a !! ok") == ["ok", "2024 a", "a ok"]
    assert [one(spark, tx.valid_span("s"), s=x) for x in ("7", "2024", "a", "!!", "ok")] == [False, False, False, False, True]


@pytest.mark.parametrize(
    ("source", "label", "aliases", "want"),
    [
        ("I saw U.S. troops", "us", [], None),
        ("must go", "us", [], (1, 3, "us", "substring", 0.85)),
        ("the New Yorkers in york", "New York", ["York"], (19, 23, "york", "boundary_exact", 1.0)),
        ("😀 Big Ben", "big ben", [], (2, 9, "Big Ben", "boundary_exact", 1.0)),
        ("a\\Eb c", "a\\Eb", [], (0, 4, "a\\Eb", "boundary_exact", 1.0)),
        ("", "x y", [], None),
    ],
)
def test_alignment(spark, source, label, aliases, want):
    got = one(spark, align("s", "l", "a"), s=source, l=label, a=aliases)
    assert (None if got is None else (got["start"], got["end"], got["matched_text"], got["match_kind"], got["match_score"])) == want


def test_overlaps(spark):
    assert one(spark, tx.jaccard("a", "b"), a="Red Gear", b="gear box") == pytest.approx(1 / 3)
    assert one(spark, tx.jaccard("a", "b"), a="日本", b="日本") == 0.0
    assert one(spark, tx.substring_hit("a", "b"), a="York", b="new york") == 1.0
    assert one(spark, tx.truncated("a", 4), a="abc  defg") == "abc..." and one(spark, tx.truncated("a", 0), a="abc") == ""
    assert one(spark, tx.distinct_by_surface("a"), a=["A b", "a, B", "", "c"]) == ["A b", "c"]
    assert one(spark, tx.language_name("a"), a="ko_KR") == "Korean" and one(spark, tx.language_name("a"), a="") == "target language"
    assert one(spark, tx.locale_of("a"), a="zh") == "zh_TW" and one(spark, tx.locale_of("a"), a="xx_YY") == "xx_YY"


def test_memory_and_prompt(spark):
    block = memory.memory_block("s", "p", "q", "l", "a", "t", "d")
    values = {"s": "I love Paris", "p": "Paris", "q": "Q90", "l": "파리", "a": ["파리", "빠리"], "t": "city", "d": "x" * 100}
    text = one(spark, memory.memory_text(block, F.lit("ko")), **values)
    assert text == "[ENTITY MEMORY]\n- Source Sentence: I love Paris\n- Source Span: Paris\n  QID: Q90\n  Target (ko): 파리\n  Type: city\n  Description: " + "x" * 80 + "..."
    both = memory.memory_block("s", "p", "q", "l", "a", "t", "d", alias_limit=2)
    assert "  Aliases: 빠리\n" in one(spark, memory.memory_text(both, F.lit("ko")), **values)
    swapped = one(spark, memory.memory_text(memory.noisy(both, "replace_canonical_with_alias"), F.lit("ko")), **values)
    assert "  Target (ko): 빠리" in swapped
    with pytest.raises(ValueError):
        memory.noisy(both, "other")
    empty = one(spark, memory.memory_text(memory.memory_block("s", "p", "q", "l", "a", "t", "d"), F.lit("ko")), **values | {"q": None})
    assert empty == "[ENTITY MEMORY]\n- None"
    plain = "[TASK]\nTranslate the following sentence into Korean naturally and accurately.\n\n[SOURCE]\nhi"
    assert one(spark, memory.translation_prompt("s", F.lit("ko"), "m"), s="hi", m=" ") == plain
    assert one(spark, memory.translation_prompt("s", F.lit("ko"), "m"), s="hi", m="- x") == plain.replace("[SOURCE]", "[ENTITY MEMORY]\n- x\n\n[SOURCE]")
    assert [m["role"] for m in one(spark, memory.chat_messages("s", F.lit(""), "m"), s="hi", m="yo")] == ["user", "assistant"]


def test_completion_labels(spark):
    frame = spark.createDataFrame([([1, 2], [1, 2, 3, 4]), ([1, 2, 3], [1, 2, 3])], "p array<int>, f array<int>")
    got = [r["x"] for r in frame.select(memory.completion_labels("p", "f", 9, 4).alias("x")).collect()]
    assert got == [[-100, -100, 3, 4], [-100, -100, -100, 9]]
    assert [r["x"] for r in frame.select(memory.padded("p", 4, 0).alias("x")).collect()] == [[1, 2, 0, 0], [1, 2, 3, 0]]


def test_reranker_learns():
    import numpy as np

    rng = np.random.default_rng(0)
    groups = []
    for _ in range(60):
        x = rng.random((5, len(rerank.FEATURES)))
        groups.append((x, [int(i == int(x[:, 0].argmax())) for i in range(5)]))
    model, history = rerank.trained(groups, epochs=25, rate=1e-2, validate=groups)
    assert history[-1]["loss"] < history[0]["loss"] and max(h["top1"] for h in history) > 0.8
    assert rerank.listwise_loss(np.zeros(3), -1)[0] == 0.0 and model(np.zeros((2, 11))).shape == (2,)


def test_raw_matches_are_those_of_a_regular_expression(spark):
    """Against a search at word boundaries that ignores case, and then one for small letters anywhere."""
    rng = random.Random(4)
    parts = ["us", "Us", "a", " ", "-", "é", "É", "x.", "\\E", "(", "σ", "Σ", "ς", "😀", "1", "_", "ſ", "s"]
    cases = [("".join(rng.choice(parts) for _ in range(rng.randint(1, 12))), "".join(rng.choice(parts[:12]) for _ in range(rng.randint(1, 3)))) for _ in range(400)]
    cases += [("must go us", "us"), ("must", "us"), ("us must", "US"), ("ΟΔΟΣ", "οδος"), ("Kelvin \u212a", "k"), ("xusx us", "us"), ("", "us")]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, s string, v string")
    got = frame.select("i", raw_match(F.col("s"), F.col("v")).alias("m")).orderBy("i").collect()
    for (source, variant), r in zip(cases, got):
        word = r"[^\W]"
        found = re.search(rf"(?<!{word}){re.escape(variant)}(?!{word})", source, re.I)
        m = r["m"]
        if found:
            assert (m["kind"], m["start"], m["matched_text"]) == ("boundary_exact", found.start(), found[0]), (source, variant)
        elif (at := source.lower().find(variant.lower())) >= 0 and len(source.lower()) == len(source):
            assert (m["kind"], m["start"], m["matched_text"]) == ("substring", at, source[at : at + len(variant)]), (source, variant)
        else:
            assert m is None, (source, variant)
