"""Retrieval, assembly, files, metrics, ingest and the driver's contract."""

import ast
import hashlib
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.functions.slots import generate_halving, generated_frame, scored_frame
from lexweave.functions import text as tx
from lexweave.operators import evaluation, linking, listwise, metrics, rerank, retrieval, samples
from lexweave.sources import dataset, files, models, runs
from lexweave.sources.keyed import KeyedTable, first_of_keys
from lexweave.streaming.ingest import append_missing, ingest

KB = "qid string, target_lang string, label_en string, aliases_en array<string>, target_label string, target_aliases array<string>, entity_type string, description string, language_available boolean, popularity double, surfaces array<string>"


@pytest.fixture(scope="module")
def kb(spark):
    row = lambda q, label, surfaces, pop=0.0, ok=True: (q, "ko", label, [], label, [], None, None, ok, pop, surfaces)
    return spark.createDataFrame([row("Q1", "New York", ["new york", "york"], 1.0), row("Q2", "York", ["york"], 5.0), row("Q3", "York b", ["york"], 9.0, ok=False), row("Q4", "City", ["new york city"])], KB)


@pytest.fixture(scope="module")
def examples(spark):
    return spark.createDataFrame([(1, "I visited New York City", "ko", "Q2"), (2, "York!", "ko", "Q3"), (3, "", "ko", None), (4, "York", "", "Q2")], "example_id int, source string, target_lang string, gold_qid string")


def ranked(df):
    return [(r["example_id"], r["rank"], r["qid"], r["ambiguity_count"]) for r in df.orderBy("example_id", "rank").collect()]


def test_candidates(kb, examples):
    assert ranked(retrieval.candidates(examples, kb, mode="surface")) == [(1, 1, "Q4", 1), (1, 2, "Q1", 1), (1, 3, "Q2", 3), (2, 1, "Q2", 3), (2, 2, "Q1", 3)]
    assert ranked(retrieval.candidates(examples, kb, mode="rerank", top_k=2)) == [(1, 1, "Q2", 1), (1, 2, "Q4", 1), (2, 1, "Q2", 3), (2, 2, "Q1", 3)]
    assert [x[2] for x in ranked(retrieval.candidates(examples, kb, mode="anchored"))] == ["Q2"]
    assert ranked(retrieval.candidates(examples, kb, mode="surface", per_surface_k=1))[-1] == (2, 1, "Q2", 3)
    with pytest.raises(ValueError):
        retrieval.candidates(examples, kb, mode="none")


def test_examples_without_source_have_no_candidates(spark, kb):
    some = spark.createDataFrame([(1, "", "ko", "Q1"), (2, None, "ko", "Q1"), (3, " ", "ko", "Q1"), (4, "x", " ", "Q1"), (5, "x", "ko", "Q1")], "example_id int, source string, target_lang string, gold_qid string")
    for mode in ("anchored", "retrieve", "rerank"):
        assert [x[0] for x in ranked(retrieval.candidates(some, kb, mode=mode))] == [5]


def test_filter_only_leaves_out_what_is_no_surface(spark, monkeypatch):
    """One table or several, full or not: the same candidates; and a filter split among tables still leaves most n-grams out."""
    words = ["ab", "cd", "ef", "gh", "ij"]
    texts = [(i, " ".join(words[(i * 7 + j * j) % 5] for j in range(12)) + ".", "ko", None) for i in range(40)]
    some = spark.createDataFrame(texts, "example_id int, source string, target_lang string, gold_qid string")
    rows = [(f"Q{i}", "ko", "l", [], f"label {i}", [], None, None, i % 4 > 0, float(i % 3), [" ".join(words[(i + j) % 5] for j in range(1 + i % 5)), words[i % 5]]) for i in range(30)]
    table = spark.createDataFrame(rows, KB)
    want = ranked(retrieval.candidates(some, table, mode="surface", top_k=50))
    assert want
    for bits, most in ((16, 1 << 8), (1, 1 << 6)):
        monkeypatch.setattr(retrieval, "BITS", bits)
        monkeypatch.setattr(retrieval, "TABLE_BITS", most)
        assert retrieval._filter_size(60)[0] == (4 if bits == 16 else 1)
        assert ranked(retrieval.candidates(some, table, mode="surface", top_k=50)) == want


def test_split_filter_leaves_most_ngrams_unexploded(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TABLE_BITS", 1 << 12)
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(400)]
    surfaces = sorted({" ".join(rng.choice(vocabulary, rng.integers(2, 5))) for _ in range(2000)})
    held = spark.createDataFrame([(s,) for s in surfaces], "surface string")
    texts = [(i, " ".join(rng.choice(vocabulary, 200)) + " " + surfaces[i], "ko", None) for i in range(50)]
    some = spark.createDataFrame(texts, "example_id int, source string, target_lang string, gold_qid string")
    assert retrieval._filter_size(len(surfaces))[0] > 5
    asked = {(r["example_id"], r["key"]) for r in retrieval._asked(some, held, len(surfaces), False, 1, 5, 2).collect()}
    grams = {(i, " ".join(t.split()[a : a + n])) for i, t, *_ in texts for n in range(1, 6) for a in range(len(t.split()) - n + 1)}
    assert {g for g in grams if g[1] in set(surfaces)} <= asked <= grams
    assert len(asked) < 0.05 * len(grams)


def test_ngram_hashes_tell_ngrams_apart():
    h = np.random.default_rng(1).integers(0, 50, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in (1, 2, 5):
        found = {}
        for at, g in enumerate(retrieval.gram_hashes(h, n).tolist()):
            assert found.setdefault(g, tuple(h[at : at + n])) == tuple(h[at : at + n])
    assert len(retrieval.gram_hashes(h[:2], 3)) == 0


def test_candidates_of_modes_are_those_of_each(spark, kb, examples):
    rows = lambda df: sorted(tuple(r) for r in df.select("example_id", "rank", "qid", "candidate_source", "source_span").collect())
    found = retrieval.candidates_of_modes(examples, kb, retrieval.MODES, top_k=3).cache()
    for mode in retrieval.MODES:
        assert rows(found.where(F.col("mode") == mode)) == rows(retrieval.candidates(examples, kb, mode=mode, top_k=3)) != []
    both = linking.entity_memories_by_mode(examples, kb, retrieval.MODES).select("example_id", "mode", "memory").collect()
    for mode in retrieval.MODES:
        assert {r["example_id"]: r["memory"] for r in both if r["mode"] == mode} == {r["example_id"]: r["memory"] for r in linking.entity_memories(examples, kb, mode).collect()}


def test_knowledge_base_rows_of_one_entity(spark):
    """Each surface yields the fields of the row that holds it."""
    rows = [("Q1", "ko", "a", [], "first", [], None, None, True, 1.0, ["one"]), ("Q1", "ko", "a", [], "second", [], None, None, True, 2.0, ["two"]), ("Q1", "ko", "a", [], "first", [], None, None, True, 1.0, ["one", "six"])]
    table = spark.createDataFrame(rows, KB)
    some = spark.createDataFrame([(1, "one", "ko", None), (2, "two", "ko", None), (3, "none", "ko", "Q1"), (4, "six", "ko", None)], "example_id int, source string, target_lang string, gold_qid string")
    assert {r["example_id"]: r["target_label"] for r in retrieval.candidates(some, table).collect()} == {1: "first", 2: "second", 3: "second", 4: "first"}
    assert retrieval.candidates(some, table).count() == 4


def test_first_by_qid_and_gold_rescue(spark, kb):
    rows = spark.createDataFrame([(1, 1, "Q1"), (1, 2, "Q1"), (1, 3, None), (1, 4, None), (2, 1, "Q1")], "example_id int, rank int, qid string")
    assert sorted((r["example_id"], r["rank"]) for r in retrieval.first_by_qid(rows).collect()) == [(1, 1), (1, 3), (1, 4), (2, 1)]
    some = spark.createDataFrame([(1, "New York", "ko", "Q2"), (2, "nothing", "ko", "Q4"), (3, "York", "ko", "Q3")], "example_id int, source string, target_lang string, gold_qid string")
    found = retrieval.candidates(some, kb, mode="surface", top_k=1)
    assert {(x[0], x[1], x[2]) for x in ranked(linking.with_gold(found, some, kb))} == {(1, 1, "Q1"), (1, 2, "Q2"), (2, 1, "Q4"), (3, 1, "Q2")}


def test_memories_of_every_mode(spark, kb):
    some = spark.createDataFrame([(1, "I saw York and New York", "ko", "Q2"), (2, "nothing", "ko", None), (3, "", "ko", "Q1")], "example_id int, source string, target_lang string, gold_qid string")
    for mode, qid, span in (("anchored", "Q2", "York"), ("surface", "Q1", "new york"), ("retrieve", "Q2", "York"), ("rerank", "Q2", "York")):
        got = {r["example_id"]: r["memory"] for r in linking.entity_memories(some, kb, mode).collect()}
        assert (got[1]["qid"], got[1]["source_span"]) == (qid, span), mode
        assert got[2] is None and got[3] is None
    with pytest.raises(ValueError):
        linking.entity_memories(some, kb, "none")
    by_model = linking.selected(some, kb, "rerank", strategy="vector", model=lambda v: v[9]).collect()
    assert [r["qid"] for r in by_model] == ["Q2"]
    with pytest.raises(ValueError):
        linking.selected(some, kb, "rerank", strategy="vector")


def test_anchored_candidates_align_their_english_names(spark):
    table = spark.createDataFrame([("Q1", "ko", "Seoul", ["Hanyang"], "서울", ["한양"], None, None, True, 0.0, [])], KB)
    some = spark.createDataFrame([(1, "old Hanyang", "ko", "Q1")], "example_id int, source string, target_lang string, gold_qid string")
    assert linking.entity_memories(some, table, "anchored").first()["memory"]["source_span"] == "Hanyang"


def test_gold_memories_and_samples(spark, kb):
    some = spark.createDataFrame(
        [(1, "in new york", "ko_KR", "Q1", None, "t1"), (2, "x", "ko", None, ["", "Q9"], "t2"), (3, "y", "ko", None, None, " "), (4, "z", "", "Q1", None, "t4")],
        "example_id int, source string, target_lang string, gold_qid string, entity_qids array<string>, target string",
    )
    memories = linking.gold_memories(some.withColumn("target_lang", F.split_part("target_lang", F.lit("_"), F.lit(1))), kb)
    got = {r["example_id"]: r for r in memories.collect()}
    assert (got[1]["candidate_source"], got[1]["memory"]["source_span"], got[1]["memory"]["canonical_target"]) == ("gold_qid_lookup", "new york", "New York")
    assert (got[2]["candidate_source"], got[2]["memory"]["qid"], got[2]["memory"]["canonical_target"]) == ("fallback_qid_only", "Q9", "")
    plain = {r["example_id"]: r for r in samples.samples(some).collect()}
    assert set(plain) == {1, 2} and "Korean" in plain[1]["prompt"] and plain[1]["mode"] == "plain"
    noisy = {r["example_id"]: r for r in samples.samples(memories, "entity-memory", "drop_alias").collect()}
    assert noisy[1]["mode"] == "noisy-memory" and "QID: Q1" in noisy[1]["prompt"]
    made = samples.tokenized(samples.samples(some), lambda: lambda texts: [[len(w) for w in t.split()] for t in texts], eos=0)
    rows = {r["example_id"]: r for r in made.collect()}
    assert rows[1]["full_ids"][: len(rows[1]["prompt_ids"])] == rows[1]["prompt_ids"] and rows[1]["labels"][-2:] == [2, 0] and rows[1]["labels"][0] == -100
    counts = samples.sample_counts(made).first()
    assert (counts["samples"], counts["kept"], counts["skipped"], counts["target_tokens"]) == (2, 2, 0, 4)
    with pytest.raises(Exception, match="lacks a target language"):
        samples.payload(some).collect()


def test_evaluation_from_examples_to_metrics(spark, kb):
    some = spark.createDataFrame([(1, "I saw New York", "ko", "Q1"), (2, "York", "ko", "Q2"), (3, "nothing", "ko", None)], "example_id int, source string, target_lang string, gold_qid string")
    target = "array<struct<translation: string, mention: string, mention_candidates: array<string>>>"
    records = spark.createDataFrame(
        [("1", "s", [("x", "NEW YORK", ["n"])], ["City"]), ("2", "s", [("x", "none", None), ("y", None, ["York"])], ["town", "CITY"]), ("3", "s", [("x", "q", [])], ["River"]), ("4", "s", [], ["City"]), ("5", "s", [("x", "straße", [])], ["city "])],
        f"id string, source string, targets {target}, entity_types array<string>",
    )

    def generator():
        return lambda prompts: [next((x.split(": ", 1)[1] for x in p.splitlines() if x.startswith("  Target (")), "?") for p in prompts]

    predictions, row = evaluation.evaluate(some, records, generator, lambda s, r, p: [0.5 if x == "x" else 0.9 for x in r], kb, "anchored", ["city"])
    assert {r["id"]: r["prediction"] for r in predictions.collect()} == {"1": "New York", "2": "York", "3": "?"}
    got = row.first()
    assert (got["correct"], got["total"], got["missing_predictions"]) == (2, 3, 1) and got["comet"] == pytest.approx((0.5 + 0.9) / 3)
    assert got["final_score"] == pytest.approx(2 * (2 / 3) * (1.4 / 3) / (2 / 3 + 1.4 / 3)) and got["m_eta_percent"] == pytest.approx(200 / 3)
    assert evaluation.usable_references(records).count() == 4
    said = spark.createDataFrame([("5", "die STRASSE")], "id string, prediction string")
    assert evaluation.evaluate_predictions(said, records.where("id = '5'"), scores=spark.createDataFrame([("5", 1.0)], "id string, score double")).first()["final_score"] == 1.0
    with pytest.raises(ValueError):
        evaluation.evaluate_predictions(said, records)
    options = evaluation.generation_options
    assert options() == {"max_new_tokens": 256, "do_sample": False} and options(temperature=0.5, top_k=3)["temperature"] == 0.5 and options(temperature=0.5, do_sample=False, top_p=0.1).get("top_p") is None


def test_case_is_folded_as_python_does(spark):
    texts = ["Straße STRASSE ẞ", "ὈΔΥΣΣΕΎΣ ς σ", "ﬁn ŉ ǰ", "İstanbul ı", "ſ K Å µ", "Ꭰꭰ", "plain ÀÉ", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.casefolded("t").alias("f")).orderBy("i").collect()
    assert [r["f"] for r in rows] == [(t or "").casefold() for t in texts]


def test_run_files(spark, tmp_path):
    row = spark.createDataFrame([(0.5, "é")], "m_eta double, name string")
    path = runs.metrics_path(None, f"{tmp_path}/out/predictions.jsonl", "x")
    assert path == f"{tmp_path}/out/predictions_metrics.json" and runs.metrics_path("a.json", "b", "c") == "a.json" and runs.metrics_path(None, None, "d/") == "d/metrics.json"
    assert runs.write_metrics(row, path, seconds=2.0) == runs.read_json(spark, path) == {"m_eta": 0.5, "name": "é", "seconds": 2.0}
    with pytest.raises(ValueError):
        runs.metrics_path(None, None, None)
    assert runs.overlaid({"a": None, "b": 3}, {"a": 1, "b": 2, "c": 0}, {"a": 9, "b": 8, "z": 7}) == {"a": 9, "b": 3, "c": 0}
    runs.write_json_array(spark.createDataFrame([("Q1", "ko"), ("Q2", "de")], files.QID_LOCALES).orderBy("qid"), f"{tmp_path}/q.json")
    assert [tuple(r) for r in files.qid_locales(spark, f"{tmp_path}/q.json").orderBy("qid").collect()] == [("Q1", "ko"), ("Q2", "de")]


def test_loading_a_split(spark):
    examples = spark.createDataFrame([(i, "train" if i % 2 else "test", "en", "ko" if i < 6 else "de", f"s{i}") for i in range(10)], "example_id int, split string, source_locale string, target_locale string, source string")
    refs = spark.createDataFrame([(i, i, f"t{i}", f"m{i}", 0) for i in range(10)], "reference_id int, example_id int, translation_text string, mention_text string, reference_order int")
    entities = spark.createDataFrame([(i, "Q1", 0) for i in range(10)], "example_id int, qid string, entity_order int")
    types = spark.createDataFrame([("Q1", "a")], "qid string, type_text string")
    terms = spark.createDataFrame([(1, "Q1", "ko", "label", "가")], "term_id int, qid string, lang_code string, term_type string, term_text string")
    tables = dataset.Tables(examples, refs, entities, types, terms)
    got = dataset.load(tables, split="train", target_locale="ko", limit=2).orderBy("example_id").collect()
    assert [(r["example_id"], r["target"], r["targets"][0]["mention_candidates"]) for r in got] == [(1, "t1", ["m1", "가"]), (3, "t3", ["m3", "가"])]
    assert dataset.load(tables).count() == 10 and dataset.load(tables, source_locale="fr").count() == 0
    ids = spark.createDataFrame([("d", 1), ("d", 2), ("e", 3)], "dataset_id string, example_id int")
    joined = dataset.with_example_ids(spark.createDataFrame([("d", "x"), ("gone", "y")], "dataset_id string, v string"), ids)
    assert [tuple(r) for r in joined.collect()] == [("d", "x", 2)]


def test_margin_is_null_for_one(spark):
    scored = spark.createDataFrame([(1, 1, 0.5, 0.0), (2, 1, 0.2, 0.0), (2, 2, 0.2, 1.0)], "example_id int, rank int, reranker_score double, prior_bonus double")
    got = {(r["example_id"], r["final_rank"]): r for r in rerank.reranked(scored).collect()}
    assert got[1, 1]["margin_to_next"] is None and got[2, 1]["rank"] == 2 and got[2, 1]["margin_to_next"] == pytest.approx(0.1)


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 3), (3, None)], "example_id int, gold_rank int")
    got = metrics.ranking_summary(ranks).first()
    assert (got["n_groups"], round(got["mrr"], 6), got["recall_at_3"]) == (3, round((1 + 1 / 3) / 3, 6), pytest.approx(2 / 3))
    assert got["recall_at_1"] <= got["recall_at_3"] <= got["recall_at_5"]
    mentions = spark.createDataFrame([("a", ["Seoul"]), ("b", ["x"]), ("c", ["y"])], "id string, mentions array<string>")
    predictions = spark.createDataFrame([("a", "in SEOUL now"), ("b", "no"), ("z", "x")], "id string, prediction string")
    assert metrics.entity_accuracy(mentions, predictions).first()[:3] == (1, 3, 2 - 1)
    twice = mentions.union(spark.createDataFrame([("a", ["Zzz", "seoul"])], "id string, mentions array<string>"))
    said = predictions.union(spark.createDataFrame([("a", "zzz"), ("b", None)], "id string, prediction string"))
    assert tuple(metrics.entity_accuracy(twice, said).first()) == (1, 3, 1, pytest.approx(1 / 3))
    none = mentions.union(spark.createDataFrame([("n", None), ("e", [" "])], "id string, mentions array<string>"))
    assert tuple(metrics.entity_accuracy(none, predictions, skip_empty=True).first()) == (1, 3, 1, pytest.approx(1 / 3))
    with pytest.raises(Exception, match="no mentions for"):
        metrics.entity_accuracy(none, predictions).collect()
    ordered = metrics.last_of(spark.createDataFrame([("a", 2, "x"), ("a", 1, "z")], "id string, n int, v string"), "id", "v", "n")
    assert ordered.first()["v"] == "x"
    scores = spark.createDataFrame([("a", 0.4), ("a", 0.9)], "id string, score double")
    assert metrics.best_reference_mean(scores, mentions).first() == (1, 2, pytest.approx(0.3))
    assert spark.range(1).select(metrics.harmonic_mean(F.lit(0.0), F.lit(1.0))).first()[0] == 0.0
    assert metrics.ranking_summary(ranks.limit(0)).first()["mrr"] == 0.0


def test_files(spark, tmp_path):
    (tmp_path / "train").mkdir()
    (tmp_path / "train" / "a.jsonl").write_text(json.dumps({"id": "t1", "source": "s", "target_locale": "ko", "target": "대상", "entities": ["Q1", "Q2"]}) + "\n", encoding="utf-8")
    (tmp_path / "val.jsonl").write_text(json.dumps({"id": "v1", "target_locale": "ko", "wikidata_id": "Q3", "entity_types": ["T", "T"], "targets": [{"translation": "x", "mention": "m"}, {"translation": "y"}]}) + "\n")
    train = files.json_lines(spark, str(tmp_path / "train"), files.TRAIN)
    val = files.json_lines(spark, str(tmp_path), files.EVAL, recursive=False)
    assert [tuple(r) for r in files.train_examples(train, "ko").select("example_id", "gold_qid").collect()] == [("t1::0", "Q1"), ("t1::1", "Q2")]
    assert files.references(train, val).count() == 3 and files.example_entities(train, val).count() == 3
    assert [tuple(r) for r in files.entity_types(val).collect()] == [("Q3", "T")]
    assert sorted(tuple(r) for r in files.entities(train, val).collect()) == [("Q1", None), ("Q2", None), ("Q3", None)]
    assert [tuple(r) for r in files.validation_examples(val, "ko").select("example_id", "gold_qid").collect()] == [("v1", "Q3")] and not files.validation_examples(val, "de").count()
    assert [r["qid"] for r in files.qid_locale_pairs(train, val).collect()] == ["Q1", "Q2", "Q3"]
    (tmp_path / "w.json").write_text(json.dumps({"entities": {"Q1": {"labels": {"ko": {"value": "파리"}}, "aliases": {"ko": [{"value": "a"}, {"value": "b"}]}}, "Q2": {"missing": ""}}}), encoding="utf-8")
    assert files.entity_terms(spark.read.schema(files.ENTITIES).json(str(tmp_path / "w.json")), ["ko"]).count() == 3
    files.write_json_lines(files.prediction_records(spark.createDataFrame([(1, None, "zh", "é", "ü")], "id int, source_lang string, target_lang string, text string, prediction string")), str(tmp_path / "out"))
    assert files.json_lines(spark, str(tmp_path / "out"), files.PREDICTIONS, pattern="*.txt").first().asDict() == {"id": "1", "source_language": "en_US", "target_language": "zh_TW", "text": "é", "prediction": "ü"}


def test_assembly_raises_and_kb(spark):
    examples = spark.createDataFrame([(1, "ko"), (2, "ko")], "example_id int, target_locale string")
    refs = spark.createDataFrame([(1, 1, "x", None, 0), (2, 2, " ", None, 0)], "reference_id int, example_id int, translation_text string, mention_text string, reference_order int")
    entities = spark.createDataFrame([(1, "Q1", 0)], "example_id int, qid string, entity_order int")
    types = spark.createDataFrame([("Q1", "b"), ("Q1", "a")], "qid string, type_text string")
    terms = spark.createDataFrame([(3, "Q1", "ko", "alias", "나"), (4, "Q1", "ko", "label", "가"), (5, "Q1", "en", "label", "A, B"), (6, "Q1", "en", "description", "d")], "term_id int, qid string, lang_code string, term_type string, term_text string")
    with pytest.raises(ValueError, match="1 examples lack a reference, such as 2"):
        dataset.assembled(examples, refs, entities, types, terms)
    got = dataset.assembled(examples.where("example_id = 1"), refs, entities, types, terms).first()
    assert got["target"] == "x" and got["targets"][0]["mention"] == "가" and got["targets"][0]["mention_candidates"] == ["가", "나"] and got["entity_types"] == ["a", "b"]
    record = dataset.knowledge_base(spark.createDataFrame([("Q1", None), ("Q2", 2.0)], "qid string, popularity_score double"), terms, types, "ko").orderBy("qid").collect()
    assert (record[0]["target_label"], record[0]["description"], record[0]["entity_type"], record[0]["surfaces"], record[0]["popularity"]) == ("가", "d", "a", ["a b"], 0.0)
    assert not record[1]["language_available"] and record[1]["target_aliases"] == []
    last = dataset.keep_last(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, n int, v string"), ["k"], "n")
    assert last.first()["v"] == "y"


def test_ingest_is_idempotent(spark, tmp_path):
    schema = "id int, v string"
    spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (None, "n"), (None, "m")], schema).write.parquet(str(tmp_path / "in"))
    for n in range(2):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ingest(stream, str(tmp_path / "out"), ["id"], str(tmp_path / f"c{n}"), buckets=4).awaitTermination(60)
    assert sorted(map(tuple, KeyedTable(str(tmp_path / "out"), ["id"], 4).rows(spark, schema).select("id", "v").collect()), key=str) == [(1, "a"), (2, "c"), (None, "m")]


def test_ingest_survives_a_half_written_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d")], "id int, v string")
    write = append_missing(str(tmp_path / "out"), ["id"], "r", buckets=4)
    write(rows.where("id = 1"), 0)
    write(rows.where("id > 1"), 1)
    part = next((tmp_path / "out" / "rows").glob("key_bucket=*/ingest_run=r/ingest_batch=1/part-*.parquet"))
    part.unlink()  # as if the batch had been cut off
    write(rows.where("id > 1"), 1)
    write(rows, 2)
    assert sorted(r["id"] for r in KeyedTable(str(tmp_path / "out"), ["id"], 4).rows(spark, "id int, v string").collect()) == [1, 2, 3]


def test_appends_read_only_buckets_that_may_hold_a_key(spark, tmp_path, monkeypatch):
    table = KeyedTable(str(tmp_path / "t"), ["id"], 16)
    table.append(spark.range(400).withColumn("v", F.lit(1)), "r", 0)
    new = spark.range(1000, 1003).withColumn("v", F.lit(2))
    read = []
    monkeypatch.setattr(KeyedTable, "rows", lambda self, spark, schema, f=KeyedTable.rows: (read.append(1), f(self, spark, schema))[1])
    assert table.missing(new).count() == 3 and not read  # no filter holds them
    some = table.missing(spark.range(5, 6).withColumn("v", F.lit(3)))
    assert some.count() == 0 and read
    plan = some._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters") :]
    assert "key_bucket" in scan[: scan.index("PushedFilters")]


@pytest.mark.parametrize("parts", [1, 7])
def test_first_of_keys_in_any_partitioning(spark, parts):
    rows = spark.createDataFrame([(1, 3, "x"), (1, 2, "z"), (1, 2, "y"), (None, 1, None), (None, 1, "q"), (2, None, "n")], "k int, o int, v string").repartition(parts)
    got = sorted((tuple(r) for r in first_of_keys(rows, ["k"], "o").collect()), key=str)
    assert [r[:2] for r in got] == [(1, 2), (2, None), (None, 1)] and got[0][2] == "y"
    assert files.missing_from(rows, rows.where("k = 1"), ["k"]).where("k = 1").count() == 0


def test_input_order_of_files(spark, tmp_path):
    """The last of a key is the last line of the last file, in any number of splits."""
    for f in range(3):
        (tmp_path / f"f{f}.jsonl").write_text("".join('{"id": "%d", "prediction": "%s"}\n' % (i % 7, f"{f}-{i}") for i in range(500)))
    with_size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (with_size, "3000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = files.json_lines(spark, str(tmp_path), files.PREDICTIONS, ordinal="ordinal").select("id", "prediction", "ordinal").repartition(5)
            last = {r["id"]: r["prediction"] for r in metrics.last_of(rows, "id", "prediction", "ordinal").collect()}
            assert last == {str(k): f"2-{max(i for i in range(500) if i % 7 == k)}" for k in range(7)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", with_size)
    records = spark.createDataFrame([("1", "s", [("x", "zeta", None)], [])], "id string, source string, targets array<struct<translation: string, mention: string, mention_candidates: array<string>>>, entity_types array<string>")
    said = spark.createDataFrame([("1", "zz none", 1), ("1", "a zeta b", 2)], "id string, prediction string, ordinal int")
    assert evaluation.evaluate_predictions(said, records, scores=spark.createDataFrame([("1", 0.5)], "id string, score double")).first()["correct"] == 1


def test_varied_feeds(spark, tmp_path):
    lines = ['{"id": 1, "source": "a", "target_locale": "ko"}', '{"example_id": "2", "text": " b ", "source": "", "lang": "de"}', '{"meta": {"id": 3, "locale": "fr"}, "sentence": "c", "source": null}', "", "   ", '{"id": 4', "[1]", '{"id": [1], "example_id": 5}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    fields = {"id": ("bigint", ("id", "example_id", "$.meta.id")), "source": ("string", ("source", "text", "sentence")), "locale": ("string", ("target_locale", "lang", "$.meta.locale"))}
    rows = files.varied_lines(spark, str(tmp_path), fields, ordinal="at").orderBy("at").drop("at").collect()
    assert [tuple(r) for r in rows] == [(1, "a", "ko", None), (2, "b", "de", None), (3, "c", "fr", None), (None, None, None, '{"id": 4'), (None, None, None, "[1]"), (5, None, None, None)]


def test_fallback_chains(spark):
    steps = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "d", 0), ("c", "d", 0), ("d", "a", 0), ("x", "", 0), (None, "a", 0)], "lang_code string, fallback string, place int")
    chain = files.fallback_chain(steps)
    assert {l: [r["fallback"] for r in chain.where(F.col("lang_code") == l).orderBy("distance").collect()] for l in "abd"} == {"a": list("abcd"), "b": list("bdac"), "d": list("dabc")}
    terms = spark.createDataFrame([("Q", "c", "label", "x"), ("Q", "d", "label", "y"), ("Q", "d", "alias", "z")], "qid string, lang_code string, term_type string, term_text string")
    got = {(r["lang_code"], r["term_type"]): (r["term_text"], r["from_lang"]) for r in files.terms_with_fallback(terms, chain).collect()}
    assert got[("a", "label")] == ("x", "c") and got[("b", "label")] == ("y", "d") and got[("c", "alias")] == ("z", "d")


def test_json_array_in_one_file(spark, tmp_path):
    for n, parts in ((0, 1), (1, 3), (1000, 7)):
        runs.write_json_array(spark.range(n).select(F.col("id"), F.lit("é").alias("v")).repartitionByRange(parts, "id").sortWithinPartitions("id"), f"{tmp_path}/{n}.json")
        assert runs.read_json(spark, f"{tmp_path}/{n}.json") == [{"id": i, "v": "é"} for i in range(n)]


def test_requirements_are_observed_while_writing(spark, tmp_path):
    none, one = [], [("t", "m", ["m"])]
    schema = "example_id int, targets array<struct<translation: string, mention: string, mention_candidates: array<string>>>"
    rows = spark.createDataFrame([(i, none if i in (3, 5) else one) for i in range(9)], schema)
    with pytest.raises(ValueError, match="2 examples lack a reference, such as 3, 5"):
        dataset.save(rows, str(tmp_path / "out"))
    assert not list(tmp_path.iterdir())
    dataset.save(rows.where("example_id < 3"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    with pytest.raises(ValueError, match="4 examples lack a mention"):
        dataset.save(spark.createDataFrame([(i, [("t", None, [])]) for i in range(4)], schema), str(tmp_path / "no"), require_references=False)


@pytest.mark.parametrize("parts", [1, 6])
def test_batches_by_length(spark, parts):
    rng = np.random.default_rng(7)
    data = [(str(i), rng.integers(1, 9, n).tolist(), [-100] + rng.integers(1, 9, n - 1).tolist()) for i, n in enumerate([*rng.integers(1, 12, 50).tolist(), *[5] * 60])]
    rows = spark.createDataFrame([*data, ("x", [1], None)], "example_id string, full_ids array<int>, labels array<int>").repartition(parts)
    got = samples.batched(rows, 8).orderBy("batch").collect()
    want = sorted(data, key=lambda r: (len(r[1]), hashlib.md5(r[0].encode()).hexdigest()))
    for b, r in enumerate(got):
        own = want[8 * b : 8 * b + 8]
        width = max(len(x[1]) for x in own)
        pad = lambda x, v: x + [v] * (width - len(x))
        assert (r["batch"], r["size"], r["width"], r["keys"]) == (b, len(own), width, [x[0] for x in own])
        assert r["input_ids"] == [pad(x[1], 0) for x in own] and r["attention_mask"] == [pad([1] * len(x[1]), 0) for x in own] and r["batch_labels"] == [pad(x[2], -100) for x in own]
    assert sum(r["size"] for r in got) == len(data)


def test_chat_templates(spark):
    rows = spark.createDataFrame([([("user", "q"), ("assistant", "a")],)], "m array<struct<role: string, content: string>>")
    signs = {"user": ("<u>", "</u>"), "assistant": ("<a>", "</a>")}
    assert rows.select(samples.templated("m", signs, "<s>", "<a>").alias("t")).first()["t"] == "<s><u>q</u><a>a</a><a>"
    with pytest.raises(Exception, match="lacks role assistant"):
        rows.select(samples.templated("m", {"user": ("", "")})).collect()


def _ranking_groups(spark, n=60):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=(3 + i % 4, 11)).tolist()) for i in range(n)]
    rows = [(i, x, [int(k == int(np.argmax([v[0] for v in x]))) for k in range(len(x))], []) for i, x in rows] + [(n, [[0.0] * 11], [0], []), (n + 1, [], [], [])]
    return spark.createDataFrame(rows, "example_id int, numeric_features array<array<double>>, labels array<int>, qids array<string>"), rows


def test_distributed_training_is_the_drivers(spark):
    """With the batches that it makes and nothing dropped out, the parameters are those of training in one place."""
    groups, rows = _ranking_groups(spark)
    batch = {r["example_id"]: r["b"] for r in groups.select("example_id", F.pmod(F.xxhash64("example_id"), F.lit(3)).alias("b")).collect()}
    some = [(np.array(x), labels, i) for i, x, labels, _ in rows if 1 in labels]
    place = {i: k for k, (*_, i) in enumerate(some)}
    batches = lambda epoch: [[place[i] for i in place if batch[i] == b] for b in np.random.default_rng([5, epoch]).permutation(3).tolist()]
    model, history = rerank.trained([(x, y) for x, y, _ in some], epochs=3, rate=1e-2, hidden=8, dropout=0.0, seed=5, batches=batches)
    state = listwise.trained(groups.repartition(5), 3, 3, rate=1e-2, hidden=8, dropout=0.0, seed=5)
    for a, b in zip(state.params, (model.w1, model.b1, model.w2, [model.b2])):
        assert np.abs(a - b).max() < 1e-9
    assert [h["loss"] for h in state.history] == pytest.approx([h["loss"] for h in history]) and all(h["groups"] == 60 for h in state.history)


def test_training_learns_stops_and_goes_on(spark, tmp_path):
    groups, _ = _ranking_groups(spark)
    whole = listwise.trained(groups, 6, 2, rate=3e-2, hidden=16, seed=1)
    assert whole.history[-1]["loss"] < 0.6 * whole.history[0]["loss"]
    store = str(tmp_path / "store")
    listwise.trained(groups, 2, 2, rate=3e-2, hidden=16, seed=1, store=store, validate=groups)
    assert models.versions(spark, store) == [1, 2]
    again = listwise.trained(groups.repartition(3), 6, 2, rate=3e-2, hidden=16, seed=1, store=store, validate=groups)
    assert all(np.abs(a - b).max() < 1e-9 for a, b in zip(whole.params, again.params)) and models.versions(spark, store) == [1, 2, 3, 4, 5, 6]
    best = again.best()
    assert again.history[best - 1]["top1"] == max(h["top1"] for h in again.history)
    x = np.random.default_rng(0).normal(size=(4, 11))
    assert (listwise.best_scorer(spark, store)(x) == listwise.State.load(spark, store, best).scorer(x)).all()
    assert listwise.judged(groups, whole.scorer)["top1"] > 0.7
    with pytest.raises(FileExistsError):
        again.save(spark, store)
    assert not [n for n in (tmp_path / "store").iterdir() if ".part" in n.name]
    empty = listwise.trained(groups.where("example_id < 0"), 1, 2)
    assert empty.history == [{"loss": 0.0, "top1": None, "groups": 0}]


def test_wrapped_parameters_are_read_by_their_plain_names(spark, tmp_path):
    models.save(spark, str(tmp_path), 3, {"module.w1": np.ones(2)}, note="n")
    arrays, values = models.load(spark, str(tmp_path))
    assert list(arrays) == ["w1"] and values == {"note": "n"}
    with pytest.raises(FileNotFoundError):
        models.load(spark, str(tmp_path / "none"))


def score_by_length(sources, references, predictions):
    return [min(1.0, len(p) / 10) for p in predictions]


def test_evaluation_from_the_command_line(spark, tmp_path):
    from lexweave import evaluate

    spark.createDataFrame([(1, "validation", "en", "ko", "s"), (2, "validation", "en", "de", "s"), (3, "test", "en", "ko", "s")], "example_id int, split string, source_locale string, target_locale string, source string").write.parquet(str(tmp_path / "t" / "examples"))
    spark.createDataFrame([(1, 1, "x", "Seoul", 0), (2, 2, "y", "Berlin", 0)], "reference_id int, example_id int, translation_text string, mention_text string, reference_order int").write.parquet(str(tmp_path / "t" / "references"))
    spark.createDataFrame([(1, "Q1", 0), (2, "Q2", 0)], "example_id int, qid string, entity_order int").write.parquet(str(tmp_path / "t" / "entities"))
    spark.createDataFrame([("Q1", "City")], "qid string, type_text string").write.parquet(str(tmp_path / "t" / "types"))
    spark.createDataFrame([], "term_id int, qid string, lang_code string, term_type string, term_text string").write.parquet(str(tmp_path / "t" / "terms"))
    files.write_json_lines(spark.createDataFrame([("1", "in seoul")], "id string, prediction string"), str(tmp_path / "predictions"))
    runs.write_json(spark, {"eval_split": "validation", "target_locale": "ko"}, str(tmp_path / "summary.json"))
    common = ["--tables", str(tmp_path / "t"), "--predictions", str(tmp_path / "predictions"), "--score", f"{__name__}:score_by_length"]
    got = evaluate.main([*common, "--summary", str(tmp_path / "summary.json")], spark)
    assert (got["correct"], got["total"], got["comet"], got["settings"]["target_locale"]) == (1, 1, pytest.approx(0.8), "ko")
    assert runs.read_json(spark, str(tmp_path / "predictions_metrics.json"))["total"] == 1
    assert evaluate.main([*common, "--metrics", str(tmp_path / "m.json")], spark)["total"] == 2


def make_generator(max_new_tokens, do_sample, **more):
    return lambda prompts: [f"{'[ENTITY MEMORY]' in p} {max_new_tokens} {do_sample} seoul" for p in prompts]


def make_score():
    return score_by_length


def test_generation_from_the_command_line(spark, tmp_path):
    from lexweave import evaluate

    t = tmp_path / "t"
    spark.createDataFrame([(1, "validation", "en", "ko", "go to Seoul"), (2, "test", "en", "ko", "s")], "example_id int, split string, source_locale string, target_locale string, source string").write.parquet(str(t / "examples"))
    spark.createDataFrame([(1, 1, "x", "Seoul", 0)], "reference_id int, example_id int, translation_text string, mention_text string, reference_order int").write.parquet(str(t / "references"))
    spark.createDataFrame([(1, "Q1", 0)], "example_id int, qid string, entity_order int").write.parquet(str(t / "entities"))
    spark.createDataFrame([("Q1", "City")], "qid string, type_text string").write.parquet(str(t / "types"))
    spark.createDataFrame([(1, "Q1", "en", "label", "Seoul"), (2, "Q1", "ko", "label", "서울")], "term_id int, qid string, lang_code string, term_type string, term_text string").write.parquet(str(t / "terms"))
    spark.createDataFrame([("Q1", 1.0)], "qid string, popularity_score double").write.parquet(str(t / "entity"))
    state = listwise.State.of(rerank.ListwiseScorer.fresh(4))
    state.epoch, state.history = 1, [{"loss": 1.0, "top1": 0.5, "groups": 1}]
    state.save(spark, str(tmp_path / "scorer"))
    for mode, more, memory in (("plain", [], "False"), ("entity-aware", ["--entity-pipeline-mode", "rerank", "--scorer", str(tmp_path / "scorer")], "True")):
        out = tmp_path / f"predictions-{mode}"
        common = ["--tables", str(t), "--predictions", str(out), "--make-score", f"{__name__}:make_score", "--generator", f"{__name__}:make_generator", "--target-locale", "ko", "--temperature", "0.5", "--max-new-tokens", "9"]
        got = evaluate.main([*common, "--mode", mode, *more], spark)
        assert (got["correct"], got["total"], got["settings"]["mode"]) == (1, 1, mode)
        assert [r["prediction"] for r in files.json_lines(spark, str(out), files.PREDICTIONS, pattern="*.txt").collect()] == [f"{memory} 9 True seoul"]
    with pytest.raises(ValueError, match="target locale"):
        evaluate.main([x for x in common if x not in ("--target-locale", "ko")] + ["--mode", "entity-aware"], spark)
    with pytest.raises(ValueError, match="--score"):
        evaluate.main(["--tables", str(t), "--predictions", "p"], spark)


def test_databases_are_named_by_settings():
    found = files.jdbc_options({"DB_HOST": "h", "DB_NAME": "n", "DB_USER": "u"})
    assert found == {"url": "jdbc:mysql://h:3306/n?characterEncoding=UTF-8", "user": "u"}
    with pytest.raises(ValueError, match="DB_HOST"):
        files.jdbc_options({"DB_NAME": "n"})


def test_slots(spark):
    def small(prompts):
        if len(prompts) > 2:
            raise MemoryError
        return [p.upper() for p in prompts]

    assert generate_halving(small, list("abcde")) == list("ABCDE")
    frame = spark.createDataFrame([("a", "r", "p")], "source string, reference string, prediction string")
    assert generated_frame(frame, "source", "made", lambda: lambda prompts: [p * 2 for p in prompts]).first()["made"] == "aa"
    assert scored_frame(frame, lambda s, r, p: [0.5] * len(s)).first()["score"] == 0.5


def test_scorer_as_a_column(spark):
    model = rerank.ListwiseScorer.fresh(8)
    frame = spark.createDataFrame([([0.5] * 11,), ([0.0] * 11,)], "f array<double>")
    got = [r["s"] for r in frame.select(model.column("f").alias("s")).collect()]
    assert got == pytest.approx([float(model([0.5] * 11)), 0.0])
    assert [r["s"] for r in frame.select(model.as_sql("f").alias("s")).collect()] == pytest.approx(got)


def test_scorer_is_saved_and_its_gradient_right(tmp_path):
    model = rerank.ListwiseScorer.fresh(4, seed=3)
    model.save(str(tmp_path / "m.npz"))
    again, x = rerank.ListwiseScorer.load(str(tmp_path / "m.npz")), np.random.default_rng(1).normal(size=(5, 11))
    assert (again(x) == model(x)).all()
    scores = np.array([0.3, -1.0, 2.0])
    _, gradient = rerank.listwise_loss(scores, 1)
    for i in range(3):
        step = np.eye(3)[i] * 1e-6
        assert gradient[i] == pytest.approx((rerank.listwise_loss(scores + step, 1)[0] - rerank.listwise_loss(scores - step, 1)[0]) / 2e-6, abs=1e-6)
    assert rerank.listwise_loss(scores, -1)[0] == 0.0


def test_contract_and_independence():
    import __spark_entry__ as entry

    from lexweave import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    top = Path(catalog.__file__).parent
    for p in top.rglob("*.py"):
        if "llm" not in p.relative_to(top).parts:
            for node in ast.walk(ast.parse(p.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any("llm" in n for n in names), p


def test_completion_labels_hold_long_answers(spark, tmp_path):
    from lexweave import catalog

    said = [(1, 0, "user", "ask " * 300), (1, 1, "assistant", "answer " * 400), (2, 0, "user", "u " * 10), (2, 1, "assistant", "aa " * 2100)]
    spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: r for r in catalog.queries()["completion_labels"](spark, str(tmp_path)).collect()}
    assert (got[1]["n_labels"], got[1]["n_masked"]) == (701, 300) and got[1]["labels"].split(",")[300:] == ["6"] * 400 + ["0"]
    assert (got[2]["n_labels"], got[2]["n_masked"]) == (2048, 10)


def test_m_eta_asks_for_every_item(spark, tmp_path):
    from lexweave import catalog

    spark.createDataFrame([(i, f"word{i} tail") for i in range(60)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(120)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(i, f"has word{i % 60} in it", "en") for i in range(120)], "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert tuple(catalog.queries()["m_eta"](spark, str(tmp_path)).first()) == (120, 120, 0, 1.0)


def test_reranker_trains_in_full(spark, monkeypatch):
    from lexweave.plans import entity_queries

    groups = spark.createDataFrame([(i, [[float(i % 7)] * 11, [0.0] * 11], [1, 0], ["a", "b"]) for i in range(900)], "example_id int, numeric_features array<array<double>>, labels array<int>, qids array<string>")
    seen, train = [], listwise.trained
    monkeypatch.setattr(entity_queries, "_groups", lambda spark, sf_dir: groups)
    monkeypatch.setattr(listwise, "trained", lambda *a, **more: seen.append(train(*a, **more)) or seen[-1])
    assert entity_queries.reranker_mlp(spark, "", epochs=2).count() == 1800
    assert [h["groups"] for h in seen[0].history] == [900, 900]


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
@pytest.mark.parametrize(
    "name",
    ["surface_topk", "align_spans", "dataset_assembly", "dataset_load", "kb_build", "translation_prompt", "pipeline_modes", "gold_memories", "noisy_samples", "fixed_scorer", "evaluation_summary", "m_eta", "completion_labels", "upsert_antijoin"],
)
def test_queries_match_sql(spark, name):
    import duckdb

    from lexweave import catalog

    con = duckdb.connect()
    for p in Path(SMALL).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, SMALL)
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    key = lambda rows: sorted(tuple("" if v is None else str(v) for v in r) for r in rows)
    assert key(got.select(*columns).collect()) == key(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_small_index_gives_what_the_join_gives(spark, kb, examples, monkeypatch):
    """Also where an id comes twice, with other sources, gold entities or languages, and where surfaces are of several languages."""
    columns = [c for c in examples.columns if c in ("example_id", "source", "target_lang", "gold_qid")]
    some = examples.select(*columns)
    twice = some.unionByName(some.withColumn("source", F.concat(F.lit("and "), F.col("source"), F.lit(" and "), F.col("source"))))
    told = lambda rows: sorted(map(repr, rows.select("example_id", "mode", "rank", "qid", "candidate_source", "source_span", "ambiguity_count", "target_label").collect()))
    for asked in (some, twice):
        monkeypatch.setattr(retrieval, "SMALL", 1 << 16)
        found = told(retrieval.candidates_of_modes(asked, kb, retrieval.MODES))
        monkeypatch.setattr(retrieval, "SMALL", -1)
        assert found and found == told(retrieval.candidates_of_modes(asked, kb, retrieval.MODES))


def test_features_of_a_small_index_deal_examples_out_once(spark, kb, examples):
    """Candidates never meet their examples or the knowledge base by a shuffle: what is dealt out by example is a row each."""
    found = retrieval.candidates(examples, linking.named(linking.prepared(kb)), more=(linking._NAMES, linking._ENTITY), carry=linking.carried())
    rows = linking.scored(linking.featured(linking.aligned(found, examples)))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(example_id") == 1 and "Exchange hashpartitioning(kb_row" not in plan


def test_features_of_prepared_texts_are_those_of_the_texts(spark, kb, examples):
    """What spans are compared by comes with the candidates, and gives what the texts give; also where an id comes twice."""
    some = examples.unionByName(examples.withColumn("source", F.concat(F.lit("in YORK "), "source")))
    found = retrieval.candidates(some, linking.named(linking.prepared(kb)), more=(linking._NAMES, linking._ENTITY), carry=linking.carried())
    rows = linking.aligned(found, some)
    assert set(linking.made(rows)) == {"source_made", "entity", "own_made", "passed_made"}
    told = lambda df: sorted(map(repr, df.select("example_id", "source", "qid", *sorted(c for c in df.columns if c.startswith("f_"))).collect()))
    got = told(linking.featured(rows))
    texts = rows.withColumn("_score", F.col("span.match_score"))
    values = rerank.features("source", "span_text", "_score", "passed_span")
    assert got and got == told(texts.withColumns({f"f_{k}": v for k, v in values.items()}))


def test_training_groups_take_one_order(spark, kb, examples):
    """Places, what is left out and groups come of one sort of the candidates, and of no aggregate over them."""
    sorts = lambda df: [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Sort [example_id#" in x]
    rows = linking.training_rows(examples, kb, 1)
    assert len(sorts(rows)) == 1 and len(sorts(linking.training_groups(examples, kb))) == 1
    want = {r["example_id"]: r for r in rerank.grouped(rows.withColumn("features", rerank.vector(linking.feature_columns()))).collect()}
    got = {r["example_id"]: r for r in linking.training_groups(examples, kb, 1).collect()}
    assert got and got == want


def test_overlaps_are_measured_only_where_they_are_asked_for(spark, kb, examples):
    found = retrieval.candidates(examples, linking.named(linking.prepared(kb)), more=(linking._NAMES, linking._ENTITY), carry=linking.carried())
    rows = linking.featured(linking.aligned(found, examples), where=F.col("qid") == "Q1").select("qid", "f_surface_overlap_score", "f_description_overlap_score").collect()
    assert {(r[0] == "Q1", r[1] is not None, r[2] is not None) for r in rows} == {(True, True, True), (False, False, False)}


def test_groups_are_kept_and_read_by_columns(spark, tmp_path):
    """Training leaves its groups, whole, to who goes on with them; nulls in them count for nothing."""
    rows = [(1, [[1.0, None], [2.0, 3.0]], [0, 1, 1], ["a", "b"]), (2, None, [1], []), (3, [[1.0, 1.0]], None, ["c"]), (4, [[5.0, 6.0]], [None], ["d"]), (5, [[7.0, 8.0], [9.0, 1.0]], [1, 1], ["e", "f"]), (6, [[0.0, 0.0]], [0, 1], ["g"])]
    groups = spark.createDataFrame(rows, "example_id int, numeric_features array<array<double>>, labels array<int>, qids array<string>")
    batch = groups.select(F.col("example_id").cast("bigint").alias("key"), "numeric_features", "labels").toArrow().combine_chunks().to_batches()[0]
    keys, sizes, golds, x = listwise._groups(batch)
    assert (keys.tolist(), sizes.tolist(), golds.tolist(), x.tolist()) == ([1, 5], [2, 2], [1, 0], [[1.0, 0.0], [2.0, 3.0], [7.0, 8.0], [9.0, 1.0]])
    held = str(tmp_path / "groups")
    some, _ = _ranking_groups(spark)
    listwise.trained(some, 1, 2, kept=held)
    assert sorted(map(repr, spark.read.schema(some.schema).parquet(held).select(*some.columns).collect())) == sorted(map(repr, some.collect()))
    drawn = listwise._kept((1, 2), keys, np.array([500, 500]), 64, 0.25)
    assert abs((drawn == 0).mean() - 0.25) < 0.01 and set(np.unique(drawn)) == {0.0, 1 / 0.75} and (drawn[500:] == listwise._kept((1, 2), keys[1:], np.array([500]), 64, 0.25)).all()


def test_recall_deals_out_gold_candidates_alone(spark, tmp_path, monkeypatch):
    from lexweave.plans import entity_queries

    seen, ranks = [], metrics.gold_ranks_by
    monkeypatch.setattr(metrics, "gold_ranks_by", lambda examples, found, *more: seen.append(found) or ranks(examples, found, *more))
    entity_queries.retrieval_recall(spark, SMALL)
    assert seen[0].where("NOT qid <=> gold_qid").isEmpty() and not seen[0].isEmpty()


def test_hits_are_cut_to_candidates_before_they_are_dealt_out(spark, kb, examples, monkeypatch):
    """What isn't asked for stays behind: further hits, sources and the fields of entities."""
    seen, made = [], retrieval._with_hits
    monkeypatch.setattr(retrieval, "_with_hits", lambda *args: seen.append(made(*args)) or seen[-1])
    found = retrieval.candidates(examples, kb, mode="retrieve", fields=())
    assert seen[0].agg(F.max(F.size("hits"))).first()[0] == 1 and "source" not in seen[0].columns
    assert not set(found.columns) & set(retrieval.KB_FIELDS)
    dealt = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "collect_list" in line]
    assert dealt and not any("source#" in line or "target_label" in line for line in dealt)
    want = [tuple(r) for r in retrieval.candidates(examples, kb, mode="rerank").where("rank = 1").select("example_id", "qid", "candidate_source", "source_span").orderBy("example_id").collect()]
    assert want and want == [tuple(r) for r in found.select("example_id", "qid", "candidate_source", "source_span").orderBy("example_id").collect()]


def test_gold_of_another_language_leaves_the_surface_candidate(spark, monkeypatch):
    """Rows of one id: a gold entity without a usable row in its row's language gives no anchored candidate, and takes no other's place."""
    row = lambda q, lang: (q, lang, "York", [], "York", [], None, None, True, 1.0, ["york"])
    table = spark.createDataFrame([row("Q1", "ko"), row("Q2", "de")], KB)
    some = spark.createDataFrame([(1, "York", "ko", None), (1, "York", "de", "Q1")], "example_id int, source string, target_lang string, gold_qid string")
    for small in (1 << 16, -1):
        monkeypatch.setattr(retrieval, "SMALL", small)
        assert {(r["qid"], r["candidate_source"]) for r in retrieval.candidates(some, table).collect()} == {("Q1", "surface_search"), ("Q2", "surface_search")}


def test_anchored_memories_make_examples_once(spark):
    """Also where an id comes twice: each row of examples gives one, with its own source."""
    from lexweave.plans import entity_queries

    for query in (entity_queries.sft_samples, entity_queries.noisy_samples):
        plan = query(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("l_linenumber#") and sum("Relation" in line and "l_orderkey" in line for line in plan.splitlines()) == 1
    table = spark.createDataFrame([("Q1", "ko", "York", [], "York", [], None, None, True, 1.0, [])], KB)
    some = spark.createDataFrame([(1, "in York", "ko", "Q1"), (1, "at york", "ko", "Q1"), (2, "York", "ko", None)], "example_id int, source string, target_lang string, gold_qid string")
    got = linking.entity_memories(some, table, "anchored").select("example_id", "memory.source_sentence", "memory.source_span").collect()
    assert sorted(map(tuple, got), key=repr) == [(1, "at york", "york"), (1, "in York", "York"), (2, None, None)]


def test_stripping_looks_at_both_ends(spark):
    texts = ["", " ", "a", "a b", " a", "a ", " a　", "a\n", "a\r\n", "\x1ca", "é", "é ", "~!", None, "a ", "x\x85"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.stripped("t").alias("a"), tx.stripped(F.col("t")).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] == ["", "", "a", "a b", "a", "a", "a", "a", "a", "a", "é", "é", "~!", None, "a", "x"]


def test_first_token_is_that_of_the_whole_text(spark):
    """Also where the head ends inside the first word, or holds none, and for texts without one."""
    texts = ["", None, " ", "Ab", "ab", "...a, b", "Ab.c d", "abcdefgh", "abcdefg h", "abcdefgh i", "        z", "!!!!!!!!z y", "ΑΣ β", "ΑΣ' β γδ", "ΑΣ''''''β"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.first_token("t", 8).alias("a"), F.get(tx.tokens(tx.normalize_surface("t")), 0).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and got[3]["a"] == "ab" and got[0]["a"] is None


def test_folding_searches_no_pattern(spark):
    """Letters that fold to others are looked up in a table; ASCII and other texts come out as Python folds them."""
    texts = ["", "Plain", "É", "Straße", "ﬁn", "ΑΣ", "ſ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.casefolded("t").alias("f"))
    assert "RLIKE" not in df._jdf.queryExecution().analyzed().toString()
    assert all(r["f"] == (r["t"] or "").casefold() for r in df.collect() if r["t"] != "ΑΣ")


@pytest.mark.parametrize("name", ["feed_references", "feed_entities", "feed_example_entities", "qid_locale_array", "duplicate_predictions"])
def test_feeds_of_texts_without_words(spark, tmp_path, name):
    """Texts that are null, empty or nothing but signs have no first or last word, which is no error."""
    import duckdb

    from lexweave import catalog

    texts = ["First word, then more.", "", None, " \t ", "... !?"]
    spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    for n in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM '{tmp_path}/{n}.parquet/*.parquet'")
    want, got = con.sql(catalog.oracle_sql()[name]), catalog.queries()[name](spark, str(tmp_path))
    key = lambda rows: sorted(tuple("" if v is None else str(v) for v in r) for r in rows)
    assert key(got.select(*want.columns).collect()) == key(want.fetchall())


def test_gradients_are_summed_in_blocks(spark, monkeypatch):
    """Hidden units are computed for a bounded number of candidates at once, whatever an Arrow batch holds; sums are the same."""
    rows = [(i, [[(i * 7 + j * 3) % 31 / 31] * 11 for j in range(1 + i % 9)], [0] * (i % 9) + [1]) for i in range(400)] + [(400, [[j / 900] * 11 for j in range(900)], [1] + [0] * 899)]
    groups = spark.createDataFrame(rows, "example_id int, numeric_features array<array<double>>, labels array<int>").coalesce(1)
    model = rerank.ListwiseScorer.fresh(8, 3)
    sizes = np.array([len(r[1]) for r in rows])
    runs = list(listwise._blocks(sizes, listwise.BLOCK))
    assert [s.start for s in runs] + [len(sizes)] == [0] + [s.stop for s in runs]
    assert all(sizes[s].sum() <= listwise.BLOCK or s.stop - s.start == 1 for s in runs) and len(runs) < 30
    x, starts = np.concatenate([r[1] for r in rows]), np.cumsum(sizes) - sizes
    want = listwise.summed(listwise.State.of(model).params, x, starts, starts + np.array([r[2].index(1) for r in rows]))
    got = listwise.judged(groups, model)
    assert got["groups"] == 401 and got["loss"] == pytest.approx(want[1] / 401) and got["top1"] == pytest.approx(want[2] / 401)
