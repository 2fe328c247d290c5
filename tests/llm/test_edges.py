"""Edge cases of every operator and stage: clashing columns, repeated rows, nulls, empty tables and very long texts."""

import hashlib
import random
import time
import zlib
from pathlib import Path

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lexweave.llm import chat, common, decontamination, mixing, near_copies, pii, quality, registry, secret_scan, sharding, substrings, toxicity

#: Columns named like those that operators make or use on their way.
CLASHING = (
    "k", "t", "rest", "row", "n", "s", "b", "i", "at", "run", "start", "nth", "token", "key", "doc", "kept", "base_failed", "llr_score", "n_words", "n_hit", "hit_items", "hit_spans", "clean", "_cleaned",
    "_words", "_hashes", "_pairs", "_weights", "_buckets", "_sums", "_draw", "_log", "_n", "_bucket", "_nth", "_copy", "tokens", "posterior", "rate", "copies", "trusted", "shard", "slot", "pii", "secrets", "score", "a.b", "N_HIT",
)
TEXTS = ["a quick note to all of you here now and then", None, "", " \n\t ", "x", "mail a.b@x.co or call +1 743 555 3824 today", "password = hunter2hunter", "a quick note to all of you here now and then"]


def table(spark, clash=True):
    """Rows with nulls in any column, repeated rows, and columns that clash."""
    names = [c for c in CLASHING if c.lower() not in ("n_hit",) or c == "n_hit"] if clash else []
    data = [(i, t, "en" if i % 2 else None, None if i == 3 else "s", None if i == 4 else i, *[f"{c}{i}" if i % 3 else None for c in names]) for i, t in enumerate(TEXTS)]
    data += [data[0], data[5], (None, TEXTS[0], None, None, None, *[None for _ in names]), (None, None, None, None, None, *[None for _ in names])]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint" + "".join(f", `{c}` string" for c in names)
    return spark.createDataFrame(data, schema)


LABELS = "doc_id bigint, quality int, toxic int"


def operators(spark):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(8)] + [(None, 1, None), (0, None, 1), (0, 1, 1)], LABELS)
    items = spark.createDataFrame([(1, "quick note to all of you here now and then"), (None, "x"), (2, None)], "item_id bigint, text string")
    return {
        "decontamination": lambda d: decontamination.find_contamination(d, items, cleaned="clean"),
        "decontaminate": lambda d: decontamination.decontaminate(d, items),
        "pii": lambda d: pii.find_pii(d, redacted="clean"),
        "secrets": lambda d: secret_scan.find_secrets(d, redacted="clean"),
        "quality": lambda d: quality.quality_verdicts(d, labels),
        "near copies": near_copies.near_copy_components,
        "toxicity": lambda d: toxicity.toxicity_scores(d, toxicity.fitted(toxicity.sample(d, labels, "doc_id", "text", "toxic"))),
        "sharding": lambda d: sharding.number_slots(sharding.shard_records(d, ["doc_id"], [(0, 1.0), (1, 2.0)]), "shard", ["doc_id", "text"]),
        "mixing": lambda d: mixing.mixed(d, mixing.domain_of_labels(labels), {"good": 0.5, "toxic": 0.5}),
        "substrings": substrings.repeats_removed,
    }


@pytest.mark.parametrize("name", ["decontamination", "decontaminate", "pii", "secrets", "quality", "near copies", "toxicity", "sharding", "mixing", "substrings"])
@pytest.mark.filterwarnings("ignore:the mix misses")
def test_operator(spark, name):
    f = operators(spark)[name]
    docs = table(spark)
    out = f(docs)
    got = out.collect()
    assert len(got) == docs.count() or name == "decontaminate"
    if name not in ("near copies", "substrings"):
        # The caller's columns come back as they were, but for those named like new ones.
        plain = f(table(spark, clash=False))
        new = {c.lower() for c in plain.columns} - {"doc_id", "text", "lang", "source", "n_chars"}
        held = [c for c in docs.columns if c.lower() not in new and c != "text"]
        want = docs if name != "decontaminate" else docs.where("coalesce(text, '') NOT LIKE '%quick%' AND coalesce(text, '') <> 'x'")
        quoted = [f"`{c}`" for c in held]
        assert sorted(map(str, out.select(*quoted).collect())) == sorted(map(str, want.select(*quoted).collect()))
        names = sorted(new)
        if name != "mixing":
            assert sorted(map(str, out.select(*names).collect())) == sorted(map(str, plain.select(*names).collect()))
    assert f(docs.limit(0)).collect() == []


@pytest.mark.filterwarnings("ignore:the mix misses")
def test_stages_keep_clashing_columns(spark, tmp_path):
    rng = random.Random(1)
    words = [a + b for a in "bcdfghjk" for b in ("an", "eo", "il", "ou", "ast")]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(30)]
    names = [c for c in CLASHING if c not in ("N_HIT", "shard")]
    data = [(i, t, "en", "s", len(t), *[f"{c}{i}" for c in names]) for i, t in enumerate(texts)]
    data += [data[7], (None, texts[9] + " tail of another kind", None, None, len(texts[9]) + 21, *[None] * len(names)), (40, None, None, None, None, *[None] * len(names)), (41, "", "en", "s", 0, *[None] * len(names))]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint" + "".join(f", `{c}` string" for c in names))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "nothing of that kind")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(30)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    kept = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = common.cut(stage(spark, now, str(tmp_path)))
        assert now.columns == docs.columns + ["shard"] * (name == "sharding")
        kept[name] = now.select(*[f"`{c}`" for c in docs.columns]).collect()
    every = {str(r) for r in docs.collect()}
    assert all({str(r) for r in rows} <= every for rows in kept.values())
    assert sorted(str(r["doc_id"]) for r in kept["quality rules"]) == sorted([str(i) for i in range(30)] + ["7", "None"])
    assert sorted(str(r["doc_id"]) for r in kept["n-gram Jaccard join"]) == sorted([str(i) for i in range(30)] + ["None"])
    assert len(kept["sharding"]) == len(kept["mixing to target weights"])
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = common.cut(stage(spark, empty, str(tmp_path)))
        assert empty.count() == 0


def test_chat_with_nulls_repeated_rows_and_clashes(spark):
    rows = [(1, 0, "user", "x", "m"), (1, 0, "user", "x", "m"), (None, None, None, None, None), (None, 2, "assistant", "y", None), (2, None, "assistant", None, "z")]
    log = chat.log_of_rows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, message_id string"))
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.read_back(chat.rendered(chat.folded(log))).collect()}
    assert got == {1: (2, 0), None: (2, 1), 2: (1, 0)}


LONG = 5_000_000


@pytest.mark.parametrize("kind", ["words", "numbers", "hashes", "one word"])
def test_very_long_texts(spark, kind):
    rng = random.Random(2)
    if kind == "words":
        text = " ".join(f"w{rng.randrange(9_999)}" for _ in range(LONG // 6))
    elif kind == "numbers":
        text = "é " + " ".join(str(rng.randrange(10**7)) for _ in range(LONG // 8))
    elif kind == "hashes":
        text = "é " + " ".join(f"{rng.getrandbits(128):032x}" for _ in range(LONG // 33))
    else:
        text = "é" + "7" * LONG
    began = time.monotonic()
    assert len(secret_scan.secrets_in(text, secret_scan._automaton())) == (LONG // 33 if kind == "hashes" else 0) + (0 if kind != "one word" else 1)
    base = pii.base_spans(text)
    counts = pii.combinations(text, base)
    spans = pii.further_spans(text, base, pii.Field.fitted(counts))
    assert kind != "words" or not spans
    assert time.monotonic() - began < 60
    docs = spark.createDataFrame([(1, text), (2, text), (3, "short")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, text[-3000:] if kind != "one word" else "none")], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in near_copies.near_copy_components(docs).collect()}
    assert got[2]["component_id"] == 1 and got[3]["component_id"] == 3
    left = {r["doc_id"]: r for r in substrings.repeats_removed(docs, texts=False).collect()}
    assert left[1]["n_removed"] == 0 and (left[2]["n_removed"] == left[2]["n_words"]) == (kind != "one word")
    hit = {r["doc_id"]: r["n_hit"] for r in decontamination.find_contamination(docs, items).collect()}
    assert (hit[1] > 0) == (kind != "one word") and hit[3] == 0
    assert quality.quality_verdicts(docs, spark.createDataFrame([], LABELS), keep_text=False).count() == 3


def test_queries_return_their_contract(spark, tmp_path):
    """The registered queries on a small corpus: columns, types and one row a document."""
    wanted = {
        "op1": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
        "op2": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
        "op3": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
        "op4": "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
        "op5": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
        "op6": "doc_id bigint, n_shingles bigint, component_id bigint",
        "op7": "doc_id bigint, held_out boolean, score double, predicted int",
        "op8": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
        "op9": "doc_id bigint",
        "op10": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    }
    docs = table(spark, clash=False).where("doc_id IS NOT NULL").distinct()
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "x"), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "assistant", None)], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = {}
    for name, query in registry.queries().items():
        op = name.split("_")[0]
        if op in wanted:
            out = query(spark, str(tmp_path))
            types = dict(out.dtypes)
            for column in wanted[op].split(", "):
                c, kind = column.split()
                assert types[c] == kind, (name, c, types[c])
            found[op] = out.collect()
            assert len(found[op]) == (2 if op == "op4" else docs.count()), name
    assert set(found) == set(wanted)
    held = {r["doc_id"]: r["held_out"] for r in found["op7"]}
    import hashlib
    import zlib

    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in held}
    assert all(r["grown_shard"] in (r["shard"], 16) and r["law"] == "key" for r in found["op8"])
    slots = {}
    for r in found["op8"]:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    five = {r["doc_id"]: r for r in found["op2"]}
    said = "email:5:13,phone:22:37"
    assert five[5]["spans"] == said and five[5]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and five[5]["n_pii"] == 2
    assert {r["doc_id"]: r["spans"] for r in found["op3"]}[6] == "assign:0:24"
    assert {r["doc_id"]: r["contaminated"] for r in found["op1"]} == {i: i in (4, 5) for i in range(8)}


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda name, default=None: default)})

    with pytest.raises(ValueError, match="checkpoint.dir"):
        common.shared_dir(Session())


def test_scratch_deletes_what_it_wrote(spark):
    import os

    with common.scratch(spark) as kept:
        first = common.cut(spark.range(10))
        out = kept(first.where("id > 5"))
        paths = list(common._written)[-2:]
    assert out.count() == 4 and not os.path.exists(paths[0]) and os.path.exists(paths[1])


def test_ids_of_near_copies_are_integers(spark):
    with pytest.raises(TypeError, match="integers"):
        near_copies.near_copy_components(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_dearer_candidates_ask_for_more_matches():
    import numpy as np

    even = np.full(70, 3)
    assert near_copies.best_level(even, 40, 200) == near_copies.LEVELS
    assert near_copies.best_level(np.array([2] * 40 + [9_999] * 30), 40, 200) == 1
    assert near_copies.best_level(np.array([2, 2]), 2, 3) == 1 and near_copies.best_level(np.array([5]), 1, 1) == 1


def test_levels_leave_fewer_pairs_to_compare(spark, monkeypatch):
    rng = random.Random(7)
    common_ = [f"c{i}" for i in range(30)]
    texts = []
    for i in range(150):
        # Half of each text is a run of one long passage: many share a few shingles, few link.
        at = rng.randrange(20)
        w = common_[at : at + 9] + [f"x{rng.randrange(10**6)}" for _ in range(10)]
        texts.append((i, " ".join(w)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    pairs = {}
    for most in (1, 4):
        monkeypatch.setattr(near_copies, "LEVELS", most)
        frequent = near_copies._frequent(near_copies._described(docs, 8))
        sets = near_copies._sets(docs, frequent, 8)
        none = spark.createDataFrame([], "node bigint, root bigint")
        pairs[most] = near_copies._other_pairs(near_copies._prefixes(sets), none).count()
    assert pairs[4] < pairs[1] or pairs[1] == 0


SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(SMALL).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SMALL)
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    key = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert key(got.select(*columns).collect()) == key(want.select(*[f'"{c}"' for c in columns]).fetchall())
