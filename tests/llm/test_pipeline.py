"""The pipeline's stages, each on what the last one kept."""

import random

import corpus_pipeline
from lexweave.llm.common import cut


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = [a + b for a in "bcdfghjk" for b in ("an", "eo", "il", "ou", "ast")]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(80)]
    item = " ".join(rng.choice(vocabulary) for _ in range(14))
    texts[5] = f"{texts[5]} {item}"
    texts[70] = texts[3] + " end"
    texts += ["short", None, "a b c d e " * 30]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for _, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, str(tmp_path)))
        assert out.columns[:5] == docs.columns
        seen.append({r["doc_id"]: r for r in out.collect()})
        docs = out
    assert set(seen[0]) == set(range(80))
    assert set(seen[1]) == set(range(80)) - {70}
    assert item not in seen[2][5]["text"] and seen[2][5]["n_chars"] == len(seen[2][5]["text"]) and seen[2][4]["text"] == texts[4]
    assert {r["shard"] for r in seen[4].values()} <= set(range(16)) and set(seen[4]) == set(seen[3])


def test_unlike_texts_of_one_id_all_stay(spark):
    rng = random.Random(4)
    made = lambda: " ".join(rng.choice("abcdefghij") * 2 + str(rng.randrange(50)) for _ in range(40))
    one, other, third = made(), made(), made()
    rows = [(1, one), (1, other), (1, one), (2, one + " end"), (3, third), (4, ""), (4, None), (5, ""), (None, one), (None, None), (0, other + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, one), (0, other + " end"), (3, third), (4, ""), (4, None), (5, ""), (None, one), (None, None)], key=str)
