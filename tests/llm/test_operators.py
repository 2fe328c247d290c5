"""Each operator against brute force on small texts, with nulls, empty texts, ties, repeated rows and empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexweave.llm import chat, decontamination, mixing, near_copies, pii, quality, secret_scan, sharding, substrings, toxicity


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def some_texts(seed=1, n=60, vocabulary=12, longest=60):
    rng = random.Random(seed)
    out = [None, "", "   \n", "one", "one"]
    for _ in range(n):
        out.append(" ".join(rng.choice("abcdefghijklmnop"[:vocabulary]) for _ in range(rng.randint(1, longest))))
    out += [out[-1], out[-2] + " z", "q " * 3000, out[-3].upper()]
    return out


# 1


def brute_hits(texts, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    out = []
    for t in texts:
        w, hit, found = word.findall(low(t)), set(), set()
        for item, it in items:
            v = word.findall(low(it))
            k = min(window, len(v))
            grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
            for i in range(len(w) - k + 1):
                if grams and tuple(w[i : i + k]) in grams:
                    hit |= set(range(i, i + k))
                    found |= {str(item)} if item is not None else set()
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_decontamination_is_brute_force(spark, docs):
    texts = some_texts(vocabulary=3) + ["x A-b,c a É b c 1 b a b a c b a tail", "É b c"]
    items = [(1, texts[12]), (2, "a b c a"), (11, "É B c"), (None, "a a a a b"), (3, None), (4, "..."), (2, "c c c b b b a a a b b c")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = rows(decontamination.find_contamination(docs(texts), table).orderBy("doc_id"))
    assert [(r["n_words"], r["n_hit"], r["hit_items"]) for r in got] == brute_hits(texts, items)
    assert got[0]["lang"] == "en"


def test_decontamination_in_blocks_and_cleaning(spark, docs, monkeypatch):
    texts = ["keep this. The quick brown Fox, jumps over! And stay", None, ""]
    table = spark.createDataFrame([(1, "quick brown fox jumps over"), (2, "nothing here at all")], "item_id bigint, text string")
    assert len(list(decontamination.automata(table, "item_id", "text", block_words=3))) == 2
    out = rows(decontamination.decontaminate(docs(texts), table, max_coverage=0.9).orderBy("doc_id"))
    assert [r["text"] for r in out] == ["keep this. The ! And stay", None, ""]
    assert not rows(decontamination.decontaminate(docs(texts[:1]), table, max_coverage=0.2))
    assert rows(decontamination.find_contamination(docs(texts), table.limit(0)))[0]["n_hit"] == 0
    assert not rows(decontamination.find_contamination(docs(texts).limit(0), table))


def test_decontamination_in_several_passes(spark, docs):
    texts = some_texts(vocabulary=3) + ["É b c"]
    items = [(i, t) for i, t in enumerate(some_texts(seed=8, n=12, vocabulary=3, longest=14)[5:17])] + [(11, "É B c")]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    assert len(list(decontamination._passes(decontamination.automata(table, "item_id", "text", block_words=10), 40))) > 2
    for more in ({}, {"block_words": 10, "pass_words": 40}, {"block_words": 10}):
        got = rows(decontamination.find_contamination(docs(texts), table, cleaned="clean", **more).orderBy("doc_id"))
        assert [(r["n_words"], r["n_hit"], r["hit_items"]) for r in got] == brute_hits(texts, items)
        words = [decontamination.normal_words((r["clean"] or "").encode()) for r in got]
        assert [len(w) for w in words] == [r["n_words"] - r["n_hit"] for r in got]


# 2


def test_pii_base_spans_are_the_patterns():
    rng = random.Random(3)
    parts = ["a.b@x.co", "@@x", "a@b", "1.2.3.4", "1.2.3.400", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234567", "+1", "++1 234567890", " ", "9", "é", "5" * 25, "x@y.z@w.q"]
    for _ in range(300):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 8)))
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert pii.base_spans(t) == sorted(want, key=lambda s: (s[1], pii.KINDS.index(s[0]))), t


def said_twice(n):
    return [f"mail u{i}@x.com or +49 30 {5550000 + i} today, or +49 30 {5550000 + i}; u{i}@x.com again, {i} times" for i in range(n)]


def test_pii_labels_recurring_numbers_alike(spark, docs):
    plain = ["nothing to see", None, "", "year 1999 and 2024", "9 9 9 " * 2000]
    said = "call +1 (743) 555-3824 now, she said; later 743-555-3824 again"
    out = rows(pii.find_pii(docs([*plain, said, *said_twice(40)])).orderBy("doc_id"))
    assert all(not r["pii"] for r in out[: len(plain)])
    spans = out[len(plain)]["pii"]
    assert [said[s["start"] : s["end"]] for s in spans if s["base"]] == ["+1 (743) 555-3824"]
    assert [(s["kind"], said[s["start"] : s["end"]]) for s in spans if not s["base"]] == [("phone", "743-555-3824")]
    assert not rows(pii.find_pii(docs(["a"]).limit(0)))


def test_pii_counts_cover_all_documents(spark):
    said = "mail a.b@x.co, 555-3824 or 555-3824 "
    table = spark.range(9_000).select(F.col("id").alias("doc_id"), F.lit(said).alias("text")).repartition(8)
    table = table.union(spark.createDataFrame([(None, said), (None, None)], "doc_id bigint, text string"))
    got = pii._counts(table, "text")
    number = pii._shape("555-3824", "5553824")
    assert got == Counter({(pii._shape("a.b@x.co", ""), 1, -1, -1, -1, -1): 9_001, (number, 0, -1, -1, -1, 0): 9_001, (number, 0, -1, -1, 0, -1): 9_001})


def test_pii_leaves_half_matched_likes_out():
    got = pii.combinations(t := "+1 743 555-3824 or 743-555-3824, or 17", pii.base_spans(t))
    assert got == Counter({("9-11+-", 4, -1, -1, -1, -1): 1, ("1-3", 0, -1, -1, -1, -1): 1})


def test_pii_nodes_are_parts_of_words_and_take_the_kind_that_covers_most():
    text = 'a@b.co,555-3824;"1.2.3.4"' + " 1" * 20
    nodes = pii.nodes_of(text, pii.base_spans(text))
    assert [text[a:b] for a, b in zip(nodes.starts, nodes.ends)] == ["a@b.co", "555-3824", "1.2.3.4"] + ["1"] * 20 and list(nodes.seen) == [1, 0, 2] + [0] * 20
    many = " ".join(f"x{i}@y.co" for i in range(30))
    assert set(pii.nodes_of(many, pii.base_spans(many)).seen) == {1}


def test_pii_beliefs_are_exact_on_a_tree():
    rng = np.random.default_rng(5)
    k = len(pii.LABELS)
    near, far = (m + m.T for m in rng.normal(0, 1, (2, k, k)))
    text = "a@b.co 77 555-3824 and 743-555-3824 12"
    nodes = pii.nodes_of(text, pii.base_spans(text))
    field = pii.Field(rng.normal(0, 1, k), {s: rng.normal(0, 1, k) for s in nodes.names}, near, far)
    n, names = len(nodes.starts), list(nodes.names)
    edges = [(i, i + 1, near) for i in nodes.near(text)] + [(i, j, far) for i, j in zip(nodes.far, nodes.far_next)]
    assert n == 5 and len(edges) == 4  # a tree
    want = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        if labels[0] != 1:
            continue
        weight = np.exp(sum((field.any_shape + field.shapes[names[nodes.shapes[i]]])[y] for i, y in enumerate(labels) if i) + sum(t[labels[i], labels[j]] for i, j, t in edges))
        for i, y in enumerate(labels):
            want[i, y] += weight
    rounds, pii.ROUNDS = pii.ROUNDS, 60
    try:
        got = field.beliefs(text, nodes)
    finally:
        pii.ROUNDS = rounds
    assert got == pytest.approx(want / want.sum(1, keepdims=True), abs=1e-3)


def test_pii_weights_are_those_of_the_greatest_likelihood():
    counts = Counter()
    for t in said_twice(60):
        counts.update(pii.combinations(t, pii.base_spans(t)))
    field = pii.Field.fitted(counts)
    assert field.far[4, 4] > 2 and field.far[1, 1] > 2 and field.far[4, 0] < 0 and (field.near == field.near.T).all()
    f = lambda x: (float(((x - 3) ** 2).sum() + (x[0] * x[1]) ** 2), 2 * (x - 3) + np.array([2 * x[0] * x[1] ** 2, 2 * x[1] * x[0] ** 2]))
    best = pii._minimised(f, np.zeros(2), 200)
    assert np.abs(f(best)[1]).max() < 1e-3


def test_pii_field_runs_without_base_spans():
    k = len(pii.LABELS)
    field = pii.Field(np.array([1.0, 0, 0, 0, 0.6]), {}, np.zeros((k, k)), 2 * np.eye(k) + 2 * np.diag([0, 0, 0, 0, 1]))
    text = "see 555-3824 then 555-3824 and 555-3824 or 555-3824"
    assert not pii.base_spans(text)
    assert [(k, text[a:b]) for k, a, b in pii.further_spans(text, [], field)] == [("phone", "555-3824")] * 4
    assert pii.further_spans("see 555-3824 once", [], field) == [] == pii.further_spans(None, [], field)


# 3


def test_secrets_are_the_patterns_and_checksums(spark, docs):
    rng = random.Random(5)
    parts = ["password", "Secret", "TOKEN", "api_key", "apikey", "passwd", "=", ": ", '"', "'", "abc123", "hunter2x", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "0123456789abcdef", " ", "é", "İ", "token: token: abcdef1"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(300)] + [None, ""]
    body = "Ab1" * 10
    good, bad = f"ghp_{body}{secret_scan.checksum62(body)}", f"ghp_{body}000000"
    out = rows(secret_scan.find_secrets(docs([*texts, f"x {good} y", f"x {bad} y"]), redacted="clean").orderBy("doc_id"))
    for t, r in zip(texts, out):
        t = t or ""
        want = [("assign", *m.span()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [(s["kind"], s["start"], s["end"]) for s in r["secrets"]] == sorted(want, key=lambda s: (s[1], secret_scan.KINDS.index(s[0]))), t
    assert [s["kind"] for s in out[-2]["secrets"]] == ["github"] and out[-2]["clean"] == "x [github] y"
    assert out[-1]["secrets"] == [] and out[-1]["clean"] == f"x {bad} y"


# 4


def test_chat_round_trip(spark):
    said = [("user", "a\\b</s><s>[INST] x <<SYS>>"), ("assistant", "é </s>\n<|im_end|> \\"), ("odd\nrole\\", ""), ("assistant", None), ("assistant", "tail")]
    table = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(said)] + [(None, 0, "user", "x"), (2, 0, None, "y"), (2, 0, None, "y")], "conv_id bigint, turn bigint, role string, text string")
    pieces = chat.rendered(chat.folded(chat.log_of_rows(table)))
    text = "".join(r["formatted"] for r in rows(pieces.where("conv_id = 1").orderBy("seq", "message_id")))
    assert list(chat.parsed(text)) == [(r, t or "") for r, t in said]
    got = {r["conv_id"]: r for r in rows(chat.read_back(pieces))}
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t or ''}\n" for r, t in said).encode()).hexdigest()
    answers = "".join(t or "" for r, t in said if r == "assistant")
    assert got[1]["loss_sha256"] == hashlib.sha256(answers.encode()).hexdigest() and got[1]["loss_chars"] == len(answers)
    assert got[2]["n_turns"] == 2 and got[None]["n_turns"] == 1 and got[1]["formatted_chars"] == len(text)
    assert not rows(chat.read_back(chat.rendered(chat.folded(chat.log_of_rows(table.limit(0))))))


def test_chat_orders_many_rows_of_one_turn(spark):
    said = [(1, 0, "user", f"t{i:02d}") for i in range(12)] + [(1, 3, "assistant", f"x{i % 7}") for i in range(300)]
    table = spark.createDataFrame(random.Random(3).sample(said, len(said)), "conv_id bigint, turn bigint, role string, text string")
    pieces = chat.rendered(chat.folded(chat.log_of_rows(table)))
    text = "".join(r["formatted"] for r in rows(pieces.orderBy("seq", "message_id")))
    want = [(r, t) for _, _, r, t in sorted(said)]
    assert list(chat.parsed(text)) == want
    got = rows(chat.read_back(pieces))[0]
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest() and got["formatted_chars"] == len(text)


def test_chat_log_has_deltas_edits_and_regenerations(spark):
    said = [(c, t, "assistant" if t % 2 else "user", f"é {c} \\ {t}" * (t % 4)) for c in range(20) for t in range(10)]
    log = chat.log_of_rows(spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string"))
    assert {r["event"]: r["n"] > 20 for r in rows(log.groupBy("event").agg(F.count("*").alias("n")))} == {"message": True, "delta": True, "edit": True, "regenerate": True}
    got = rows(chat.folded(log).orderBy("conv_id", "seq"))
    assert [(r["conv_id"], r["role"], r["text"]) for r in got] == [(c, r, t) for c, _, r, t in sorted(said)]


def test_chat_folds_events(spark):
    events = [
        (1, 1, "m1", "message", "user", "hi"), (1, 2, "m2", "message", "assistant", ""), (1, 3, "m2", "delta", None, "wro"), (1, 4, "m2", "delta", None, "ng"),
        (1, 5, "m2", "regenerate", None, None), (1, 6, "m2", "delta", None, "ri"), (1, 7, "m1", "edit", None, "hello"), (1, 8, "m2", "delta", None, "ght"),
    ]
    table = spark.createDataFrame(events, "conv_id bigint, seq bigint, message_id string, event string, role string, text string")
    assert [(r["role"], r["text"]) for r in rows(chat.folded(table).orderBy("seq"))] == [("user", "hello"), ("assistant", "right")]


# 5


def test_quality_counts_are_brute_force(spark, docs):
    texts = some_texts(vocabulary=4) + ["a b\na b\n\nc d e a b c d e a b", "# $ | word", "x " * 9, " ".join(map(str, range(50))), "  é"]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, len(texts), 3)] + [(None, 1), (999, 0)], "doc_id bigint, quality int")
    got = rows(quality.quality_verdicts(docs(texts), labels).orderBy("doc_id"))
    for t, r in zip(texts, got):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        many = Counter(grams)
        covered = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)), t
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["kept"] and r["base_failed"])


def test_quality_score_is_brute_force(spark, docs):
    texts = [t for t in some_texts(vocabulary=9) if t]
    good = set(range(0, len(texts), 2))
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(len(texts))], "doc_id bigint, quality int")
    good &= {r["doc_id"] for r in rows(labels.where(F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(2)) == 0))}
    got = rows(quality.quality_verdicts(docs(texts), labels).orderBy("doc_id"))

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    def grams(t):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in t.split()]
        pairs = []
        for a, b in zip(h, h[1:]):
            pairs.append(xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)))
        return [signed(x) % quality.BUCKETS for x in h + pairs]

    raw, trusted = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for i, t in enumerate(texts):
        np.add.at(raw, grams(t), 1)
        if i in good:
            np.add.at(trusted, grams(t), 1)
    llr = np.log(trusted / trusted.sum()) - np.log(raw / raw.sum())
    for t, r in zip(texts, got):
        assert r["llr_score"] == pytest.approx(llr[grams(t)].mean() if grams(t) else None, abs=1e-9) if grams(t) else r["llr_score"] is None


# 6 and 10


def test_near_copies_are_brute_force(spark, docs):
    rng = random.Random(2)
    texts = dict(enumerate(some_texts(3, n=30, vocabulary=16)))
    for base in range(4):
        w = [rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("xyz") for _ in range(rng.choice([6, 40, 120]))]
        for _ in range(40):
            v = list(w)
            for _ in range(rng.randint(0, 4)):
                v[rng.randrange(len(v))] = rng.choice("abc")
            texts[len(texts)] = " ".join(v)
    sets = {}
    for k, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    got = rows(near_copies.near_copy_components(docs(texts)).orderBy("doc_id"))
    assert [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got] == [(k, len(sets[k]), find(k)) for k in texts]
    assert not rows(near_copies.near_copy_components(docs(["a"]).limit(0)))


def brute_kept(texts, window=13):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in texts}
    least = {}
    for k, w in words.items():
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            least[g] = min(k, least.get(g, k))
    out = {}
    for k, w in words.items():
        gone = {j for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < k for j in range(i, i + window)}
        out[k] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def test_repeats_are_brute_force(spark, docs, monkeypatch):
    rng = random.Random(4)
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(rng.choice([12, 13, 14, 30]))] for _ in range(6)]
    texts = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(passages) if rng.random() < 0.6 else [rng.choice("ijkl") + str(rng.randrange(99)) for _ in range(rng.randint(1, 20))]
        texts.append((119 - i, " ".join(w)))
    texts += [(500, None), (501, ""), (502, "o " * 4000), (503, "o " * 30)]
    got = rows(substrings.repeats_removed(docs(dict(texts))))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == brute_kept(texts)
    none = spark.createDataFrame([(None, texts[0][1]), (None, texts[0][1])], "doc_id bigint, text string")
    assert all(r["n_removed"] == 0 for r in rows(substrings.repeats_removed(none))) and not rows(substrings.repeats_removed(none.limit(0)))


def test_repeats_are_found_between_repeated_rows(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    a, b = (1, f"{passage} first"), (2, f"{passage} second")
    for order in ([a, b, a], [b, a, b], [a, a, b, b, a]):
        table = spark.createDataFrame(order, "doc_id bigint, text string").coalesce(1)
        got = rows(substrings.repeats_removed(table))
        want = brute_kept([a, b])
        assert len(got) == len(order) and all((r["n_words"], r["n_removed"], r["kept"]) == want[r["doc_id"]] for r in got), order


# 7


def test_toxicity_learns_terms(spark, docs):
    rng = random.Random(6)
    texts, labels = [None, ""], []
    for i in range(2, 400):
        w = [rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(30)]
        if i % 4 == 0:
            w[rng.randrange(30)] = "moron."
        texts.append(" ".join(w))
        labels.append((i, int(i % 4 == 0)))
    marks = spark.createDataFrame(labels + [(None, 1), (7777, None)], "doc_id bigint, toxic int")
    model = toxicity.fitted(toxicity.sample(docs(texts), marks.where("doc_id % 5 <> 0"), "doc_id", "text", "toxic"))
    got = rows(toxicity.toxicity_scores(docs(texts), model).orderBy("doc_id"))
    assert all((r["score"] >= 0.5) == (i % 4 == 0) for i, r in enumerate(got) if i >= 2) and all(0 <= r["score"] <= 1 for r in got)
    a, b = model.linear.copy(), model.factors
    t = np.array([3, 5, 9])
    v = b[t] * toxicity.weight_of(3)
    pairs = sum(float(v[i] @ v[j]) for i in range(3) for j in range(i))
    assert model.logit(t) == pytest.approx(model.bias + toxicity.weight_of(3) * a[t].sum() + pairs, abs=1e-6)
    assert toxicity.fitted([]).score(t) == 0.0


def test_toxicity_learns_pairs_that_are_neutral_singly():
    def made(seed, n):
        rng, terms, out = random.Random(seed), toxicity.Terms(), []
        for i in range(n):
            # "group" and "mild" are each in half of the toxic and half of the clean texts: only their pair tells.
            some = [[], ["group"], ["mild"], ["group", "mild"]][i % 4]
            w = [rng.choice("abcdefghij") + rng.choice("abcdefghij") for _ in range(10)] + some
            out.append((terms.of(" ".join(w).encode()), int(len(some) != 1)))
        return out

    model = toxicity.fitted(made(6, 1200))
    right = [(model.score(t) >= 0.5) == bool(y) for t, y in made(9, 400)]
    group, mild = (model.factors[toxicity.Terms()[w]] for w in (b"group", b"mild"))
    assert np.mean(right) > 0.9 and group @ mild > 0.1


# 8


def test_shards_move_only_into_the_new_one(spark, docs):
    table = docs({**dict(enumerate(some_texts(n=500))), 900: "x"}).select("doc_id", "text")
    table = table.union(table.where("doc_id < 20")).union(spark.createDataFrame([(None, None)], "doc_id bigint, text string"))
    a = rows(sharding.shard_records(sharding.shard_records(table, ["doc_id"], [(s, 1.0) for s in range(4)]), ["doc_id"], [(s, 1.0) for s in range(5)], "grown"))
    assert all(r["grown"] in (r["shard"], 4) for r in a) and {r["grown"] for r in a} == set(range(5))
    keys = spark.range(40_000)
    heavy = Counter(r["shard"] for r in sharding.shard_records(keys, ["id"], [(0, 3.0), (1, 1.0)]).collect())
    assert 0.73 < heavy[0] / 40_000 < 0.77


def test_slots_are_gapless(spark):
    table = spark.createDataFrame([(i % 50, i % 3) for i in range(1000)] + [(7, 1)] * 3000, "k bigint, shard int")
    got = defaultdict(list)
    for r in sharding.number_slots(table, "shard", ["k"]).collect():
        got[r["shard"]].append(r["slot"])
    assert sum(map(len, got.values())) == 4000 and all(sorted(v) == list(range(len(v))) for v in got.values())


def test_query8(spark, tmp_path, docs):
    texts = some_texts()
    docs(texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(sharding.op8_rendezvous_sharding(spark, str(tmp_path)).orderBy("doc_id"))
    assert [(r["size"], r["text_crc32"]) for r in got] == [(len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts]


# 9


def made_rows(seed=12, n=600, softest=1.0):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        kind = 0 if i % 10 < 3 else 2 if i % 100 == 99 else 1
        x = [rng.expovariate(1) * (20 if k == kind else softest) for k in range(3)]
        made.append((float(rng.randint(1, 400)), [v / sum(x) for v in x]))
    return made


def test_mixing_meets_targets(spark, docs):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(("aa", "bb", "cc") if i % 3 else ("xx", "yy", "cc")) for _ in range(rng.randint(20, 80))) for i in range(300)] + [None, ""]
    labels = spark.createDataFrame([(i, "left" if i % 3 else "right") for i in range(0, 300, 2)], "doc_id bigint, domain string")
    told = {}
    out = rows(mixing.mixed(docs(texts), labels, {"left": 0.5, "right": 0.5}, report=told).orderBy("doc_id"))
    total = [sum(r["rate"] * r["tokens"] * r["posterior"][d] for r in out) for d in (0, 1)]
    assert total[0] == pytest.approx(total[1], rel=0.01) and all(r["rate"] >= 0 for r in out)
    assert all((r["posterior"][0] > 0.5) == bool(i % 3) for i, r in enumerate(out[:300]))
    assert sum(total) == pytest.approx(sum(r["tokens"] for r in out), rel=0.01) and out[300]["tokens"] == 0
    assert [told[d][0] for d in ("left", "right")] == pytest.approx(total, rel=1e-6) and told["left"][1] == told["right"][1]
    assert not rows(mixing.mixed(docs(texts).limit(0), labels, {"left": 0.5, "right": 0.5}))


@pytest.mark.parametrize(
    ("aims", "softest", "most"),
    [((0.92, 0.04, 0.04), 1.0, None), ((0.2, 0.4, 0.4), 1.0, None), ((1 / 3, 1 / 3, 1 / 3), 12.0, None), ((0.02, 0.03, 0.95), 12.0, None), ((0.2, 0.4, 0.4), 1.0, 4.0), ((0.92, 0.04, 0.04), 12.0, 1.5)],
)
def test_mixing_is_the_least_squares_optimum(spark, aims, softest, most):
    """Where the targets can be met they are; where they can't, the rates fulfil the conditions of the optimum."""
    made = made_rows(softest=softest)
    w, p = np.array([t for t, _ in made]), np.array([x for _, x in made])
    table = spark.createDataFrame(made, "tokens double, posterior array<double>").coalesce(1)
    found = mixing.fit_rates(table, aims, most=most)
    out = rows(table.withColumn("rate", found.column()))
    rate, n = np.array([r["rate"] for r in out]), w.sum()
    share = (rate * w) @ p / n
    assert (share * n).tolist() == pytest.approx(found.totals, rel=1e-6) and rate.min() >= 0
    gradient = p @ (share - np.array(aims)) + mixing.RIDGE * (rate - 1)
    assert rate.max() <= (most or np.inf) and gradient[rate < (most or np.inf)].min() > -1e-7 and gradient[rate > 0].max() < 1e-7
    # Brute force: plain projected gradient with momentum, many steps from 1.
    objective = lambda r: 0.5 * (((r * w) @ p / n - aims) ** 2).sum() + 0.5 * mixing.RIDGE * (w * (r - 1) ** 2).sum() / n
    r, v = np.ones(len(w)), np.ones(len(w))
    step = 1 / (np.linalg.eigvalsh((p * w[:, None]).T @ p / n).max() + mixing.RIDGE)
    for i in range(4_000):
        to = np.clip(v - step * (p @ ((v * w) @ p / n - aims) + mixing.RIDGE * (v - 1)), 0, most)
        v, r = to + i / (i + 3) * (to - r), to
    assert objective(rate) <= objective(r) + 1e-9
    if most is None and aims[2] < 0.9:
        assert found.gap() < mixing.CLOSE


def test_mixing_keeps_a_domain_whole(spark):
    """Of domains that all but lack, no rates are taken beyond the bound, and the whole domain's tokens stay."""
    rng = random.Random(5)
    made = [(float(rng.randint(50, 400)), [0.98, 0.015, 0.005]) for _ in range(500)] + [(20.0, [0.5, 0.4, 0.1]) for _ in range(10)]
    table = spark.createDataFrame(made, "tokens double, posterior array<double>").coalesce(1)
    found = mixing.fit_rates(table, (0.9, 0.08, 0.02), most=4.0, whole=0)
    rate = np.array([r["rate"] for r in rows(table.select(found.column().alias("rate")))])
    assert rate.max() <= 4 and np.abs(rate[:500] - 1).max() < 0.1 and found.gap() > mixing.CLOSE
    assert found.aims[0] == pytest.approx(sum(t * p[0] for t, p in made))


def test_mixing_chooses_evidence_by_held_out_labels(spark):
    rng = random.Random(4)
    texts = []
    for i in range(600):
        # Words that come in runs look like more evidence than they are.
        texts.append((i, " ".join(rng.choice(("aa", "bb") if (i % 2) ^ (rng.random() < 0.25) else ("xx", "yy")) + " " for _ in range(1)) * 60))
    labels = spark.createDataFrame([(i, "left" if i % 2 else "right") for i in range(600)], "doc_id bigint, domain string")
    rows_ = spark.createDataFrame(texts, "k bigint, t string")
    got = rows(mixing.posteriors(rows_, labels, ["left", "right"]))
    sure = [max(r["posterior"]) for r in got]
    assert 0.65 < np.mean(sure) < 0.85  # a quarter is of the other kind, however long the texts


def test_mixing_warns_of_unmet_targets(spark, docs):
    texts = ["aa bb cc " * 5] * 20 + [None]
    labels = spark.createDataFrame([(i, "left") for i in range(20)], "doc_id bigint, domain string")
    with pytest.warns(UserWarning, match="right: .* of 150"):
        out = rows(mixing.mixed(docs(texts), labels, {"left": 0.5, "right": 0.5}).orderBy("doc_id"))
    assert all(r["rate"] == pytest.approx(0.5, abs=0.01) for r in out[:20]) and out[20]["rate"] == 1.0


def test_more_buckets_than_partitions(spark, docs, monkeypatch):
    rng = random.Random(6)
    passages = [" ".join(f"{rng.choice('abcd')}{rng.randrange(9)}" for _ in range(40)) for _ in range(8)]
    texts = {i: " ".join(rng.choice(passages) if rng.random() < 0.5 else f"z{rng.randrange(999)} " * 9 for _ in range(rng.randint(1, 5))) for i in range(80)}
    monkeypatch.setattr(substrings, "buckets_for", lambda _: 37)
    monkeypatch.setattr(near_copies, "buckets_for", lambda _: 37)
    got = rows(substrings.repeats_removed(docs(texts)))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == brute_kept(list(texts.items()))
    many = {r["doc_id"]: r["component_id"] for r in rows(near_copies.near_copy_components(docs(texts)))}
    monkeypatch.setattr(near_copies, "buckets_for", lambda _: 8)
    assert many == {r["doc_id"]: r["component_id"] for r in rows(near_copies.near_copy_components(docs(texts)))}
