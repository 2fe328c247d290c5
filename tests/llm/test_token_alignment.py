"""Operator 12 against brute force."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
import tokenizers

from lexweave.llm import token_alignment
from lexweave.llm.token_alignment import FOLDER, A, B, Aligner, aligned, op12_union_find_alignment, pair_scores, union_find
from lexweave.llm.tokenizers_read import contents, tokenizer

PARTS = [" ", "  ", "a", "the ", "é", "\U0001f600", "\n", "\t", " x", "’", "<s>", "<|endoftext|>", "<0x0A>", "中文", "1234", "ﬁ", "!!", " 　", "\xa0", "can't", "\x00", "́", "Ünï"]


@pytest.fixture(scope="module")
def files():
    return contents(FOLDER, A), contents(FOLDER, B)


@pytest.fixture(scope="module")
def plain(files):
    """Groups and links of a text, by the libraries' own engines and intervals held against one another."""
    a_own, b_own = tokenizers.Tokenizer.from_str(files[0].decode()), sentencepiece.SentencePieceProcessor(model_proto=files[1])
    a_own.encode_special_tokens = True
    a_pieces = tokenizer(A, files[0]).pieces

    def b_bytes(i):
        return bytes([int(b_own.id_to_piece(i)[3:5], 16)]) if b_own.is_byte(i) else b_own.id_to_piece(i).replace("▁", " ").encode()

    def spans(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    def of(text):
        if not text:
            return [], [], [], []
        a, b = a_own.encode(" " + text, add_special_tokens=False).ids, b_own.encode(text)
        a_parts, b_parts = [a_pieces[i] for i in a], [b_bytes(i) for i in b]
        if not (b"".join(a_parts) == b"".join(b_parts) == (" " + text).encode()):
            return [], [], [], []
        a_spans, b_spans = spans(a_parts), spans(b_parts)
        groups, done = [], 0
        for end in sorted({e for _, e in a_spans} & {e for _, e in b_spans}):
            groups.append(tuple([i for i, (s, e) in zip(x, y) if done <= s and e <= end] for x, y in ((a, a_spans), (b, b_spans))))
            done = end
        links = [(i, j) for i, (s, e) in zip(a, a_spans) for j, (u, v) in zip(b, b_spans) if s < v and u < e]
        return a, b, groups, links

    return of


def texts():
    rng = random.Random(3)
    made = ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(150)]
    return [*made, *made[:4], None, "", " ", "  ", "   ", "\n", "x▁y", " " * 300, "a" * 500, "word " * 60]


def digest(groups):
    return hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else ""


@pytest.mark.parametrize("head", [1 << 19, 40, 0])
def test_scores_are_brute_force(spark, plain, head):
    own = texts()
    docs = spark.createDataFrame([(i if i else None, t, "r", 1, "c") for i, t in enumerate(own)], "doc_id bigint, text string, row string, n_a int, `a.b` string").repartition(3)
    got = sorted(map(tuple, pair_scores(docs, head=head).collect()), key=lambda r: (r[0] or 0, r))
    found = [plain(t) for t in own]
    count = Counter(p for f in found for p in f[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    want = [(i if i else None, len(a), len(b), len(g), len(links), digest(g), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links)) for i, (a, b, g, links) in enumerate(found)]
    assert got == want


def test_aligned_gives_tokens_and_groups(spark, plain):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts())], "doc_id bigint, text string, a_ids string, t string")
    out = aligned(docs)
    assert out.columns == ["doc_id", "text", "t", "a_ids", "b_ids", "a_groups", "b_groups"]
    for r in out.collect():
        a, b, groups, _ = plain(r["text"])
        assert (r["a_ids"], r["b_ids"]) == (a, b)
        assert r["a_groups"] == [n for n, g in enumerate(groups) for _ in g[0]] and r["b_groups"] == [n for n, g in enumerate(groups) for _ in g[1]]


def test_tokenizers_of_one_kind(files):
    """A against itself: each token is a group."""
    own = Aligner(tokenizer(A, files[0]), tokenizer(A, files[0]))
    x = own.align(["one two three", None, "four"])
    assert x.a_group.tolist() == x.b_group.tolist() == list(range(len(x.a)))


def test_engines_agree(files):
    """The fast engine and the words' memory give what the files' own engines give on whole texts, for all kinds of characters."""
    a, b = tokenizer(A, files[0]), tokenizer(B, files[1])
    a_own, b_own = tokenizers.Tokenizer.from_str(files[0].decode()), sentencepiece.SentencePieceProcessor(model_proto=files[1])
    a_own.encode_special_tokens = True
    assert a._ranked is not None and b._by_word
    rng = random.Random(8)
    some = [c for c in (chr(rng.randrange(1, 0x30000)) for _ in range(4000)) if not 0xD800 <= ord(c) < 0xE000]
    own = ["".join(rng.choices([*some, " ", " ", "a", "1"], k=20)) for _ in range(1500)] + [" \n" * 3000 + "x", "　" * 5000]
    raw = [t.encode() for t in own]
    for tokens, engine in ((a, lambda t: a_own.encode(" " + t, add_special_tokens=False).ids), (b, b_own.encode)):
        ids, sizes, _ = tokens.encode(own, raw)
        assert ids.tolist() == [i for t in own for i in engine(t)] and sizes.tolist() == [len(engine(t)) for t in own]


def test_union_find_is_components():
    rng = random.Random(2)
    for _ in range(50):
        n = rng.randint(1, 60)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, n))]
        root = list(range(n))
        for _ in range(n):
            for u, v in edges:
                root[u] = root[v] = min(root[u], root[v])
        import numpy as np

        u, v = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
        assert union_find(n, u, v).tolist() == root


def test_query12(spark, tmp_path):
    long = "many words of one very long text, über 12 " * 20_000
    for i, rows in enumerate(([], [(1, None), (2, "")], [(1, long), (2, "x" * 100_000), (1, "short")])):
        spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/{i}/documents.parquet")
        out = op12_union_find_alignment(spark, f"{tmp_path}/{i}")
        assert dict(out.dtypes) == {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "groups_sha256": "string", "n_best": "bigint", "count_sum": "bigint"}
        got = {r["n_a"]: r for r in out.collect()}
        assert len(got) == [0, 1, 3][i]
    assert max(got) > 180_000 and all(r["n_links"] >= max(r["n_a"], r["n_b"]) for r in got.values())
    with pytest.raises(ValueError, match="byte-level"):
        token_alignment.Aligner(tokenizer("word_bpe_49k.json", contents(FOLDER, "word_bpe_49k.json")), tokenizer(B, contents(FOLDER, B)))
