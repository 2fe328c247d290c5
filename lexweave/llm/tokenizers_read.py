"""Two kinds of public tokenizers, read from their files: byte-level BPE (JSON) and sentence pieces with byte fallback.

Both give, for a list of texts, the ids of blank + text as one array, the number of ids of each text, and whether the
bytes of these make up blank + text again.  Special tokens' strings inside a text are plain text.  The files' contents, a few MB, travel to the tasks; paths are read by the driver.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import sentencepiece
import tiktoken
import tokenizers

#: Runs of white space from this length on go to the slower of the two engines, as the other one's recursion is bounded.
_LONG = re.compile(r"\s{2000,}")
#: Words of which a tokenizer remembers the ids.
_REMEMBERED = 300_000


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The lists' numbers, and how many each has."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _byte_of_letter() -> dict[str, int]:
    """Byte-level BPE writes printable bytes as their own letters and the others, in order, as those from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """Byte-level BPE of a ``tokenizers`` JSON file.

    Where each merge makes a new token, with ids in the order of the merges, the merges are ranks, and tiktoken's engine
    gives the same ids as the file's own in a fifth of the time; other files, and texts with very long runs of white
    space, go to the file's own engine.
    """

    def __init__(self, content: bytes):
        said = json.loads(content)
        model, before = said["model"], said["pre_tokenizer"] or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
            raise ValueError("only byte-level BPE without a prefix blank is read here")
        letters = _byte_of_letter()
        special = {x["content"] for x in said["added_tokens"]}
        self.pieces = [b""] * (max([*model["vocab"].values(), *[x["id"] for x in said["added_tokens"]]]) + 1)
        for token, i in model["vocab"].items():
            if token not in special:
                self.pieces[i] = bytes(letters[c] for c in token)
        self._lengths = np.array([len(p) for p in self.pieces])
        self._own = tokenizers.Tokenizer.from_str(content.decode())
        self._own.encode_special_tokens = True
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        made = [model["vocab"][m] for m in merges]
        as_ranks = made == sorted(set(made)) and before.get("use_regex", True) and said["normalizer"] is None and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        self._ranked = None
        if as_ranks:
            # Fixed value: how byte-level BPE parts a text into words.
            words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self._ranked = tiktoken.Encoding("ranks", pat_str=words, mergeable_ranks={p: i for i, p in enumerate(self.pieces) if p}, special_tokens={})

    def encode(self, texts: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = []
        for t in texts:
            if self._ranked is None or _LONG.search(t):
                found.append(self._own.encode(" " + t, add_special_tokens=False).ids)
            else:
                found.append(self._ranked.encode_ordinary(" " + t))
        ids, sizes = _flat(found)
        if self._ranked is None:
            right = [b"".join(map(self.pieces.__getitem__, f)) == b" " + r for f, r in zip(found, raw)]
        else:
            # Without a normaliser, byte-level BPE parts a text's bytes and changes none.
            ends = np.concatenate(([0], np.cumsum(self._lengths[ids])))[np.concatenate(([0], np.cumsum(sizes)))]
            right = np.diff(ends) == np.array([len(r) + 1 for r in raw], np.int64)
        return ids, sizes, np.array(right, bool)


class _Words(dict):
    """Ids of a word with the blanks before it, the first of which the model adds itself; ``changed`` counts the words whose
    ids' bytes are others, which aren't remembered."""

    def __init__(self, of: sentencepiece.SentencePieceProcessor, pieces: list[bytes]):
        super().__init__()
        self._own, self._pieces, self._blank, self.changed = of, pieces, of.piece_to_id("▁"), 0

    def __missing__(self, word: str) -> list[int]:
        found = self._own.encode(word[1:]) if len(word) > 1 else [self._blank]
        if b"".join(map(self._pieces.__getitem__, found)) != word.encode("utf-8", "surrogatepass"):
            self.changed += 1
        elif len(self) < _REMEMBERED and len(word) < 100:
            self[word] = found
        return found


class Pieces:
    """A ``sentencepiece`` model with byte fallback, which puts a blank before each text by itself.

    Where no piece has a blank after another character, no merge crosses from a word to the blanks before the next one,
    so a text's ids are those of its words, with the blanks before them; ids of words are remembered.
    """

    def __init__(self, content: bytes):
        self._own = sentencepiece.SentencePieceProcessor(model_proto=content)
        n = self._own.get_piece_size()
        names = [self._own.id_to_piece(i) for i in range(n)]
        self.pieces = [bytes([int(x[3:5], 16)]) if self._own.is_byte(i) else b"" if self._own.is_control(i) or self._own.is_unknown(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self._by_word = not any(re.search("[^▁]▁", x) for x in names) and self._own.encode("a b") == self._own.encode("a") + self._own.encode("b")
        self._words = _Words(self._own, self.pieces)

    def encode(self, texts: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, words, right = [], [], []
        for t, r in zip(texts, raw):
            if self._by_word:
                changed, parts = self._words.changed, re.findall(" +[^ ]*", " " + t)
                found.extend(map(self._words.__getitem__, parts))
                words.append(len(parts))
                right.append(changed == self._words.changed)
            else:
                found.append(self._own.encode(t))
                words.append(1)
                right.append(b"".join(map(self.pieces.__getitem__, found[-1])) == b" " + r)
        ids, sizes = _flat(found)
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(np.array(words, np.int64))))]
        return ids, np.diff(ends), np.array(right, bool)


def contents(folder: str, name: str) -> bytes:
    with open(os.path.join(folder, name), "rb") as f:
        return f.read()


def tokenizer(name: str, content: bytes) -> ByteBpe | Pieces:
    """The tokenizer of a file's contents: ``.json`` is byte-level BPE, ``.model`` sentence pieces."""
    return ByteBpe(content) if name.endswith(".json") else Pieces(content)
