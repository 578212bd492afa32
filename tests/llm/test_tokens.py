"""Token counts against greedy matching; encoding against the tokenizers library and back."""

from __future__ import annotations

import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldlens.llm import bpe, piececount

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a", "b", "aa", "'s", "'", "<|startoftext|>", "<|endoftext|>", " ", "\n", "é", "é", "Σ", "ΑΣ ", "1", "23", "!?", "漢字", "👍🏽",
       "\x1c", " ", "\x85", "İ", "ǅ", "՘", "Ᲊ", "the", "ing", "h" * 30, "\0", "ñ", "ñ", "'LL", "lol", "　", "<|"]
DOCS = "doc_id long, text string, ids string, n_tokens string"


def texts():
    draw = random.Random(5)
    return [None, "", " \n\t", "word", "word", "a" * 5000, "the cat " * 4000] + ["".join(draw.choice(ODD) for _ in range(draw.randrange(25))) for _ in range(400)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "extra", "extra") for i, t in enumerate(texts())] + [(None, "no id", None, None), (3, "word", None, None)]
    return spark.createDataFrame(rows, DOCS)


def greedy(pieces: set[str], word: str, close: str) -> int:
    """Longest match by trying every length."""
    n = at = 0
    while at < len(word):
        for stop in range(len(word), at, -1):
            if (word[at:stop] + close if stop == len(word) else word[at:stop]) in pieces:
                break
        else:
            return -1
        n, at = n + 1, stop
    return n


def test_counts_equal_greedy_matching():
    code = piececount.counter(open(PATH, encoding="utf-8").read())
    pieces = set(bpe.encoder(open(PATH, encoding="utf-8").read()).automaton.vocab)
    for text in filter(None, texts()):
        for chunk in code.split.chunks(text):
            if chunk not in code.split.special:
                assert [code.match.count(w) for w in code.split.words(chunk)] == [greedy(pieces, w, "</w>") for w in code.split.words(chunk)]


def test_counts_with_going_on_prefix():
    pieces = ["a", "abcdx", "##b", "##c", "##cdy", "##dz", "##e"]
    match = piececount.LongestMatch(pieces, "##")
    draw = random.Random(2)

    def slow(word):
        n = at = 0
        while at < len(word):
            for stop in range(len(word), at, -1):
                if ("##" if at else "") + word[at:stop] in pieces:
                    break
            else:
                return -1
            n, at = n + 1, stop
        return n
    for _ in range(3000):
        word = "".join(draw.choice("abcdxyze") for _ in range(draw.randrange(9)))
        assert match.count(word) == slow(word), word
    assert match.count("abcdz") == 4


def test_token_counts_frame(docs):
    rows = piececount.token_counts(docs, PATH).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None and r.doc_id < 3}
    assert all((r.n_words, r.n_tokens, r.n_unknown) == (0, 0, 0) for r in by.values())
    assert [r.n_tokens for r in rows if r.doc_id == 6] == [8000]
    assert piececount.token_counts(docs.limit(0), PATH).collect() == []


def test_digests_equal_library(docs):
    library = Tokenizer.from_file(PATH)
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(docs, PATH).collect()), key=repr) == sorted(want, key=repr)
    assert bpe.digests(docs.limit(0), PATH).collect() == []


def test_encode_then_decode(docs):
    library = Tokenizer.from_file(PATH)
    coded = bpe.encode(docs, PATH)
    assert coded.columns == ["doc_id", "ids", "n_tokens"]
    texts_of = {(r.doc_id): r.text for r in docs.collect()}
    for r in bpe.decode(coded, PATH).collect():
        ids = library.encode(texts_of[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_automaton_accepts_what_merging_gives():
    """Small merge lists, with repeats and dead merges, against merging pair by pair."""
    draw = random.Random(8)
    for _ in range(60):
        vocab = {c: i for i, c in enumerate("abc")}
        merges = []
        for _ in range(12):
            a, b = draw.choice(list(vocab)), draw.choice(list(vocab))
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                merges.append((a, b))
        code = bpe.MergeAutomaton(vocab, merges, "")
        rank = {m: i for i, m in enumerate(merges)}
        for _ in range(40):
            word = "".join(draw.choice("abc") for _ in range(draw.randrange(1, 14)))
            parts = list(word)
            while True:
                best = min(((rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank), default=None)
                if best is None:
                    break
                i = best[1]
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            assert code.decode(code.encode_word(word)) == parts, (merges, word)
