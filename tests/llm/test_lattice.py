"""Lattice likelihood against enumeration, word model against plain counting."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from fieldlens.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")


def enumerate_paths(table: dict[str, float], byte: dict[int, float], word: str) -> tuple[float, Counter]:
    """Total probability over all segmentations, and the expected use of each piece."""
    if not word:
        return 1.0, Counter()
    total, uses = 0.0, Counter()
    for stop in range(1, len(word) + 1):
        piece = word[:stop]
        if piece in table:
            p, names = table[piece], [piece]
        elif stop == 1:
            names = [f"<0x{b:02X}>" for b in piece.encode()]
            p = math.prod(byte[b] for b in piece.encode())
        else:
            continue
        q, more = enumerate_paths(table, byte, word[stop:])
        total += p * q
        for n in names:
            uses[n] += p * q
        for n, x in more.items():
            uses[n] += p * x
    return total, uses


def test_forward_backward_equals_enumeration():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab", "bb"] + [f"<0x{b:02X}>" for b in range(256)]
    p = np.linspace(1, 3, len(pieces))
    p /= p.sum() * 1.1
    table = {s: x for s, x in zip(pieces, p) if not s.startswith("<0x")}
    byte = {b: p[9 + b] for b in range(256)}
    words = ["a", "ab", "abab", "bbb", "aéb", "漢", "abba", "a", "zz", "ab" * 4]
    weight = np.arange(1.0, len(words) + 1)
    total = np.zeros(len(pieces))
    got = lattice.Lattice(pieces, np.log(np.r_[p, 0.09])).solve(words, weight, total)
    want = Counter()
    for w, z, x in zip(words, got, weight):
        mass, uses = enumerate_paths(table, byte, "▁" + w)
        assert math.isclose(math.exp(z), mass, rel_tol=1e-9)
        for n, u in uses.items():
            want[n] += x * u / mass
    assert np.allclose(total, [want[s] for s in pieces])


def test_long_word_does_not_underflow():
    pieces = lattice.load_pieces(PATH)
    w = np.array([x for _, x in pieces])
    model = lattice.Lattice([s for s, _ in pieces], np.log(np.r_[w, 1.0] / (w.sum() + 1)))
    z = model.solve(["a" * 30_000])
    assert np.isfinite(z).all() and z[0] < -1000
    assert len(model.solve([])) == 0


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, t, "x") for i, t in enumerate([None, "", "the The THE cat", "zzq 漢字 the\tcat\x0bx", "word " * 3000, "a" * 9000, "the cat"] * 6)]
    rows += [(None, "no id here", "x"), (3, "zzq 漢字 the\tcat\x0bx", "x")]
    return rows, lattice.score_documents(spark.createDataFrame(rows, "doc_id long, text string, score string"), PATH).collect()


def test_word_model_equals_counting(scored):
    rows, got = scored

    def remainder(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 5
    c = Counter()
    for i, t, _ in rows:
        if remainder(i) != 1:
            c.update(lattice.text_words(t) + [None])
    n, v = sum(c.values()), len(c)
    want = []
    for i, t, _ in rows:
        tokens = lattice.text_words(t) + [None]
        want.append((i, remainder(i) == 1, len(tokens), sum(c[w] > 0 for w in tokens), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)))
    assert len(got) == len(want)
    for a, b in zip(sorted(want, key=repr), sorted((tuple(r)[:6] for r in got), key=repr)):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)


def test_scores_are_log_probabilities(scored):
    _, got = scored
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    same = {}
    for r in got:
        same.setdefault((r.doc_id, r.n_tokens), set()).add(round(r.score, 6))
    assert all(len(x) == 1 for x in same.values())


def test_empty_table(spark):
    assert lattice.score_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
