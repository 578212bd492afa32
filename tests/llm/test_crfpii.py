"""Base spans against the plain patterns, Viterbi and gradients against enumeration, masks, odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
from itertools import product

import numpy as np
import pytest

from fieldlens.llm import crfpii as crf

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            keep = (True, kind == 1 and all(int(p) <= 255 for p in m[0].split(".")), 16 <= len(digits) <= 19 and crf.luhn(digits or "1"), 8 <= len(digits) <= 15)[kind]
            if keep:
                out.append((kind, m.start(), m.end()))
    return out


def odd_texts():
    draw = random.Random(9)
    bits = ["a@b.c", "@", "a", ".", "é", " ", "-", "+", "1", "12", "255", "256", "0", "4111111111111111", "4111 1111 1111 1111", "(", ")", "\n", "a.b%c+d@x-y.example.com", "٣", "漢", "..", "+1 (017) 555-7713"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(30))) for _ in range(3000)]
    return texts + ["", "a" * 3000 + "@", "1" * 3000, "+1" + " " * 3000, "a@b.c@d.e", "1.2.3.4.5.6.7.8", "x" * 200 + "@b.c" * 50]


def test_base_spans_equal_patterns():
    for text in odd_texts():
        assert crf.base_spans(text) == brute(text), text


def test_table_is_learned():
    field = crf.fitted()
    wrong = sum((field.decode(c, np.r_[np.zeros(len(c) - 1, bool), True]) != y).any() for c, y in crf.labelled_sentences())
    assert wrong <= 5


def test_decode_equals_trying_all_paths():
    field, draw = crf.Field(), np.random.default_rng(1)
    field.w, field.t = draw.normal(size=field.w.shape) / 4, draw.normal(size=field.t.shape)
    field.start, field.end = draw.normal(size=9), draw.normal(size=9)
    field.tables()
    size = [1, 4, 2, 3, 1, 4]
    code = draw.integers(0, len(crf.FEATURES), sum(size))
    closes = np.zeros(len(code), bool)
    closes[np.cumsum(size) - 1] = True
    got = field.decode(code, closes)
    at = 0
    for n in size:
        part = code[at:at + n]
        e = field.emissions(part, np.r_[True, np.zeros(n - 1, bool)])

        def value(path):
            return field.start[path[0]] + field.end[path[-1]] + sum(e[i, p] for i, p in enumerate(path)) + sum(field.t[a, b] for a, b in zip(path, path[1:]))
        best = max(product(range(9), repeat=n), key=value)
        assert tuple(got[at:at + n]) == best
        at += n


def test_adds_numbers_without_plus_and_leaves_prose_alone():
    field = crf.fitted()
    texts = ["Please call (555) 010-2299 today.", "We met 12 times in 1999, see 4.0.", "The and attion to thanedble the, anea.", "card 4111 1111 1111 1111 5500 0000 0000 0004 here", "order 2390409500648960 shipped"]
    found = crf.find_spans(texts, field)
    assert found[0] == ([], [(3, 12, 26)])
    assert [s for _, s in found[1:3]] == [[], []] and found[4][1] == []
    for text in odd_texts()[:500]:
        [(base, spans)] = crf.find_spans([text], field)
        assert set(base) <= set(spans) and spans == sorted(spans)


def test_slices_do_not_matter():
    field, texts = crf.fitted(), odd_texts()[:300]
    assert crf.find_spans(texts, field) == [crf.find_spans([t], field)[0] for t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "a@b.c", "é漢 mail ann@x.org, +1 (017) 555-7713", "w " * 30_000 + "1.2.3.4"]
    rows = [(i, t, "x", None if t is None else len(t)) for i, t in enumerate(texts)] + [(None, "a@b.c", "x", 5), (2, "a@b.c", "x", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")


def test_frame(docs):
    got = {r.doc_id: r for r in crf.personal_data(docs).collect()}
    assert crf.personal_data(docs).count() == 7 and crf.personal_data(docs.limit(0)).count() == 0
    assert got[0].spans == "" and got[0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].spans == "email:8:17,phone:19:36" and (got[3].n_email, got[3].n_phone) == (1, 1)
    assert got[3].base_sha256 == hashlib.sha256(got[3].spans.encode()).hexdigest()
    assert got[4].n_ip == 1 and got[None].n_email == 1


def test_masks(docs):
    got = crf.mask_personal_data(docs)
    assert got.schema == docs.schema
    by = {r.doc_id: r for r in got.collect()}
    assert by[0].text is None and by[0].n_chars is None and by[1].text == ""
    assert by[3].text == "é漢 mail <EMAIL>, <PHONE>" and by[3].n_chars == len(by[3].text)
    assert by[4].text.endswith("w <IP>")
    assert crf.masked("abcdef", [(0, 1, 4), (1, 2, 5)]) == "a<EMAIL>f"
