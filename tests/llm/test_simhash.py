"""Fingerprints and components against comparing all pairs, hot groups, odd tables."""

from __future__ import annotations

import random

import numpy as np
import xxhash

from fieldlens.llm import simhash
from fieldlens.llm.components import linked_components


def slow_print(text):
    tokens = [t for t in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if t]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i:i + 3]) for i in range(len(tokens) - 2)] or [" ".join(tokens)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def close_components(prints, ids):
    label = dict(zip(ids, ids))
    while True:
        before = dict(label)
        for i, p in zip(ids, prints):
            near = [j for j, q in zip(ids, prints) if bin(p ^ q).count("1") <= 3]
            least = min(label[j] for j in near)
            for j in near:
                label[j] = least
        if label == before:
            return label


def test_fingerprints():
    draw = random.Random(1)
    for _ in range(200):
        text = "".join(draw.choice(["a", "B", "É", " ", "\t", "\x0b", "\xa0", "word", "\n"]) for _ in range(draw.randrange(40)))
        assert simhash.text_fingerprint(text) == slow_print(text)
    assert simhash.text_fingerprint(None) == simhash.text_fingerprint(" \r\n") == 0


def cloud(draw, centres, spread, n):
    out = set()
    while len(out) < n:
        p = draw.choice(centres)
        for _ in range(draw.randrange(spread)):
            p ^= 1 << draw.randrange(64)
        out.add(p)
    return sorted(out)


def check_links(spark, prints, bucket):
    ids = list(range(0, 7 * len(prints), 7))
    nodes = spark.createDataFrame([(simhash.signed(p), i) for p, i in zip(prints, ids)], "fp long, id long")
    got = {r.id: r.component for r in linked_components(simhash.close_links(nodes, 3, bucket)).collect()}
    want = close_components(prints, ids)
    assert {i: got.get(i, i) for i in ids} == want


def test_links_equal_all_pairs(spark):
    draw = random.Random(2)
    centres = [draw.getrandbits(64) for _ in range(6)]
    check_links(spark, cloud(draw, centres, 7, 300), simhash.BUCKET)


def test_hot_groups_are_divided_exactly(spark):
    draw = random.Random(3)
    check_links(spark, cloud(draw, [draw.getrandbits(64)], 8, 300), 20)


def test_loose_thresholds_find_all(spark, monkeypatch):
    """With dear pairs the programming picks unequal thresholds; no link is lost."""
    draw = random.Random(4)
    monkeypatch.setattr(simhash, "PAIR_COST", 1e-2)
    monkeypatch.setattr(simhash, "ROW_COST", 1e-9)
    prints = [draw.getrandbits(64) for _ in range(600)]
    nodes = spark.createDataFrame([(simhash.signed(p), i) for i, p in enumerate(prints)], "fp long, id long")
    masks, known = simhash.probe_masks(nodes)
    assert len(masks) > 4 and known == -1
    for p in prints[:40]:
        for _ in range(40):
            q = p
            for b in draw.sample(range(64), 3):
                q ^= 1 << b
            assert any(p & m == q & m for m in masks)
    monkeypatch.setattr(simhash, "probe_masks", lambda nodes, radius: (masks, -1))
    check_links(spark, cloud(draw, prints[:4], 7, 200), 50)


def test_allocation_is_the_cheapest():
    costs = [[0, 5.0, 9.0, 30.0], [0, 1.0, 20.0, 21.0], [0, 7.0, 8.0, 8.5]]
    best = min((sum(c[u] for c, u in zip(costs, (a, b, d))), (a - 1, b - 1, d - 1)) for a in range(4) for b in range(4) for d in range(4) if a + b + d == 4)
    assert tuple(simhash.allocate(costs, 4)) == best[1]


def test_frame(spark):
    rows = [(5, "one two three four"), (2, "one two three four"), (9, None), (7, ""), (None, "one two three four"), (5, "one two three four"), (1, "other words stand here")]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, fingerprint string, component_id long")
    got = simhash.near_duplicates(docs)
    assert sorted((r.doc_id or -1, r.component_id) for r in got.collect()) == [(-1, None), (1, 1), (2, 2), (5, 2), (5, 2), (7, 7), (9, 7)]
    assert {r.fingerprint for r in got.collect() if r.doc_id in (7, 9)} == {"0" * 16}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 7]
    assert simhash.near_duplicates(docs.limit(0)).collect() == [] and simhash.keep_one(docs.limit(0)).collect() == []


def test_components_of_chains_and_stars(spark):
    draw = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(200, 200), (300, 301), (301, 300), (300, 301)]
    draw.shuffle(edges)
    got = {r.id: r.component for r in linked_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {i: got[i] for i in range(61)} == dict.fromkeys(range(61), 0)
    assert {got[i] for i in range(100, 180)} == {100} and got[301] == got[300] == 300 and 200 not in got
    assert np.unique(list(got.values())).tolist() == [0, 100, 300]


def test_the_stage_goes_through_near_duplicates(spark, monkeypatch):
    """keep_one takes the components of the operator (before: it never called it) and decides them on the texts."""
    same, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(1, same), (2, same + " end"), (3, other)], "doc_id long, text string")
    called, whole = [], simhash.near_duplicates

    def put_in_one(rows):
        called.append(whole(rows).count())
        return rows.selectExpr("doc_id", "'' as fingerprint", "1L as component_id")
    monkeypatch.setattr(simhash, "near_duplicates", put_in_one)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3] and called == [3]
