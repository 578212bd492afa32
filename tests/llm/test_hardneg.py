"""Hard negatives against scoring every pair."""

from __future__ import annotations

import math
import random

import compare
import numpy as np
from fieldlens.llm import hardneg
from fieldlens.llm.queries import QUERIES, SQL

SCHEMA = "vec_id long, label int, embedding array<float>, score string, qid long"


def brute(rows, every, positives=5, negatives=5, low=80, high=100):
    whole = sorted({(i, y, tuple(math.floor(256 * float(np.float32(x))) for x in e)) for i, y, e, *_ in rows
                    if None not in (i, y, e) and all(x is not None and math.isfinite(x) for x in e)})
    out = []
    for i, y, e in whole:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(e, f)), j, z) for j, z, f in whole if j != i)
        for s, j, _ in [r for r in scored if r[2] == y][:positives]:
            fit = [r for r in scored if r[2] != y and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(i, j, n, r[1], -s, -r[0]) for n, r in enumerate(fit, 1)]
    return sorted(out)


def check(spark, rows, every=10, **how):
    table = spark.createDataFrame([(*r[:3], "s", 1) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in hardneg.hard_negatives(table, every, **how).collect())
    assert got == brute(rows, every, **{k: v for k, v in how.items() if k != "block"})
    return got


def clustered(draw, n, width=12, centres=6):
    middle = [[draw.gauss(0, 0.5) for _ in range(width)] for _ in range(centres)]
    return [(i, draw.randrange(3), [c + draw.gauss(0, 0.08) for c in draw.choice(middle)]) for i in range(n)]


def test_clusters_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "CELL_ROWS", 50)
    monkeypatch.setattr(hardneg, "LEAF", 8)
    rows = clustered(random.Random(5), 700)
    assert check(spark, rows, block=60)
    assert check(spark, rows, block=60, positives=2, negatives=3, low=50, high=130)


def test_subtrees_are_left_out(monkeypatch):
    """On clustered vectors a narrow window scores few members, and finds all of it."""
    draw = random.Random(6)
    rows = clustered(draw, 2000, centres=40)
    whole = np.array([r[2] for r in rows])
    vecs = np.floor(256 * whole / np.linalg.norm(whole, axis=1)[:, None]).astype(np.int64)
    norm = (vecs.astype(float) ** 2).sum(1)
    scored = []
    exact = hardneg.inner
    monkeypatch.setattr(hardneg, "inner", lambda q, x: scored.append(len(q) * len(x)) or exact(q, x))
    tree = hardneg.Tree(np.arange(2000), np.array([r[1] for r in rows]), vecs, float(norm.max()))
    q = vecs[:20]
    scores = q @ vecs.T
    low = np.sort(scores, 1)[:, -20]
    got = tree.search(q, norm[:20], np.arange(20), low, np.full(20, hardneg.TOP), lambda r, m: np.ones((len(r), len(m)), bool), 30)
    assert sum(scored) < 0.25 * scores.size
    want = sorted((w, -scores[w, i], i) for w in range(20) for i in np.flatnonzero(scores[w] >= low[w]))
    assert sorted(zip(got[0].tolist(), (-got[1]).tolist(), got[2].tolist())) == want


def test_copies_ties_and_bad_rows(spark):
    draw = random.Random(7)
    same = [0.1] * 8
    rows = [(i, draw.randrange(2), same) for i in range(200)] + [(i, draw.randrange(4), [draw.choice([0.0, 0.1, -0.1]) for _ in range(8)]) for i in range(200, 300)]
    rows += [(20, rows[20][1], same), (20, 3, same), (30, 0, [0.2] * 8), (400, 0, None), (410, None, same), (420, 1, [0.1, None]), (430, 1, [float("nan")] * 8),
             (440, 1, [float("inf")] + [0.0] * 7), (None, 1, same), (450, 1, []), (460, 0, [0.5, 0.5]), (470, 2, [0.0] * 8), (480, -3, [-0.4] * 8)]
    check(spark, rows)
    check(spark, rows, block=16)


def test_long_vectors_stay_exact(spark):
    draw = random.Random(8)
    rows = [(i, i % 3, [draw.choice([1.0, -1.0, 3.0]) * draw.choice([1e5, 3e5, 0.01]) for _ in range(6)]) for i in range(90)]
    check(spark, rows, every=5)
    big = np.array([[2**62, -2**62, 5]])
    assert hardneg.inner(big, big).tolist() == [[hardneg.TOP]] and hardneg.inner(big, -big).tolist() == [[-hardneg.TOP]]


def test_few_rows_and_none(spark):
    check(spark, [(0, 1, [1.0, 2.0]), (7, 1, [1.0, 0.5]), (10, 2, [1.0, 0.5])])
    check(spark, [(0, 1, [1.0])])
    check(spark, [])


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op11_hard_negatives"](spark, folder)
    cur = compare.duck(folder).execute(SQL["op11_hard_negatives"])
    assert compare.normal(got.columns, got.collect()) == compare.normal([d[0] for d in cur.description], cur.fetchall())
