"""Exact top-k against scoring everything."""

from __future__ import annotations

import math
import random

import compare
from fieldlens.llm import topk
from fieldlens.llm.queries import QUERIES, SQL


def brute(rows, k, every):
    whole = {(i, tuple(math.floor(256 * x) for x in e)) for i, e, *_ in rows
             if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    want = set()
    for q, a in {r for r in whole if r[0] % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in whole if c != q)
        want |= {(q, n, c, -s) for n, (s, c) in enumerate(scored[:k], 1)}
    return want


def check(spark, rows, k=5, every=10):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, cid long")
    got = topk.top_k(table, k, every).collect()
    exact = [(i, None if e is None else [None if x is None else struct_float(x) for x in e]) for i, e, *_ in rows]
    assert len(got) == len(set(map(tuple, got)))
    assert {tuple(r) for r in got} == brute(exact, k, every)


def struct_float(x):
    import numpy as np
    return float(np.float32(x))


def test_random_and_clustered(spark):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0, 0.2) for _ in range(16)], "x", 0) for i in range(300)]
    centre = [draw.gauss(0, 0.2) for _ in range(16)]
    rows += [(i, [c + draw.gauss(0, 0.01) for c in centre], "x", 0) for i in range(300, 420)]
    check(spark, rows)


def test_copies_ties_and_bad_vectors(spark):
    draw = random.Random(4)
    same = [0.1] * 8
    rows = [(i, same, None, None) for i in range(0, 200)] + [(i, [draw.choice([0.0, 0.1, -0.1]) for _ in range(8)], None, None) for i in range(200, 260)]
    rows += [(20, same, None, None), (300, None, None, None), (310, [0.1, None], None, None), (320, [float("nan")] * 8, None, None),
             (330, [float("inf")] + [0.0] * 7, None, None), (None, same, None, None), (340, [], None, None), (350, [5.0, 1.0], None, None)]
    check(spark, rows)


def test_fewer_than_k_and_empty(spark):
    check(spark, [(0, [1.0, 2.0], None, None), (7, [1.0, 0.5], None, None), (10, [-1.0, 0.5], None, None)])
    check(spark, [(0, [1.0], None, None)])
    check(spark, [(3, [1.0], None, None)])
    check(spark, [])


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op8_exact_top_k"](spark, folder)
    cur = compare.duck(folder).execute(SQL["op8_exact_top_k"])
    want = compare.normal([d[0] for d in cur.description], cur.fetchall())
    assert compare.normal(got.columns, got.collect()) == want
