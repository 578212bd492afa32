"""Spaced seeds against aligning everything, the SQL check, and the masks' guarantee."""

from __future__ import annotations

import random
import re
from itertools import combinations

import compare
from fieldlens.llm import decontam
from fieldlens.llm.queries import QUERIES, SQL


def test_every_window_with_two_substitutions_has_a_seed():
    for mask in decontam.MASKS:
        assert mask[-1] + 1 == decontam.SPAN
        for bad in combinations(range(decontam.WINDOW), decontam.WINDOW - decontam.LEAST):
            assert any(not any(s + p in bad for p in mask) for s in range(decontam.WINDOW - decontam.SPAN + 1))


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    want = {}
    for doc_id, text in docs:
        a = tokens(text)
        for item_id, passage in items:
            b = tokens(passage)
            n = min(decontam.WINDOW, len(b))
            if len(b) < decontam.SPAN:
                continue
            for shift in range(-len(b) + n, len(a) - n + 1):
                for s in range(len(b) - n + 1):
                    if 0 <= shift + s and shift + s + n <= len(a):
                        m = sum(a[shift + s + i] == b[s + i] for i in range(n))
                        if m >= (decontam.LEAST if n == decontam.WINDOW else n):
                            want[doc_id, item_id] = max(m, want.get((doc_id, item_id), 0))
    return {(d, i, m) for (d, i), m in want.items()}


def planted():
    draw = random.Random(6)
    vocab = [f"w{i}" for i in range(60)] + ["é", "Straße", "x2"]
    items = [(i, " ".join(draw.choice(vocab) for _ in range(n))) for i, n in enumerate([5, 8, 12, 13, 20, 40, 60])] + [(7, None), (8, ""), (5, "w1 w2 " * 10)]
    docs = [(0, None), (1, ""), (2, "w1"), (None, items[5][1])]
    for k in range(60):
        base = [draw.choice(vocab) for _ in range(draw.randrange(50))]
        item = tokens(draw.choice(items)[1])
        for _ in range(draw.randrange(5)):
            if item:
                item[draw.randrange(len(item))] = draw.choice(vocab)
        a = draw.randrange(max(1, len(item)))
        cut = item[a:] if draw.random() < 0.4 else item
        at = draw.randrange(len(base) + 1)
        docs.append((10 + k, (", " if k % 2 else "\n").join(base[:at] + [w.upper() if k % 3 else w for w in cut] + base[at:])))
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(*d, "x", 1) for d in docs] + [(*docs[-1], "x", 1)], "doc_id long, text string, item_id string, key int"),
            spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, mask string"))


def test_overlaps_equal_aligning_everything(spark):
    docs, items = planted()
    d, i = frames(spark, docs, items)
    want = brute(docs, items)
    assert len(want) > 20
    assert {tuple(r) for r in decontam.contaminated(d, i).collect()} == want
    unplanned = decontam.overlaps(d, i, planned_seeds=1).select("doc_id", "item_id", "matched").collect()
    assert {tuple(r) for r in unplanned} == want


def test_clean_rows_stay(spark):
    docs, items = planted()
    d, i = frames(spark, docs, items)
    bad = {t[0] for t in brute(docs, items)}
    kept = decontam.keep_clean(d, i)
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r.doc_id for r in d.collect() if r.doc_id not in bad), key=repr)


def test_empty_tables(spark):
    docs, items = planted()
    d, i = frames(spark, docs, items)
    assert decontam.contaminated(d.limit(0), i).collect() == []
    assert decontam.contaminated(d, i.limit(0)).collect() == []
    assert decontam.keep_clean(d, i.limit(0)).count() == d.count()


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op9_benchmark_overlaps"](spark, folder)
    cur = compare.duck(folder).execute(SQL["op9_benchmark_overlaps"])
    want = compare.normal([d[0] for d in cur.description], cur.fetchall())
    assert compare.normal(got.columns, got.collect()) == want
