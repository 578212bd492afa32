"""Importance resampling against counting every feature in Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import compare
import numpy as np
import pyarrow as pa
import xxhash
from fieldlens.llm import resample
from fieldlens.llm.queries import QUERIES, SQL

UPPER = {c: c + 32 for c in range(65, 91)}


def features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    return words, [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest=1, buckets=10_000, share=10, least_words=20, seed="2024"):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(place(f) for _, t in docs for f in features(t, longest)[1])
    t = Counter(place(f) for x in target for f in features(x, longest)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets))))
    rows = []
    for i, text in docs:
        words, found = features(text, longest)
        weight = sum(gain(place(f)) for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least_words])
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {id(r): n for n, r in enumerate(fit[:len(fit) * share // 100], 1)}
    return sorted([(*r[:4], rank.get(id(r))) for r in rows], key=repr)


def check(spark, docs, target, **how):
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, weight string")
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    assert sorted([tuple(r) for r in resample.resample(table, goal, **how).collect()], key=repr) == brute(docs, target, **how)


def odd_rows():
    draw = random.Random(1)
    words = [f"w{i}" for i in range(300)] + ["ÉTÉ", "naïve", "Çà", "数", "🙂🙂", "x" * 70, "x" * 69 + "y", "Mixed.Case-9"]
    rows = [(i, draw.choice([" ", "\n", ", "]).join(draw.choice(words) for _ in range(draw.randrange(60)))) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(200)]                                    # copies: equal weights
    return rows + [(None, None), (None, rows[6][1] * 2), (None, rows[6][1] * 2), (700, None), (701, ""), (702, "..."), (7, rows[8][1]), (703, " ".join(words * 200))]


def test_odd_rows_equal_brute_force(spark):
    target = ["w1 w2 w3 naïve " * 9, "", None, "数 ÉTÉ w4", "w1 w1 w1"]
    check(spark, odd_rows(), target)
    check(spark, odd_rows(), target, longest=3, buckets=97, share=40, least_words=3, seed="a")


def test_empty_tables(spark):
    check(spark, [], ["a b"])
    check(spark, odd_rows()[:40], [])


def test_one_bucket_and_no_words(spark):
    check(spark, [(i, "!!") for i in range(30)], ["a"], share=50, least_words=0)
    check(spark, odd_rows()[:50], ["a"], buckets=1, least_words=1)


def test_table_keeps_equal_keys_apart(monkeypatch):
    """With one key for all n-grams only their bytes tell them apart."""
    texts = [t or "" for _, t in odd_rows()[:60]]
    found = resample.Features(pa.array(["skipped words", *texts]).slice(1), 2)
    monkeypatch.setattr(resample.Features, "keys", lambda self: np.full(len(self), 7, np.uint64))
    held = resample.Interned(found, 1000)
    names = [bytes(found.bytes[a:a + n]) for a, n in zip(found.start, found.size)]
    assert len(set(zip(held.slot.tolist(), names))) == len(set(names)) == len(set(held.slot.tolist()))
    assert all(held.bucket[s] == zlib.crc32(n) % 1000 for s, n in zip(held.slot, names))
    assert Counter(names) == Counter({n: int(held.count[s]) for s, n in zip(held.slot, names)})


def test_span_hashes_are_xxh64():
    draw = np.random.default_rng(1)
    data = draw.integers(0, 256, 3000, dtype=np.uint8)
    start, size = draw.integers(0, 2900, 1500), draw.integers(0, 80, 1500)
    got = resample.xxh64_spans(data, start, size)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(data[a:a + n].tobytes()) for a, n in zip(start, size)]


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op12_importance_resampling"](spark, folder)
    cur = compare.duck(folder).execute(SQL["op12_importance_resampling"])
    assert compare.normal(got.columns, got.collect()) == compare.normal([d[0] for d in cur.description], cur.fetchall())
