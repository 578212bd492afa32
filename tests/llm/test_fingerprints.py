"""Bottom-k fingerprints against hashing every shingle in Python."""

from __future__ import annotations

import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from fieldlens.llm import fingerprints
from fieldlens.llm.queries import QUERIES

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text):
    words = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]

    def chain(some):
        h = 42
        for x in some:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), h)
        return signed(h)
    if not hashes:
        return set()
    return {chain(hashes[i:i + 5]) for i in range(len(hashes) - 4)} if len(hashes) >= 5 else {chain(hashes)}


def likeness(a, b, keep):
    if len(a) < keep and len(b) < keep:
        both = a | b
    else:
        a, b = set(sorted(a)[:keep]), set(sorted(b)[:keep])
        both = set(sorted(a | b)[:keep])
    return len(a & b & both) / len(both) if both else 1.0


def text_of(hashes, keep):
    return "".join(f"{x & MASK:016x}" for x in sorted(hashes)[:keep])


def brute(rows, keep=128):
    rows = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42))), reverse=True)
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        cut = len(t) // 3
        new = t[:len(t) - cut] + after[:cut]
        a, e, n = shingle_hashes(t), shingle_hashes(new), shingle_hashes(after)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), text_of(a, keep), text_of(e, keep), likeness(a, e, keep), likeness(a, n, keep)))
    return sorted(out, key=repr)


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, h int, sketch string")
    return sorted([tuple(r) for r in fingerprints.edited_likeness(docs).collect()], key=repr)


def test_odd_rows_equal_brute_force(spark):
    draw = random.Random(2)
    long = " ".join(f"w{draw.randrange(4000)}" for _ in range(30_000))
    rows = [(9, None), (8, ""), (7, "one two"), (6, "Ünï cödé 🙂 a b c d e f"), (5, long), (4, long + " x"), (3, "... !!"), (2, "same text here"), (2, "same text here"),
            (2, "another text of that id"), (None, "no id"), (None, "no id at all in this row"), (-4, "a b c d e f g h"), (1 << 62, "far away id")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:1]) == brute(rows[:1])
    assert run(spark, []) == []


def test_many_blocks_equal_brute_force(spark, monkeypatch):
    """Documents on both sides of a block's edge, with clustered ids, ids shared by many texts and none."""
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 3)
    monkeypatch.setattr(fingerprints, "SIDE", 5)
    draw = random.Random(3)
    words = lambda: " ".join(f"v{draw.randrange(50)}" for _ in range(draw.randrange(40)))
    rows = [(i, words()) for i in range(60)] + [(10**15 + i, words()) for i in range(30)] + [(77, words()) for _ in range(50)] + [(None, words()) for _ in range(20)]
    assert run(spark, rows) == brute(rows)


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_document_fingerprints"](spark, folder)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())
    got = sorted([tuple(r) for r in got.collect()], key=repr)
    assert got == brute(docs)
    long = [r for r in got if r[1] > 300]
    assert sum(r[5] > r[6] for r in long) > 0.9 * len(long)


def test_parts_merge_and_estimates_hold(spark):
    draw = random.Random(4)
    vocabulary = [f"x{i}" for i in range(3000)]
    a = [draw.choice(vocabulary) for _ in range(20_000)]
    b = a[:12_000] + [draw.choice(vocabulary) for _ in range(8_000)]
    sa, sb = shingle_hashes(" ".join(a)), shingle_hashes(" ".join(b))
    parts = [("a", " ".join(a[i:i + 54])) for i in range(0, 20_000, 50)] + [("b", " ".join(b[i:i + 54])) for i in range(0, 20_000, 50)]
    df = fingerprints.sketched(spark.createDataFrame(parts + [("c", None), (None, "left out")], "k string, text string"), "text", "sketch")
    got = {r.k: r for r in fingerprints.merged(df, ["k"], fan=7).withColumn("n", fingerprints.distinct_shingles(F.col("sketch"))).collect()}
    assert got["a"].sketch == sorted(sa)[:128] and got["b"].sketch == sorted(sb)[:128]
    assert got["c"].sketch == [] and got["c"].n == 0 and got[None].n == 1
    assert abs(got["a"].n / len(sa) - 1) < 0.3
    pair = spark.createDataFrame([(got["a"].sketch, got["b"].sketch, sorted(list(sa)[:90]), sorted(list(sa)[:40]))], "a array<long>, b array<long>, c array<long>, d array<long>")
    r = pair.select(fingerprints.resemblance(F.col("a"), F.col("b")), fingerprints.containment(F.col("a"), F.col("b")), fingerprints.containment(F.col("c"), F.col("d")),
                    fingerprints.containment(F.col("d"), F.col("c")), fingerprints.resemblance(F.col("c"), F.col("d")), fingerprints.merge(F.col("a"), F.col("b")) == F.lit(sorted(sa | sb)[:128])).first()
    assert abs(r[0] - len(sa & sb) / len(sa | sb)) < 0.15 and abs(r[1] - len(sa & sb) / len(sa)) < 0.25
    assert r[2] == 40 / 90 and r[3] == 1 and r[4] == 40 / 90 and r[5]
