"""Benchmark passages in training texts, by spaced-seed hashing in DataFrame operations only.

A seed hashes the words at a mask's positions and ignores those between, so a substituted
word spoils only the seeds that look at it. Either mask alone has an intact seed in every
window of WINDOW words with at most two substitutions, so no window that counts is missed.
Hits are verified on the words around them, aligned word by word.

Benchmark seeds go into the plan as a value set while they are few (checked), which drops
other positions before a row is made of them; with more, all seeds are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word positions each mask looks at.
MASKS = ((0, 1, 3, 6, 7), (0, 1, 4, 6, 7))
SPAN = 8
#: An overlap is this many aligned words of which LEAST agree; an item with fewer words must agree whole.
WINDOW, LEAST = 13, 11
#: Seeds in the plan at most; beyond it positions are not dropped early, with the same result.
PLANNED_SEEDS = 200_000


def words(text: Column) -> Column:
    """Hashes of lower-cased runs of letters and digits."""
    return F.transform(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def seed(hashes: Column, at: Column, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(*[F.get(hashes, at + p) for p in mask])


def starts(n: Column) -> Column:
    return F.when(n >= SPAN, F.sequence(F.lit(0), n - SPAN)).otherwise(F.array().cast("array<int>"))


def around(hashes: Column, at: Column) -> Column:
    """The words a window with this seed can reach, and where the seed is among them."""
    first = F.greatest(at - WINDOW, F.lit(0))
    return F.struct(at.alias("at"), (at - first).alias("back"), F.slice(hashes, first + 1, at - first + SPAN + WINDOW).alias("near"))


def seeds_of(items: DataFrame) -> DataFrame:
    """(item_id, size, mask, key, b_back, b_near): one row a seed of items(item_id, text)."""
    rows = (items.select("item_id", words(F.col("text")).alias("h")).distinct().withColumn("size", F.size("h"))
            .select("item_id", "size", "h", F.explode(F.transform(starts(F.col("size")), lambda i: around(F.col("h"), i))).alias("s")))
    keys = F.array(*[F.struct(F.lit(m).alias("mask"), seed(F.col("h"), F.col("s.at"), mask).alias("key")) for m, mask in enumerate(MASKS)])
    return (rows.select("item_id", "size", F.col("s.back").alias("b_back"), F.col("s.near").alias("b_near"), F.explode(keys).alias("k"))
            .select("item_id", "size", "b_back", "b_near", "k.mask", "k.key"))


def overlaps(docs: DataFrame, items: DataFrame, planned_seeds: int = PLANNED_SEEDS) -> DataFrame:
    """(doc_id, text_hash, item_id, matched): texts that hold a passage of an item.

    docs(doc_id, text), items(item_id, text). matched is the most words that agree in a window
    of WINDOW words (the item's size, if smaller). An item of fewer than SPAN words is too short
    to tell from chance and is not searched; null texts hold nothing. Repeated rows give one
    row; ids may be null. Other columns are ignored.
    """
    bench = seeds_of(items)
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("h")).where(F.size("h") >= SPAN)
    keys = bench.select("key").distinct().limit(planned_seeds + 1).collect()
    at = starts(F.size("h"))
    h = F.col("h")
    if len(keys) <= planned_seeds:
        values = [r.key for r in keys]
        at = F.filter(at, lambda i: seed(h, i, MASKS[0]).isin(values) | seed(h, i, MASKS[1]).isin(values))
    found = hashed.select("doc_id", "text_hash", F.explode(F.transform(at, lambda i: F.struct(
        around(h, i).alias("s"), *[seed(h, i, mask).alias(f"key{m}") for m, mask in enumerate(MASKS)]))).alias("p"))
    found = found.select("doc_id", "text_hash", F.col("p.s.back").alias("d_back"), F.col("p.s.near").alias("d_near"),
                         F.explode(F.array(*[F.struct(F.lit(m).alias("mask"), F.col(f"p.key{m}").alias("key")) for m in range(len(MASKS))])).alias("k"))
    hits = found.select("doc_id", "text_hash", "d_back", "d_near", "k.mask", "k.key").join(bench, ["mask", "key"])
    back = F.least("d_back", "b_back")
    ahead = F.least(F.size("d_near") - F.col("d_back"), F.size("b_near") - F.col("b_back"))
    agree = F.transform(F.sequence(-back, ahead - 1), lambda k: (F.get("d_near", F.col("d_back") + k) == F.get("b_near", F.col("b_back") + k)).cast("int"))
    window = F.least(F.lit(WINDOW), F.col("size"))
    sums = F.transform(F.sequence(F.lit(1), F.size("agree") - F.col("window") + 1),
                       lambda s: F.aggregate(F.slice("agree", s, F.col("window")), F.lit(0), lambda a, x: a + x))
    return (hits.select("doc_id", "text_hash", "item_id", window.alias("window"), agree.alias("agree")).where(F.size("agree") >= F.col("window"))
            .select("doc_id", "text_hash", "item_id", "window", F.array_max(sums).alias("matched"))
            .where(F.col("matched") >= F.when(F.col("window") < WINDOW, F.col("window")).otherwise(LEAST))
            .groupBy("doc_id", "text_hash", "item_id").agg(F.max("matched").alias("matched")))


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched): one row a document and item whose passage it holds."""
    return overlaps(docs, items).groupBy("doc_id", "item_id").agg(F.max("matched").cast("long").alias("matched"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without rows whose text holds a passage of an item; rows without doc_id are told by their text."""
    bad = overlaps(docs, items).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    return docs.alias("d").join(bad.alias("b"), F.col("d.doc_id").eqNullSafe(F.col("b.bad_id")) & (F.xxhash64("d.text") == F.col("b.bad_hash")), "left_anti")
