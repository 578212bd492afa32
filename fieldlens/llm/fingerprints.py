"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions only.

A text's shingles are all runs of WORDS lower-cased words; a shingle's hash is the XXH64 of its
words' XXH64. The sketch is the KEEP least hashes in ascending order, all of them if there are
fewer. The least hashes of two sketches together are the sketch of both texts together, so sketches
of parts merge to the sketch of the whole, and two sketches estimate resemblance (shared shingles
of all), containment (shared shingles of one's) and the number of distinct shingles. Estimates
from sketches of fewer than KEEP hashes are exact.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm.common import stored

WORDS, KEEP = 5, 128
#: Sketches merged by one group at most, on average.
FAN = 256
#: Blocks of the order of documents (at most SIDE squared), rows of a block at least (on average), keys sampled a block.
SIDE, BLOCK_ROWS, SAMPLED = 64, 256, 8


def word_hashes(text: Column) -> Column:
    """Hashes of lower-cased runs of letters and digits; null text has none."""
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def sketched(df: DataFrame, text: str, name: str, words: int = WORDS, keep: int = KEEP) -> DataFrame:
    """df with the sketch of a text column: the `keep` least shingle hashes in ascending order.

    A text of fewer than `words` words is one shingle; a wordless or null one has an empty sketch.
    """
    held = df.withColumn("__words", word_hashes(F.col(text)))
    h, n = F.col("__words"), F.size("__words")
    shingles = (F.when(n >= words, F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)])))
                .when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>")))
    return held.withColumn(name, F.slice(F.sort_array(F.array_distinct(shingles)), 1, keep)).drop("__words")


def fingerprint(sketch: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def merge(a: Column, b: Column, keep: int = KEEP) -> Column:
    """The sketch of two texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, keep)


def distinct_shingles(sketch: Column, keep: int = KEEP) -> Column:
    """Number of distinct shingles: exact below `keep`, else (keep - 1) over the share of hashes up to the last kept one."""
    share = F.element_at(sketch, -1).cast("double") / F.lit(2.0 ** 64) + 0.5
    return F.when(F.size(sketch) < keep, F.size(sketch).cast("double")).otherwise((keep - 1) / share)


def _union(a: Column, b: Column, keep: int) -> Column:
    """The hashes an estimate looks at: all, if neither sketch left any out, else the least of both."""
    both = F.sort_array(F.array_union(a, b))
    return F.when((F.size(a) < keep) & (F.size(b) < keep), both).otherwise(F.slice(both, 1, keep))


def resemblance(a: Column, b: Column, keep: int = KEEP) -> Column:
    """Shared shingles of all shingles of two texts, 0 to 1; two texts without any are alike."""
    both = _union(a, b, keep)
    shared = F.array_intersect(F.array_intersect(a, b), both)
    return F.when(F.size(both) == 0, 1.0).otherwise(F.size(shared) / F.size(both))


def containment(a: Column, b: Column, keep: int = KEEP) -> Column:
    """Shared shingles of the first text's shingles, 0 to 1; a text without any is contained in every one."""
    both = _union(a, b, keep)
    exact = (F.size(a) < keep) & (F.size(b) < keep)
    all_of = F.when(exact, F.size(both).cast("double")).otherwise(distinct_shingles(both, keep))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), resemblance(a, b, keep) * all_of / distinct_shingles(a, keep)))


def merged(sketches: DataFrame, keys: list[str], sketch: str = "sketch", keep: int = KEEP, fan: int = FAN) -> DataFrame:
    """(keys, sketch): one sketch for each key, of all its rows' shingles.

    A key's rows are dealt into groups of about `fan`, each becomes one sketch, and so on until
    every key has one, so a key may have any share of the rows. Null keys are a key; null sketches
    are empty.
    """
    left = sketches.select(*keys, F.coalesce(F.col(sketch), F.array().cast("array<bigint>")).alias(sketch)).distinct()
    left = stored(left, "sketches")
    together = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(sketch)))), 1, keep).alias(sketch)
    while True:
        sizes = left.groupBy(*keys).agg(F.count("*").alias("__n"))
        most = sizes.agg(F.max("__n")).first()[0] or 0
        if most <= 2 * fan:
            return left.groupBy(*keys).agg(together)
        deal = F.pmod(F.xxhash64(sketch), F.lit(-(-most // fan)))
        left = stored(left.withColumn("__deal", deal).groupBy(*keys, "__deal").agg(together).drop("__deal"), "sketches")


def in_blocks(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, h) with `block`, ascending in (doc_id, h), and `guest`.

    Block edges come from a bounded sample of keys. The last row of a block is also a guest of
    the next one (the last of all, of the first), so each row finds the row before it in its block.
    """
    spark = docs.sparkSession
    rows = docs.count()
    blocks = max(1, min(SIDE * SIDE, rows // BLOCK_ROWS))
    low = (0, 0)
    order = lambda k: low if k is None else (1, k)
    sample = docs.sample(min(1.0, SAMPLED * blocks / max(rows, 1)), seed=1).select("doc_id", "h").collect()
    sample = sorted(map(tuple, sample), key=lambda k: (order(k[0]), k[1]))
    edges = [sample[len(sample) * i // blocks] for i in range(1, blocks)] if len(sample) >= blocks else sample
    tuples = [edges[i:i + SIDE] for i in range(0, len(edges), SIDE)]
    kind = "array<struct<d:bigint,h:bigint>>"
    as_json = lambda xs: [{"d": d, "h": h} for d, h in xs]
    coarse = F.from_json(F.lit(json.dumps(as_json([t[0] for t in tuples[1:]]))), kind)
    fine = F.from_json(F.lit(json.dumps([as_json(t) for t in tuples] or [[]])), f"array<{kind}>")
    key = F.struct(F.col("doc_id").alias("d"), F.col("h").alias("h"))
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b <= key))
    placed = docs.withColumn("__i", below(coarse))
    placed = placed.withColumn("block", F.col("__i") * (SIDE + 1) + below(F.get(fine, F.col("__i")))).drop("__i")
    ends = sorted(placed.groupBy("block").agg(F.max(key).alias("k")).collect())          # one row a block
    guests = [(ends[i][0], ends[i - 1][1]["d"], ends[i - 1][1]["h"]) for i in range(len(ends))]
    known = F.broadcast(spark.createDataFrame(guests, "block int, g_id long, g_h long"))
    found = (docs.join(known, docs["doc_id"].eqNullSafe(F.col("g_id")) & (docs["h"] == F.col("g_h")))
             .groupBy("block", "doc_id", "h").agg(F.first("text").alias("text")))
    return (placed.select("block", F.lit(0).alias("guest"), "doc_id", "h", "text")
            .unionByName(found.select("block", F.lit(1).alias("guest"), "doc_id", "h", "text")))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): each document and the next by descending doc_id, the first after the last.

    Texts move once, to the blocks of that order. Documents of one doc_id follow each other by
    their text's hash; those without doc_id come last. A single document is its own next.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("h", F.xxhash64("text"))
    dealt = sketched(in_blocks(keyed).repartition("block"), "text", "sketch")
    order = Window.partitionBy("block").orderBy(F.desc("guest"), F.asc_nulls_first("doc_id"), "h")
    return (dealt.select("doc_id", "text", "sketch", "guest", F.lag("text").over(order).alias("next_text"), F.lag("sketch").over(order).alias("next_sketch"))
            .where(F.col("guest") == 0).drop("guest"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row a row of docs(doc_id, text).

    The edited text has its last third of code points (rounded down) replaced by as many of the
    next document's first ones, or all it has. Null text is empty; empty and wordless texts have
    an empty fingerprint and are alike. Repeated rows are documents of their own, one the next of
    the other. Other columns are ignored; an empty table gives no rows.
    """
    rows = with_next(docs).withColumn("n_chars", F.length("text"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - third), F.substring("next_text", F.lit(1), third)))
    rows = sketched(rows.drop("text", "next_text"), "edited", "edited_sketch")
    return rows.select("doc_id", F.col("n_chars").cast("long"), F.sha2("edited", 256).alias("edited_sha256"),
                       fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
                       resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                       resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
