"""Importance resampling towards a target distribution of hashed n-grams.

Features are all runs of 1 to `longest` words; a feature's bucket is its CRC-32. Bucket counts
of the raw and of the target texts give each bucket a gain, a document's weight is the sum of
its features' gains, and the documents of highest weight plus Gumbel noise are drawn.

A batch's n-grams are interned in an open-addressed NumPy table: the XXH64 of an n-gram's bytes
is its key and first place, places are probed linearly for all n-grams at once, and an n-gram
only takes a slot that is free or holds the same bytes, so equal keys of different n-grams stay
apart. A slot holds its n-gram's bucket and count, so buckets are worked out once a distinct
n-gram; each occurrence keeps its slot's id and gathers the gain through it.

Ranks come from one range partitioning: a row's rank is its place in its partition plus the
rows before it, so no task sees more than a partition.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import stored, text_slices

#: Bytes of words: digits, letters of lower case and everything outside ASCII.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
#: Masks for the last one to seven bytes of a span read eight at a time.
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(8)], np.uint64)


#: The fixed primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxh64_spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of spans of data, whose last seven bytes are none's start; short spans at once, others one by one."""
    eights = np.ndarray((max(len(data) - 7, 0),), "<u8", data, 0, (1,))
    fours = np.ndarray((max(len(data) - 3, 0),), "<u4", data, 0, (1,))
    out = _P5 + size.astype(np.uint64)
    done = np.zeros(len(size), np.int64)
    for lane in range(3):
        i = np.flatnonzero((size >= 8 * lane + 8) & (size < 32))
        out[i] = _turned(out[i] ^ _turned(eights[start[i] + 8 * lane] * _P2, 31) * _P1, 27) * _P1 + _P4
    done = size & ~7
    i = np.flatnonzero((size & 4 > 0) & (size < 32))
    out[i] = _turned(out[i] ^ fours[start[i] + done[i]].astype(np.uint64) * _P1, 23) * _P2 + _P3
    done = size & ~3
    for step in range(3):
        i = np.flatnonzero((size & 3 > step) & (size < 32))
        out[i] = _turned(out[i] ^ data[start[i] + done[i] + step].astype(np.uint64) * _P5, 11) * _P1
    out = (out ^ (out >> np.uint64(33))) * _P2
    out = (out ^ (out >> np.uint64(29))) * _P3
    out ^= out >> np.uint64(32)
    view = memoryview(data)
    for i in np.flatnonzero(size >= 32).tolist():
        out[i] = xxhash.xxh64_intdigest(view[start[i]:start[i] + size[i]])
    return out


class Features:
    """The n-grams of a batch of texts: bytes of each, and which document each belongs to."""

    def __init__(self, texts: pa.Array, longest: int) -> None:
        texts = texts.cast(pa.large_string())
        count = len(texts)
        _, offsets, data = texts.buffers()
        edges = np.frombuffer(offsets, np.int64, count + 1 + texts.offset)[texts.offset:] if count else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[edges[0]:edges[-1]] if data is not None else np.empty(0, np.uint8)
        edges = edges - edges[0]
        lower = _LOWER[raw]
        inside = _WORD[lower]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        inner = edges[1:-1][edges[1:-1] < len(raw)]
        first[inner] = inside[inner]                       # a text's first byte never goes on a word of the text before it
        last = np.append(~inside[1:], True)[:len(raw)] if len(raw) else first
        last = last & inside
        cut = inner[inner > 0] - 1
        last[cut] = inside[cut]
        start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        size = stop - start
        #: Words of each document in a row, one space after each, so that every n-gram is one span.
        at = np.cumsum(size + 1) - (size + 1)
        self.bytes = np.full(int((size + 1).sum()) + 8, 32, np.uint8)
        self.bytes[np.flatnonzero(inside) + np.repeat(at - start, size)] = lower[inside]
        doc = np.searchsorted(edges, start, "right") - 1
        self.words = np.bincount(doc, minlength=count)
        self.start, self.size, self.doc = at, size, doc
        if longest > 1:
            spans = [(at, size, doc)]
            for n in range(1, longest):
                same = doc[n:] == doc[:len(doc) - n] if n < len(doc) else np.zeros(0, bool)
                head, tail = np.flatnonzero(same), np.flatnonzero(same) + n
                spans.append((at[head], at[tail] + size[tail] - at[head], doc[head]))
            self.start, self.size, self.doc = (np.concatenate(x) for x in zip(*spans))

    def __len__(self) -> int:
        return len(self.start)

    def keys(self) -> np.ndarray:
        return xxh64_spans(self.bytes, self.start, self.size)


class Interned:
    """An open-addressed table of a batch's n-grams: bucket and count by slot, slot by occurrence."""

    def __init__(self, found: Features, buckets: int) -> None:
        keys = found.keys()
        room = 1 << max(4, (2 * len(keys)).bit_length())
        owner = np.full(room, -1, np.int64)                # the occurrence whose bytes a slot holds
        self.slot = np.full(len(keys), -1, np.int64)
        eights = np.ndarray((max(len(found.bytes) - 7, 0),), "<u8", found.bytes, 0, (1,))
        place = (keys & np.uint64(room - 1)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            want = place[left]
            free = owner[want] < 0
            owner[want[free]] = left[free]                 # of several that want a free slot one gets it
            held = owner[want]
            same = (keys[held] == keys[left]) & (found.size[held] == found.size[left])
            same[same] = equal_bytes(eights, found.start[held[same]], found.start[left[same]], found.size[left[same]])
            self.slot[left[same]] = want[same]
            left = left[~same]
            place[left] = (place[left] + 1) & (room - 1)
        used = np.flatnonzero(owner >= 0)
        view = memoryview(found.bytes)
        self.bucket = np.zeros(room, np.int64)
        self.bucket[used] = [zlib.crc32(view[a:b]) % buckets for a, b in zip(found.start[owner[used]].tolist(), (found.start + found.size)[owner[used]].tolist())]
        self.count = np.bincount(self.slot, minlength=room)


def equal_bytes(eights: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether spans of one size hold the same bytes, eight at a time for all spans."""
    same = np.ones(len(a), bool)
    left = np.flatnonzero(a != b)
    done = 0
    while len(left):
        rest = size[left] - done
        apart = eights[a[left] + done] ^ eights[b[left] + done]
        short = rest < 8
        apart[short] &= _TAIL[rest[short]]
        same[left[apart != 0]] = False
        done += 8
        left = left[(apart == 0) & (rest > 8)]
    return same


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket: `buckets` numbers, summed on the executors."""
    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(buckets, np.int64)
        for part in text_slices(batches, 0):
            held = Interned(Features(part.column(0), longest), buckets)
            used = held.count > 0
            total += np.bincount(held.bucket[used], held.count[used], buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])
    rows = texts.where("text is not null").select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():         # at most `buckets` rows
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed target share over the smoothed raw share) of each bucket."""
    size, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1.0) * (s_all + size)) / ((s + 1.0) * (t_all + size)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def gumbel(doc_id: int | None, seed: str, sha256) -> int:
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, gain: np.ndarray, longest: int, seed: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row of docs(doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]):
        from hashlib import sha256
        for part in text_slices(batches, 1):
            found = Features(part.column(1), longest)
            held = Interned(found, len(gain))
            by_slot = gain[held.bucket]
            total = np.zeros(part.num_rows, np.int64)
            np.add.at(total, found.doc, by_slot[held.slot])
            noise = np.array([gumbel(i, seed, sha256) for i in part.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (
                found.words, np.bincount(found.doc, minlength=part.num_rows), total, total + noise))], ["doc_id", "n_words", "n_features", "weight", "score"])
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows with their place, from 1, in the given order; rows that tie in all of it come in any order.

    Rows are dealt by ranges of the order and numbered where they are; the only table with a
    row for each partition says how many rows come before it.
    """
    spark = rows.sparkSession
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = ", ".join([f"`{n}` {t}" for n, t in rows.dtypes] + ["part int", "here long"])

    def number(batches: Iterator[pa.RecordBatch]):
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen + 1, seen + n + 1))],
                                             [*batch.schema.names, "part", "here"])
            seen += n
    numbered = stored(rows.repartitionByRange(deal, *order).sortWithinPartitions(*order).mapInArrow(number, schema), "numbered")
    before = 0
    offsets = [(-1, 0)]
    for part, n in sorted(numbered.groupBy("part").agg(F.max("here")).collect()):      # one row a partition
        offsets.append((part, before))
        before += n
    offset = spark.createDataFrame(offsets, "part int, before long")
    return numbered.join(F.broadcast(offset), "part").withColumn(name, F.col("here") + F.col("before")).drop("part", "here", "before")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, share: int = 10,
             least_words: int = 20, seed: str = "2024") -> DataFrame:
    """(doc_id, n_features, weight, score, rank): a row for every row of docs(doc_id, text), target(text).

    share percent (rounded down) of the documents with at least `least_words` words are drawn,
    by descending score, then ascending doc_id (none last), and ranked from 1; rank is null for
    the others. Null texts have no words and weigh 0. Repeated rows are documents of their own,
    with scores of their shared doc_id; a row without doc_id draws the noise of an empty one.
    An empty target leaves smoothed shares; an empty docs gives no rows. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target.select("text"), longest, buckets))
    rows = weights(docs, gain, longest, seed).select(
        "doc_id", "n_words", "n_features", "weight", "score", F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "weights")
    fit = F.col("n_words") >= least_words
    drawn = rows.where(fit).count() * share // 100
    order = [F.when(fit, 0).otherwise(1).asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    place = ranked(rows, order)
    return place.select("doc_id", "n_features", "weight", "score", F.when(fit & (F.col("place") <= drawn), F.col("place")).alias("rank"))
