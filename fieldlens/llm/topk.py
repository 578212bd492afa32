"""Exact top-k inner products by three phases under a uniform threshold.

The dimensions are divided into FRAGMENTS lists of local scores, each shifted by the least
local score a query sees in it so that none is negative; a vector's score is the sum over
its lists. Phase 1 gathers, from every block of vectors, the best entries of each list with
their sums; the k-th best sum over all blocks is a safe cutoff. Phase 2 tells every block the
cutoffs and collects, list by list, the entries of at least cutoff / FRAGMENTS: a vector with
none is below the cutoff. Phase 3 resolves the other local scores of those vectors where they
are and hands on exact scores of at least the cutoff, a few a query, for the final ranking.

Equal vectors are one candidate that keeps its smallest k + 1 ids: with its own id left out a
query needs no more of them. Queries meet vectors block by block; nothing is broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm.common import map_slices, stored

FRAGMENTS = 2
#: Vectors a block holds at most and at least (on average), and queries a block holds.
BLOCK, LEAST_BLOCK, QUERY_BLOCK = 8192, 1024, 2048
SALTS = 16
EXACT = 2.0 ** 53


def whole_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, vec): components floor(256 * x) as packed 64-bit integers, padded to one length with zeros."""
    x = F.col("embedding").cast("array<double>")
    fit = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    rows = table.where(fit).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 256)).alias("e"))
    width = rows.agg(F.max(F.size("e"))).first()[0] or 0

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            packed = []
            for e in part.column(1).to_pylist():
                v = np.zeros(width, "<i8")
                v[:len(e)] = e
                packed.append(v.tobytes())
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["vec_id", "vec"])
        return work
    return map_slices(rows, make, "vec_id long, vec binary")


def smallest_ids(vectors: DataFrame, k: int) -> DataFrame:
    """(cid, vec, ids): distinct vectors with their k smallest ids in order; salted, as one vector may be very common."""
    pairs = vectors.select("vec_id", "vec", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")).dropDuplicates(["vec", "vec_id", "salt"])
    for keys in (["vec", "salt"], ["vec"]):
        pairs = pairs.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("at") <= k).drop("at")
    return pairs.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("cid"), "vec", "ids")


def unpack(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), -1)


def product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while no sum can leave their whole numbers."""
    if q.size and c.size and float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < EXACT:
        return np.rint(q.astype(float) @ c.astype(float).T).astype(np.int64)
    return q @ c.T


def cuts(width: int) -> list[slice]:
    edge = [width * i // FRAGMENTS for i in range(FRAGMENTS + 1)]
    return [slice(a, b) for a, b in zip(edge, edge[1:])]


def top_k(table: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose vec_id is divisible by `every`.

    table(vec_id, embedding). Ties go to the smaller vec_id; a query never meets its own
    vec_id. Rows with a null vec_id, a null vector or a null or non-finite component take no
    part. Shorter vectors are padded with zeros. Repeated rows count once; rows that share a
    vec_id with different vectors are candidates each and queries each. With fewer than k
    candidates all are returned; an empty table gives no rows. Other columns are ignored.
    """
    spark = table.sparkSession
    vectors = stored(whole_vectors(table), "vectors")
    need = k + 1
    distinct = stored(smallest_ids(vectors, need), "distinct")
    asked = vectors.where(F.col("vec_id") % every == 0).distinct().select(F.col("vec_id").alias("qid"), F.xxhash64("vec").alias("own"), "vec")
    asked = stored(asked, "asked")
    rows, queries = distinct.count(), asked.count()
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-rows // BLOCK), min(2 * deal, -(-rows // LEAST_BLOCK)), 1)
    asks = max(-(-queries // QUERY_BLOCK), 1)

    spread = distinct.select(F.pmod(F.xxhash64("vec"), F.lit(blocks)).alias("block"), "cid", "vec").withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))

    def meet(ask_rows: DataFrame, work, schema: str) -> DataFrame:
        left = (ask_rows.withColumn("ask", F.pmod(F.xxhash64("qid"), F.lit(asks)).cast("int"))
                .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))
        return left.groupBy("block", "ask").cogroup(spread.groupBy("block", "ask")).applyInArrow(work, schema)

    def chunks(left: pa.Table, right: pa.Table):
        """(queries, local scores of each list, vectors' ids) for some queries of a block at a time."""
        if left.num_rows and right.num_rows:
            q, c, cid = unpack(left["vec"]), unpack(right["vec"]), right["cid"].to_numpy()
            for a in range(0, len(q), 256):
                yield slice(a, a + 256), [product(q[a:a + 256, part], c[:, part]) for part in cuts(q.shape[1])], cid

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        """Phase 1: per query the least score of each list, and the best sums among the lists' best entries."""
        rows: list[pa.Table] = []
        for part, scores, _ in chunks(left, right):
            total, listed = sum(scores), np.zeros(scores[0].shape, bool)
            n = min(need, total.shape[1])
            for s in scores:
                np.put_along_axis(listed, np.argpartition(s, total.shape[1] - n, axis=1)[:, -n:], True, 1)
            sums = np.where(listed, total, np.iinfo(np.int64).min)
            sums = np.partition(sums, total.shape[1] - n, axis=1)[:, -n:]
            rows.append(pa.table({"qid": left["qid"][part], "own": left["own"][part], "sums": pa.array(list(sums), pa.list_(pa.int64())),
                                  **{f"floor{f}": s.min(1) for f, s in enumerate(scores)}}))
        return pa.concat_tables(rows) if rows else pa.table(
            {"qid": pa.array([], pa.int64()), "own": pa.array([], pa.int64()), "sums": pa.array([], pa.list_(pa.int64())), **{n: pa.array([], pa.int64()) for n in floor}})
    floor = [f"floor{f}" for f in range(FRAGMENTS)]
    local = stored(meet(asked, gather, "qid long, own long, sums array<long>, " + ", ".join(f"{n} long" for n in floor)), "local")
    by_query = Window.partitionBy("qid", "own")
    floors = local.groupBy("qid", "own").agg(*[F.min(n).alias(n) for n in floor])
    cutoff = (local.select("qid", "own", F.explode("sums").alias("cutoff"))
              .withColumn("at", F.row_number().over(by_query.orderBy(F.desc("cutoff")))).where(F.col("at") == need).drop("at"))
    told = stored(asked.join(floors, ["qid", "own"]).join(cutoff, ["qid", "own"], "left"), "cutoffs")

    def collect(left: pa.Table, right: pa.Table) -> pa.Table:
        """Phases 2 and 3: entries of at least the uniform share of the cutoff (all, if there is none), resolved exactly."""
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            qid, own, lows = left["qid"].to_numpy(), left["own"].to_numpy(), np.stack([left[n].to_numpy() for n in floor], 1)
            told_cut = left["cutoff"].to_pylist()
            least = np.array([np.iinfo(np.int64).min if x is None else x for x in told_cut], np.int64)
            share = np.array([-1 if x is None else x - int(b) for x, b in zip(told_cut, lows.sum(1))], np.int64)    # shifted cutoff
        for part, scores, cid in chunks(left, right):
            enough = np.zeros(scores[0].shape, bool)
            for f, s in enumerate(scores):
                enough |= (s - lows[part, f, None]) * FRAGMENTS >= share[part, None]
            i, j = np.nonzero(enough)
            exact = sum(s[i, j] for s in scores)
            keep = exact >= least[part][i]
            i, j = i[keep], j[keep]
            for column, x in zip(out, (qid[part][i], own[part][i], cid[j], exact[keep])):
                column.append(x)
        return pa.table({n: np.concatenate([np.empty(0, np.int64), *x]) for n, x in zip(("qid", "own", "cid", "score"), out)})
    resolved = meet(told, collect, "qid long, own long, cid long, score long")
    groups = (resolved.withColumn("at", F.row_number().over(by_query.orderBy(F.desc("score"), "cid")))
              .where(F.col("at") <= need).join(distinct.select("cid", "ids"), "cid")
              .select("qid", "own", "score", F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("qid")))
    return (groups.withColumn("rank", F.row_number().over(by_query.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
            .select(F.col("qid").alias("query_id"), "rank", "vec_id", "score"))
