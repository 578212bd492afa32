"""Hard negatives by range search in a multiway hyperplane tree.

Each anchor's positives are its best rows of its own label; around each positive's score lies a
window, and the best rows of other labels in that window are its hard negatives.

The tree is a GNAT over whole-number vectors. One extra coordinate gives all of them the length
of the longest, so a window of inner products with an anchor is an annulus of distances around
it. A node has several split points; a vector goes to the nearest one, and for each split point
the node holds the least and greatest distance to the members of every sibling subtree. A
subtree whose distances to the anchor, as the ranges bound them, miss the annulus is left out.
Leaves score their members exactly, in whole numbers.

The root's split points come from a bounded sample and its cells hold all rows; a cell of many
rows is dealt into blocks, each with a tree of its own. Anchors are sent only to blocks of the
cells they reach. A task holds one block and one batch of anchors: rows arrive sorted, a
block's members before its anchors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlens.llm.common import slices, stored

#: Split points and members of a leaf, at most, in a block's tree.
SPLITS, LEAF = 16, 96
#: Cells of the root at most, rows for each cell at least, and vectors they are chosen from (on average).
CELLS, CELL_ROWS, SAMPLE = 64, 2048, 2048
#: Rows of a block: at most, and at least if there are enough (on average).
BLOCK, LEAST_BLOCK = 4096, 512
#: Anchors searched at a time.
ASKS = 256
#: Slack of a distance comparison, as a share of the longest distance: far above rounding, so nothing is lost.
SLACK = 1e-6
TOP = np.iinfo(np.int64).max


def packed(table: DataFrame) -> DataFrame:
    """(vec_id, label, vec, norm): components floor(256 * x) as packed 64-bit integers, padded to one length with zeros."""
    x = F.col("embedding").cast("array<double>")
    fit = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
           & F.forall(x, lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False))))
    rows = table.where(fit).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), x.alias("e"))
    width = rows.agg(F.max(F.size("e"))).first()[0] or 0

    def run(batches):
        for part in slices(batches, 4096):
            e = part.column(2)
            size = np.diff(e.offsets.to_numpy())
            at = np.arange(width) < size[:, None]
            v = np.zeros((part.num_rows, width))
            v[at] = np.floor(256 * e.flatten().to_numpy())
            whole = np.where(np.abs(v) < 2.0 ** 62, v, np.sign(v) * 2.0 ** 62).astype("<i8")
            f = whole.astype(float)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in whole], pa.binary()),
                                              pa.array((f * f).sum(1))], ["vec_id", "label", "vec", "norm"])
    return rows.mapInArrow(run, "vec_id long, label long, vec binary, norm double")


def unpacked(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), -1)


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole-number inner products: in doubles while no sum can leave their whole numbers, then in
    longs, then in Python integers held at the ends of a long."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2.0 ** 53:
        return np.rint(q.astype(float) @ x.astype(float).T).astype(np.int64)
    if most < 2.0 ** 62:
        return q @ x.T
    return np.clip(q.astype(object) @ x.astype(object).T, -TOP, TOP).astype(np.int64)


def spread_points(dots: np.ndarray, many: int) -> list[int]:
    """Greedy choice of rows far from each other; dots holds lifted inner products of all rows, whose lengths are equal."""
    chosen = [0]
    near = dots[0].copy()
    while len(chosen) < many:
        far = int(near.argmin())
        if near[far] >= dots[far, far]:                    # all others coincide with a chosen one
            break
        chosen.append(far)
        near = np.maximum(near, dots[far])
    return chosen


class Lifted:
    """Vectors with the extra coordinate that makes their squared lengths `top`."""

    def __init__(self, vecs: np.ndarray, top: float) -> None:
        self.vecs, self.top = vecs.astype(float), top
        self.extra = np.sqrt(np.maximum(top - (self.vecs * self.vecs).sum(1), 0))

    def take(self, at: np.ndarray) -> Lifted:
        new = object.__new__(Lifted)
        new.vecs, new.top, new.extra = self.vecs[at], self.top, self.extra[at]
        return new

    def dots(self, other: Lifted) -> np.ndarray:
        return self.vecs @ other.vecs.T + np.outer(self.extra, other.extra)

    def to(self, other: Lifted) -> np.ndarray:
        return np.sqrt(np.maximum(2 * self.top - 2 * self.dots(other), 0))

    def from_query(self, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(norm[:, None] + self.top - 2 * (q.astype(float) @ self.vecs.T), 0))


def annulus(norm: np.ndarray, top: float, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of vectors whose inner products lie in [low, high]; a score no vector can have gives an empty one."""
    inner_edge, outer = norm + top - 2.0 * high, norm + top - 2.0 * low
    slack = SLACK * SLACK * (norm + top)
    return np.sqrt(np.maximum(inner_edge, 0)), np.where(outer < -slack, -np.inf, np.sqrt(np.maximum(outer, 0)))


def reached(far: np.ndarray, least: np.ndarray, most: np.ndarray, inside: np.ndarray, outside: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """(asks, subtrees): whether a subtree's distances, as the ranges to all split points bound them, meet the annulus."""
    d = far[:, :, None]
    low = np.maximum(np.maximum(d - most, least - d), 0).max(1)
    high = (d + most).min(1)
    return (low <= outside[:, None] + slack[:, None]) & (high >= inside[:, None] - slack[:, None])


class Tree:
    """The tree of one block."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray, top: float) -> None:
        self.ids, self.labels, self.vecs, self.top = ids, labels, vecs, top
        self.points = Lifted(vecs, top)
        self.root = self.grown(np.arange(len(ids)))

    def grown(self, at: np.ndarray):
        if len(at) <= LEAF:
            return at
        some = at[np.linspace(0, len(at) - 1, min(len(at), 4 * SPLITS)).astype(int)]
        tried = self.points.take(some)
        chosen = some[spread_points(tried.dots(tried), min(SPLITS, -(-len(at) // LEAF) + 1))]
        if len(chosen) < 2:
            return at
        splits = self.points.take(chosen)
        far = splits.to(self.points.take(at))
        owner = far.argmin(0)
        used = np.unique(owner)
        if len(used) < 2:
            return at
        least = np.stack([far[:, owner == j].min(1) for j in used], 1)
        most = np.stack([far[:, owner == j].max(1) for j in used], 1)
        return splits, least, most, [self.grown(at[owner == j]) for j in used]

    def search(self, q: np.ndarray, norm: np.ndarray, ask: np.ndarray, low: np.ndarray, high: np.ndarray,
               fits: Callable[[np.ndarray, np.ndarray], np.ndarray], keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, score, id) of the best `keep` members, by score then id, in each window.

        ask gives the row of q a window belongs to; fits(rows of q, members) says which members count for it.
        """
        low = low.copy()
        slack = SLACK * np.sqrt(norm + self.top)
        found: list[tuple[np.ndarray, ...]] = []
        todo = [(self.root, np.flatnonzero(low <= high))]
        while todo:
            node, w = todo.pop()
            w = w[low[w] <= high[w]]
            if not len(w):
                continue
            if isinstance(node, np.ndarray):
                rows, back = np.unique(ask[w], return_inverse=True)
                score = inner(q[rows], self.vecs[node])[back]
                hit = (score >= low[w][:, None]) & (score <= high[w][:, None]) & fits(rows, node)[back]
                i, j = np.nonzero(hit)
                w_hit, s_hit, id_hit = first_of(w[i], score[i, j], self.ids[node[j]], keep)
                found.append((w_hit, s_hit, id_hit))
                full = np.flatnonzero(np.bincount(w_hit, minlength=len(low)) >= keep)
                if len(full):                              # the last of `keep` kept ones is a safe lower end from now on
                    last = s_hit[np.searchsorted(w_hit, full, "right") - 1]
                    low[full] = np.maximum(low[full], last)
                continue
            splits, least, most, below = node
            rows, back = np.unique(ask[w], return_inverse=True)
            far = splits.from_query(q[rows], norm[rows])[back]
            inside, outside = annulus(norm[ask[w]], self.top, low[w].astype(float), high[w].astype(float))
            alive = reached(far, least, most, inside, outside, slack[ask[w]])
            todo += [(child, w[alive[:, j]]) for j, child in enumerate(below)]
        if not found:
            return (np.empty(0, np.int64),) * 3
        return first_of(*(np.concatenate(x) for x in zip(*found)), keep)


def first_of(window: np.ndarray, score: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first `keep` of each window by descending score, then id, windows in order."""
    order = np.lexsort((ids, -score, window))
    window, score, ids = window[order], score[order], ids[order]
    start = np.searchsorted(window, window, "left")
    top = np.arange(len(window)) - start < keep
    return window[top], score[top], ids[top]


class Root:
    """Split points and ranges of the root, and how its cells are dealt into blocks."""

    def __init__(self, members: DataFrame, rows: int, block: int | None) -> None:
        spark = members.sparkSession
        self.top = float(members.agg(F.max("norm")).first()[0] or 0.0)
        sample = [r.vec for r in members.sample(min(1.0, SAMPLE / rows), seed=1).select("vec").collect()] or [members.first().vec]
        vecs = np.frombuffer(b"".join(sample), "<i8").reshape(len(sample), -1)
        every = Lifted(vecs, self.top)
        self.splits = every.take(np.array(spread_points(every.dots(every), max(1, min(CELLS, rows // CELL_ROWS)))))
        splits, many = self.splits, len(self.splits.vecs)

        def place(batches):
            for part in slices(batches, 2048):
                cell = splits.to(Lifted(unpacked(part.column("vec")), splits.top)).argmin(0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32))], [*part.schema.names, "cell"])

        def ranges(batches):
            least, most, count = np.full((many, many), np.inf), np.full((many, many), -np.inf), np.zeros(many, np.int64)
            for part in slices(batches, 2048):
                far, cell = splits.to(Lifted(unpacked(part.column("vec")), splits.top)), part.column("cell").to_numpy()
                for j in np.unique(cell):
                    least[:, j] = np.minimum(least[:, j], far[:, cell == j].min(1))
                    most[:, j] = np.maximum(most[:, j], far[:, cell == j].max(1))
                count += np.bincount(cell, minlength=many)
            i, j = (x.ravel() for x in np.indices((many, many)))
            keep = count[j] > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (i.astype(np.int32), j.astype(np.int32), least.ravel(), most.ravel(), count[j])],
                                             ["i", "j", "least", "most", "n"])
        self.place = lambda df: df.mapInArrow(place, ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", cell int")
        self.members = stored(self.place(members), "members")
        self.least, self.most, count = np.full((many, many), np.inf), np.full((many, many), -np.inf), np.zeros(many, np.int64)
        found = self.members.select("vec", "cell").mapInArrow(ranges, "i int, j int, least double, most double, n long")
        for i, j, a, b, n in found.groupBy("i", "j").agg(F.min("least"), F.max("most"), F.sum("n")).collect():   # at most CELLS squared
            self.least[i, j], self.most[i, j], count[j] = a, b, n
        deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
        size = block or min(BLOCK, max(LEAST_BLOCK, rows // (2 * deal)))
        self.deal = np.maximum(-(-count // size), 1)
        self.first = np.cumsum(self.deal) - self.deal

    def own_block(self, df: DataFrame) -> DataFrame:
        """df(vec, cell) with the block its row belongs to."""
        first, deal = (F.array(*[F.lit(int(x)) for x in xs]) for xs in (self.first, self.deal))
        return df.withColumn("block", (F.get(first, F.col("cell")) + F.pmod(F.xxhash64("vec"), F.get(deal, F.col("cell")))).cast("int"))

    def send(self, asks: DataFrame) -> DataFrame:
        """asks(vec, norm, lows, highs) to all blocks of the cells that a window reaches."""
        splits, least, most, first, deal = self.splits, self.least, self.most, self.first, self.deal

        def run(batches):
            for part in slices(batches, ASKS):
                q, norm = unpacked(part.column("vec")), part.column("norm").to_numpy()
                lows, highs, ask = windows(part)
                inside, outside = annulus(norm[ask], splits.top, lows.astype(float), highs.astype(float))
                far = splits.from_query(q, norm)[ask]
                meets = np.concatenate([np.empty((0, len(deal)), bool)] + [reached(
                    far[s:s + ASKS], least, most, inside[s:s + ASKS], outside[s:s + ASKS], SLACK * np.sqrt(norm + splits.top)[ask[s:s + ASKS]])
                    for s in range(0, len(ask), ASKS)])
                any_of = np.zeros((part.num_rows, len(deal)), bool)
                np.logical_or.at(any_of, ask, meets & np.isfinite(least[0]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([
                    [b for c in np.flatnonzero(row).tolist() for b in range(first[c], first[c] + deal[c])] for row in any_of], pa.list_(pa.int32()))],
                    [*part.schema.names, "blocks"])
        sent = asks.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in asks.dtypes) + ", blocks array<int>")
        return sent.withColumn("block", F.explode("blocks")).drop("blocks")

    def search(self, asks: DataFrame, same: bool, keep: int) -> DataFrame:
        """(qid, own, place, score, vec_id): for each ask's windows the best `keep` members of each block it was sent to.

        asks(qid, own, label, vec, norm, lows, highs, block); place counts an ask's windows from 0;
        same: members of the ask's label count, else those of other labels; an ask's own vec_id never does.
        """
        top = self.top

        def run(batches):
            held: list[pa.RecordBatch] = []
            block = tree = None
            for batch in batches:
                at = batch.column("block").to_numpy()
                member = batch.column("ask").to_numpy(zero_copy_only=False) == 0
                edges = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (member[1:] != member[:-1])]).tolist() + [len(at)]
                for a, b in zip(edges, edges[1:]):
                    if at[a] != block:
                        held, block, tree = [], at[a], None
                    part = batch.slice(a, b - a)
                    if member[a]:
                        held.append(part)
                        continue
                    if not held:
                        continue
                    if tree is None:
                        whole = pa.Table.from_batches(held)
                        tree = Tree(whole["qid"].to_numpy(), whole["label"].to_numpy(), unpacked(whole["vec"]), top)
                    for few in slices(iter([part]), ASKS):
                        yield answer(tree, few)

        def answer(tree: Tree, part: pa.RecordBatch) -> pa.RecordBatch:
            q, norm, label, qid = unpacked(part.column("vec")), part.column("norm").to_numpy(), part.column("label").to_numpy(), part.column("qid").to_numpy()
            lows, highs, ask = windows(part)

            def fits(rows, members):
                alike = label[rows][:, None] == tree.labels[members]
                return (alike if same else ~alike) & (qid[rows][:, None] != tree.ids[members])
            w, score, ids = tree.search(q, norm, ask, lows, highs, fits, keep)
            start = np.searchsorted(ask, ask, "left")
            place = np.arange(len(ask)) - start
            return pa.RecordBatch.from_arrays([pa.array(qid[ask[w]]), pa.array(part.column("own").to_numpy()[ask[w]]), pa.array(place[w].astype(np.int32)),
                                               pa.array(score), pa.array(ids)], ["qid", "own", "place", "score", "vec_id"])
        none = F.lit(None).cast("array<long>")
        members = self.own_block(self.members).select(F.lit(0).alias("ask"), F.col("vec_id").alias("qid"), F.lit(0).cast("long").alias("own"), "label", "vec", "norm",
                                                      none.alias("lows"), none.alias("highs"), "block")
        asks = asks.select(F.lit(1).alias("ask"), "qid", "own", "label", "vec", "norm", "lows", "highs", "block")
        return (members.unionByName(asks).repartition("block").sortWithinPartitions("block", "ask")
                .mapInArrow(run, "qid long, own long, place int, score long, vec_id long"))


def windows(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower and upper ends of all windows of a batch, and the row each belongs to."""
    lows, highs = part.column("lows"), part.column("highs")
    return lows.flatten().to_numpy(), highs.flatten().to_numpy(), np.repeat(np.arange(part.num_rows), np.diff(lows.offsets.to_numpy()))


def best(rows: DataFrame, keys: list[str], keep: int) -> DataFrame:
    """The first `keep` rows of each key by descending score, then vec_id, with their rank from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def hard_negatives(table: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   block: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of table(vec_id, label, embedding).

    Anchors are rows whose vec_id is divisible by `every`; positives the best others of their
    label; negatives the best rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Scores are inner products
    of floor(256 * x); higher ones come first, ties by smaller vec_id. Fewer rows than asked for
    are all returned; a positive without negatives gives no row, nor does a negative
    positive_score while low <= high.

    Rows with a null vec_id, label or vector, or a null or non-finite component take no part.
    Shorter vectors are padded with zeros. Repeated rows count once; rows that share a vec_id
    with another label or vector are rows of their own, but never each other's positive or
    negative. Components are held at 2**62 and scores at the ends of a long. An empty table gives
    no rows. Other columns are ignored.
    """
    spark = table.sparkSession
    vectors = stored(packed(table.select("vec_id", "label", "embedding")), "vectors").dropDuplicates(["vec_id", "label", "vec"])
    vectors = stored(vectors, "rows")
    need = max(positives, negatives) + 1
    alike = Window.partitionBy("vec", "label").orderBy("vec_id")      # of rows equal in vector and label an anchor needs no more
    members = stored(vectors.withColumn("at", F.row_number().over(alike)).where(F.col("at") <= need).drop("at"), "distinct")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = members.count()
    if not rows:
        return spark.createDataFrame([], schema)
    root = Root(members, rows, block)
    asks = root.own_block(root.place(vectors.where(F.col("vec_id") % every == 0))).select(
        F.col("vec_id").alias("qid"), F.xxhash64("vec", "label").alias("own"), "label", "vec", "norm", "block")
    asks = stored(asks, "asks")
    window = lambda a, b: (F.array(a).alias("lows"), F.array(b).alias("highs"))
    anything = window(F.lit(-int(TOP)).cast("long"), F.lit(int(TOP)).cast("long"))

    near = root.search(asks.select("*", *anything), True, positives)             # in an anchor's own block: a safe cutoff
    cutoff = near.groupBy("qid", "own").agg(F.when(F.count("*") >= positives, F.min("score")).alias("cutoff"))
    told = asks.drop("block").join(cutoff, ["qid", "own"], "left").select(
        "qid", "own", "label", "vec", "norm", *window(F.coalesce("cutoff", F.lit(-int(TOP))), F.lit(int(TOP)).cast("long")))
    alike = best(root.search(root.send(stored(told, "cutoffs")), True, positives), ["qid", "own"], positives)
    pairs = stored(alike.select("qid", "own", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    ceiling = lambda x: F.ceil(x.cast("decimal(38,0)") / 100).cast("long")
    floor = lambda x: F.floor(x.cast("decimal(38,0)") / 100).cast("long")
    bounds = pairs.select("qid", "own", "nth", ceiling(F.col("positive_score").cast("decimal(38,0)") * low).alias("a"), floor(F.col("positive_score").cast("decimal(38,0)") * high).alias("b"))
    bounds = bounds.groupBy("qid", "own").agg(F.sort_array(F.collect_list(F.struct("nth", "a", "b"))).alias("w"))    # at most `positives` each
    told = asks.drop("block").join(bounds, ["qid", "own"]).select("qid", "own", "label", "vec", "norm", F.col("w.a").alias("lows"), F.col("w.b").alias("highs"))
    apart = best(root.search(root.send(stored(told, "windows")), False, negatives), ["qid", "own", "place"], negatives)
    apart = apart.select("qid", "own", (F.col("place") + 1).alias("nth"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (pairs.join(apart, ["qid", "own", "nth"])
            .select(F.col("qid").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
