"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint folds the 64-bit hashes of a text's word shingles by majority. Two
fingerprints that differ in at most `radius` bits differ, in some part i of any division of
the 64 bits, in at most t_i bits, provided the sum of (t_i + 1) is radius + 1; a part with
t_i = -1 is not probed. Correlated bits share a part, and the t_i come from dynamic
programming on estimated candidate counts, so a dense part gets a strict threshold.

"At most t bits differ in a part" is probed as equality on the part without some t of its
bits, so candidates meet through equi keys (mask, value). A key's group never grows beyond
`bucket` rows: a larger one is divided again by the same principle over the bits its key
leaves free, which is exact, and a group that leaves f bits free has at most 2^f members.
Groups emit links that join the same members as all their close pairs, never all pairs.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm import nearcopies
from fieldlens.llm.common import bounded_batches, discard, map_slices, stored
from fieldlens.llm.components import linked_components

RADIUS = 3
WORDS = 3
BUCKET = 4096
#: Seconds a probe row and a candidate pair cost, and the rows that a mask's place in the plan is worth.
ROW_COST, PAIR_COST, PLAN_ROWS = 1e-6, 5e-9, 1000
ALL = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority fold of the shingle hashes; a bit is set when over half of them set it."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = list(map(b" ".join, zip(*(tokens[i:] for i in range(words)))))
    hashes = np.array(list(map(xxhash.xxh64_intdigest, shingles, repeat(42))), np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65536):
        part = hashes[start:start + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): one row a document; null text is an empty one, whose fingerprint is 0."""
    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            prints = [signed(text_fingerprint(t, words)) for t in part.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])
        return work
    return map_slices(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), make, "doc_id long, fp long")


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each two bits how many set both."""
    def run(batches):
        both = np.zeros((64, 64), np.int64)
        rows = 0
        for part in batches:
            bits = np.unpackbits(part.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            for start in range(0, len(bits), 65536):
                x = bits[start:start + 65536].astype(np.float32)
                both += (x.T @ x).astype(np.int64)
            rows += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4097, dtype=np.int32)), pa.array(np.append(both.ravel(), rows))], ["cell", "n"])
    got = dict(nodes.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n")).collect())
    table = np.array([got.get(i, 0) for i in range(4096)], np.int64).reshape(64, 64)
    return got.get(4096, 0), table


def group_bits(rows: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Divide the bits so that correlated ones share a part."""
    n = max(rows, 1)
    share = np.diag(both) / n
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    near = np.abs((both / n - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(near, 0)
    left, groups = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        seed = max(sorted(left), key=lambda b: near[b, sorted(left)].sum())
        group = [seed]
        left.discard(seed)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: near[b, group].sum())
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def mask_of(bits) -> int:
    return sum(1 << b for b in bits)


def pair_counts(nodes: DataFrame, masks: list[int]) -> tuple[list[float], list[int]]:
    """For each mask the candidate pairs that agree on it, and its largest group."""
    keyed = nodes.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("k", "value"))
    sizes = keyed.groupBy("k", "value").agg(F.count("*").alias("n"))
    got = {k: (s, m) for k, s, m in sizes.groupBy("k").agg(F.sum(F.col("n") * (F.col("n") - 1.0) / 2), F.max("n")).collect()}
    return [got.get(k, (0.0, 0))[0] for k in range(len(masks))], [got.get(k, (0.0, 0))[1] for k in range(len(masks))]


def allocate(costs: list[list[float]], budget: int) -> list[int]:
    """Thresholds t_i >= -1 with the sum of (t_i + 1) equal to budget and the least total cost.

    costs[i][t + 1] is the cost of part i at threshold t; costs[i][0] is 0.
    """
    best = {0: (0.0, [])}
    for part in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for units, more in enumerate(part):
                total = used + units
                if total <= budget and (total not in step or cost + more < step[total][0]):
                    step[total] = (cost + more, chosen + [units - 1])
        best = step
    return best[budget][1]


def probe_masks(nodes: DataFrame, radius: int = RADIUS) -> tuple[list[int], int]:
    """The masks to probe, chosen over divisions into 2 to radius + 1 parts, and the largest group if known (else -1)."""
    rows, both = bit_counts(nodes)
    divisions = [group_bits(rows, both, parts) for parts in range(2, radius + 2)]
    pairs, largest = pair_counts(nodes, [mask_of(g) for groups in divisions for g in groups])
    share = np.diag(both) / max(rows, 1)
    agree = np.maximum(share ** 2 + (1 - share) ** 2, 0.5)
    best = None
    at = 0
    for groups in divisions:
        costs = []
        for g in groups:
            exact = pairs[at + len(costs)]
            loose = [1.0]                                  # elementary sums of 1 / agree: expected growth when t bits are left out
            for b in g:
                loose = [x + (loose[i - 1] / agree[b] if i else 0) for i, x in enumerate(loose + [0.0])][:radius + 1]
            ways = [1]
            for _ in g:
                ways = [x + (ways[i - 1] if i else 0) for i, x in enumerate(ways + [0])][:radius + 1]
            costs.append([0.0] + [(rows + PLAN_ROWS) * ways[t] * ROW_COST + exact * loose[t] * PAIR_COST for t in range(min(radius, len(g)) + 1)])
        chosen = allocate(costs, radius + 1)
        total = sum(c[t + 1] for c, t in zip(costs, chosen))
        if best is None or total < best[0]:
            masks = [mask_of(g) & ~mask_of(out) & ALL for g, t in zip(groups, chosen) if t >= 0 for out in combinations(g, t)]
            known = max([largest[at + i] for i, t in enumerate(chosen) if t >= 0]) if max(chosen) == 0 else -1
            best = (total, masks, known)
        at += len(groups)
    return best[1], best[2]


def finer(mask: int, radius: int) -> list[int]:
    """Divide the bits a mask leaves free into radius + 1 parts: close members agree on one of them."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | mask_of(free[i::radius + 1]) for i in range(radius + 1)]


def group_links(prints: np.ndarray, ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same members as all close pairs of one group do.

    A member reached takes all unreached members near it, so a member is compared only
    with those not reached yet.
    """
    left = np.arange(1, len(prints))
    src, dst, queue = [], [], [0]
    while queue or len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
        i = queue.pop()
        near = np.bitwise_count(prints[left] ^ prints[i]) <= radius
        if near.any():
            hit = left[near]
            src.append(np.full(len(hit), ids[i]))
            dst.append(ids[hit])
            queue.extend(hit.tolist())
            left = left[~near]
    none = np.empty(0, np.int64)
    return (np.concatenate(src), np.concatenate(dst)) if src else (none, none)


def bucket_links(keyed: DataFrame, radius: int) -> DataFrame:
    """(src, dst) links inside each (k, value) group of at most BUCKET rows."""
    def run(batches):
        def solve(k, value, prints, ids):
            same = (k[1:] == k[:-1]) & (value[1:] == value[:-1])
            starts = np.flatnonzero(np.r_[True, ~same])
            sizes = np.diff(np.r_[starts, len(k)])
            src, dst = [], []
            small = np.repeat(sizes <= 16, sizes)
            for step in range(1, 16):                      # small groups: compare rows `step` apart, all groups at once
                if len(k) <= step:
                    break
                hit = (k[step:] == k[:-step]) & (value[step:] == value[:-step]) & small[step:]
                if not hit.any():
                    break
                at = np.flatnonzero(hit)
                at = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= radius]
                src.append(ids[at])
                dst.append(ids[at + step])
            for s, n in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist()):
                a, b = group_links(prints[s:s + n], ids[s:s + n], radius)
                src.append(a)
                dst.append(b)
            none = np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *src])), pa.array(np.concatenate([none, *dst]))], ["src", "dst"])

        held = None
        for part in batches:
            now = [part.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            now[2] = now[2].view(np.uint64)
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])       # the last group may go on in the next batch
            cut = int(np.argmax(last))
            held = [x[cut:] for x in now]
            if cut:
                yield solve(*(x[:cut] for x in now))
        if held is not None and len(held[0]):
            yield solve(*held)
    return (keyed.repartition("k", "value").sortWithinPartitions("k", "value")
            .mapInArrow(run, "src long, dst long"))


def close_links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(src, dst) links that connect all nodes(fp, id) whose fingerprints differ in at most `radius` bits."""
    masks, largest = probe_masks(nodes, radius)
    rows, links = nodes.select("fp", "id"), None
    parent = None
    while True:
        values = [F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value")) for k, m in enumerate(masks)]
        if parent is None:
            keyed = rows.select(F.explode(F.array(*values)).alias("key"), "fp", "id")
        else:                                              # only the masks made from a row's own group
            keyed = rows.select(F.explode(F.array(*[F.when(F.col("k") == p, v) for p, v in zip(parent, values)])).alias("key"), "fp", "id").where("key is not null")
        keyed = keyed.select("key.k", "key.value", "fp", "id")
        hot = None
        if not 0 <= largest <= bucket:
            hot = keyed.groupBy("k", "value").agg(F.count("*").alias("n")).where(F.col("n") > bucket).drop("n")
            hot = stored(hot, "hot")
            wide = [r[0] for r in hot.select("k").distinct().collect()]      # at most one row a mask
            if not wide:
                hot = None
        cold = keyed if hot is None else keyed.join(hot, ["k", "value"], "left_anti")
        more = bucket_links(cold, radius)
        links = more if links is None else links.unionByName(more)
        if hot is None:
            return links
        rows = stored(keyed.join(hot, ["k", "value"], "left_semi").select("k", "fp", "id"), "wide")
        made = [(k, m) for k in wide for m in finer(masks[k], radius)]
        parent, masks, largest = [k for k, _ in made], [m for _, m in made], -1


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text).

    Null or wordless text has fingerprint 0 and is linked like any other. Repeated rows each
    give a row. A row without doc_id keeps its fingerprint, takes no part in linking and has
    a null component. Other columns are ignored. An empty table gives no rows.
    """
    prints = stored(fingerprints(docs, words), "fingerprints")
    nodes = stored(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    found = linked_components(close_links(nodes, radius, bucket))
    labels = nodes.join(found, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    labels = stored(labels, "labels")
    discard(nodes, found)
    return (prints.join(labels, "fp", "left")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies: that of its smallest doc_id.

    Near copies share at least four fifths of their five-word shingles. The components of
    `near_duplicates` are decided on the texts; what three words and three bits miss, `nearcopies`
    finds. It also says which row stays where ids or rows repeat.
    """
    bounded_batches(docs.sparkSession)
    return nearcopies.keep_one(docs, near_duplicates(docs))
