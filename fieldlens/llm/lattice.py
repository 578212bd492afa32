"""Document probability under a unigram piece model, over all segmentations.

A word with its leading mark is a lattice whose arcs are the vocabulary's pieces; a document
is its words and one end piece. No piece reaches across a word, so the document's marginal
probability is the product of its words', each the total over all paths by a forward
recursion in log space. Letters without a piece of their own are spelled by byte pieces.

The vocabulary and the order of its scores exist: the scores are ranks, read as Zipf weights.
One round of expected counts over the corpus words (forward-backward, weighted by how often
each word occurs) turns them into probabilities.

Words are counted and scored once each, in a table spread over the cluster. Words that hold at
least 1 / FREQUENT of all tokens, so at most FREQUENT of them, are sent to all tasks; the
others are joined, and as none of them is as common as that no key is hot.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import fold, slices, stored

MARK = "▁"
FREQUENT = 1 << 19
#: Distinct words a task holds before it hands their counts on; bounds memory only.
HELD_WORDS = 150_000
#: Words per numpy batch, and symbols per batch at most (one long word is a batch of its own).
BATCH_WORDS, BATCH_SYMBOLS = 20_000, 400_000
#: Ranks this close to the top are near alike in the Zipf reading.
ZIPF_SHIFT = 10.0
NEG = -np.inf


def load_pieces(model_path: str) -> list[tuple[str, float]]:
    """(piece, starting weight): ordinary and byte pieces of a sentencepiece file."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    found = []
    for i in range(len(model)):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or MARK in piece[1:]:
            continue
        found.append((piece, len(model) if model.is_byte(i) else -model.get_score(i)))
    return [(p, 1.0 / (rank + ZIPF_SHIFT)) for p, rank in found]


class Lattice:
    """Forward and backward recursions over many words at once."""

    def __init__(self, pieces: list[str], logp: np.ndarray):
        """logp: natural log probability of each piece, then that of the end."""
        self.logp = np.asarray(logp, np.float64)
        edges: dict[tuple[int, int], int] = {}
        self.piece_of = [-1]
        self.byte = np.full(256, -1, np.int64)
        for number, piece in enumerate(pieces):
            if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
                self.byte[int(piece[3:5], 16)] = number
                continue
            node = 0
            for c in piece:
                key = (node, ord(c))
                if key not in edges:
                    edges[key] = len(self.piece_of)
                    self.piece_of.append(-1)
                node = edges[key]
            self.piece_of[node] = number
        keys = np.array([n << 21 | c for n, c in edges] + [1 << 62], np.int64)
        order = np.argsort(keys)
        self.keys, self.target = keys[order], np.array([*edges.values(), 0], np.int64)[order]
        self.piece_of = np.array(self.piece_of, np.int64)

    def arcs(self, words: list[str]):
        """Arcs (from, to, piece) between nodes of all words' lattices, and each word's first and last node."""
        marked = [MARK + w for w in words]
        symbols = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(words)), sizes)
        first = ends - sizes + np.arange(len(words))        # a word of n symbols has n + 1 nodes
        last = first + sizes
        node_of = np.arange(len(symbols)) + word            # node before each symbol
        stop = ends[word]
        at, trie, here = np.arange(len(symbols)), np.zeros(len(symbols), np.int64), np.arange(len(symbols))
        src, dst, piece = [], [], []
        single = np.zeros(len(symbols), bool)
        length = 0
        while len(at):
            key = trie << 21 | symbols[here]
            found = np.searchsorted(self.keys, key)
            ok = self.keys[found] == key
            at, here, trie = at[ok], here[ok], self.target[found[ok]]
            length += 1
            got = self.piece_of[trie]
            has = got >= 0
            src.append(node_of[at[has]])
            dst.append(node_of[at[has]] + length)
            piece.append(got[has])
            if length == 1:
                single[at[has]] = True
            here = here + 1
            on = here < stop[at]
            at, here, trie = at[on], here[on], trie[on]
        src, dst, piece = map(np.concatenate, (src, dst, piece))
        return src, dst, piece, first, last, node_of[~single], symbols[~single]

    def solve(self, words: list[str], weight: np.ndarray | None = None, total: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each word; with weights, expected piece counts are added to `total`."""
        if not words:
            return np.empty(0)
        src, dst, piece, first, last, odd, letters = self.arcs(words)
        spelled = [[int(self.byte[b]) for b in chr(c).encode("utf-8", "surrogatepass")] for c in letters.tolist()]
        cost = np.array([sum(self.logp[b] for b in s) for s in spelled])
        n_plain = len(src)
        src, dst = np.concatenate([src, odd]), np.concatenate([dst, odd + 1])
        lp = np.concatenate([self.logp[piece], cost])
        depth = np.arange(int(last[-1]) + 1) - np.repeat(first, last - first + 1)
        alpha = np.full(int(last[-1]) + 1, NEG)
        alpha[first] = 0.0
        order = np.lexsort((dst, depth[dst]))
        self._sweep(alpha, src[order], dst[order], lp[order], depth[dst[order]])
        logz = alpha[last]
        if weight is not None:
            beta = np.full(len(alpha), NEG)
            beta[last] = 0.0
            high = depth.max() - depth
            order = np.lexsort((src, high[src]))
            self._sweep(beta, dst[order], src[order], lp[order], high[src[order]])
            of_word = np.searchsorted(first, src, side="right") - 1
            with np.errstate(invalid="ignore"):
                share = np.exp(alpha[src] + lp + beta[dst] - logz[of_word]) * weight[of_word]
            share = np.nan_to_num(share)
            total += np.bincount(piece, share[:n_plain], minlength=len(total))
            for s, x in zip(spelled, share[n_plain:].tolist()):
                for b in s:
                    total[b] += x
        return logz

    @staticmethod
    def _sweep(value, src, dst, lp, level):
        """value[dst] = log of the sum over arcs of exp(value[src] + lp), level by level."""
        cuts = np.flatnonzero(np.r_[True, level[1:] != level[:-1]]) if len(level) else []
        for a, b in zip(cuts, [*cuts[1:], len(level)]):
            t, d = value[src[a:b]] + lp[a:b], dst[a:b]
            heads = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            top = np.maximum.reduceat(t, heads)
            top = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                value[d[heads]] = top + np.log(np.add.reduceat(np.exp(t - np.repeat(top, np.diff(np.r_[heads, len(t)]))), heads))

    def batches(self, words: list[str]):
        start = size = 0
        for i, w in enumerate(words):
            size += len(w) + 1
            if i > start and (i - start >= BATCH_WORDS or size > BATCH_SYMBOLS):
                yield start, i
                start, size = i, len(w) + 1
        if start < len(words):
            yield start, len(words)


def text_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, c): occurrences of each word in docs(text, train), and those in training rows."""
    def run(batches):
        held: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def flush():
            words = list(held[True].keys() | held[False].keys())
            c = [held[True][w] for w in words]
            n = [x + held[False][w] for x, w in zip(c, words)]
            for k in held.values():
                k.clear()
            for a in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in words[a:a + 50_000]], pa.string()),
                                                  pa.array(n[a:a + 50_000], pa.int64()), pa.array(c[a:a + 50_000], pa.int64())], ["word", "n", "c"])
        for part in slices(batches):
            for text, train in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                held[train].update(text_words(text))
            if len(held[True]) + len(held[False]) >= HELD_WORDS:
                yield from flush()
        yield from flush()
    return (docs.select("text", "train").mapInArrow(run, "word string, n long, c long")
            .groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c")))


@lru_cache(maxsize=4)
def _lattice(pieces: tuple, logp: bytes) -> Lattice:
    return Lattice(list(pieces), np.frombuffer(logp))


def expected_counts(counts: DataFrame, shipped, n_pieces: int) -> dict[int, float]:
    """Expected uses of each piece over the training words; at most one row a piece comes back."""
    def run(batches):
        lattice = _lattice(*shipped.value)
        total = np.zeros(n_pieces)
        for part in slices(batches, 100_000):
            words, c = part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False).astype(float)
            for a, b in lattice.batches(words):
                lattice.solve(words[a:b], c[a:b], total)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "uses"])
    return dict(counts.where("c > 0").select("word", "c").mapInArrow(run, "piece int, uses double")
                .groupBy("piece").agg(F.sum("uses")).collect())


def score_documents(docs: DataFrame, model_path: str, held_fold: int = 1) -> DataFrame:
    """Word and piece model scores of every row of docs(doc_id, text).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Null text is
    empty: its only token is the end. Repeated rows each count and each give a row. A null
    doc_id counts as empty text when folds are dealt. Without training rows every probability
    comes from smoothing alone. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (fold(F.col("doc_id")) != held_fold).alias("train"))
    counts = stored(word_counts(rows), "words")
    train_docs = rows.where("train").count()
    known, tokens, every = counts.agg(F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    train_tokens, distinct = tokens + train_docs, known + (train_docs > 0)
    floor = train_tokens + 0.5 * (distinct + 1)

    pieces = load_pieces(model_path)
    names = tuple(p for p, _ in pieces)
    start = np.log(np.array([w for _, w in pieces]) / sum(w for _, w in pieces))
    first = spark.sparkContext.broadcast((names, start.tobytes()))
    uses = expected_counts(counts, first, len(names))
    weight = np.array([uses.get(i, 0.0) for i in range(len(names))] + [float(train_docs)]) + 0.5
    logp = np.log(weight / weight.sum())
    fitted = spark.sparkContext.broadcast((names, logp.tobytes()))

    def score_words(batches):
        lattice = _lattice(*fitted.value)
        for part in slices(batches, 100_000):
            words = part.column(0).to_pylist()
            c = part.column(2).to_numpy(zero_copy_only=False)
            got = [lattice.solve(words[a:b]) for a, b in lattice.batches(words)]
            got = np.concatenate(got) if got else np.empty(0)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.log10((c + 0.5) / floor)), pa.array(got / math.log(10))],
                                             ["word", "n", "c", "base", "score"])
    scored = stored(counts.mapInArrow(score_words, "word string, n long, c long, base double, score double"), "scored")
    often = spark.sparkContext.broadcast({r.word.encode("utf-8"): (r.c > 0, r.base, r.score) for r in
                                          scored.where(F.col("n") * FREQUENT >= every).collect()})
    end = (train_docs > 0, math.log10((train_docs + 0.5) / floor), float(logp[-1]) / math.log(10))

    def divide(batches):
        table = often.value
        for part in slices(batches):
            keys, words, times = [], [], []
            heads: list[list] = [[], [], [], []]
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                tokens = text_words(text)
                n, (k, b, s) = 1 + len(tokens), end
                k = int(k)
                for w, m in Counter(tokens).items():
                    got = table.get(w)
                    if got is None:
                        keys.append(key)
                        words.append(w.decode("utf-8", "replace"))
                        times.append(m)
                    else:
                        k += m * got[0]
                        b += m * got[1]
                        s += m * got[2]
                for column, x in zip(heads, (n, k, b, s)):
                    column.append(x)
            none = [None] * part.num_rows
            gap = [None] * len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([part.column(0), pa.array(keys, pa.int64())]), pa.array(none + words, pa.string()),
                 pa.array(none + times, pa.int64()), pa.concat_arrays([part.column(2), pa.array(gap, pa.int64())]),
                 pa.concat_arrays([part.column(3), pa.array(gap, pa.bool_())]),
                 pa.array(heads[0] + gap, pa.int64()), pa.array(heads[1] + gap, pa.int64()),
                 pa.array(heads[2] + gap, pa.float64()), pa.array(heads[3] + gap, pa.float64())],
                ["key", "word", "times", "doc_id", "train", "n_tokens", "k", "b", "s"])
    keyed = rows.select(F.monotonically_increasing_id().alias("key"), "text", "doc_id", "train")
    parts = stored(keyed.mapInArrow(divide, "key long, word string, times long, doc_id long, train boolean, n_tokens long, k long, b double, s double"), "parts")
    heads = parts.where("word is null").select("key", "doc_id", "train", "n_tokens", "k", "b", "s")
    rest = (parts.where("word is not null").select("key", "word", "times").join(scored.drop("n").hint("shuffle_hash"), "word")
            .select("key", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("train"), F.lit(None).cast("long").alias("n_tokens"),
                    F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("k"), (F.col("times") * F.col("base")).alias("b"),
                    (F.col("times") * F.col("score")).alias("s")))
    return (heads.unionByName(rest).groupBy("key")
            .agg(F.max("doc_id").alias("doc_id"), F.max("train").alias("train"), F.max("n_tokens").alias("n_tokens"),
                 F.sum("k").alias("n_known"), F.sum("b").alias("base_score"), F.sum("s").alias("score"))
            .select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"),
                    "base_score", "score"))
