"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words; only the document has a label. Every
passage is encoded (a dense layer over letter-class shares, word lengths and repetition),
gated attention weighs the passages, softmax(w . (tanh(V h) * sigmoid(U h))), and a logistic
layer scores the weighted sum of their codes. All layers are fitted together on document
labels by Adam with hand-written gradients, in numpy, on a bounded sample of labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import fold, map_slices

PASSAGE = 64
#: Labelled rows the fit reads at most (those of least hash), and passages a training bag is merged to at most.
FIT_ROWS, FIT_PASSAGES = 6000, 48
LAGS = (1, 2, 3, 4, 6, 8, 12)
CUT = 0.3
CODE, GATE, EPOCHS, BATCH, RATE = 24, 12, 30, 128, 0.01

#: Class of each byte: 0 letters, 1 capitals, 2 digits, 3 spaces, 4 line ends, 5 other controls, 6 beyond ASCII, then a class for each mark.
MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
BYTE_CLASS = np.full(256, 5, np.int64)
BYTE_CLASS[128:] = 6
for _b in range(128):
    if chr(_b).isalpha():
        BYTE_CLASS[_b] = int(chr(_b).isupper())
    elif chr(_b).isdigit():
        BYTE_CLASS[_b] = 2
BYTE_CLASS[32], BYTE_CLASS[9], BYTE_CLASS[10], BYTE_CLASS[13] = 3, 3, 4, 4
for _i, _b in enumerate(MARKS):
    BYTE_CLASS[_b] = 7 + _i
CLASSES = 7 + len(MARKS)
LENGTHS = 14
WIDTH = CLASSES + LENGTHS + len(LAGS) + 2
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_draw = np.random.default_rng(11)
BYTE_CODE, PLACE_CODE = (_draw.integers(0, 1 << 62, n).astype(np.uint64) | np.uint64(1) for n in (256, 64))


def passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and how many passages each text has (at least one)."""
    raw = [((t or "").encode("utf-8", "surrogatepass") + b"\n") for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    blank = BLANK[data]
    opens = ~blank & np.r_[True, blank[:-1]]
    first = np.flatnonzero(opens)
    after = np.flatnonzero(blank & np.r_[False, ~blank[:-1]])
    length = after - first
    doc = np.searchsorted(ends, first, side="right")
    n_words = np.bincount(doc, minlength=len(texts))
    rank = np.arange(len(first)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    count = np.maximum(1, -(-n_words // PASSAGE))
    base = np.cumsum(count) - count
    home = base[doc] + rank // PASSAGE                      # passage of each word
    total = int(count.sum())
    x = np.zeros((total, WIDTH))

    # bytes belong to the passage of the last word begun, or to their document's first one
    word_at = np.cumsum(opens) - 1
    before = np.repeat(np.cumsum(n_words) - n_words, sizes)
    byte_home = np.where(word_at >= before, home[np.maximum(word_at, 0)] if len(home) else 0, np.repeat(base, sizes))
    classes = np.bincount(byte_home * CLASSES + BYTE_CLASS[data], minlength=total * CLASSES).reshape(total, CLASSES)
    x[:, :CLASSES] = np.sqrt(classes / np.maximum(classes.sum(1, keepdims=True), 1))
    if len(first):
        lengths = np.bincount(home * LENGTHS + np.minimum(length, LENGTHS) - 1, minlength=total * LENGTHS).reshape(total, LENGTHS)
        held = np.bincount(home, minlength=total)
        share = 1 / np.maximum(held, 1)
        x[:, CLASSES:CLASSES + LENGTHS] = lengths * share[:, None]
        place = np.arange(len(data)) - np.repeat(np.r_[0, first], np.diff(np.r_[0, first, len(data)]))
        mixed = np.where(blank, np.uint64(0), BYTE_CODE[data] * PLACE_CODE[place % 64])
        code = np.add.reduceat(mixed, first)
        again = np.zeros(len(first), bool)
        for j, lag in enumerate(LAGS):
            if len(first) > lag:
                same = np.r_[np.zeros(lag, bool), (code[lag:] == code[:-lag]) & (doc[lag:] == doc[:-lag])]
                again |= same
                x[:, CLASSES + LENGTHS + j] = np.bincount(home, same, minlength=total) * share
        x[:, -2] = np.bincount(home, again, minlength=total) * share
        x[:, -1] = np.log1p(held) / 4
    return x, count


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Net:
    """Encoder, gated attention and scorer; parameters in one dictionary."""

    def __init__(self, width: int, seed: int = 3):
        draw = np.random.default_rng(seed)
        scale = lambda *s: draw.normal(0, 1 / np.sqrt(s[-1]), s)
        self.p = {"We": scale(CODE, width), "be": np.zeros(CODE), "V": scale(GATE, CODE), "U": scale(GATE, CODE), "w": scale(1, GATE)[0],
                  "c": scale(1, CODE)[0], "b": np.zeros(1)}
        self.mean, self.spread = np.zeros(width), np.ones(width)

    def forward(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray):
        p = self.p
        x = (x - self.mean) / self.spread
        h = np.tanh(x @ p["We"].T + p["be"])
        t, s = np.tanh(h @ p["V"].T), sigmoid(h @ p["U"].T)
        e = (t * s) @ p["w"]
        top = np.maximum.reduceat(e, starts)
        a = np.exp(e - top[bag])
        a /= np.add.reduceat(a, starts)[bag]
        z = np.add.reduceat(h * a[:, None], starts)
        return x, h, t, s, a, z, z @ p["c"] + p["b"][0]

    def score(self, x: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each bag and attention of each passage."""
        starts = np.cumsum(count) - count
        *_, a, _, y = self.forward(x, starts, np.repeat(np.arange(len(count)), count))
        return sigmoid(y), a

    def gradient(self, x, count, label, decay):
        p = self.p
        starts, bag = np.cumsum(count) - count, np.repeat(np.arange(len(count)), count)
        x, h, t, s, a, z, y = self.forward(x, starts, bag)
        dy = (sigmoid(y) - label) / len(label)
        g = {"c": dy @ z, "b": np.array([dy.sum()])}
        dz = dy[:, None] * p["c"]
        dh = a[:, None] * dz[bag]
        da = (h * dz[bag]).sum(1)
        de = a * (da - np.add.reduceat(a * da, starts)[bag])
        g["w"] = de @ (t * s)
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        g["V"], g["U"] = dt.T @ h, ds.T @ h
        dh = (dh + dt @ p["V"] + ds @ p["U"]) * (1 - h * h)
        g["We"], g["be"] = dh.T @ x, dh.sum(0)
        return {k: v + decay * p[k] for k, v in g.items()}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, seed: int = 5, decay: float = 1e-4) -> Net:
        every = np.concatenate(bags)
        self.mean, self.spread = every.mean(0), np.maximum(every.std(0), 0.02)
        share = labels.mean()
        self.p["b"][0] = np.log((share + 0.01) / (1.01 - share))
        draw = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = draw.permutation(len(bags))
            rate = RATE * (1 - epoch / EPOCHS) + RATE * 0.05
            for i in range(0, len(order), BATCH):
                pick = order[i:i + BATCH]
                step += 1
                g = self.gradient(np.concatenate([bags[j] for j in pick]), np.array([len(bags[j]) for j in pick]), labels[pick], decay)
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v2[k] = 0.999 * v2[k] + 0.001 * g[k] ** 2
                    self.p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)
        return self


def merged(x: np.ndarray, most: int) -> np.ndarray:
    """At most `most` passages: neighbours averaged, so the whole text still counts."""
    if len(x) <= most:
        return x
    cuts = np.linspace(0, len(x), most + 1).astype(int)[:-1]
    return np.add.reduceat(x, cuts) / np.diff(np.r_[cuts, len(x)])[:, None]


def learn(docs: DataFrame, labels: DataFrame, held_fold: int | None = 0, rows: int = FIT_ROWS) -> Net:
    """Fit on docs(doc_id, text) with labels(doc_id, quality), outside the held-out fold.

    A bounded sample: the `rows` labelled documents of least id hash. A doc_id labelled twice
    counts once with its greatest label; null labels, ids and labels other than 0 and 1 teach
    nothing. Without both labels at hand the net scores their share (one half, without any).
    """
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    if held_fold is not None:
        marked = marked.where(fold(F.col("doc_id")) != held_fold)
    present = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id")
    marked = marked.join(present, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select(F.col("doc_id"), F.col("text").cast("string")).join(F.broadcast(marked), "doc_id").select("doc_id", "text", "quality")

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            x, count = passages(part.column(1).to_pylist())
            cuts = np.cumsum(count)[:-1]
            bags = [merged(b, FIT_PASSAGES).astype("<f4").tobytes() for b in np.split(x, cuts)]
            return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(bags, pa.binary())], ["doc_id", "quality", "bag"])
        return work
    got = map_slices(sample.select(F.col("doc_id").cast("long"), "text", F.col("quality").cast("int")), make, "doc_id long, quality int, bag binary")
    got = got.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("bag").alias("bag")).orderBy("doc_id").collect()
    net = Net(WIDTH)
    y = np.array([r.quality for r in got], float)
    if len(set(y)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        net.p["c"][:] = 0
        net.p["b"][0] = np.log(share / (1 - share))
        return net
    return net.fit([np.frombuffer(r.bag, "<f4").reshape(-1, WIDTH).astype(float) for r in got], y)


def score(docs: DataFrame, net: Net, held_fold: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages, focus) for every row of docs(doc_id, text).

    focus is the passage of greatest attention, from 0. Null and empty texts are one passage
    without words. Repeated rows each give a row, doc_id may be null, other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        model = shipped.value

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            x, count = passages(part.column(1).to_pylist())
            y, a = model.score(x, count)
            focus = [int(p.argmax()) for p in np.split(a, np.cumsum(count)[:-1])]
            return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(y), pa.array((y >= CUT).astype(np.int32)),
                                               pa.array(count), pa.array(focus, pa.int32())], ["doc_id", "held_out", "score", "predicted", "passages", "focus"])
        return work
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (fold(F.col("doc_id")) == held_fold).alias("held_out"))
    return map_slices(rows, make, "doc_id long, held_out boolean, score double, predicted int, passages long, focus int")
