"""Language shares of a document by expectation-maximisation over n-gram likelihoods.

Each language is a smoothed distribution over hashed letter trigrams, counted over all
training texts. A document's trigrams are taken as draws from a mixture of languages; EM
estimates the shares. The language set grows from the best single language by one language at
a time while the likelihood gained exceeds a penalty that grows with the log of the text's
length. The likelihood is concave in the shares, so its largest directional derivative bounds
what any addition can gain: most documents are settled without EM, with the same answer.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm.common import fold, map_slices, slices

BUCKETS = 1 << 14
SMOOTHING = 0.5
#: Log-likelihood a further language must add, times the log of the number of trigrams.
PENALTY = 3.0
ROUNDS = 40
#: The model has BUCKETS numbers a language and goes to every task; more languages are an error, never cut.
MOST_LANGUAGES = 4096
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def buckets_of(text: str | None) -> np.ndarray:
    """Bucket of every trigram whose middle is a letter; other characters count as blanks."""
    if not text:
        return np.empty(0, np.int64)
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[c]
    c = np.where(letter, c, 32).astype(np.uint64)
    h = c[:-2] * np.uint64(0x9E3779B97F4A7C15) + c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + c[2:] * np.uint64(0x165667B19E3779F9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h[letter[1:-1]] >> np.uint64(50)).astype(np.int64)


class Model:
    def __init__(self, names: list[str], counts: np.ndarray):
        """counts[bucket, language]"""
        self.names = names
        p = counts + SMOOTHING
        self.p = p / p.sum(0)
        self.logp = np.log(self.p)


def learn(docs: DataFrame, held_fold: int | None = 0) -> Model:
    """Trigram distributions of every language in docs(doc_id, text, lang).

    Rows with null text or null lang, and those of the held-out fold, teach nothing.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if held_fold is not None:
        rows = rows.where(fold(F.col("doc_id")) != held_fold)

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for part in slices(batches):
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if lang not in held:
                    held[lang] = np.zeros(BUCKETS, np.int64)
                held[lang] += np.bincount(buckets_of(text), minlength=BUCKETS)
        for lang, n in held.items():
            used = np.flatnonzero(n)
            if not len(used):                               # a language of texts without letters is still learned
                used = np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(n[used])], ["lang", "bucket", "n"])
    counts = (rows.select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(run, "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    table = counts.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(table) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: the model would outgrow its broadcast bound")
    table.sort(key=lambda r: r.lang)
    matrix = np.zeros((BUCKETS, len(table)))
    for i, r in enumerate(table):
        matrix[r.buckets, i] = r.n
    return Model([r.lang for r in table], matrix)


def mixtures(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares (documents x languages), log-likelihood of the mixture, and trigrams counted."""
    docs, g, c = [], [], []
    for i, t in enumerate(texts):
        n = np.bincount(buckets_of(t), minlength=1)
        used = np.flatnonzero(n)
        docs.append(np.full(len(used), i))
        g.append(used)
        c.append(n[used])
    docs, g, c = np.concatenate(docs), np.concatenate(g), np.concatenate(c).astype(float)
    size = np.bincount(docs, c, minlength=len(texts))
    k = len(model.names)
    share = np.zeros((len(texts), k))
    value = np.zeros(len(texts))
    live = np.flatnonzero(size > 0)
    if not len(live) or not k:
        return share, value, size
    starts = np.searchsorted(docs, live)
    single = np.add.reduceat(model.logp[g] * c[:, None], starts)
    best = single.argmax(1)
    share[live, best] = 1.0
    value[live] = single.max(1)
    limit = np.zeros(len(texts))
    limit[live] = PENALTY * np.log(size[live] + 1)

    open_docs = live
    while len(open_docs):
        pick = np.isin(docs, open_docs)
        d, gg, cc = docs[pick], g[pick], c[pick]
        starts = np.searchsorted(d, open_docs)
        at = np.searchsorted(open_docs, d)
        mix = np.einsum("ij,ij->i", model.p[gg], share[d])
        slope = np.add.reduceat(model.p[gg] * (cc / mix)[:, None], starts) - size[open_docs, None]
        slope[share[open_docs] > 0] = -np.inf
        add = slope.argmax(1)
        more = slope.max(1) > limit[open_docs]              # else nothing can gain the penalty
        if not more.any():
            break
        open_docs, add = open_docs[more], add[more]
        keep = more[at]
        d, gg, cc = d[keep], gg[keep], cc[keep]
        starts = np.searchsorted(d, open_docs)
        at = np.searchsorted(open_docs, d)
        trial = share[open_docs].copy()
        trial *= 0.9
        trial[np.arange(len(open_docs)), add] = 0.1
        p = model.p[gg]
        for _ in range(ROUNDS):
            part = p * trial[at]
            new = np.add.reduceat(part * (cc / part.sum(1))[:, None], starts) / size[open_docs, None]
            moved = np.abs(new - trial).max()
            trial = new
            if moved < 1e-4:
                break
        got = np.add.reduceat(cc * np.log((p * trial[at]).sum(1)), starts)
        win = got - value[open_docs] > limit[open_docs]
        share[open_docs[win]] = trial[win]
        value[open_docs[win]] = got[win]
        open_docs = open_docs[win]
    return share, value, size


def ship(spark, model: Model):
    return spark.sparkContext.broadcast(model)


def predict(docs: DataFrame, model: Model, held_fold: int = 0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, shares) for every row of docs(doc_id, text).

    lang_pred is the language of the largest share (ties: the first by name) and score its
    share. Null text, text without a letter, and a model of no languages give `und` and 0.
    Repeated rows each give a row, doc_id may be null, other columns are ignored.
    """
    shipped = ship(docs.sparkSession, model)

    def make():
        m = shipped.value

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            share, _, size = mixtures(m, part.column(1).to_pylist())
            known = (size > 0) & (len(m.names) > 0)
            top = share.argmax(1) if len(m.names) else np.zeros(len(size), int)
            lang = [m.names[t] if k else UNKNOWN for t, k in zip(top, known)]
            score = [float(min(share[i, t], 1.0)) if k else 0.0 for i, (t, k) in enumerate(zip(top, known))]
            shares = [[(m.names[j], float(x[j])) for j in np.flatnonzero(x > 0)] for x in share]
            return pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                               pa.array(shares, pa.map_(pa.string(), pa.float64()))],
                                              ["doc_id", "held_out", "lang_pred", "score", "shares"])
        return work
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (fold(F.col("doc_id")) == held_fold).alias("held_out"))
    return map_slices(rows, make, "doc_id long, held_out boolean, lang_pred string, score double, shares map<string,double>")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """docs without rows that no learned language explains.

    A row goes if its text is null or has no letter, or if its trigrams are likelier as even
    noise over all buckets than under its language mixture, by more than the penalty of one
    language: a short text with a key or a password in it stays. A model of no languages keeps all.
    """
    shipped = ship(docs.sparkSession, model)
    at = docs.columns.index("text")

    def make():
        m = shipped.value

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            if not m.names:
                return part
            _, value, size = mixtures(m, part.column(at).to_pylist())
            noise = -size * np.log(BUCKETS) - value
            return part.filter(pa.array((size > 0) & (noise <= PENALTY * np.log(size + 1))))
        return work
    return map_slices(docs, make, docs.schema)
