"""Registered queries of the training-data operators, and their SQL where SQL can express them.

Each query applies its operator to a whole table with production settings. Operators are
imported on use, so one query's libraries are no burden to another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldlens.llm.common import read_table
from fieldlens.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(build):
        QUERIES[name] = lambda spark, folder: build(prepare(spark), folder)
        if sql is not None:
            SQL[name] = sql
        return build
    return wrap


def tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_token_counts")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Greedy word-piece counts of every document."""
    from fieldlens.llm import piececount
    return piececount.token_counts(read_table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


@query("op2_warc_revisits", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    h AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY sha1(body)) AS first_id FROM p)
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), '') AS payload_digest,
           CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first_id THEN first_id END AS refers_to
    FROM h""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Pages archived, repeated payloads resolved to revisits, archives read back."""
    from fieldlens.llm import warc
    return warc.archive_pages(read_table(spark, folder, "pages")).drop("record_id", "url")


@query("op3_language_mixture")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from four fifths of them."""
    from fieldlens.llm import langmix
    docs = read_table(spark, folder, "documents")
    return langmix.predict(docs, langmix.learn(docs))


@query("op4_passage_quality")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document, learned from labels of four fifths of them."""
    from fieldlens.llm import milquality
    docs = read_table(spark, folder, "documents")
    return milquality.score(docs, milquality.learn(docs, read_table(spark, folder, "labels")))


@query("op5_bpe_digests")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document and the text they decode to, as digests."""
    from fieldlens.llm import bpe
    return bpe.digests(read_table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


@query("op6_personal_data")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document: fixed patterns and what the field adds."""
    from fieldlens.llm import crfpii
    return crfpii.personal_data(read_table(spark, folder, "documents"))


@query("op7_simhash_components")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    from fieldlens.llm import simhash
    return simhash.near_duplicates(read_table(spark, folder, "documents"))


@query("op9_benchmark_overlaps", r"""
    WITH d AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
               FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents)),
    b AS (SELECT item_id, len(w) AS size, unnest(w) AS word, generate_subscripts(w, 1) AS pos
          FROM (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark)),
    same AS (SELECT DISTINCT doc_id, item_id, size, d.pos - b.pos AS shift, b.pos AS pos FROM d JOIN b USING (word) WHERE size >= 8),
    long AS (SELECT doc_id, item_id, size, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY pos RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) AS n FROM same)
    SELECT doc_id, item_id, CAST(max(n) AS BIGINT) AS matched FROM long WHERE n >= least(size, 11) AND (size >= 13 OR n = size) GROUP BY doc_id, item_id""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark passage, with the passage."""
    from fieldlens.llm import decontam
    return decontam.contaminated(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@query("op10_lattice_scores")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Word-model and piece-lattice log probability of every document."""
    from fieldlens.llm import lattice
    return lattice.score_documents(read_table(spark, folder, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op8_exact_top_k", """
    WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    from fieldlens.llm import topk
    return topk.top_k(read_table(spark, folder, "embeddings"))


@query("op12_importance_resampling", r"""
    WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
                     lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
    d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    df AS (SELECT row, unnest(w) AS word FROM d),
    bf AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
    v AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(word)), lambda i: CAST('0x' || substr(hex(word), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))),
              lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket
          FROM (SELECT word FROM df UNION SELECT word FROM bf), crc),
    s AS (SELECT bucket, count(*) AS n FROM df JOIN v USING (word) GROUP BY bucket),
    t AS (SELECT bucket, count(*) AS n FROM bf JOIN v USING (word) GROUP BY bucket),
    g AS (SELECT b.bucket, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000)::DOUBLE)
                                                / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + 10000)::DOUBLE))) AS BIGINT) AS gain
          FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
    w AS (SELECT row, CAST(sum(gain) AS BIGINT) AS weight FROM df JOIN v USING (word) JOIN g USING (bucket) GROUP BY row),
    x AS (SELECT doc_id, CAST(len(d.w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
                 coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
          FROM d LEFT JOIN w USING (row)),
    r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM x)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM x WHERE n_features >= 20) // 100 THEN place END AS rank FROM r""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """A tenth of the documents, drawn by likeness of their words to the benchmark's."""
    from fieldlens.llm import resample
    return resample.resample(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@query("op11_hard_negatives", """
    WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
               FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id AS id, b.label AS label, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
    p AS (SELECT anchor_id, own, id AS positive_id, score AS positive_score FROM s WHERE label = own
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
    n AS (SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
                 CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
          FROM p JOIN s USING (anchor_id, own) WHERE label <> own AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh has its label moved by one."""
    from pyspark.sql import functions as F

    from fieldlens.llm import hardneg
    rows = read_table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(rows.withColumn("label", moved))


@query("op13_document_fingerprints")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    from fieldlens.llm import fingerprints
    return fingerprints.edited_likeness(read_table(spark, folder, "documents"))
