"""The pipeline against a brute-force run, and each stage on odd tables."""

from __future__ import annotations

import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fieldlens.llm import crfpii, langmix
from fieldlens.llm.queries import QUERIES, tokenizer
from test_decontam import brute
from test_nearcopies import slow_groups

FOLDER = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = langmix.learn(docs)
    _, value, size = langmix.mixtures(model, [rows[i].text for i in rows])
    kept = [i for i, v, n in zip(rows, value, size) if n > 0 and -n * np.log(langmix.BUCKETS) - v <= langmix.PENALTY * np.log(n + 1)]
    assert any(re.search(r"[^\W\d_]", rows[i].text) for i in kept)

    groups = slow_groups([(i, rows[i].text) for i in kept])
    kept = [i for i in kept if groups[i] == i]

    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    words = {i: set(re.findall(r"[^\W_]+", t.lower())) for i, t in items}

    def leaks(i):
        own = set(re.findall(r"[^\W_]+", rows[i].text.lower()))
        near = [(k, t) for k, t in items if len(words[k] & own) >= 0.5 * len(words[k])]
        return bool(brute([(i, rows[i].text)], near))
    kept = [i for i in kept if not leaks(i)]

    library, field = Tokenizer.from_file(tokenizer("word_bpe_49k.json")), crfpii.fitted()
    want = {}
    for i in kept:
        [(_, spans)] = crfpii.find_spans([rows[i].text], field)
        want[i] = library.encode(crfpii.masked(rows[i].text, spans), add_special_tokens=False).ids
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want and 0 < len(want) < len(rows)


@pytest.mark.parametrize("stage", range(5))
def test_odd_tables(spark, stage):
    run = corpus_pipeline.STAGES[stage][1]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, component_id long, bad_id long, ids string"
    rows = [(1, None, None, None, None), (2, "", None, None, 0), (3, "the and of", "en", "a", 10), (3, "the and of", "en", "a", 10), (None, "the and of", "en", "a", 10),
            (None, None, None, None, None), (4, "word " * 20_000, "en", "a", 100_000)]
    odd = spark.createDataFrame([(*r, "x", 1, 1, "x") for r in rows], schema)
    got = run(spark, odd, FOLDER)
    if stage < 4:
        assert got.columns == odd.columns
    assert 0 < got.count() <= 7
    assert run(spark, odd.limit(0), FOLDER).count() == 0


def test_registered(spark):
    import __spark_entry__
    names = __spark_entry__.queries()
    assert "pipeline" in names and set(QUERIES) <= set(names)
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
