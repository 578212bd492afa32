"""Passage features by hand, gradients by differences, held-out accuracy, odd inputs."""

from __future__ import annotations

import numpy as np
import pytest

from fieldlens.llm import milquality as mil
from fieldlens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def test_passages_by_hand():
    texts = [None, "", "a b " * 40, "Ab. 12\né!", " \n "]
    x, count = mil.passages(texts)
    assert count.tolist() == [1, 1, 2, 1, 1] and len(x) == 6
    alone = [mil.passages([t])[0] for t in texts]
    assert np.allclose(x, np.concatenate(alone))
    data = "Ab. 12\né!\n".encode()
    shares = np.bincount(mil.BYTE_CLASS[np.frombuffer(data, np.uint8)], minlength=mil.CLASSES) / len(data)
    assert np.allclose(alone[3][0, :mil.CLASSES] ** 2, shares)
    assert np.allclose(alone[3][0, mil.CLASSES:mil.CLASSES + mil.LENGTHS], np.bincount([1, 2, 2], minlength=mil.LENGTHS) / 3)
    lag = mil.CLASSES + mil.LENGTHS + mil.LAGS.index(2)
    assert x[2, lag] == 62 / 64 and x[3, lag] == 1 and x[2, lag - 1] == 0


def test_gradient_equals_differences():
    draw = np.random.default_rng(0)
    net = mil.Net(5)
    x, count, y = draw.normal(size=(9, 5)), np.array([2, 4, 3]), np.array([0.0, 1.0, 1.0])

    def loss():
        q, _ = net.score(x, count)
        return -(y * np.log(q) + (1 - y) * np.log(1 - q)).mean()
    g = net.gradient(x, count, y, 0.0)
    for k, v in net.p.items():
        for at in list(np.ndindex(v.shape))[:7]:
            old = v[at]
            v[at] = old + 1e-6
            up = loss()
            v[at] = old - 1e-6
            down = loss()
            v[at] = old
            assert abs((up - down) / 2e-6 - g[k][at]) < 1e-6, (k, at)


@pytest.fixture(scope="module")
def rows(spark):
    return QUERIES["op4_passage_quality"](spark, FOLDER).collect()


def test_held_out_accuracy(spark, rows):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    held = [(r.score, r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    assert len(held) > 500
    assert np.mean([p == q for _, p, q in held]) > 0.97
    good, bad = [s for s, _, q in held if q], [s for s, _, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and 0 <= r.focus < r.passages for r in rows)


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "a b", "x"), (2, "w " * 50_000, "x"), (2, "a b", "x")], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, 0), (None, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    net = mil.learn(docs, labels, held_fold=None)
    got = mil.score(docs, net).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.passages == 1}) == 2
    one_label = mil.learn(docs, labels.where("quality = 1"), held_fold=None)
    assert {r.score > 0.5 for r in mil.score(docs, one_label).collect()} == {True}
    none = mil.learn(docs.limit(0), labels.limit(0))
    assert {r.score for r in mil.score(docs, none).collect()} == {0.5}
    assert mil.score(docs.limit(0), none).collect() == []
