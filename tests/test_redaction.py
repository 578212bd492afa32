"""Redaction over all leaves of the built documents, against its SQL."""

from __future__ import annotations

import compare
from fieldlens.queries import load

FOLDER = "/root/testdata/sf0.01"


def test_all_leaves_are_redacted(spark):
    q = load()["document_redaction_leaves"]
    status, note = compare.check(spark, compare.duck(FOLDER), "document_redaction_leaves", q, FOLDER)
    assert status == "ok", note
    paths = {r.path for r in q.run(spark, FOLDER).collect()}
    assert {"id", "status.coordinates[1].position.coordinates", "status.coordinates[0].dateTime", "status.model", "subscriptions[0].photoCount"} <= paths
