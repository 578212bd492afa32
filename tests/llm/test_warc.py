"""Archives: round trips of odd payloads, revisits against grouping by hand, the SQL check."""

from __future__ import annotations

import base64
import gzip
import hashlib

import compare
import pytest
from fieldlens.llm import warc
from fieldlens.llm.common import shared_folder
from fieldlens.llm.queries import QUERIES, SQL

ODD = ["", "a", "\r\n\r\n", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\ny", "end\r\n", "\r\n\r\n\r\n\r\n", "é漢字\0", "z" * 300_000, "\n\n", "tail\r\n\r", "\r\n\r\n" * 5000]


def rows():
    out = [(i, f"http://x/{i}", h, "extra") for i, h in enumerate(ODD)]
    out += [(100 - i, "http://y/\r\n é", h, None) for i, h in enumerate(ODD)]
    return out + [(200, None, None, None), (3, "http://x/3", ODD[3], "extra"), (None, "u", "only here", None), (None, "u", "a", None), (None, "v", "only here", None)]


def expected(data):
    groups = {}
    for page, _, html, _ in data:
        groups.setdefault(html or "", []).append(page)
    want = []
    for html, pages in groups.items():
        body = html.encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        pages = sorted(pages, key=lambda p: (p is None, p or 0))
        want += [(p, len(body), digest, "revisit" if n else "response", pages[0] if n else None) for n, p in enumerate(pages)]
    return sorted(want, key=repr)


def test_revisits(spark):
    data = rows()
    got = warc.archive_pages(spark.createDataFrame(data, "page_id long, url string, html string, record_type string").repartition(3))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == expected(data)


def test_small_payloads_stay_responses(spark):
    data = [(1, "u", "ab", None), (2, "u", "ab", None), (3, "u", "abc", None), (4, "u", "abc", None)]
    got = warc.archive_pages(spark.createDataFrame(data, "page_id long, url string, html string, x string"), least_bytes=3)
    assert {r.page_id: r.record_type for r in got.collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_archive_is_plain_warc(spark, tmp_path):
    data = [(1, "http://a/", "<p>é</p>", None)]
    folder = warc.first_archives(spark.createDataFrame(data, "page_id long, url string, html string, x string"), shared_folder(spark, "w"))
    import glob
    text = b"".join(gzip.open(f).read() for f in glob.glob(folder.removeprefix("file:") + "/*.gz"))
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith("<p>é</p>\r\n\r\n".encode())
    whole = warc.read_archives(spark, folder, payload=True).collect()
    assert [(r.page_id, r.payload.decode()) for r in whole] == [(1, "<p>é</p>")]


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    got = QUERIES["op2_warc_revisits"](spark, folder)
    cur = compare.duck(folder).execute(SQL["op2_warc_revisits"])
    want = compare.normal([d[0] for d in cur.description], cur.fetchall())
    assert compare.normal(got.columns, got.collect()) == want


def test_cut_archives_are_an_error():
    record = warc.response("<r>", 1, "u", b"body of it", "D") + warc.END
    for cut in (5, len(record) - 9):
        with pytest.raises(ValueError, match="ends within a record"):
            list(warc.parse([("a", record[:cut].removesuffix(warc.END))]))
    assert len(list(warc.parse([("a", x) for x in record.split(warc.END)[:-1]] + [("b", x) for x in record.split(warc.END)[:-1]]))) == 2
