import hashlib

import pytest

from tidemark.llm import warc


def expected(rows):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, other in rows if (other or "") == (html or "") and j is not None]
        last = max(same, default=None)
        revisit = len(body) >= 1000 and i is not None and last is not None and i != last
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=repr)


FAKE = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("split", ["128m", "3k"])
def test_round_trip(spark, split):
    rows = [(i, f"http://h/{i}", f"<p>{i}é</p>\n" * (i * 7)) for i in range(40)]
    rows += [(100, None, "long " * 300), (7000, "u\r\nv", "long " * 300), (101, "u", "long " * 300), (102, "u", "short"), (103, "u", "short"), (104, "u", None), (105, "u", "")]
    rows += [(200, "u", FAKE), (201, "u", FAKE * 40), (202, "u", "WARC/1.1\r\n" * 500), (203, "u", "a\r\n\r\n"), (204, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "u", "none " * 400)]
    rows += [(300, "u", "same " * 300), (300, "u", "same " * 300), (301, "u", "same " * 300)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, file int").repartition(2)
        got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got), key=repr) == expected(rows)


@pytest.mark.parametrize("split", ["128m", "3k"])
def test_long_url(spark, split):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(5)] + [(5, "http://h/" + "x" * 20_000, "long url")] + [(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(6, 12)]
    rows += [(12, "http://h/" + "é" * 200_000, "longer " * 300)] + [(i, "WARC-Type: x Content-Length: 3", f"<p>{i}</p>") for i in range(13, 20)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
        got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == expected(rows)
    assert {r.page_id: r.url for r in got} == {i: url for i, url, _ in rows}


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
