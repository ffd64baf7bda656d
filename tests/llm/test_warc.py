"""WARC archives: round trip, revisits, ranges."""

import hashlib

from sparkloom.llm import warc
from sparkloom.llm.common import scratch


def test_round_trip(spark):
    long = "é" * 500_000
    rows = [(1, "http://a/", None), (2, "http://b/\r\nX: y", ""), (3, "http://c/", "same " * 40), (4, "http://d/", "same " * 40), (5, None, long), (6, "u", long), (7, "u", "short"), (8, "u", "short"), (None, "n", "same " * 40), (3, "http://c/", "same " * 40)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    index = warc.write_archives(pages, scratch(spark, "t"))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(index).collect()]
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = min((j for j, _, g in rows if g == h and j is not None), default=i) if len(data) >= 100 and i is not None else i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if to == i else "revisit", None if to == i else to))
    assert sorted(got, key=str) == sorted(want, key=str)
    some = warc.read_records(index.where("page_id = 5"), with_payload=True).collect()
    assert [r.payload.decode() for r in some] == [long]
    assert warc.read_records(warc.write_archives(pages.limit(0), scratch(spark, "t"))).count() == 0


def test_ranges_coalesce():
    assert list(warc._ranges([(0, 10), (10, 5), (200, 5)], gap=50)) == [(0, 2, 0, 15), (2, 3, 200, 205)]
    assert list(warc._ranges([(0, 10), (10, 10)], most=15)) == [(0, 1, 0, 10), (1, 2, 10, 20)]
