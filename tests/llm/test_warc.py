from __future__ import annotations

import hashlib
import io

import pytest

from staffloom.llm import warc

BIG = "<p>" + "same " * 60
ROWS = [(5, "http://a/5", BIG), (3, "http://a/3", BIG), (9, None, BIG), (1, "u", "tiny"), (2, "u", "tiny"), (4, "http://\r\nx", None), (6, "é", "ü" * 120), (2**60, "big", BIG), (6, "é", "ü" * 120), (None, "n", BIG)]


def order(r):
    return r[0] or 0


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS first")


def test_round_trip(spark):
    out = sorted(map(tuple, warc.read_archives(warc.write_archives(pages(spark))).collect()), key=order)
    expected = []
    for page, _, html in ROWS:
        raw = (html or "").encode()
        refers = 3 if html == BIG and page not in (3, None) else None
        expected.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if refers else "response", refers))
    assert out == sorted(expected, key=order)


def test_small_archives_and_empty_table(spark):
    manifest = warc.write_archives(pages(spark), archive_bytes=500)
    assert manifest.count() > 2 and warc.read_archives(manifest).count() == len(ROWS)
    none = warc.write_archives(pages(spark).limit(0))
    assert none.count() == 0 and warc.read_archives(none).count() == 0


def test_records_are_compressed_one_by_one_with_the_dictionary():
    records = [warc.record(str(i), "http://x", f"<html>page {i} {'text ' * 50}</html>".encode(), "d", None) for i in range(400)]
    raw, places = warc.archive(records, 3, 4096, 1 << 20)
    assert list(warc.records_of(io.BytesIO(raw), chunk=100)) == records
    tail = io.BytesIO(raw[: places[0]] + raw[places[7] :])  # any record can be read alone
    assert next(warc.records_of(tail)) == records[7]
    assert len(raw) < sum(map(len, records)) / 3


def test_a_cut_archive_is_an_error():
    raw, _ = warc.archive([b"WARC/1.1 a" * 50], 3, 4096, 1 << 20)
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(raw[:-3])))
