"""Archives of pages with hostile urls and ids, hot payloads, and no pages at all."""

from __future__ import annotations

import base64
import hashlib

import pytest

from panelwright.llm import warc

PAGES = "page_id long, url string, html string, keeper string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("packed", ["gzip", "none"])
def test_urls_come_back_as_they_were(spark, tmp_path, packed):
    urls = ["http://h/\r\n\r\n", "http://h/\r\nWARC-Type: evil", "a\nb", "\ttab ", " ", "", "é\x85 x", "=?utf-8?B?YQ==?=", "WARC/1.1\r\n", None, "plain: x", "\x00"]
    pages = spark.createDataFrame([(i, u, f"<p>{i % 5}</p>", "k") for i, u in enumerate(urls)], PAGES).repartition(3)
    path = f"file://{tmp_path}/w"
    found = {r.page_id: r for r in warc.page_records(pages, path).collect()}
    assert sorted(found) == list(range(len(urls)))
    for i in found:
        last = max(k for k in found if k % 5 == i % 5)
        assert (found[i].record_type, found[i].refers_to, found[i].payload_digest) == (("response", None) if i == last else ("revisit", last)) + (digest(f"<p>{i % 5}</p>"),)
    assert {r.record_id: r.target_uri for r in warc.read_warc(spark, path).collect()} == {f"<urn:page:{i}>": u for i, u in enumerate(urls)}
    records = warc.read_warc(spark, path)
    again = f"file://{tmp_path}/again"
    records.write.format("warc").option("compression", packed).mode("append").save(again)
    key = lambda r: str(r.record_id)
    plain = [c for c in records.columns if c not in ("payload_digest", "content_length")]
    assert sorted(map(tuple, warc.read_warc(spark, again).select(plain).collect()), key=str) == sorted(map(tuple, records.select(plain).collect()), key=str)
    assert sorted(map(key, records.collect())) == sorted(f"<urn:page:{i}>" for i in range(len(urls)))


def test_ids_of_another_type(spark, tmp_path):
    rows = [("b\r\nx", "u", "same"), ("a", "u", "same"), ("", "u", "same"), (None, "u", "same"), ("z", None, None)]
    found = warc.page_records(spark.createDataFrame(rows, "page_id string, url string, html string"), f"file://{tmp_path}/w").collect()
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in found), key=str)
    assert got == sorted([("b\r\nx", "response", None), ("a", "revisit", "b\r\nx"), ("", "revisit", "b\r\nx"), (None, "revisit", "b\r\nx"), ("z", "response", None)], key=str)


def test_a_page_with_a_third_of_all_rows(spark, tmp_path):
    rows = [(i, "u", "hot" if i % 3 else f"page {i}") for i in range(3000)] + [(2998, "u", "hot")]
    found = warc.page_records(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), f"file://{tmp_path}/w").collect()
    assert len(found) == 3001
    assert sorted(r.page_id for r in found if r.record_type == "response") == sorted([i for i in range(0, 3000, 3)] + [2999])
    assert {r.refers_to for r in found if r.record_type == "revisit"} == {2999}


def test_no_pages(spark, tmp_path):
    assert warc.page_records(spark.createDataFrame([], PAGES), f"file://{tmp_path}/w").collect() == []


def test_a_damaged_last_member_is_named():
    from io import BufferedReader, BytesIO

    fields = {"WARC-Type": "response", "WARC-Record-ID": "<urn:page:7>", "WARC-Payload-Length": "3"}
    whole = warc.gzip_member(warc.record_bytes(fields, warc.http_block(b"abc" * 900)))
    assert len(list(warc.scan_members(BufferedReader(BytesIO(whole * 2)), lambda f: True))) == 2
    for cut in (1, 6, 9, 40):
        with pytest.raises(ValueError, match="urn:page:7|ends in its header"):
            list(warc.scan_members(BufferedReader(BytesIO(whole + whole[:-cut])), lambda f: True))
