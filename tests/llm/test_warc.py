"""WARC archives: round trip, records, index lookups."""

import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from skytrace.llm import common, warc
from skytrace.llm.common import table

LONG = "<p>" + "é\U0001f600x" * 600
ROWS = [(1, "http://a.example.org/x", LONG), (2, "http://b.example.org:8080/?q=1", LONG), (9, "https://user@c.org", LONG), (3, None, "short"), (4, "not a url\r\nX: y", "short"), (5, "http://[bad", None),
        (6, "", ""), (7, "http://a.example.org/x", "z" * 999), (8, "http://a.example.org/x", "z" * 999), (7, "http://a.example.org/x", "z" * 999), (None, "http://n.org", LONG)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'mine' AS digest", "1 AS shared", "'k' AS key")


@pytest.mark.parametrize("limit", [0, 300_000])
def test_round_trip(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "LOOKUP_ROWS", limit)
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages(spark)).collect()), key=str)
    want = []
    for page, _, html in ROWS:
        data = (html or "").encode()
        again = len(data) >= 1000 and page != 9
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", 9 if again else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages(spark).limit(0)).count() == 0


def test_archives_are_gzip_members(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    warc.write_archives(pages(spark), folder)
    data = b"".join(gzip.decompress((tmp_path / "w" / n).read_bytes()) for n in os.listdir(tmp_path / "w") if n.endswith(".warc.gz"))
    assert data.count(b"WARC/1.1\r\n") == len(ROWS) and data.count(b"WARC-Type: revisit") == 3
    assert data.endswith(b"\r\n\r\n") and b"\nX: y" not in data


def test_keys():
    assert warc.reversed_host_key("http://m.Example.org:80/a?b=1#t") == "org,example,m)/a?b=1"
    assert warc.reversed_host_key("https://x.org:8443") == "org,x:8443)/"
    assert warc.reversed_host_key(None) == ")/"


def test_lookup_by_url(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 5)
    monkeypatch.setattr(warc, "PART_LINES", 60)
    source = table(spark, sf_dir, "pages")
    twice = source.union(source.limit(20).selectExpr("page_id + 100000", "url", "html")).union(spark.createDataFrame([(500000 + i, "http://hot.org/", "x") for i in range(23)], source.schema))
    folder = f"file://{tmp_path}"
    parts = warc.write_index(warc.write_archives(twice, folder + "/a"), folder + "/i")
    assert parts.count() > 1
    some = [r["url"] for r in source.collect()][:40] + ["http://hot.org/", "http://nowhere.org/", "zzz"]
    urls = list({warc.reversed_host_key(u): u for u in some}.values())
    found = warc.find(spark.createDataFrame([(u,) for u in urls], "url string"), parts, folder + "/i")
    rows = warc.read_records(found, folder + "/a", 1, payloads=True).collect()
    want = sorted((r["page_id"], (r["html"] or "").encode()) for r in twice.collect() if warc.reversed_host_key(r["url"]) in set(map(warc.reversed_host_key, urls)))
    assert sorted(r["page_id"] for r in rows) == [p for p, _ in want]
    payload = dict(want)
    assert all(bytes(r["payload"]) == payload[r["page_id"]] for r in rows if r["record_type"] == "response")


def test_reading_back_needs_the_order_and_the_responses(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    source = pages(spark)
    urls, folder = source.select("url"), f"file://{tmp_path}"
    placed = warc.write_archives(source, folder + "/archives")
    good = warc.write_index(placed, folder + "/index")
    assert warc.read_back(urls, good, folder).count() == len(ROWS)
    # keys out of order: the search misses captures
    broken = warc.write_index(placed.withColumn("key", F.reverse("key")), folder + "/index")
    with pytest.raises(RuntimeError, match="the search found"):
        warc.read_back(urls, broken, folder)
    # without the response its revisits can't be resolved
    lone = placed.where("page_id IS NULL OR page_id <> 9")
    with pytest.raises(Exception, match="no matching response"):
        warc.read_back(urls.where("url IS NULL OR url <> 'https://user@c.org'"), warc.write_index(lone, folder + "/index"), folder).collect()
