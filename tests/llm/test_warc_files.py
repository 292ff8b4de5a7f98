"""Archives: odd urls, the record that opens a file, and the number of tasks."""

from __future__ import annotations

import gzip

from ticklattice.llm import shared, warc


def test_odd_urls_come_back_and_files_open_with_their_info(spark):
    urls = ["http://a/\x01b", "http://é/日", "", None, "http://x/%01", "http://y/\r\nWARC-Type: response"]
    rows = [(k, u, "<p>é</p>" * 40 if k % 2 else None) for k, u in enumerate(urls)]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), shared.scratch(spark, "warc"))
    got = {r["page_id"]: r for r in warc.read_archives(index).collect()}
    assert {k: r["url"] for k, r in got.items()} == dict(enumerate(urls))
    assert [got[k]["record_type"] for k in (1, 3, 5)] == ["response", "revisit", "revisit"]
    files = {r["file"] for r in index.collect()}
    for f in files:
        text = gzip.decompress(shared.read_bytes(f))
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and text.count(b"WARC-Type: warcinfo") == 1
    assert min(r["offset"] for r in index.collect()) > 0


def test_few_bytes_make_few_tasks(spark):
    index = spark.createDataFrame([("f", k << 30, 1 << 30, k, "u", "d", "response", None) for k in range(64)], warc.INDEX)
    cores = spark.sparkContext.defaultParallelism
    assert warc.read_archives(index).rdd.getNumPartitions() == 1 + 64 * 4
    assert warc.read_archives(index.limit(0)).count() == 0
    assert warc.read_archives(index.limit(1)).rdd.getNumPartitions() <= 1 + warc.TASKS * cores
