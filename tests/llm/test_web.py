"""URL lists and archives."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections import Counter

from pyspark.sql import functions as F

from protlake.llm import url_lists, warc
from protlake.session import scratch_path


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def test_captures_meet_the_entries_of_their_day(spark):
    entries = spark.createDataFrame([
        ("h", "bad.example.org", "add", "block", day(10), "x"), ("h", "bad.example.org", "remove", "block", day(20), "x"), ("h", "bad.example.org", "add", "block", day(30), "x"),
        ("h", "bad.example.org", "add", "block", day(30), "x"), ("p", "bad.example.org/fine", "add", "allow", day(0), "x"), ("d", "example.org", "add", "block", day(35), "x"),
        ("h", None, "add", "block", day(0), "x"), ("h", "other.org", "add", "block", None, "x"), ("h", "late.org", "add", "block", day(5), "x"), ("h", "late.org", "remove", "block", day(5), "x"),
    ], "list string, key string, action string, verdict string, dated date, host string")
    url = "https://user@BAD.example.org:8080/Fine/x?q=1"
    captures = spark.createDataFrame([
        (1, "http://bad.example.org/", day(9), "x"), (2, "http://bad.example.org/", day(10), "x"), (3, "http://bad.example.org/", day(20), "x"), (4, "http://bad.example.org/a", day(40), "x"),
        (5, url, day(12), "x"), (6, "http://late.org/", day(5), "x"), (7, None, day(40), "x"), (8, "", day(40), "x"), (9, "http://example.org", None, "x"), (10, "no url", day(40), "x"),
        (2, "http://bad.example.org/", day(10), "x"), (None, "http://www.example.org.", day(36), "x")], "page_id long, url string, fetched date, key string")
    got = Counter((r.page_id, r.verdict, r.matched, r.active_entries) for r in url_lists.judged(captures, entries).collect())
    assert got == Counter([
        (1, None, None, 0), (2, "block", "bad.example.org", 1), (2, "block", "bad.example.org", 1), (3, None, None, 0), (4, "block", "bad.example.org", 2),
        (5, "allow", "bad.example.org/fine", 2), (6, None, None, 0), (7, None, None, 0), (8, None, None, 0), (9, None, None, 0), (10, None, None, 0), (None, "block", "example.org", 1)])
    assert url_lists.judged(captures.limit(0), entries).count() == 0
    assert url_lists.judged(captures, entries.limit(0)).filter("verdict is null").count() == captures.count()


def pages():
    big, other = "é<p>" * 400, "b" * 999
    return [(1, "http://a/", big), (2, "http://b/", big), (3, None, big), (3, None, big), (4, "http://c/", other), (5, "http://d/", other), (6, "http://e/", None), (7, "http://f/", ""),
            (8, "http://g/\r\nX: y", "\r\n\r\nWARC/1.1\r\n"), (9, "http://h/", "z" * 3_000_000), (None, "http://i/", big), (None, None, None)]


def test_archives_come_back_whole(spark):
    table = pages()
    df = spark.createDataFrame([(*r, "mine", "mine") for r in table], "page_id long, url string, html string, digest string, frame string").repartition(3)
    folder = scratch_path(spark, "archives")
    index = warc.write_archives(df, folder, frame_bytes=4000).cache()
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, index).collect())
    want = Counter()
    for i, _, html in table:
        data = (html or "").encode()
        revisit = i in (1, 2)
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None] += 1
    assert got == want
    texts = {i: h for i, _, h in table}
    for row in index.filter("page_id in (4, 6, 8, 9)").collect():
        headers, block = warc.read_record(row.asDict())
        assert block == (texts[row.page_id] or "").encode() and headers["WARC-Type"] == "response"
    assert index.select(F.countDistinct("bundle", "frame")).first()[0] > 3
    index.unpersist()
    assert warc.archived(df.limit(0)).count() == 0
