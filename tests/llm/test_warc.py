import base64
import hashlib

from shoal.llm import scratch, warc

PAGES = "page_id long, url string, html string, key string, file string, _digest string"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def build(spark, rows, per_block=4, per_file=3):
    path = scratch.new_path(spark, "warc")
    warc.write(pages(spark, rows), path)
    return warc.CaptureIndex.build(spark, path, scratch.new_path(spark, "cdx"), per_block, per_file)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", "f", "d") for r in rows], PAGES)


ROWS = [
    (1, "http://www.a.com/x", "one"), (2, "https://b.org/y?q=2&a=1#f", "one"), (3, None, None), (4, "http://a.com/x/", ""), (5, "http://a.com/z", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"),
    (6, "http://c.net/ a\r\nb", "long " * 200_000), (None, "http://d.com", "one"), (7, "http://e.com", "tie"), (7, "http://e.com", "tie"), (7, "http://e.com", "tie"), (8, "::bad::[", "x"),
]


def test_records_come_back(spark):
    got = build(spark, ROWS).find(pages(spark, ROWS).select("url")).collect()
    assert len(got) == len(ROWS)
    winner = {}
    for i, _, h in ROWS:
        winner[digest(h)] = max(winner.get(digest(h), -1), -1 if i is None else i)
    for i, _, h in ROWS:
        own = [r for r in got if r["page_id"] == i and r["payload_digest"] == digest(h)]
        assert own and all(r["payload_bytes"] == len((h or "").encode()) for r in own)
        if winner[digest(h)] == (-1 if i is None else i):
            assert sorted(r["record_type"] for r in own) == ["response"] + ["revisit"] * (len(own) - 1)
        for r in own:
            assert r["refers_to"] == (None if r["record_type"] == "response" else winner[digest(h)])


def test_lookup(spark):
    index = build(spark, ROWS + [(100 + k, f"http://h{k % 7}.com/{k}", f"p{k}") for k in range(60)])
    assert {r["page_id"] for r in index.lookup(["https://a.com/x"]).collect()} == {1, 4}
    assert {r["page_id"] for r in index.lookup(["http://b.org/y?a=1&q=2", "http://h3.com/3", "http://none.com"]).collect()} == {2, 103}
    assert index.lookup([]).count() == 0


def test_a_lookup_reads_only_the_blocks_that_may_hold_its_key(spark):
    rows = [(k, f"http://h{k:04d}.com/", f"p{k}") for k in range(200)] + [(1000 + k, "http://same.com/", f"q{k}") for k in range(50)]
    index = build(spark, rows)
    url = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    assert len(index.top) > 3 and all(a[1] <= b[0] for a, b in zip(index.top, index.top[1:], strict=False))
    assert index.locate(url("http://h0100.com/")).count() == 1
    assert index.locate(url("http://h0100.com/", "http://h0101.com/", "http://zzz.com")).select("file", "start").distinct().count() <= 2
    many = index.locate(url("http://same.com/", None, "http://same.com")).count()
    assert 13 <= many <= 16  # 50 captures in blocks of four, which may begin and end elsewhere
    assert {r["page_id"] for r in index.lookup(["http://same.com/"]).collect()} == set(range(1000, 1050))


def test_no_pages(spark):
    assert build(spark, []).lookup(["http://a.com"]).count() == 0


def test_url_keys():
    assert warc.url_key("https://www.Example.com:443/A/") == "com,example)/a" and warc.url_key(None) == ""
