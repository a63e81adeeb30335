"""Live sources against a loopback server that fails twice before it answers, and files of records."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from veriflux.operators import intake
from veriflux.sources import readers, records, web

ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:a="http://www.w3.org/2005/Atom"><title>all</title>
<entry><id>i1</id><title type="html"><![CDATA[A <entry> &  more]]></title><summary>one
 two</summary><published>2024-01-02T00:00:00Z</published><updated>2024-01-03T00:00:00Z</updated><link rel="self" href="s"/><link rel="alternate" href="http://a/1"/></entry>
<a:entry><a:id>i2</a:id><a:title>B &amp; C</a:title><a:link href="http://a/2"/></a:entry></feed>"""
POSTS = {"data": [{"id": "7", "author_id": "1", "text": "look  here", "created_at": "2024-02-03T04:05:06Z"}, {"id": "8", "author_id": "2", "text": "x" * 300}], "includes": {"users": [{"id": "1", "username": "ann"}]}}


@pytest.fixture(scope="module")
def server():
    asked, fails = Counter(), 2

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            at, query = urlparse(self.path).path, parse_qs(urlparse(self.path).query)
            if at == "/never" or asked[self.path] <= fails:
                self.send_error(503)
                return
            body = {"/feed": ATOM, "/posts": json.dumps(POSTS), "/list": '[{"v": 1}, {"v": null}, 3]', "/one": '{"v": 1}',
                    "/lookup": json.dumps({"results": [1, 2] if query.get("url") == ["http://n/1?x=y"] else []})}.get(at, at)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", asked
    httpd.shutdown()


def test_three_tries_and_a_cache(spark, server, tmp_path):
    base, asked = server
    addresses, cache = [f"{base}/page/{i}" for i in range(6)], f"file://{tmp_path}/cache"
    got = web.fetched(spark, [*addresses, addresses[0]], cache, delay=0.01).collect()
    assert sorted((r.address, r.body, r.attempts, r.error) for r in got) == [(a, a.removeprefix(base), 3, None) for a in sorted(addresses)]
    again = web.fetched(spark, addresses, cache, delay=0.01).collect()
    assert {(r.body, r.attempts) for r in again} == {(f"/page/{i}", 0) for i in range(6)} and all(asked[f"/page/{i}"] == 3 for i in range(6))
    assert web.fetched(spark, [], cache).collect() == []
    lost = web.fetched(spark, [f"{base}/never", addresses[1]], cache, delay=0.01, strict=False).collect()
    assert {(r.body, r.attempts, r.error is None) for r in lost} == {(None, 3, False), ("/page/1", 0, True)}
    with pytest.raises(Exception, match="3 attempts"):
        web.fetched(spark, [f"{base}/never"], delay=0.01).collect()


def test_addresses_and_page_sizes():
    size = lambda a: parse_qs(urlparse(a).query)["max_results"][0]
    assert [size(web.posts_address("q", n)) for n in (1, 10, 50, 500)] == ["10", "10", "50", "100"]
    assert [size(web.list_address("42", n)) for n in (1, 5, 500)] == ["5", "5", "100"] and "/lists/42/tweets" in web.list_address("42")
    assert parse_qs(urlparse(web.lookup_address("http://n/1?x=y")).query)["url"] == ["http://n/1?x=y"]
    assert parse_qs(urlparse(web.feed_address("all:agents & tools", 7)).query)["search_query"] == ["all:agents & tools"]
    assert len(web.AddressReader({"addresses": json.dumps([str(i) for i in range(5000)])}).partitions()) == web.PARTITIONS


def test_feeds_lookups_posts_and_documents(spark, server, tmp_path):
    base, _ = server
    feeds = f"file://{tmp_path}/feeds"
    assert [r.attempts for r in web.feed_files(spark, [("q", 5)], feeds, base=f"{base}/feed", delay=0.01).collect()] == [3]
    config = spark.createDataFrame([("agents", ["s"], ["c"], "ingress", "q")], "name string, affected_surfaces array<string>, risk_categories array<string>, proposed_probe_stage string, query string")
    entries = readers.atom_entries(spark, feeds)
    assert sorted(tuple(r) for r in entries.collect()) == [("i1", "A <entry> & more", "one two", "2024-01-02", "2024-01-03", "http://a/1"), ("i2", "B & C", "", "", "", "http://a/2")]
    signals = {r.source_url: r for r in intake.feed_signals(entries, config, "2025-05-05").collect()}
    assert signals["http://a/1"].observed_at == "2024-01-03" and signals["http://a/2"].observed_at == "2025-05-05"
    records_ = spark.createDataFrame([("http://n/1?x=y", "t"), ("http://n/2", None)], "url string, title string")
    found = web.looked_up(spark, records_, f"{base}/lookup", delay=0.01)
    got = {r.source_url: (r.title, r.evidence_status, r.actionability, r.notes) for r in intake.lookup_signals(found, "2024-01-01").collect()}
    assert got == {"http://n/1?x=y": ("t", "corroborated", 3, "lookup_result_count=2"), "http://n/2": ("AIID lookup for http://n/2", "unverified", 2, "lookup_result_count=0")}
    posts = intake.posts(*web.posts_and_users(web.fetched(spark, [f"{base}/posts"], delay=0.01)), "2025-01-01", source_name="X recent search: q", raw_detail_policy="summarize_only")
    got = {r.event_id: r for r in posts.collect()}
    assert (got["7"].source_url, got["7"].title, got["7"].summary, got["7"].observed_at) == ("https://x.com/ann/status/7", "X weak signal from @ann", "look here", "2024-02-03")
    assert (got["8"].source_url, got["8"].observed_at, len(got["8"].summary), got["8"].source_name, got["8"].raw_detail_policy) == ("https://x.com/i/web/status/8", "2025-01-01", 220, "X recent search: q", "summarize_only")
    (tmp_path / "d.json").write_text(' [{"v": 1}, {"v": null}, 3]')
    for where in (f"{base}/list", str(tmp_path / "d.json")):
        cache = f"file://{tmp_path}/c"
        if web.is_address(where):
            web.fetched(spark, [where], cache, delay=0.01).collect()
        assert sorted(r.j for r in web.json_documents(spark, where, cache).select(F.to_json("document").alias("j")).collect()) == ["3", '{"v":1}', '{"v":null}']


def test_a_large_feed_is_several_tasks(spark, tmp_path):
    n = 20_000
    entry = "<entry><id>{0}</id><title>t {0}</title><updated>2024-01-01T00:00:00Z</updated><link rel='alternate' href='http://a/{0}'/></entry>"
    (tmp_path / "feed.xml").write_text("<feed>" + "\n".join(entry.format(i) for i in range(n)) + "\n<entry><id>bad</id><title>no end</titl></entry></feed>")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
        rows = readers.atom_entries(spark, str(tmp_path / "feed.xml"), split=True)
        assert rows.rdd.getNumPartitions() > 4
        assert sorted(int(r.entry_id) for r in rows.select("entry_id").collect()) == list(range(n))
        bad = readers.rejected(readers.atom_entries(spark, str(tmp_path / "feed.xml"), keep_rejected=True, split=True)).collect()
        assert len(bad) == 1 and "no end" in bad[0][readers.CORRUPT]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def names(folder):
    return sorted(p.name for p in folder.iterdir())


def test_one_file_for_each_record(spark, tmp_path):
    rows = spark.createDataFrame([("ART-008", 1), ("ART-009", 2), ("ART-009", 3), ("a/b c", 4)], "trace_id string, v int").repartition(3)
    out = tmp_path / "out"
    for _ in range(2):  # the same batch again changes nothing
        records.write_records(rows, f"file://{out}", "trace_id", "b1")
        assert names(out) == ["ART-008.json", "ART-009.json", "_batch-b1", "a%2Fb%20c.json"]
    assert json.loads((out / "ART-008.json").read_text()) == {"trace_id": "ART-008", "v": 1}
    records.write_records(rows.where("v = 1").withColumn("v", F.lit(5)), f"file://{out}", "trace_id", "b2")
    assert json.loads((out / "ART-008.json").read_text())["v"] == 5 and len(names(out)) == 5
    with pytest.raises(Exception, match="has no trace_id"):
        records.write_records(spark.createDataFrame([(None, 1)], "trace_id string, v int"), f"file://{out}", "trace_id", "b3")
    assert len(names(out)) == 5  # a job that fails leaves nothing
    records.write_records(rows.limit(0), f"file://{out}", "trace_id", "b4")
    assert names(out)[-2:] == ["_batch-b4", "a%2Fb%20c.json"]


def test_a_retried_task_leaves_no_second_copy(tmp_path):
    out = tmp_path / "out"
    writer = records.RecordWriter({"path": f"file://{out}", "batch": "b"})
    first = writer.write(iter([("x", "1"), ("y", "2")]))  # this attempt's message is lost
    second, other = writer.write(iter([("x", "1"), ("y", "2")])), writer.write(iter([("z", "3")]))
    assert first.name != second.name
    writer.commit([second, other, None])
    assert names(out) == ["_batch-b", "x.json", "y.json", "z.json"]
    late = records.RecordWriter({"path": f"file://{out}", "batch": "c"})
    late.write(iter([("q", "1")]))
    late.abort([None])
    assert names(out) == ["_batch-b", "x.json", "y.json", "z.json"]
