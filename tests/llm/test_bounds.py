"""Time and memory stay in proportion to the input where a file, a page, a url or a hub is made to cost more."""

import hashlib
import re
import struct
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from barloom.llm import common, media, urlfilter, warc


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def empty_runs(payload, runs):
    """A file of ``payload`` with fragments that claim as many samples as the file has bytes, none of which costs a byte."""
    data = media.write_media(payload)
    run = box(b"trun", struct.pack(">II", 0, len(data)))
    head = box(b"tfhd", struct.pack(">II", 0x20000, 1))
    return data + box(b"moof", box(b"traf", head, *[run] * runs))


@pytest.mark.parametrize("runs", [1, 50, 1500])
def test_fragments_cannot_claim_more_samples_than_bytes(runs):
    tracemalloc.start()
    began = time.time()
    data = empty_runs(b"x" * 192, runs)
    try:
        found = media.tracks(data)
        assert sum(len(t["samples"]) for t in found) <= len(data)
    except ValueError as e:
        assert "run of samples" in str(e)
    assert time.time() - began < 5 and tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()


def test_members_that_inflate_beyond_their_records(monkeypatch):
    """A small member of 2 GB of zeros, bare and behind a good record, costs little and loses no other record; one that declares its size is read."""
    import gzip
    import zlib

    zeros = zlib.compressobj(9, zlib.DEFLATED, 31)
    good = [warc.member(warc.record(i, f"http://h/{i}", b"p" * 1500, hashlib.sha1(b"p" * 1500).hexdigest(), None)) for i in range(3)]
    first = zlib.compressobj(9, zlib.DEFLATED, 31)
    chunk = bytes(1 << 24)
    bomb = b"".join([*(zeros.compress(chunk) for _ in range(125)), zeros.flush()])
    led = first.compress(warc.record(9, "http://h/9", b"q", hashlib.sha1(b"q").hexdigest(), None)) + b"".join([*(first.compress(chunk) for _ in range(20)), first.flush()])
    tracemalloc.start()
    began = time.time()
    rows = [r for r in warc.read_archive(good[0] + bomb + good[1] + led + good[2])]
    took, peak = time.time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["page_id"] for r in rows if r["kind"] != "gap"] == [0, 1, 9, 2] and len([r for r in rows if r["kind"] == "gap"]) == 2
    assert len(bomb) > 1_500_000 and took < 10 and peak < 500e6, (took, peak)
    monkeypatch.setattr(warc, "MEMBER_BYTES", 1000)
    body = b"z" * 3_000_000
    large = gzip.compress(warc.record(5, "http://h/5", body, hashlib.sha1(body).hexdigest(), None), mtime=0)
    assert [(r["kind"], len(r["payload"])) for r in warc.read_archive(large, most=1000)] == [("response", 3_000_000)]
    both = [(r["kind"], r["page_id"], r["length"]) for r in warc.read_archive(large + good[0] + large)]  # what follows a member of several steps
    assert both == [("response", 5, len(large)), ("response", 0, len(good[0])), ("response", 5, len(large))]


def test_pages_of_unclosed_tags_and_urls_of_ampersands(spark):
    html = ["<link rel=canonical " * 50_000, "<link " * 170_000 + "rel=canonical href=/x", "<meta http-equiv=refresh " * 40_000, "<" * 1_000_000, "rel=" * 250_000 + "<link canonical", "<link rel=" + " " * 1_000_000]
    urls = ["http://a.net/?" + "&" * 1_000_000, "http://b.org/?" + "&" * 500_000 + "x" + "?" * 500_000, "http://c.org/?" + "utm_" * 250_000, "http://d.org/p?utm_a=1&" * 40_000]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)] + [(100 + i, "http://h.org/p", h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(1)
    began = time.time()
    edges = {r.to_url for r in urlfilter.html_edges(pages).collect()}
    nodes = [r.n for r in pages.where("page_id < 100").orderBy("page_id").select(urlfilter.canonical_of(F.col("url")).alias("n")).collect()]
    took = time.time() - began
    assert edges == {"http://h.org/x"} and nodes[0] == "a.net/" and nodes[1].startswith("b.org/?&") and nodes[1].endswith("&x")
    assert took < 20, took  # ten pages and urls of a megabyte


def test_declared_links(spark):
    html = [
        '<LINK href="/a?x=1&amp;y=2" REL=canonical>', "<link rel='alternate' href='/no'><link rel = 'canonical' href = '/b'>", "<links rel=canonical href=/no>", '<link rel="canonical">x href="/no"',
        '<meta content="0; url=/c" http-equiv="refresh">', '<meta http-equiv=refresh content="5">', "<link rel=canonical href=mailto:x@y.org>", "<meta http-equiv=refresh content='0;url=javascript:go()'>",
        "<link rel=canonical href=data:text/html,x>", "<link rel=canonical href=//other.org/d>", "<link rel=canonical\nhref=https://z.org/e>", None, "",
    ]
    pages = spark.createDataFrame([("http://h.org/p", h) for h in html], "url string, html string")
    assert sorted(r.to_url for r in urlfilter.html_edges(pages).collect()) == ["http://h.org/a?x=1&y=2", "http://h.org/b", "http://h.org/c", "http://other.org/d", "https://z.org/e"]


def test_equal_html_makes_aliases_only_where_asked(spark):
    pages = spark.createDataFrame([(1, "http://bad.net/", "parked"), (2, "http://good.com/", "parked"), (3, "http://other.com/", "else"), (4, "http://none.com/", None)], "page_id long, url string, html string")
    rules = urlfilter.rules_frame(spark, [("block", "net", "/")])
    verdicts = lambda **o: {r.page_id: r.verdict for r in urlfilter.judge_urls(pages, rules, **o).collect()}
    assert verdicts() == {1: "block", 2: "allow", 3: "allow", 4: "allow"}
    assert verdicts(mirrors=True) == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_joins_of_a_hub_are_split(spark):
    """A node with most of the edges, and html that half of all pages share: with low thresholds Spark splits the joins."""
    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.openCostInBytes": "1k", "spark.sql.files.maxPartitionBytes": "32k",
    }
    held = {k: spark.conf.get(k) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        edges = common.materialize(spark.range(1, 60_000, 1, 8).select(F.when(F.col("id") % 4 < 3, 1_000_000).otherwise(F.col("id") + 1).alias("a"), F.col("id").alias("b")), "hub")
        made, used = common.star_edges(edges)
        final = lambda df: (df.collect(), df._jdf.queryExecution().executedPlan().toString())[1]
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        assert "skew=true" in final(both.join(used[0], "u")) and "skew=true" in final(made)
        pages = spark.range(40_000).select(F.concat(F.lit("http://h"), "id", F.lit(".org/")).alias("url"), F.when(F.col("id") % 2 == 0, "parked").otherwise(F.concat(F.lit("x"), F.col("id"))).alias("html"))
        pages = common.materialize(pages.repartition(12), "pages")
        assert "skew=true" in final(urlfilter.mirror_edges(pages))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_rounds_leave_no_tables_behind(spark):
    import os

    root = common.scratch_root(spark).removeprefix("file:") + "/" + spark.sparkContext.applicationId
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    common.connected_components(spark.createDataFrame([(2, 1), (3, 2), (9, 8)], "a long, b long")).collect()
    assert not [f for f in set(os.listdir(root)) - before if re.match("least|down|large-star", f)]
