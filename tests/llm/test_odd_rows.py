"""Repeated rows, null columns and long values: results are compared, not only counted."""

import pytest
from pyspark.sql import functions as F

from barloom.llm import common, exactdedup, media, mixing, secretscan, urlfilter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def doubled(once, twice):
    """Whether ``twice`` has every row of ``once`` two times, and no other row."""
    rows = sorted(map(str, once.collect()))
    return sorted(map(str, twice.collect())) == sorted(rows * 2)


def test_repeated_rows_repeat_their_results(spark, docs):
    model = secretscan.train(docs)
    assert doubled(secretscan.scan(docs, model), secretscan.scan(docs.unionAll(docs), model))
    few = docs.where("doc_id % 4 = 1")
    digest = lambda d: media.digest(common.materialize(media.store(d), "media-test"))
    assert doubled(digest(few), digest(few.unionAll(few)))
    got = mixing.mix_sizes(docs.unionAll(docs)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("size", "target", "taken").alias("values"))
    assert got.where("n <> 2 or values <> 1").count() == 0 and got.count() == docs.count()


def test_stages_with_null_sources_and_repeated_rows(spark, docs):
    import corpus_pipeline as p

    some = docs.where("doc_id < 60").withColumn("source", F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("source")))
    ids = lambda d: sorted(r[0] for r in d.select("doc_id").collect())
    once = twice = some
    twice = twice.unionAll(twice)
    for name, stage in p.STAGES[:-1]:
        once, twice = (common.materialize(stage(spark, d, SF), "stage-test") for d in (once, twice))
        if name == "language":
            assert ids(twice) == sorted(ids(once) * 2)
        elif name != "mix":  # exact copies are gone: each document once
            assert ids(twice) == ids(once)
    assert ids(twice) == ids(once) and once.where("source is null").count() > 0
    tokens = p.token_ids(spark, once, SF)
    assert ids(tokens) == ids(once)
    assert doubled(tokens, p.token_ids(spark, once.unionAll(once), SF))


def test_long_urls_and_pages(spark):
    far = "http://a.net/" + "x/" * 40_000
    rows = [(1, far, "y" * 300_000), (2, "http://b.org/" + "?" * 50_000, "<link rel=canonical href='" + far + "'>" + "<" * 200_000), (3, "x" * 100_000 + "://h.net", None), (4, "http://" + "s." * 20_000 + "net/p", ""), (5, None, "z"), (5, None, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("q") for c in ("host", "path", "node", "component", "rule")})
    rules = urlfilter.rules_frame(spark, [("block", "net", "/")])
    got = sorted((r.page_id, len(r.host), len(r.path), r.rule, r.verdict) for r in urlfilter.judge_urls(pages, rules).collect())
    assert got == [(1, 5, 80_001, "net/", "block"), (2, 5, 1, None, "block"), (3, 5, 0, None, "allow"), (4, 40_003, 2, "net/", "block"), (5, 0, 0, None, "allow"), (5, 0, 0, None, "allow")]


def test_dropped_keys_by_broadcast_and_by_shuffle(spark, docs, monkeypatch):
    """Both plans leave the same rows, and the shuffle plan sorts no texts."""
    more = docs.unionAll(docs.withColumn("doc_id", F.col("doc_id") + 5000)).unionAll(spark.createDataFrame([(None, "a", None, None, None), (None, "A", None, None, None)], docs.schema))
    kept = {}
    for keys in (500_000, 0):
        monkeypatch.setattr(common, "BROADCAST_KEYS", keys)
        found = exactdedup.drop_exact_duplicates(more)
        plan = found._jdf.queryExecution().executedPlan().toString()
        kept[keys] = sorted(map(str, found.collect()))
        assert "SortMergeJoin" not in plan and ("BroadcastHashJoin" if keys else "ShuffledHashJoin") in plan
    assert kept[500_000] == kept[0] and len(kept[0]) <= docs.count() + 1
    gone = docs.where("doc_id % 11 = 3").select("doc_id")
    for keys in (5, 5000):
        monkeypatch.setattr(common, "BROADCAST_KEYS", keys)
        left = common.without(docs, gone, docs["doc_id"] == gone["doc_id"])
        assert {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.where("doc_id % 11 <> 3").collect()}
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    assert common.without(docs, gone.limit(0), docs["doc_id"] == gone["doc_id"]).count() == docs.count()
