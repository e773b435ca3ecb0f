"""Stored tables, key filters and bucketed joins: what changes, what is opened, what survives a failed writer."""

import re
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from barloom.operators import keyfilter, upsert
from barloom.sources import candles
from barloom.sources.stored import StoredTable

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def bars(spark):
    return candles.candles_from_events(candles.read_table(spark, SF, "events"), "1 hour").withColumn("note", F.lit("n")).cache()


@pytest.fixture
def table(spark, bars):
    made = StoredTable(spark, tempfile.mkdtemp(prefix="spark-") + "/t", "date_format(timestamp_utc, 'MM/dd: EEE')")
    assert made.create(bars) == 0
    return made


def rows(df):
    return sorted(map(str, df.collect()))


def files(table, version=None):
    return {r["file"]: r["part"] for r in table.manifest(version).collect()}


def test_update_rewrites_only_what_it_touches(spark, bars, table):
    day = bars.where("dayofmonth(timestamp_utc) in (3, 9)")
    new = day.select("pair", "timestamp_utc", F.when(F.hour("timestamp_utc") % 2 == 0, F.col("volume") * 10).alias("volume"), F.lit("changed").alias("note"))
    strangers = new.limit(3).withColumn("timestamp_utc", F.lit("2031-01-01").cast(new.schema["timestamp_utc"].dataType))
    assert table.update(new.unionByName(strangers).unionByName(new)) == 1
    assert rows(table.read()) == rows(upsert.join_update(bars, new)) and rows(table.read(version=0)) == rows(bars)
    before, after = files(table, 0), files(table)
    touched = {p for p in before.values() if p[:5] in ("01/03", "01/09")}
    assert touched and {f for f, p in before.items() if p not in touched} == {f for f, p in after.items() if p not in touched}
    assert not {f for f, p in before.items() if p in touched} & set(after)
    assert table.update(strangers) == 1 and table.versions() == [0, 1]


def test_failed_and_concurrent_writers_leave_the_table_whole(spark, bars, table, monkeypatch):
    new = bars.select("pair", "timestamp_utc", F.lit(7.0).alias("volume"))
    monkeypatch.setattr(StoredTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        table.update(new)
    monkeypatch.undo()
    assert table.versions() == [0] and rows(table.read()) == rows(bars)
    assert table.vacuum(older_than_s=3600) == 0 and table.vacuum(older_than_s=-5) == 1
    assert rows(table.read()) == rows(bars)
    table.update(new)
    with pytest.raises(Exception, match="exist"):  # another writer that read version 0, too
        table._commit(table.manifest(0), 1)
    assert table.read().where("volume <> 7").count() == 0
    with pytest.raises(FileExistsError):
        table.create(bars)
    assert table.vacuum(keep=1, older_than_s=-5) >= 1 and table.versions() == [1] and table.read().count() == bars.count()


def test_insert_adds_files_and_empty_tables_work(spark, bars, table):
    first = files(table)
    more = bars.limit(5).unionByName(bars.limit(4).withColumn("timestamp_utc", F.col("timestamp_utc") + F.expr("interval 400 days")))
    table.insert(more.unionByName(more).withColumn("unknown", F.lit(1)))
    assert table.read().count() == bars.count() + 4 and set(first) <= set(files(table))
    none = StoredTable(spark, tempfile.mkdtemp(prefix="spark-") + "/t")
    none.create(bars.limit(0))
    assert none.read().count() == 0 and none.read("click", "2024-01-01").count() == 0 and none.update(bars) == 0
    none.insert(bars)
    assert rows(none.read()) == rows(bars)
    with pytest.raises(FileNotFoundError):
        StoredTable(spark, tempfile.mkdtemp(prefix="spark-")).read()


def test_scan_of_a_pair_and_a_week_opens_few_files(spark, table, bars):
    got = table.read("view", "2024-01-05", "2024-01-11 23:00:00")
    want = candles.in_range(candles.of_pair(bars, "view"), "2024-01-05", "2024-01-11 23:00:00")
    assert rows(got) == rows(want)
    assert len(got.inputFiles()) <= 16 < len(table.read().inputFiles())  # a day has a file or two
    assert len(table.read("zzz").inputFiles()) == 0


def test_bucketed_tables_are_joined_without_an_exchange(spark, bars):
    names = [f"b{uuid.uuid4().hex}" for _ in range(2)]
    for name, df in zip(names, (bars, bars.select("pair", "timestamp_utc", F.lit(3.0).alias("volume"))), strict=True):
        upsert.write_bucketed(df, name, 4)
    for name in names:
        upsert.analyze(spark, name)
    stats = spark.sql(f"DESCRIBE EXTENDED {names[0]} pair").collect()
    assert any(r[0] == "distinct_count" and int(r[1]) == 5 for r in stats)
    held = {k: spark.conf.get(k) for k in ("spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = upsert.join_update(spark.table(names[0]), spark.table(names[1]))
        assert not re.search(r"\bExchange\b", joined._jdf.queryExecution().executedPlan().toString())
        assert joined.where("volume <> 3").count() == 0
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
        for name in names:
            spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("cell_keys", [25_000, 40])
def test_filter_inserts_what_the_anti_join_does(spark, bars, monkeypatch, cell_keys):
    monkeypatch.setattr(keyfilter, "CELL_KEYS", cell_keys)
    odd = spark.createDataFrame([(None, None, 1.0), (None, None, 2.0)], "pair string, timestamp_utc timestamp_ntz, open double")
    have = bars.where("xxhash64(pair, timestamp_utc) % 3 = 0").select("pair", "timestamp_utc", F.col("open").alias("__one"), "note")
    have = have.unionByName(have.limit(1).withColumns({"pair": F.lit(None), "timestamp_utc": F.lit(None)}))
    new = bars.select("pair", "timestamp_utc", F.col("open").alias("__one"), "note")
    new = new.unionByName(new).unionByName(odd.select("pair", "timestamp_utc", F.col("open").alias("__one"), F.lit("n").alias("note")))
    for period in (None, F.date_format("timestamp_utc", "yyyy-MM-dd")):
        known = keyfilter.build_filter(have, period=period)
        assert known.selectExpr("max(size(words)) = min(size(words)) and min(size(words)) = 4096").first()[0]
        want = rows(upsert.insert_ignore(have, new))
        for few in (500_000, 0):
            monkeypatch.setattr(keyfilter, "BROADCAST_KEYS", few)
            monkeypatch.setattr(keyfilter, "BROADCAST_CELLS", few)
            assert rows(keyfilter.insert_unknown(have, new, known, period=period)) == want
        assert rows(keyfilter.insert_unknown(have.limit(0), new, keyfilter.build_filter(have.limit(0), period=period), period=period)) == rows(upsert.one_of_each(new, upsert.KEY))
        assert keyfilter.insert_unknown(have, new.limit(0), known, period=period).count() == 0


def test_filter_spares_most_unknown_rows(spark):
    have = spark.range(0, 100_000).select(F.col("id").alias("pair"), F.lit(0).alias("timestamp_utc"))
    new = spark.range(90_000, 190_000).select(F.col("id").alias("pair"), F.lit(0).alias("timestamp_utc"))
    r = keyfilter.filter_figures(have, new, keyfilter.build_filter(have)).first()
    print("filter figures", r)
    assert r["missed"] == 0 and r["repeats"] == 10_000 and r["possible"] - r["repeats"] < 0.015 * (r["rows"] - r["repeats"])
