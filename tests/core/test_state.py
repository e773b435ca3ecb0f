"""State in streams: features as a batch run gives them, hours that go out once, recovery from a checkpoint."""

import tempfile
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions.frames import numbered
from barloom.operators import features
from barloom.operators.recursive import recursive
from barloom.streaming import state
from barloom.streaming.candles import current_bars, write_bars

T0 = datetime(2024, 1, 1)
SCHEMA = "pair string, timestamp_utc timestamp, open double, high double, low double, close double, volume double"


def series(n, pair, seed):
    draw = np.random.default_rng(seed)
    c = 100 + np.round(np.cumsum(draw.normal(0, 1, n)), 2)
    return [(pair, T0 + timedelta(hours=i), float(x), float(x + draw.integers(0, 3)), float(x - draw.integers(0, 3)), float(x), float(draw.integers(0, 9))) for i, x in enumerate(c)]


def streamed(spark, batches, schema, make):
    """Each batch arrives while no query runs; the query starts again from its checkpoint."""
    state.use_rocksdb(spark)
    root = tempfile.mkdtemp(prefix="spark-")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        write_bars(make(spark.readStream.schema(schema).parquet(f"{root}/in")), f"{root}/out", f"{root}/checkpoint").awaitTermination()
        time.sleep(0.01)
    return f"{root}/out"


def test_late_and_repeated_bars_leave_what_a_batch_run_gives(spark):
    a, b = series(170, "a", 1), series(16, "b", 2)
    fixed = [a[150][:2] + (1.0, 2.0, 0.5, 1.5, 7.0)]  # a bar that is sent again with other prices
    batches = [a[:60] + b[:14], a[60:65] + a[68:140] + b[14:], a[140:] + fixed[:0], a[65:68] + a[130:132] + fixed]
    path = streamed(spark, batches, SCHEMA, lambda s: state.feature_stream(s, held=80))
    got = current_bars(spark, path).toPandas().sort_values(["pair", "timestamp_utc"]).reset_index(drop=True)
    bars = spark.createDataFrame([r for k, r in enumerate(a) if k != 150] + fixed + b, SCHEMA)
    want = features.volume(numbered(recursive(bars))).toPandas().sort_values(["pair", "timestamp_utc"]).reset_index(drop=True)
    late = got["pair"].eq("a") & got["timestamp_utc"].isin([r[1] for r in a[65:68]])
    assert len(got) == len(want) == 186
    # 75 and more rows late, with 80 held: still in their place.
    for c in state.KEPT:
        x, y = got[c].to_numpy(float), want[c].to_numpy(float)
        assert np.allclose(x, y, rtol=1e-9, atol=1e-9), c
    assert late.sum() == 3


def test_bars_later_than_what_is_held_go_out_without_values(spark):
    a = series(300, "a", 3)
    path = streamed(spark, [a[:20] + a[21:], a[20:21]], SCHEMA, lambda s: state.feature_stream(s, held=50))
    got = current_bars(spark, path).toPandas()
    lost = got[got["timestamp_utc"] == a[20][1]]
    assert len(got) == 300 and len(lost) == 1 and lost[list(state.KEPT)].isna().all(axis=None)
    assert got[got["timestamp_utc"] != a[20][1]][list(state.KEPT)].notna().all(axis=None)


@pytest.mark.parametrize("wait", [0, 2])
def test_hours_go_out_once_when_complete_or_at_their_deadline(spark, wait):
    at = lambda h, m=0: T0 + timedelta(hours=h, minutes=m)
    batches = [
        [("a", at(0)), ("b", at(0, 5)), ("a", at(0, 9)), (None, at(0)), ("a", at(1)), ("b", at(1)), ("c", at(1, 59))],  # hour 1 is complete, hour 0 has two pairs
        [("c", at(0, 30)), ("d", at(1)), ("a", at(5))],  # late: hour 0 is complete if the watermark lets it in
        [("b", at(5)), ("a", at(9))],
        [("c", at(5)), ("x", at(20))],  # far too late for hour 5
        [("a", at(60))],
    ]
    path = streamed(spark, batches, "pair string, ts timestamp", lambda s: state.release_hours(s, expected=3, late="1 hour", wait_ms=wait * 3_600_000))
    got = sorted((r.hour, r.bars, r.reason) for r in spark.read.parquet(path).collect())
    assert [(h, n, r) for h, n, r in got if h == at(1)] == [(at(1), 3, "complete")]
    assert got == sorted([(at(0), 2, "deadline"), (at(1), 3, "complete"), (at(5), 2, "deadline"), (at(9), 1, "deadline"), (at(20), 1, "deadline")])
