"""Exact quantiles by distributed selection: histograms of leading bits, refined where wanted ranks lie.

A double becomes a whole number of the same order. The first pass counts values by their leading ``BITS`` bits; a rank
lies in one cell, and the next pass counts only the values of such cells by their next bits. At most five passes fix all
64 bits, and a rank whose cell holds one value is done before. Once no cell holds more than ``CELL_VALUES`` values, the last pass
counts these values themselves. No task sees a column whole: what is shuffled are partial counts of cells, of which a
group has at most 2^``BITS``, or ``CELL_VALUES``, for each rank it is still looking for. Equal values may come as one row with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.scratch import written

#: Bits that a pass fixes, and values of a cell that one task may order.
BITS, CELL_VALUES = 13, 1 << 17
#: Tables of wanted ranks are broadcast up to so many rows; beyond, they are joined by shuffle.
BROADCAST_RANKS = 500_000
_SIGN = np.int64((1 << 63) - 1)


@F.pandas_udf(T.LongType())
def ordered(v: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Whole numbers in the order of doubles; -0.0 is 0.0."""
    for x in v:
        b = (x.to_numpy(float) + 0.0).view(np.int64)
        yield pd.Series(np.where(b < 0, b ^ _SIGN, b))


@F.pandas_udf(T.DoubleType())
def restored(v: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The doubles of ``ordered`` numbers."""
    for x in v:
        b = x.to_numpy(np.int64)
        yield pd.Series(np.where(b < 0, b ^ _SIGN, b).view(float))


def _prefix(bits: int) -> Column:
    """The leading bits of a key, 0 for none."""
    return F.shiftright("key", 64 - bits) if bits else F.lit(0).cast("long")


def select_ranks(values: DataFrame, ranks: DataFrame, group: list[str], most: int | None = None, weight: str | None = None) -> DataFrame:
    """(group, rank, value) of each wanted rank, counted from 0 among a group's values in ascending order.

    values: rows of ``group`` and value (double, no nulls or NaN); ranks: rows of ``group`` and rank, each below the group's number of
    values; most: the largest group's number of rows, if it is known; weight: a column that tells how many values a row
    stands for, one each by default. Group columns are not null.
    """
    keys = written(values.select(*group, ordered("value").alias("key"), F.col(weight).alias("w") if weight else F.lit(1).cast("long").alias("w")), "keys")
    wanted = ranks.select(*group, "rank").distinct().withColumns({"left": F.col("rank").cast("long"), "prefix": F.lit(0).cast("long")})
    wanted = wanted.withColumn("rows", F.lit(most).cast("long"))
    done, bits = [], 0
    while bits < 64:
        wanted = written(wanted, "ranks")
        n, most = wanted.agg(F.count(F.lit(1)), F.max("rows")).first()
        if not n:
            break
        more = 64 if most is not None and most <= CELL_VALUES else min(64, bits + BITS)
        wanted = wanted.drop("rows")
        cells = wanted.select(*group, "prefix").distinct()
        rows = keys.withColumn("prefix", _prefix(bits)).join(F.broadcast(cells) if n <= BROADCAST_RANKS else cells, [*group, "prefix"])
        counts = rows.groupBy(*group, "prefix", _prefix(more).alias("next")).agg(F.sum("w").alias("c"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))
        upto = F.sum("c").over(Window.partitionBy(*group, "prefix").orderBy("next").rowsBetween(Window.unboundedPreceding, 0))
        # Cells of one prefix: at most 2^BITS rows, or CELL_VALUES.
        placed = counts.withColumn("upto", upto)
        found = wanted.join(placed, [*group, "prefix"]).where((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("c")))
        found = written(found.select(*group, "rank", (F.col("left") - F.col("upto") + F.col("c")).alias("left"), F.col("next").alias("prefix"), "rows", "low", "high"), "found")
        done.append(found.where("low = high").select(*group, "rank", "low"))
        wanted = found.where("low < high").drop("low", "high")
        bits = more
    out = done[0] if done else wanted.select(*group, "rank", F.col("left").alias("low"))
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(*group, "rank", restored("low").alias("value"))


def quantiles(values: DataFrame, sizes: DataFrame, group: list[str], shares: dict[str, float], weight: str | None = None) -> DataFrame:
    """(group, a column for each of ``shares``): quantiles with linear interpolation between the two nearest values.

    values and weight as for ``select_ranks``; sizes: rows of ``group`` and n, the number of the group's values.
    """
    sizes = written(sizes.select(*group, "n"), "sizes")
    at = {name: (F.col("n") - 1) * p for name, p in shares.items()}
    ends = [F.struct(F.lit(name).alias("name"), f(x).cast("long").alias("rank"), F.lit(k).alias("end"), (x - F.floor(x)).alias("part")) for name, x in at.items() for k, f in enumerate((F.floor, F.ceil))]
    wanted = written(sizes.select(*group, F.inline(F.array(*ends))), "quantile-ends")
    found = select_ranks(values, wanted, group, None if weight else sizes.agg(F.max("n")).first()[0], weight)
    value = lambda name, end: F.max(F.when((F.col("name") == name) & (F.col("end") == end), F.col("value")))
    part = lambda name: F.max(F.when(F.col("name") == name, F.col("part")))
    between = lambda name: F.when(value(name, 0) == value(name, 1), value(name, 0)).otherwise(value(name, 0) + (value(name, 1) - value(name, 0)) * part(name))
    return wanted.join(found, [*group, "rank"]).groupBy(*group).agg(*(between(name).alias(name) for name in shares))
