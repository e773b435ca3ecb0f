"""Known keys by Bloom filters: most new rows are told from known ones without a look at the stored keys.

A filter has fixed-size cells, one or more for each period of the keys (a month), so that no cell outgrows a task:
tasks hash their keys to bits, words of 64 bits meet by ``bit_or``, and a cell's words become an array. A new
row whose bits are not all set is new for certain; the others, repeats and a share of false positives, go to the exact anti join.
All of it is SQL functions. A filter can be stored beside its table, and cells of later periods added to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .upsert import KEY, one_of_each

#: Words of a cell, keys that it is made for (10.5 bits each), and bits that a key sets: about 0.7 % of unknown keys look known.
WORDS, CELL_KEYS, HASHES = 4096, 25_000, 7
#: Cells (32 KB each) and possible repeats are broadcast up to so many; beyond, they are joined by shuffle.
BROADCAST_CELLS, BROADCAST_KEYS = 2048, 500_000


def _hashed(df: DataFrame, key: list[str], period: Column | None) -> DataFrame:
    """(row, __period, __deal, __one, __two): the rows of ``df`` whole, their keys' period and hashes."""
    bits = WORDS * 64
    return df.select(
        F.struct("*").alias("row"), (F.lit("") if period is None else F.coalesce(period.cast("string"), F.lit(""))).alias("__period"), F.xxhash64(*key, F.lit("deal")).alias("__deal"),
        F.pmod(F.xxhash64(*key), F.lit(bits)).alias("__one"), F.pmod(F.xxhash64(*key, F.lit("step")), F.lit(bits)).bitwiseOR(F.lit(1).cast("long")).alias("__two"),
    )


def _place(j: int | Column) -> Column:
    """The place of a key's j-th bit in its cell."""
    return F.pmod(F.col("__one") + j * F.col("__two"), F.lit(WORDS * 64))


def build_filter(existing: DataFrame, key: list[str] | None = None, period: Column | None = None) -> DataFrame:
    """(period, cells, cell, words) over the keys of ``existing``: a period has one cell for each ``CELL_KEYS`` rows."""
    rows = _hashed(existing, key or KEY, period)
    cells = rows.groupBy("__period").agg(F.ceil(F.count(F.lit(1)) / CELL_KEYS).cast("long").alias("cells"))
    dealt = rows.join(cells, "__period").select("__period", "cells", F.pmod("__deal", "cells").alias("cell"), "__one", "__two")
    at = dealt.select("__period", "cells", "cell", F.explode(F.array(*(_place(j) for j in range(HASHES)))).alias("at"))
    set_bits = at.select("__period", "cells", "cell", F.floor(F.col("at") / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int")).alias("bits"))
    none = cells.select("__period", "cells", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"))
    none = none.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WORDS - 1).cast("long"))).alias("word"), F.lit(0).cast("long").alias("bits"))
    words = set_bits.unionByName(none).groupBy("__period", "cells", "cell", "word").agg(F.bit_or("bits").alias("bits"))
    whole = words.groupBy("__period", "cells", "cell").agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("words"))
    return whole.withColumnRenamed("__period", "period")


def judge(new: DataFrame, known: DataFrame, key: list[str] | None = None, period: Column | None = None) -> DataFrame:
    """``new`` with __possible: whether a filter allows that the row's key is known. Rows of periods without a cell are new."""
    rows = _hashed(new, key or KEY, period)
    few = known.count() <= BROADCAST_CELLS
    small = lambda df: F.broadcast(df) if few else df
    cells = known.select(F.col("period").alias("__period"), F.col("cells").alias("__cells")).distinct()
    rows = rows.join(small(cells), "__period", "left").withColumn("__cell", F.when(F.col("__cells") > 0, F.pmod("__deal", "__cells")))
    held = known.select(F.col("period").alias("__period"), F.col("cell").alias("__cell"), F.col("words").alias("__words"))
    rows = rows.join(small(held), ["__period", "__cell"], "left")
    bit = lambda j: F.getbit(F.get("__words", F.floor(_place(j) / 64).cast("int")), (_place(j) % 64).cast("int")) == 1
    every = F.lit(True)
    for j in range(HASHES):
        every = every & bit(j)
    return rows.select("row.*", F.coalesce(every, F.lit(False)).alias("__possible"))


def insert_unknown(existing: DataFrame, new: DataFrame, known: DataFrame, key: list[str] | None = None, period: Column | None = None) -> DataFrame:
    """What ``insert_ignore`` gives: rows of ``new`` whose key ``existing`` lacks, one for each key.

    known: a filter of ``build_filter`` over the keys of ``existing``, with the same period. Possible repeats are sought among the stored
    keys, which are read but, if few rows are possible repeats, not shuffled. A null in a key never matches.
    """
    key = key or KEY
    judged = judge(new, known, key, period)
    maybe = judged.where("__possible").drop("__possible")
    keys = maybe.select(*key).distinct()
    few = keys.count() <= BROADCAST_KEYS
    repeats = existing.select(*key).join(F.broadcast(keys) if few else keys, key, "left_semi").distinct()
    left = maybe.join(repeats, key, "left_anti")
    return one_of_each(judged.where(~F.col("__possible")).drop("__possible").unionByName(left), key)


def filter_figures(existing: DataFrame, new: DataFrame, known: DataFrame, key: list[str] | None = None, period: Column | None = None) -> DataFrame:
    """(rows, possible, repeats): rows of ``new``, those that go to the exact join, and those whose key is known."""
    key = key or KEY
    judged = judge(new, known, key, period)
    hit = judged.join(existing.select(*key).distinct().withColumn("__hit", F.lit(True)), key, "left")
    return hit.agg(F.count(F.lit(1)).alias("rows"), F.count_if("__possible").alias("possible"), F.count_if("__hit").alias("repeats"), F.count_if(F.col("__hit") & ~F.col("__possible")).alias("missed"))
