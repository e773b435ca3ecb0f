"""Mixing sources to target weights: repetition rates, whole copies and one Bernoulli copy.

Tokens are counted for each source with partial sums before the shuffle. Targets follow the weights,
no target exceeds ``cap`` times its source, and what is cut off is shared again by weight: with the
sources ordered by cap over weight, the capped ones are a prefix, and prefix sums over the small table
of sources give the level at once. A document is emitted floor(rate) times, and once more if a
uniform number hashed from the seed and its id lies below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: By code point order of the sources, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all tokens that the targets add up to, and the most that a source is repeated.
TOTAL, CAP = 1.5, 2.0
SEED = "mix"
#: The table of sources is broadcast up to so many rows; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000


def words_in(c: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """(source, source_size, target, rate) for each source of ``sizes`` (source, size); null is a source.

    A source without tokens has target and rate 0.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row a source from here on: the windows over all of them are small.
    every = Window.partitionBy()
    named = by.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("place") % len(weights) + 1)
    named = named.withColumns({"weight": weight, "most": F.col("source_size") * cap, "goal": F.sum("source_size").over(every) * total})
    ordered = Window.orderBy(F.col("most") / F.col("weight"), "place")
    named = named.withColumns({
        "full": F.coalesce(F.sum("most").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(ordered.rowsBetween(0, Window.unboundedFollowing)),
    })
    named = named.withColumn("level", (F.col("goal") - F.col("full")) / F.col("open"))
    capped = F.col("most") <= F.col("level") * F.col("weight")
    named = named.withColumns({"capped": capped, "level": F.max(F.when(~capped, F.col("level"))).over(every)})
    target = F.when(F.col("capped"), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight")))
    return named.withColumn("target", target).select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))


def copies(rate: Column, doc_id: Column, seed: str = SEED) -> Column:
    """floor(rate), and one more with the fraction's probability; the same for a seed and id in every run."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 12), 16, 10).cast("long") / float(1 << 48)
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).cast("int")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows``, which have a column a_source, with the plan's columns; broadcast only below a checked size."""
    side = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    return rows.join(side, F.col("a_source").eqNullSafe(F.col("source")))


def plan_for(docs: DataFrame, text_col: str = "text", source_col: str = "source", **kw) -> DataFrame:
    """``targets`` of ``docs``, written to the shared folder."""
    sizes = docs.select(F.col(source_col).alias("source"), words_in(F.col(text_col)).alias("size"))
    return materialize(targets(sizes, **kw), "mix-plan")


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **kw) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs``.

    taken is the words that the mix takes, repeats counted: 0 to ``cap`` times size. Null texts have
    size 0, null sources form one source, repeated rows get equal values, no rows give no rows.
    Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("a_source"), words_in(F.col(text_col)).alias("size"))
    slim = materialize(slim, "mix-sizes")
    plan = materialize(targets(slim.select(F.col("a_source").alias("source"), "size"), **kw), "mix-plan")
    rated = _with_plan(slim, plan)
    return rated.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("rate"), F.col("doc_id"), seed)).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, **kw) -> DataFrame:
    """The mixed rows of ``docs``: each as often as its copies say; same columns, whatever their names.

    Rows that repeat an id, or have none, draw the same number for that id.
    """
    plan = plan_for(docs, text_col, source_col, **kw).select("source", "rate")
    packed = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("a_source"))
    times = F.array_repeat(F.lit(0), copies(F.col("rate"), F.col("id"), seed))
    return _with_plan(packed, plan).select("row", F.explode(times).alias("copy")).select("row.*")
