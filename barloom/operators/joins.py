"""As-of, range and neighbourhood joins, expressed so that no pair of rows is tried in vain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], keep_unmatched: bool = False, slot: int = 86_400) -> DataFrame:
    """Each left row with the ``values`` of the newest right row of its key at or before its time.

    Both sides are united, dealt by key and slot (``slot`` seconds, or units where the time is a number)
    and ordered there; the last right row seen is carried forward. What the slots before hand on is found
    in a table of one row a key and slot, so that a busy key is spread over as many tasks as it has slots.
    No quadratic join. Of right rows with one key and time, the one with the greatest values counts; a
    null key matches none.
    """
    best = right.where(F.col(key).isNotNull()).groupBy(key, F.col(right_time).alias("__t")).agg(F.max(F.struct(*values)).alias("__v"))
    fields = F.struct(*(F.col(c) for c in left.columns))
    rows = left.select(F.col(key).alias("__k"), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), fields.alias("__left"), F.lit(None).cast(best.schema["__v"].dataType).alias("__v"))
    other = best.select(F.col(key).alias("__k"), "__t", F.lit(0).alias("__side"), F.lit(None).cast(rows.schema["__left"].dataType).alias("__left"), "__v")
    both = rows.unionByName(other)
    at = F.unix_micros(F.col("__t").cast("timestamp")) / 1_000_000 if dict(both.dtypes)["__t"].startswith(("timestamp", "date")) else F.col("__t")
    both = both.withColumn("__slot", F.floor(at / slot))
    order = Window.partitionBy("__k", "__slot").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__v", F.last("__v", ignorenulls=True).over(order)).where("__side = 1")
    ends = both.groupBy("__k", "__slot").agg(F.max_by("__v", F.when(F.col("__side") == 0, F.col("__t"))).alias("__end"))
    earlier = Window.partitionBy("__k").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("__k", "__slot", F.last("__end", ignorenulls=True).over(earlier).alias("__end")).where("__end is not null")
    seen = seen.join(ends, ["__k", "__slot"], "left").withColumn("__v", F.coalesce("__v", "__end"))
    if not keep_unmatched:
        seen = seen.where("__v is not null")
    return seen.select("__left.*", *(F.col(f"__v.{v}").alias(v) for v in values))


def within(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of rows of one key whose times differ by at most ``seconds``.

    Times are cut into slots of that width; a left row looks into its own and the two slots beside it, so
    the join is by equality and a slot, not by a comparison over all rows of a key.
    """
    slot = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    a = left.withColumn("__slot", F.explode(F.array(*(slot(left_time) + d for d in (-1, 0, 1)))))
    b = right.withColumn("__slot", slot(right_time))
    gap = F.abs(F.unix_micros(F.col(left_time).cast("timestamp")) - F.unix_micros(F.col(right_time).cast("timestamp")))
    return a.join(b, [key, "__slot"]).where(gap <= seconds * 1_000_000).drop("__slot")


def issue_neighbourhood(issues: DataFrame, bars: DataFrame, hours: int = 5) -> DataFrame:
    """Bars within ``hours`` of each issue (pair, issue_time, ...) of the same pair."""
    return within(issues, bars, "pair", "issue_time", "timestamp_utc", hours * 3600)
