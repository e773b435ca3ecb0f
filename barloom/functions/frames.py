"""Windows over one pair's bars, and guards for warm-up rows, divisions and missing values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

PAIR, TIME = "pair", "timestamp_utc"
TINY = 1e-8


def by_pair() -> WindowSpec:
    """One specification for all features of a pair: Spark then sorts once and evaluates them in one pass."""
    return Window.partitionBy(PAIR).orderBy(TIME)


def whole() -> WindowSpec:
    """All rows of the pair."""
    return by_pair().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def so_far() -> WindowSpec:
    """The pair's rows up to the current one."""
    return by_pair().rowsBetween(Window.unboundedPreceding, 0)


def at_time() -> WindowSpec:
    """All pairs' rows of one time."""
    return Window.partitionBy(TIME)


def last_n(n: int) -> WindowSpec:
    """The newest n rows, the current one included."""
    return by_pair().rowsBetween(-(n - 1), 0)


def before(n: int) -> WindowSpec:
    """The n rows before the current one."""
    return by_pair().rowsBetween(-n, -1)


def ahead(n: int) -> WindowSpec:
    """The n rows after the current one."""
    return by_pair().rowsBetween(1, n)


def lag(c: str | Column, k: int = 1) -> Column:
    return F.lag(c, k).over(by_pair())


def numbered(df: DataFrame) -> DataFrame:
    """Adds __i, the row's number from 0, and __n, the pair's rows."""
    return df.withColumns({"__i": F.row_number().over(by_pair()) - 1, "__n": F.count(F.lit(1)).over(whole())})


def from_row(k: int, value: Column, default: float | Column = 0.0) -> Column:
    """``value`` from row k on, ``default`` before and where it is null."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.when(F.col("__i") >= k, F.coalesce(value, default)).otherwise(default)


def ratio(a: Column, b: Column, default: float | Column = 0.0) -> Column:
    """a / b where b > 0."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.when(b > 0, a / b).otherwise(default)


def clean(c: Column, default: float = 0.0) -> Column:
    """NaN, infinities and nulls become ``default``."""
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce(F.when(~bad, c), F.lit(default))


def truthy(c: Column) -> Column:
    """Texts that mean true: true, t, yes, y, 1."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "t", "yes", "y", "1"), F.lit(False))


def millis(c: Column) -> Column:
    """Epoch milliseconds, as text or number, to a timestamp."""
    return F.timestamp_millis(c.cast("bigint"))


def rounded_short(c: Column) -> Column:
    """Rounded half to even, as smallint; null as 0."""
    return F.coalesce(F.bround(c), F.lit(0)).cast("smallint")
