"""Validators: (pair, validator, issue_type, column, issues, candles) rows, one pass over all pairs.

A check is a condition on a row; rows are turned into the numbers of the checks they fail, which are
counted by pair with partial sums. ``examples`` gives the first rows of a check, a top-k by pair.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.frames import PAIR, TIME, by_pair
from barloom.functions.scratch import written
from barloom.operators.joins import within
from barloom.operators.selection import BROADCAST_RANKS, quantiles
from barloom.params import Params
from barloom.plans.pipeline import compute_features
from barloom.schemas import ISSUES

from . import rules


class Check(NamedTuple):
    validator: str
    issue: str
    column: str
    failed: Column


def count_issues(df: DataFrame, checks: list[Check]) -> DataFrame:
    """Rows of all checks that failed somewhere; pairs without an issue have none."""
    # Each row gives the numbers of the checks that it fails, and -1: only failures grow the rows.
    hits = F.array_compact(F.array(F.lit(-1), *(F.when(c.failed, F.lit(i)) for i, c in enumerate(checks))))
    by = df.select(PAIR, F.explode(hits).alias("__i")).groupBy(PAIR, "__i").agg(F.count(F.lit(1)).alias("issues"))
    by = by.withColumn("candles", F.max(F.when(F.col("__i") == -1, F.col("issues"))).over(Window.partitionBy(PAIR))).where("__i >= 0")
    name = lambda k: F.element_at(F.array(*(F.lit(c[k]) for c in checks)), F.col("__i") + 1)
    return by.select(PAIR, name(0).alias("validator"), name(1).alias("issue_type"), name(2).alias("column"), "issues", "candles")


def examples(df: DataFrame, check: Check, k: int = 5) -> DataFrame:
    """Each pair's first k rows that fail a check."""
    order = Window.partitionBy(PAIR).orderBy(TIME)
    return df.where(check.failed).withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= k).drop("__rn")


#: Columns that validators cannot do without; a table that lacks one has a status, not issues.
NEEDED = {"raw_ohlcv": ("open", "high", "low", "close", "volume"), "completeness": (TIME,), "targets": ("future_max_return_24h_pct", "future_return_12h_pct", "profit_target_1pct", "profit_target_2pct", "was_profitable_12h"), "cross_pair": ("btc_corr_24h",)}
#: Examples kept of each check, and of gaps.
EXAMPLES, GAP_EXAMPLES = 5, 10
#: One row a pair: what ``results`` returns and ``read_results`` reads.
RESULT = (
    "pair string, validator string, status string, issues_count bigint, candles_count bigint, issue_percentage double, issue_summary map<string, struct<count: bigint>>, "
    "issues array<struct<issue_type: string, column: string, timestamp: timestamp_ntz, actual: double>>"
)


def results(df: DataFrame, validator: str, make: Callable[[DataFrame], tuple[DataFrame, list[Check]]], pairs: DataFrame | None = None, k: int = EXAMPLES, gaps: int = GAP_EXAMPLES) -> DataFrame:
    """``RESULT``: one row a pair, with counts by type of issue and the first examples of each check.

    make gives the table and checks, for a table that has the columns of ``NEEDED``; without them each pair's status is
    ``missing_columns``. pairs: those that must have a row; one without bars has status ``no_data``. issue_percentage is issues for
    a hundred bars. Of a check and pair at most ``k`` examples are kept, ``gaps`` of gaps: the limit is taken in each task before rows are
    shuffled, so no task holds a pair's failures.
    """
    known = df.select(PAIR).distinct() if pairs is None else df.select(PAIR).distinct().union(pairs.select(PAIR)).distinct()
    if any(c not in df.columns for c in NEEDED.get(validator, ())):
        out = known.join(df.groupBy(PAIR).agg(F.count(F.lit(1)).alias("candles_count")), PAIR, "left").withColumns({"status": F.when(F.col("candles_count").isNull(), "no_data").otherwise("missing_columns"), "issues_count": F.lit(0).cast("long"), "issue_summary": F.lit(None), "issues": F.lit(None)})
        return _shaped(out, validator)
    df, checks = make(df)
    hits = F.array_compact(F.array(*(F.when(c.failed, F.lit(i)) for i, c in enumerate(checks))))
    name = lambda n: F.element_at(F.array(*(F.lit(c[n]) for c in checks)), F.col("__i") + 1)
    actual = F.element_at(F.array(*(F.col(c.column).try_cast("double") if c.column in df.columns and c.column != TIME else F.lit(None).cast("double") for c in checks)), F.col("__i") + 1)
    rows = df.withColumn("__i", F.explode(hits)).select(PAIR, F.col(TIME).cast("timestamp_ntz").alias("timestamp"), "__i", name(1).alias("issue_type"), name(2).alias("column"), actual.alias("actual"))
    counts = rows.groupBy(PAIR, "issue_type").agg(F.count(F.lit(1)).alias("count")).groupBy(PAIR).agg(F.sum("count").alias("issues_count"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("issue_type", F.struct("count"))))).alias("issue_summary"))
    first = Window.partitionBy(PAIR, "__i").orderBy("timestamp", "actual")
    kept = rows.withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= max(k, gaps)).where(F.col("__k") <= F.when(F.col("issue_type") == "gap", gaps).otherwise(k))
    kept = kept.groupBy(PAIR).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__k", F.struct("issue_type", "column", "timestamp", "actual").alias("x")))), lambda e: e["x"]).alias("issues"))
    bars = df.groupBy(PAIR).agg(F.count(F.lit(1)).alias("candles_count"))
    out = known.join(bars, PAIR, "left").join(counts, PAIR, "left").join(kept, PAIR, "left")
    return _shaped(out.withColumn("status", F.when(F.col("candles_count").isNull(), "no_data").otherwise("completed")), validator)


def _shaped(out: DataFrame, validator: str) -> DataFrame:
    """Rows of ``RESULT``: no issue is 0, an empty map and an empty list."""
    n, bars = F.coalesce("issues_count", F.lit(0).cast("long")), F.coalesce("candles_count", F.lit(0).cast("long"))
    none = T._parse_datatype_string(RESULT)
    empty = lambda c: F.from_json(F.lit("{}" if c == "issue_summary" else "[]"), none[c].dataType)
    nested = {c: F.coalesce(F.col(c).cast(none[c].dataType), empty(c)) for c in ("issue_summary", "issues")}
    made = {"validator": F.lit(validator), "issues_count": n, "candles_count": bars, "issue_percentage": F.when(bars > 0, 100 * n / bars).otherwise(0.0), **nested}
    return out.select(*(made.get(c, F.col(c)).alias(c) for c in none.names))


def write_results(rows: DataFrame, path: str) -> None:
    """Results as JSON lines, nested as they are."""
    rows.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULT).json(path)


def raw_checks(columns: list[str]) -> list[Check]:
    """Order of prices, negative volumes, taker volume above the whole."""
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    out = [
        Check("raw_ohlcv", "high_low_issues", "high", h < lo), Check("raw_ohlcv", "open_high_issues", "open", h < o),
        Check("raw_ohlcv", "low_close_issues", "low", lo > c), Check("raw_ohlcv", "high_close_issues", "close", h < c),
        Check("raw_ohlcv", "low_open_issues", "open", lo > o), Check("raw_ohlcv", "negative_volume", "volume", v < 0),
    ]
    if "taker_buy_base" in columns:
        out.append(Check("raw_ohlcv", "taker_buy_issues", "taker_buy_base", F.col("taker_buy_base") > v))
    return out


def completeness_checks(df: DataFrame, exempt: tuple = ()) -> tuple[DataFrame, list[Check]]:
    """``df`` with helper columns, and checks for nulls, gaps and labels that know more than the data."""
    t = F.col(TIME).cast("timestamp")
    whole = Window.partitionBy(PAIR)
    minutes = (F.unix_seconds(t) - F.unix_seconds(F.lag(TIME).over(by_pair()).cast("timestamp"))) / 60
    df = df.withColumns({"__minutes": minutes, "__end": F.max(TIME).over(whole)})
    out = [Check("completeness", "null_values", c, F.col(c).isNull()) for c in df.columns if c not in (PAIR, TIME, *exempt) and not c.startswith("__")]
    out.append(Check("completeness", "gap", TIME, F.coalesce(F.col("__minutes") > rules.GAP_MINUTES, F.lit(False))))
    for c, hours in rules.HORIZON.items():
        if c in df.columns:
            late = F.col(TIME) > F.col("__end") - F.expr(f"interval {hours} hours")
            out.append(Check("completeness", "label_leakage", c, late & (F.col(c) != 0)))
    return df, out


def forgiven(issues: DataFrame, columns: int) -> DataFrame:
    """``issues`` without the nulls of pairs in which less than the forgiven share of cells is null."""
    nulls = F.sum(F.when(F.col("issue_type") == "null_values", F.col("issues")).otherwise(0)).over(Window.partitionBy(PAIR))
    kept = (F.col("issue_type") != "null_values") | (F.col("__nulls") >= rules.FORGIVEN * F.col("candles") * columns)
    return issues.withColumn("__nulls", nulls).where(kept).drop("__nulls")


def sanity_checks(df: DataFrame) -> tuple[DataFrame, list[Check]]:
    """NaN, infinities, ranges, flags that are neither 0 nor 1, and absurd sizes."""
    numbers = [c for c, k in df.dtypes if k in ("double", "float", "smallint", "int", "bigint")]
    floats = [c for c, k in df.dtypes if k in ("double", "float")]
    df = df.withColumns({f"__mean_{c}": F.avg(c).over(Window.partitionBy(PAIR)) for c in ("volume", "open", "high", "low", "close") if c in numbers})
    out = []
    for c in floats:
        out += [Check("sanity", "nan_values", c, F.isnan(c)), Check("sanity", "infinite_values", c, F.abs(F.col(c)) == float("inf"))]
    for columns, least, most in rules.RANGES:
        for c in columns:
            if c in numbers:
                bad = (F.col(c) < least) | (F.col(c) > most) if most is not None else F.col(c) < least
                out.append(Check("sanity", "range_violations", c, bad & ~F.isnan(F.col(c).cast("double"))))
    out += [Check("sanity", "binary_violations", c, ~F.col(c).isin(0, 1)) for c in rules.BINARY if c in numbers]
    for c in numbers:
        if c in rules.NO_SIZE or c == "id":
            continue
        if c == "volume":
            limit = F.col("__mean_volume") * 100
        elif c in ("open", "high", "low", "close"):
            limit = F.col(f"__mean_{c}") * 10
        elif c.startswith("future_return") or c.endswith("_pct"):
            limit = F.lit(2.0)
        else:
            limit = F.lit(100.0 if "rank" in c else 1e6)
        out.append(Check("sanity", "absurd_values", c, (F.col(c) > limit) & ~F.isnan(F.col(c).cast("double"))))
    return df, out


def cross_pair_checks(btc: str) -> list[Check]:
    corr = F.col("btc_corr_24h")
    ranks = ("volume_rank_1h", "volatility_rank_1h", "performance_rank_btc_1h", "performance_rank_eth_1h")
    return [Check("cross_pair", "rank_range", c, ~F.col(c).between(0, 100)) for c in ranks] + [
        Check("cross_pair", "benchmark_correlation", "btc_corr_24h", (F.col(PAIR) == btc) & (corr <= 0.95) & (corr != 0)),
        Check("cross_pair", "correlation_range", "btc_corr_24h", ~corr.between(-1, 1)),
    ]


def target_checks() -> list[Check]:
    top, gain = F.col("future_max_return_24h_pct"), F.col("future_return_12h_pct")
    return [
        Check("targets", "inconsistent_target", "profit_target_1pct", F.col("profit_target_1pct") != (top > 0.01).cast("int")),
        Check("targets", "inconsistent_target", "profit_target_2pct", F.col("profit_target_2pct") != (top > 0.02).cast("int")),
        Check("targets", "order_of_targets", "profit_target_2pct", F.col("profit_target_2pct") > F.col("profit_target_1pct")),
        Check("labels", "inconsistent_profit", "was_profitable_12h", F.col("was_profitable_12h") != (gain > 0).cast("int")),
    ]


#: Validators that recompute, and the groups that they recompute.
RECOMPUTE = {
    "price_action": ["price_action"], "momentum": ["momentum"], "volatility": ["volatility"], "volume": ["volume"], "recursive": ["recursive"],
    "statistical": ["statistical"], "patterns": ["pattern"], "temporal": ["calendar"], "labels": ["labels"],
}


def recomputed(stored: DataFrame, groups: dict[str, list[str]], params: Params | None = None) -> DataFrame:
    """Issues of stored feature columns that differ from their recomputation beyond the tolerance.

    groups: by validator. All groups are recomputed in one pass over the bars. Bars are recomputed whole,
    so stored values of a rolling update differ where its recursion began.
    """
    params = params or Params()
    raw = stored.select(PAIR, TIME, "open", "high", "low", "close", "volume")
    added: dict[str, str] = {}
    made = compute_features(raw, params, [g for names in groups.values() for g in names], added)
    owner = {c: v for v, names in groups.items() for c, g in added.items() if g in names}
    columns = [c for c in made.columns if c in stored.columns and c in owner]
    both = made.select(PAIR, TIME, *(F.col(c).alias(f"__{c}") for c in columns)).join(stored.select(PAIR, TIME, *columns), [PAIR, TIME])
    return count_issues(both, [Check(owner[c], "calculation_mismatch", c, _apart(c)) for c in columns])


def _apart(c: str) -> Column:
    stored, made = F.col(c).cast("double"), F.col(f"__{c}").cast("double")
    # Equal infinities, and two NaN, have no distance, but Spark holds them equal.
    return F.coalesce((stored != made) & (F.abs(stored - made) > rules.TOLERANCE.get(c, 1e-6)), F.col(c).isNull())


def validate(stored: DataFrame, params: Params | None = None, skip: tuple = ()) -> DataFrame:
    """All validators over a feature table; ``skip`` names those that do not run."""
    params = params or Params()
    out = []
    if "raw_ohlcv" not in skip:
        out.append(count_issues(stored, raw_checks(stored.columns)))
    if "completeness" not in skip:
        df, checks = completeness_checks(stored)
        out.append(forgiven(count_issues(df, checks), len(stored.columns) - 2))
    if "sanity" not in skip:
        out.append(count_issues(*sanity_checks(stored)))
    if "cross_pair" not in skip and "btc_corr_24h" in stored.columns:
        out.append(count_issues(stored, cross_pair_checks(params.cross_pair.btc)))
    if "targets" not in skip and "profit_target_1pct" in stored.columns:
        out.append(count_issues(stored, target_checks()))
    groups = {name: names for name, names in RECOMPUTE.items() if name not in skip}
    if groups:
        out.append(recomputed(stored, groups, params))
    both = out[0]
    for x in out[1:]:
        both = both.unionByName(x)
    return both


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """(pair, column, n, mean, median, least, most, sd, q1, q3, iqr, zeros, distinct, skew, kurt, outliers) of numeric columns.

    Quartiles are exact with linear interpolation, found by selection (``operators.selection``); deviation, skew and
    kurtosis (excess) are those of a sample; outliers lie beyond one and a half times the quartiles' distance. Equal values are
    counted first, and all else is computed from values and counts: the input is read once, and what repeats is neither
    stored nor ordered again. No task holds a column whole.
    """
    key, v, n, c = [PAIR, "column"], F.col("value"), F.col("n"), F.col("c")
    long = df.select(PAIR, *(F.col(x).cast("double").alias(x) for x in columns)).unpivot([PAIR], columns, "column", "value").where("value is not null and not isnan(value)")
    long = written(long.groupBy(*key, (v + 0.0).alias("value")).agg(F.count(F.lit(1)).alias("c")), "values")
    by = long.groupBy(*key).agg(
        F.sum("c").alias("n"), (F.sum(c * v) / F.sum("c")).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.sum(F.when(v == 0, c).otherwise(0)).alias("zeros"), F.count(F.lit(1)).alias("distinct"),
    )
    # Within its bounds, the mean of equal values is that value, and their deviation 0.
    by = written(by.withColumn("mean", F.greatest("least", F.least("most", "mean"))), "totals")
    cuts = quantiles(long, by, key, {"median": 0.5, "q1": 0.25, "q3": 0.75}, "c").withColumn("iqr", F.col("q3") - F.col("q1"))
    by = written(by.join(cuts, key), "quartiles")
    d = v - F.col("mean")
    far = (v < F.col("q1") - 1.5 * F.col("iqr")) | (v > F.col("q3") + 1.5 * F.col("iqr"))
    few = by.count() <= BROADCAST_RANKS  # a row a pair and column
    ends = by.select(*key, "mean", "q1", "q3", "iqr")
    out = long.join(F.broadcast(ends) if few else ends, key).groupBy(*key).agg(
        F.sum(F.when(far, c).otherwise(0)).alias("outliers"), F.sum(c * d * d).alias("__m2"), F.sum(c * d * d * d).alias("__m3"), F.sum(c * d * d * d * d).alias("__m4"),
    )
    m2, spread = F.col("__m2"), F.sqrt(F.col("__m2") / n) > 1e-9
    skew, kurt = F.sqrt(n) * F.col("__m3") / F.sqrt(m2 * m2 * m2), n * F.col("__m4") / (m2 * m2) - 3
    return by.join(out, key).select(
        *key, "n", "mean", "median", "least", "most", F.when(n > 1, F.sqrt(m2 / (n - 1))).alias("sd"), "q1", "q3", "iqr", "zeros", "distinct",
        F.when((n > 2) & spread, skew * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when((n > 3) & spread, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6)).alias("kurt"), "outliers",
    )


def distribution_issues(stats: DataFrame) -> DataFrame:
    """(pair, column, issue_type, value): over 40 % zeros, skew beyond 10, over 5 % outliers."""
    n = F.col("n")
    found = F.array(
        F.when(100 * F.col("zeros") / n > 40, F.struct(F.lit("high_zeros_percentage").alias("issue_type"), (100 * F.col("zeros") / n).alias("value"))),
        F.when(F.abs("skew") > 10, F.struct(F.lit("extreme_skewness").alias("issue_type"), F.col("skew").alias("value"))),
        F.when(100 * F.col("outliers") / n > 5, F.struct(F.lit("high_outliers_percentage").alias("issue_type"), (100 * F.col("outliers") / n).alias("value"))),
    )
    return stats.select(PAIR, "column", F.explode(F.array_compact(found)).alias("x")).select(PAIR, "column", "x.*")


def grade(issues: DataFrame, bars: DataFrame) -> DataFrame:
    """(validator, issues, pairs_with_issues, pairs, grade): PASSED, MINOR (<5 % of pairs and <100 issues) or SIGNIFICANT."""
    total = bars.agg(F.countDistinct(PAIR).alias("pairs"))
    by = issues.groupBy("validator").agg(F.sum("issues").alias("issues"), F.countDistinct(PAIR).alias("pairs_with_issues")).crossJoin(F.broadcast(total))
    minor = (F.col("pairs_with_issues") < 0.05 * F.col("pairs")) & (F.col("issues") < 100)
    return by.withColumn("grade", F.when(F.col("issues") == 0, "PASSED").when(minor, "MINOR").otherwise("SIGNIFICANT"))


def top_offenders(issues: DataFrame, k: int = 20) -> DataFrame:
    """The k pairs with most issues."""
    return issues.groupBy(PAIR).agg(F.sum("issues").alias("issues")).orderBy(F.desc("issues"), PAIR).limit(k)


def commonest(issues: DataFrame, k: int = 5) -> DataFrame:
    """The k commonest types of issue."""
    return issues.groupBy("issue_type").agg(F.sum("issues").alias("issues")).orderBy(F.desc("issues"), "issue_type").limit(k)


def text_report(issues: DataFrame, bars: DataFrame, offenders: int = 20, types: int = 5) -> DataFrame:
    """(section, place, line) of a report to be read: grades by validator, worst pairs, commonest types of issue."""
    grades = grade(issues, bars)
    place = lambda name, *order: F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(*order))
    # Each section has a bounded number of rows: one a validator, ``offenders``, ``types``.
    head = grades.select(F.lit(1).alias("section"), place("grades", "validator").alias("place"), F.format_string("%s: %s, %d issues in %d of %d pairs", "validator", "grade", "issues", "pairs_with_issues", "pairs").alias("line"))
    worst = top_offenders(issues, offenders).select(F.lit(2).alias("section"), place("worst", F.desc("issues"), PAIR).alias("place"), F.format_string("%s: %d issues", PAIR, "issues").alias("line"))
    often = commonest(issues, types).select(F.lit(3).alias("section"), place("often", F.desc("issues"), "issue_type").alias("place"), F.format_string("%s: %d", "issue_type", "issues").alias("line"))
    return head.unionByName(worst).unionByName(often)


def write_report(issues: DataFrame, path: str) -> None:
    """Issues as JSON lines."""
    issues.write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str, validator: str, issue_type: str | None = None, examples: int = 5) -> DataFrame:
    """Rows of a written report: one validator's, of one type if given, at most ``examples`` a pair, the largest first."""
    rows = spark.read.schema(ISSUES).json(path).where(F.col("validator") == validator)
    if issue_type is not None:
        rows = rows.where(F.col("issue_type") == issue_type)
    order = Window.partitionBy(PAIR).orderBy(F.desc("issues"), "column")
    return rows.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= examples).drop("__rn")


#: What to look at for a column's issues: (text in the column's name, columns, hint). The first that fits counts.
DRILL_DOWN = (
    (("atr", "true_range", "keltner"), ("open", "high", "low", "close", "atr_1h", "true_range"), "recompute the range from high, low and the close before; check the seed row"),
    (("rsi",), ("close", "rsi_1h", "rsi_slope_1h"), "check that the history reaches back far enough for the seed"),
    (("macd", "ppo", "tsi"), ("close", "macd_slope_1h", "macd_hist_slope_1h"), "exponential means restart where the read begins"),
    (("volume", "obv", "flow"), ("close", "volume"), "check for zero volumes and repeated bars"),
    (("future", "profit"), ("close", "high", "low"), "recompute labels after the newest bars arrived"),
)


def drill_down(issues: DataFrame) -> DataFrame:
    """``issues`` with look_at, the columns to show beside an issue, and a hint; both null where none is known."""
    look, hint = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
    for texts, columns, advice in reversed(DRILL_DOWN):
        fits = F.col("column").rlike("|".join(texts))
        look = F.when(fits, F.array(*map(F.lit, columns))).otherwise(look)
        hint = F.when(fits, advice).otherwise(hint)
    return issues.withColumns({"look_at": look, "hint": hint})


def recheck(stored: DataFrame, issues: DataFrame, params: Params | None = None, hours: int = 5) -> DataFrame:
    """(pair, issue_time, column, timestamp_utc, stored, recomputed) around each issue (pair, issue_time, column).

    The groups that make the issues' columns are recomputed for the pairs that have issues, and no others.
    """
    named = [r[0] for r in issues.where(F.col("column").isin(stored.columns)).select("column").distinct().collect()]  # at most one row a column of the table
    added: dict[str, str] = {}
    raw = stored.join(issues.select(PAIR).distinct(), PAIR, "left_semi")
    bars = raw.select(PAIR, TIME, "open", "high", "low", "close", "volume")
    compute_features(bars, params, None, added)  # builds a plan to learn the columns' groups; nothing runs
    columns = [c for c in named if c in added and c in stored.columns]
    schema = "pair string, issue_time timestamp_ntz, column string, timestamp_utc timestamp_ntz, stored double, recomputed double"
    if not columns:
        return stored.sparkSession.createDataFrame([], schema)
    made = compute_features(bars, params, sorted({added[c] for c in columns}))
    both = raw.select(PAIR, TIME, *columns).join(made.select(PAIR, TIME, *(F.col(c).alias(f"__{c}") for c in columns)), [PAIR, TIME])
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("stored"), F.col(f"__{c}").cast("double").alias("recomputed")) for c in columns))
    long = both.select(PAIR, TIME, F.explode(pairs).alias("x")).select(PAIR, TIME, F.col("x.column").alias("__column"), "x.stored", "x.recomputed")
    near = within(issues.select(PAIR, "issue_time", "column"), long, PAIR, "issue_time", TIME, hours * 3600)
    return near.where(F.col("column") == F.col("__column")).drop("__column")
