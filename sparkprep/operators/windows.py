"""Features of a row's past: ordered by time (and a tie-breaking key) within groups.

A window that reads the target leaves out the row's own value (``shift`` 1). Without a group
rows are dealt by ranges of the order, and a range gets what it needs of those before it: the
few rows that a lag or a rolling frame reaches back, the totals of an expanding one, or the few values
from which its median can be taken. The order must then tell all rows apart.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sparkprep.functions.tables import durable, in_ranges, with_rows_before
from sparkprep.operators.profile import adjusted_kurtosis, adjusted_skew

MISSING_GROUP = "__MISSING__"


def _over(order: list[str], group: Iterable[str]):  # noqa: ANN202
    if not order:
        raise ValueError("a history feature needs a time order")
    return Window.partitionBy(*[F.coalesce(F.col(g).cast("string"), F.lit(MISSING_GROUP)) for g in group]).orderBy(*order)


def _reaching(df: DataFrame, order: list[str], reach: int, make: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """Columns over the whole order that look at most ``reach`` rows back."""
    if not order:
        raise ValueError("a history feature needs a time order")
    dealt = with_rows_before(in_ranges(df, [F.col(o) for o in order]), reach)
    made = make(Window.partitionBy("_range").orderBy("_at"))
    return dealt.withColumns(made).where(~F.col("_edge")).select(*df.columns, *made)


def _statistic(name: str, c: str, over) -> Column:  # noqa: ANN001
    x = F.col(c).cast("double")
    n = F.count(c).over(over)
    make = {
        "mean": lambda: F.avg(x).over(over), "sum": lambda: F.sum(x).over(over), "min": lambda: F.min(x).over(over), "max": lambda: F.max(x).over(over),
        "std": lambda: F.stddev_samp(x).over(over), "var": lambda: F.var_samp(x).over(over), "count": lambda: F.nullif(n, F.lit(0)).cast("double"),
        "median": lambda: F.percentile(x, F.lit(0.5)).over(over), "skew": lambda: adjusted_skew(n, F.skewness(x).over(over)), "kurt": lambda: adjusted_kurtosis(n, F.kurtosis(x).over(over)),
    }
    return make[name]()


def lag_features(df: DataFrame, column: str, lags: Iterable[int], order: list[str], group: Iterable[str] = ()) -> DataFrame:
    """column_lag_k for each k; signs are ignored, zero is left out."""
    steps = [abs(k) for k in lags if k]

    def make(over: WindowSpec) -> dict[str, Column]:
        return {f"{column}_lag_{k}": F.lag(column, k).over(over) for k in steps}

    return df.withColumns(make(_over(order, group))) if group else _reaching(df, order, max(steps, default=0), make)


def rolling_features(df: DataFrame, column: str, windows: Iterable[int] = (3,), statistics: Iterable[str] = ("mean",), order: list[str] = (), group: Iterable[str] = (), shift: int = 0) -> DataFrame:
    """column_roll_n_statistic over the last n rows, from one value on."""
    windows = list(windows)

    def make(over: WindowSpec) -> dict[str, Column]:
        return {f"{column}_roll_{n}_{s}": _statistic(s, column, over.rowsBetween(-(max(2, n) - 1) - shift, -shift)) for n in windows for s in statistics}

    return df.withColumns(make(_over(order, group))) if group else _reaching(df, order, max(2, *windows) - 1 + shift, make)


def diff_features(df: DataFrame, column: str, periods: Iterable[int] = (1,), order: list[str] = (), group: Iterable[str] = (), shift: int = 0) -> DataFrame:
    """column_diff_k: the value less the one k rows before; with a shift both move back."""
    steps = [abs(k) for k in periods if k]

    def make(over: WindowSpec) -> dict[str, Column]:
        now = F.lag(column, shift).over(over) if shift else F.col(column)
        return {f"{column}_diff_{k}": now - F.lag(column, shift + k).over(over) for k in steps}

    return df.withColumns(make(_over(order, group))) if group else _reaching(df, order, shift + max(steps, default=0), make)


def expanding_features(df: DataFrame, column: str, statistics: Iterable[str] = ("mean",), order: list[str] = (), group: Iterable[str] = (), shift: int = 0) -> DataFrame:
    """column_expanding_statistic over the whole past."""
    statistics = list(statistics)
    if group:
        over = _over(order, group).rowsBetween(Window.unboundedPreceding, -shift)
        return df.withColumns({f"{column}_expanding_{s}": _statistic(s, column, over) for s in statistics})
    if not order:
        raise ValueError("a history feature needs a time order")
    dealt = in_ranges(df, [F.col(o) for o in order])
    centre = df.agg(F.coalesce(F.avg(F.col(column).cast("double")), F.lit(0.0)).alias("c")).first()["c"]
    x = F.col(column).cast("double") - F.lit(centre)  # powers about the mean lose no digits
    sums = {"n": F.when(x.isNotNull(), 1), **{f"p{k}": F.pow(x, F.lit(float(k))) for k in (1, 2, 3, 4)}}
    ends = {"lo": F.min, "hi": F.max}
    totals = dealt.groupBy(F.col("_range").alias("_of")).agg(*[F.sum(v).alias(k) for k, v in sums.items()], *[f(column).alias(k) for k, f in ends.items()])
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = totals.select("_of", *[F.sum(k).over(before).alias(f"_o_{k}") for k in sums], *[f(k).over(before).alias(f"_o_{k}") for k, f in ends.items()])
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.join(F.broadcast(offsets), F.col("_range") == F.col("_of"))
    run = run.withColumns({f"_{k}": F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.coalesce(f"_o_{k}", F.lit(0)) for k, v in sums.items()} | {"_lo": F.least(F.min(column).over(inside), "_o_lo"), "_hi": F.greatest(F.max(column).over(inside), "_o_hi")})
    powers = _from_powers(centre)
    if "median" in statistics:
        run = run.join(_running_medians(dealt, column), "_at")
        powers["median"] = F.col("_median")
    made = {f"{column}_expanding_{s}": powers[s] for s in statistics}
    out = run.withColumns(made)
    if not shift:
        return out.select(*df.columns, *made)
    kept = with_rows_before(out.select(*df.columns, *made, "_range", "_at"), shift)
    over = Window.partitionBy("_range").orderBy("_at")
    return kept.withColumns({c: F.lag(c, shift).over(over) for c in made}).where(~F.col("_edge")).select(*df.columns, *made)


def _median_candidates(own: DataFrame) -> DataFrame:
    """_of, _v, _m, _less: for each range those of the ``_m`` values before it that its medians can take, ``_less`` smaller ones left out.

    Within a range of n values that m precede, the median lies among the range's own values and those of
    the m that have ranks from (m - n) / 2 to (m + n) / 2 + 2: no further can n values move it. Which these
    are, tell counts by range of time and bucket of value, as many buckets of equal size as there are
    ranges: at most their number squared. Whole buckets are taken, so a range gets at most some n values and two buckets.
    """
    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    valued = durable(own.where("_x is not null").repartitionByRange(n, "_x", "_at").withColumn("_bucket", F.spark_partition_id()))
    cells = valued.groupBy("_range", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    every = own.select("_range").distinct().crossJoin(F.broadcast(valued.select("_bucket").distinct()))  # as many as partitions, squared
    past = Window.partitionBy("_bucket").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_range")
    lower = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = every.join(cells, ["_range", "_bucket"], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(past), F.lit(0)))
    counts = counts.withColumns({"_under": F.coalesce(F.sum("_before").over(lower), F.lit(0)), "_m": F.sum("_before").over(whole), "_own": F.sum("_n").over(whole)})
    first, last = F.greatest(F.lit(1), F.floor((F.col("_m") - F.col("_own")) / 2)), F.floor((F.col("_m") + F.col("_own")) / 2) + 2
    taken = counts.where((F.col("_before") > 0) & (F.col("_under") < last) & (F.col("_under") + F.col("_before") >= first))
    taken = taken.select(F.col("_range").alias("_of"), "_bucket", "_m", F.min("_under").over(whole).alias("_less"))
    # back in the order of time, so that a bucket that many ranges take is sent by many tasks
    sent = valued.repartition(n, "_at").join(taken, "_bucket").where(F.col("_range") < F.col("_of"))
    return sent.select("_of", F.col("_x").alias("_v"), "_m", "_less")


def _running_medians(dealt: DataFrame, column: str) -> DataFrame:
    """_at, _median: the median of all values so far, for rows dealt by ranges of their order; NaN is no value."""
    x = F.col(column).cast("double")
    own = dealt.select("_range", "_at", F.when(~F.isnan(x), x).alias("_x"))

    def medians(rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        rows, seen = rows.sort_values("_at"), np.sort(before["_v"].to_numpy(dtype=float))
        m, less = (int(before["_m"].iloc[0]), int(before["_less"].iloc[0])) if len(seen) else (0, 0)
        cut = max(0, (m + 1) // 2 - less)
        low, high = (-seen[:cut][::-1]).tolist(), seen[cut:].tolist()  # sorted lists are heaps
        out, count, below = np.full(len(rows), np.nan), m, less + len(low)
        for i, v in enumerate(rows["_x"].to_numpy(dtype=float)):
            if v == v:
                count += 1
                if low and v < -low[0]:
                    heapq.heappush(low, -v)
                    below += 1
                else:
                    heapq.heappush(high, v)
                while below < (count + 1) // 2:
                    heapq.heappush(low, -heapq.heappop(high))
                    below += 1
                while below > (count + 1) // 2:
                    heapq.heappush(high, -heapq.heappop(low))
                    below -= 1
            if count:
                out[i] = -low[0] if count % 2 else (high[0] - low[0]) / 2
        made = pd.Series(out, dtype=object).where(~np.isnan(out), None)
        return pd.DataFrame({"_at": rows["_at"].to_numpy(), "_median": made})

    return own.groupBy("_range").cogroup(_median_candidates(own).groupBy("_of")).applyInPandas(medians, "_at long, _median double")


def _from_powers(centre: float) -> dict[str, Column]:
    """Statistics of what has been seen from its count, its sums of powers about ``centre`` and its ends."""
    n, p1, p2, p3, p4 = (F.col(c) for c in ("_n", "_p1", "_p2", "_p3", "_p4"))
    d = p1 / n
    m2 = F.greatest(p2 / n - d * d, F.lit(0.0))
    m3 = p3 / n - 3 * d * p2 / n + 2 * F.pow(d, F.lit(3.0))
    m4 = p4 / n - 4 * d * p3 / n + 6 * d * d * p2 / n - 3 * F.pow(d, F.lit(4.0))
    var = F.when(n > 1, m2 * n / (n - 1))
    some = n > 0
    out = {
        "mean": d + centre, "sum": p1 + n * centre, "min": F.col("_lo").cast("double"), "max": F.col("_hi").cast("double"), "var": var, "std": F.sqrt(var), "count": n.cast("double"),
        "skew": adjusted_skew(n, F.try_divide(m3, F.pow(m2, F.lit(1.5)))), "kurt": adjusted_kurtosis(n, F.try_divide(m4, m2 * m2) - 3),
    }
    return {k: F.when(some, v) for k, v in out.items()}


def average_rank(df: DataFrame, column: str, name: str, group: Iterable[str] = ()) -> DataFrame:
    """Rank with the mean for ties, among rows that have a value.

    Without a group the ranks come from counts by value in a global order, so no task holds a whole column.
    """
    if group:
        over = Window.partitionBy(*group).orderBy(column)
        ties = Window.partitionBy(*group, column)
        return df.withColumn(name, F.when(F.col(column).isNotNull(), F.rank().over(over.orderBy(F.col(column).asc_nulls_last())) + (F.count(column).over(ties) - 1) / 2))
    from sparkprep.functions.tables import global_running

    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranks = global_running(counted, [F.col("_v")], {"_upto": F.col("_n")}).select("_v", (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def top_per_group(df: DataFrame, group: Iterable[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits each task's rows before they are shuffled."""
    over = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(over)).where(F.col("place") <= k)
