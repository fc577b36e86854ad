"""Exact quantiles of whole columns without a shuffle of values: histograms that narrow the ranges the wanted ranks lie in.

A pass counts, per range, equal-width bins with their least and greatest values (added up in the tasks first,
so a row a range and bin leaves each); the bins that hold wanted ranks are the next pass's ranges, from their own
least to their greatest value. When few rows are left in all ranges together their values are counted one by one. What
comes to the driver is bounded by the parameters, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.tables import global_running

#: Bins a range, rows in ranges that are counted value by value, and columns whose ranges one pass looks at.
BINS, FEW, AT_ONCE = 2048, 20_000, 40


def _cells(columns: Mapping[int, Column], ranges: list[tuple[int, float, float]]) -> Column:
    """Rows of (range, value) for the ranges that the columns' values lie in."""
    found = []
    for i, x in columns.items():
        mine = [(k, lo, hi) for k, (c, lo, hi) in enumerate(ranges) if c == i]
        if mine:
            at = F.coalesce(*[F.when(x.between(F.lit(lo), F.lit(hi)), F.lit(k)) for k, lo, hi in mine])
            found.append(F.struct(at.alias("k"), x.alias("v")))
    return F.explode(F.filter(F.array(*found), lambda c: c["k"].isNotNull()))


def _narrowed(df: DataFrame, columns: Mapping[int, Column], counts: dict[int, int], ends: dict[int, tuple[float, float]], ranks: dict[int, set[int]]) -> dict[tuple[int, int], float]:
    """(column, rank) -> value."""
    found: dict[tuple[int, int], float] = {}
    live = [(i, *ends[i], 0, sorted(ranks[i])) for i in columns if counts[i]]  # column, least, greatest, rows below, ranks inside
    left = sum(counts[i] for i in columns)
    while live:
        for i, lo, hi, _, wanted in live:
            if lo == hi:
                found |= {(i, r): lo for r in wanted}
        live = [x for x in live if x[1] != x[2]]
        if not live:
            break
        rows = df.select(_cells(columns, [(i, lo, hi) for i, lo, hi, *_ in live]).alias("c")).select("c.k", "c.v")
        whole = left <= FEW
        if not whole:
            lo, step = (F.element_at(F.create_map(*[F.lit(x) for k, r in enumerate(live) for x in (k, of(r))]), F.col("k")) for of in (lambda r: r[1], lambda r: r[2] / BINS - r[1] / BINS))
            rows = rows.withColumn("bin", F.least(F.floor((F.col("v") - lo) / step), F.lit(BINS - 1)))
        by = rows.groupBy("k", F.col("v").alias("bin") if whole else "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        bins: dict[int, list] = {}
        for r in by:
            bins.setdefault(r["k"], []).append((r["lo"], r["hi"], r["n"]))
        after, left = [], 0
        for k, (i, _, _, below, wanted) in enumerate(live):
            for lo, hi, n in sorted(bins.get(k, ())):
                inside = [r for r in wanted if below <= r < below + n]
                if inside:
                    after.append((i, lo, hi, below, inside))
                    left += n if lo != hi else 0
                below += n
        live = after
    return found


def column_quantiles(df: DataFrame, columns: Mapping[str, Column], probabilities: Iterable[float]) -> dict[str, list[float | None]]:
    """Name -> its quantiles by linear interpolation between the two ranks around; None for a column without values. Nulls and NaN are left out."""
    ps, names, out = [float(p) for p in probabilities], list(columns), {}
    for first in range(0, len(names), AT_ONCE):
        part = names[first : first + AT_ONCE]
        numbers = {i: F.nanvl(columns[c].cast("double"), F.lit(None).cast("double")) for i, c in enumerate(part)}
        one = df.agg(*[x for i, v in numbers.items() for x in (F.count(v).alias(f"n{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}"))]).first()
        counts = {i: one[f"n{i}"] for i in numbers}
        places = {i: [(counts[i] - 1) * p for p in ps] for i in numbers}
        ranks = {i: {r for x in places[i] for r in (int(x), min(int(x) + 1, counts[i] - 1))} for i in numbers}
        at = _narrowed(df, numbers, counts, {i: (one[f"a{i}"], one[f"b{i}"]) for i in numbers}, ranks)
        for i, c in enumerate(part):
            out[c] = [None] * len(ps)
            if counts[i]:
                out[c] = [at[i, int(x)] + (x - int(x)) * (at[i, min(int(x) + 1, counts[i] - 1)] - at[i, int(x)]) for x in places[i]]
    return out


def grid_quantiles(df: DataFrame, column: Column, n: int) -> list[float]:
    """Values at n + 1 even probabilities: counts by value run up in a global order, and each task picks the ranks that fall into its range. Empty without values."""
    value = F.nanvl(column.cast("double"), F.lit(None).cast("double"))
    counts = df.select(value.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    run = global_running(counts, [F.col("v")], {"upto": F.col("n")})
    total = run.agg(F.max("upto")).first()[0]
    if not total:
        return []
    places = np.arange(n + 1) / n * (total - 1)
    low = places.astype(np.int64)
    ranks = np.unique(np.concatenate([low, np.minimum(low + 1, total - 1)]))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, here, upto = (x.to_numpy() for x in batch.columns)
            order = np.argsort(upto)
            v, here, upto = v[order], here[order], upto[order]
            if len(v):
                mine = ranks[(ranks >= upto[0] - here[0]) & (ranks < upto[-1])]
                at = np.searchsorted(upto, mine, side="right")
                inside = mine >= upto[at] - here[at]  # a batch need not hold all between its ends
                yield pa.RecordBatch.from_arrays([pa.array(mine[inside]), pa.array(v[at[inside]])], ["rank", "v"])

    at = {r["rank"]: r["v"] for r in run.select("v", "n", "upto").mapInArrow(pick, "rank long, v double").collect()}
    return [at[i] + (x - i) * (at[min(i + 1, total - 1)] - at[i]) for x, i in zip(places.tolist(), low.tolist(), strict=True)]


def group_medians(df: DataFrame, by: list[str], columns: Mapping[str, Column]) -> DataFrame:
    """by and the median of each column; a null where a group has no value. Ranks come from counts in a global order, so no task holds a group's values."""
    keys = F.struct(*[F.col(b) for b in by])
    out = None
    for name, x in columns.items():
        value = F.nanvl(x.cast("double"), F.lit(None).cast("double"))
        counts = df.select(keys.alias("_g"), value.alias("_v")).groupBy("_g", "_v").agg(F.count("_v").alias("_n"))
        run = global_running(counts, [F.col("_g"), F.col("_v")], {"_upto": F.col("_n")})
        ends = run.groupBy(F.col("_g").alias("_of")).agg(F.sum("_n").alias("_all"), F.max("_upto").alias("_end"))
        upto = F.col("_upto") - F.col("_end") + F.col("_all")
        met = run.join(ends, F.col("_g").eqNullSafe(F.col("_of"))).withColumn("_to", upto).withColumn("_mid", (F.col("_all") - 1) / 2)
        holds = lambda r: (F.col("_to") - F.col("_n") <= r) & (r < F.col("_to"))
        low, high = F.max(F.when(holds(F.floor("_mid")), F.col("_v"))), F.max(F.when(holds(F.ceil("_mid")), F.col("_v")))
        one = met.groupBy("_g").agg(((low + high) / 2).alias(name))
        out = one if out is None else out.join(one.withColumnRenamed("_g", "_h"), F.col("_g").eqNullSafe(F.col("_h"))).drop("_h")
    return out.select("_g.*", *columns)
