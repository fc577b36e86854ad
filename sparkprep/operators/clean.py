"""Cleaning operators: DataFrame to DataFrame, with what was fitted where something was.

Unknown column names are left out. The target is never imputed, clipped or dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from sparkprep.functions.quantiles import column_quantiles
from sparkprep.functions.tables import TIMES, durable, in_ranges, known, last_before, numeric_columns, spread, string_columns
from sparkprep.operators.profile import fences, value_counts

#: Texts that stand for a missing value once stripped and lower-cased.
NULL_TOKENS = ("", "-", "--", "?", "n/a", "na", "nan", "none", "null", "nil", "unknown", "missing")
#: Names of types, as plans write them.
TYPE_NAMES = {
    "int": "bigint", "int64": "bigint", "integer": "bigint", "long": "bigint", "int32": "int", "float": "double", "float64": "double", "double": "double", "number": "double", "numeric": "double", "float32": "float",
    "str": "string", "string": "string", "object": "string", "text": "string", "category": "string", "bool": "boolean", "boolean": "boolean", "datetime": "timestamp", "datetime64": "timestamp", "timestamp": "timestamp", "date": "date",
}
MISSING = "MISSING"


def _safe(df: DataFrame, columns: Iterable[str], target: str | None) -> list[str]:
    return [c for c in known(df, columns) if c != target]


def drop_columns(df: DataFrame, columns: Iterable[str], target: str | None = None) -> DataFrame:
    """Drops all but the target, and never every column."""
    names = _safe(df, columns, target)
    return df if len(names) == len(df.columns) else df.drop(*names)


def constant_columns(df: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    """Columns of one value, null counted as a value."""
    names = known(df, columns)
    if not names:
        return []
    row = df.agg(*[(F.approx_count_distinct(c, 0.05) + F.max(F.col(c).isNull().cast("int"))).alias(f"a{i}") for i, c in enumerate(names)]).first()
    likely = [c for i, c in enumerate(names) if (row[f"a{i}"] or 0) <= 2]
    if not likely:
        return []
    exact = df.agg(*[(F.count_distinct(c) + F.coalesce(F.max(F.col(c).isNull().cast("int")), F.lit(0))).alias(f"a{i}") for i, c in enumerate(likely)]).first()
    return [c for i, c in enumerate(likely) if exact[f"a{i}"] <= 1]


def drop_rows_missing_target(df: DataFrame, target: str, least: int = 10) -> DataFrame:
    """Refused, with an error, if fewer than ``least`` rows would stay."""
    kept = df.where(F.col(target).isNotNull())
    if kept.limit(least).count() < least:
        raise ValueError(f"fewer than {least} rows have a target")
    return kept


def drop_rows_missing(df: DataFrame, columns: Iterable[str], least: int = 10) -> DataFrame:
    names = known(df, columns)
    kept = df.na.drop(how="any", subset=names) if names else df
    return kept if kept.limit(least).count() >= least else df


def bounds_of(df: DataFrame, columns: list[str], multiplier: float = 1.5) -> dict[str, tuple[float, float]]:
    """Interquartile fences of the columns that have spread."""
    if not columns:
        return {}
    row = fences(df, columns, multiplier).first()
    out = {}
    for i, c in enumerate(columns):
        a, b = row[f"a{i}"], row[f"b{i}"]
        if a is not None and b > a:
            out[c] = (a - multiplier * (b - a), b + multiplier * (b - a))
    return out


def remove_outlier_rows(df: DataFrame, columns: Iterable[str], multiplier: float = 1.5, bounds: Mapping[str, tuple[float, float]] | None = None, target: str | None = None, most: float = 0.5, least: int = 10) -> DataFrame:
    """Rows outside a fence in any column go; a null is never outside. Refused if more than half or nearly all rows would go."""
    names = [c for c in _safe(df, columns, target) if c in numeric_columns(df)]
    bounds = bounds_of(df, names, multiplier) if bounds is None else bounds
    outside = F.lit(False)
    for c, (lo, hi) in bounds.items():
        outside = outside | F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False))
    seen = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(outside).alias("out")).first()
    if seen["out"] > most * seen["n"] or seen["n"] - seen["out"] < least:
        return df
    return df.where(~outside)


def clip_outliers(df: DataFrame, columns: Iterable[str], multiplier: float = 1.5, bounds: Mapping[str, tuple[float, float]] | None = None, target: str | None = None) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Values outside the bounds become the bounds; nulls pass. A column without spread is left as it is."""
    names = [c for c in _safe(df, columns, target) if c in numeric_columns(df)]
    bounds = bounds_of(df, names, multiplier) if bounds is None else {c: b for c, b in bounds.items() if c in names}
    return df.withColumns({c: F.when(F.col(c) < lo, F.lit(lo)).when(F.col(c) > hi, F.lit(hi)).otherwise(F.col(c)) for c, (lo, hi) in bounds.items()}), dict(bounds)


def drop_duplicates(df: DataFrame, columns: Iterable[str] | None = None, keep: str = "first", order: Iterable[str] = ()) -> DataFrame:
    """Whole rows, or by key: the first or last by ``order``, or with keep="none" only keys that occur once."""
    if columns is None and keep != "none":
        return df.dropDuplicates()
    keys = known(df, columns)
    if keep == "none":
        alone = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
        match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        return df.join(alone, match, "left_semi")
    # partial aggregates pick the row, so a hot key costs a row a task
    rest = [c for c in [*order, *df.columns] if c not in keys]
    whole = F.struct(*[F.col(c) for c in dict.fromkeys(rest)])
    picked = df.groupBy(*keys).agg((F.min(whole) if keep == "first" else F.max(whole)).alias("_r"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in df.columns])


def strip_whitespace(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    names = [c for c in known(df, columns) if c in string_columns(df)]
    return df.withColumns({c: F.regexp_replace(c, r"^\s+|\s+$", "") for c in names})


def normalise_categories(df: DataFrame, columns: Iterable[str], lowercase: bool = True, collapse: bool = True, nullify: bool = True, mapping: Mapping[str, str] | None = None) -> DataFrame:
    out = {}
    for c in [c for c in known(df, columns) if c in string_columns(df)]:
        x = F.regexp_replace(c, r"^\s+|\s+$", "")
        x = F.lower(x) if lowercase else x
        x = F.regexp_replace(x, r"\s+", " ") if collapse else x
        if mapping:
            pairs = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
            x = F.coalesce(F.try_element_at(pairs, x), x)
        out[c] = F.when(~F.lower(x).isin(*NULL_TOKENS), x) if nullify else x
    return df.withColumns(out)


def as_datetime(column: str, format: str | None = None, unit: str | None = None, dayfirst: bool = False) -> Column:
    """The column as a time: by unit (s, ms, us), by format, else by the usual forms in order; null where it does not parse."""
    if unit is not None:
        scale = {"s": 1_000_000, "ms": 1_000, "us": 1}[unit]
        return F.timestamp_micros((F.col(column).try_cast("double") * scale).cast("long"))
    days = ("dd/MM/yyyy", "dd-MM-yyyy", "MM/dd/yyyy") if dayfirst else ("MM/dd/yyyy", "MM-dd-yyyy", "dd/MM/yyyy")
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", *days, "dd MMM yyyy", "yyyyMMdd")
    text = F.trim(F.col(column).cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in ((format,) if format else forms)])


def parsing_columns(df: DataFrame, columns: Iterable[str], format: str | None = None, unit: str | None = None, dayfirst: bool = False) -> list[str]:
    """The columns, not times yet, in which something parses."""
    names = [c for c in known(df, columns) if not isinstance(df.schema[c].dataType, TIMES)]
    if not names:
        return []
    parsed = df.agg(*[F.count(as_datetime(c, format, unit, dayfirst)).alias(f"n{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if parsed[f"n{i}"]]


def apply_datetime(df: DataFrame, columns: Iterable[str], format: str | None = None, unit: str | None = None, dayfirst: bool = False) -> DataFrame:
    """The columns as times, whatever they hold; what are times already stay."""
    return df.withColumns({c: as_datetime(c, format, unit, dayfirst) for c in known(df, columns) if not isinstance(df.schema[c].dataType, TIMES)})


def parse_datetime(df: DataFrame, columns: Iterable[str], format: str | None = None, unit: str | None = None, dayfirst: bool = False) -> DataFrame:
    """``apply_datetime`` for the columns in which something parses; others are left as they are."""
    return apply_datetime(df, parsing_columns(df, columns, format, unit, dayfirst), format, unit, dayfirst)


def cast_types(df: DataFrame, types: Mapping[str, str]) -> tuple[DataFrame, dict[str, int]]:
    """Casts with null for what does not parse, and how many values that took from each column."""
    wanted = {c: TYPE_NAMES.get(t, t) for c, t in types.items() if c in df.columns}
    if not wanted:
        return df, {}
    lost = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(f"l{i}") for i, (c, t) in enumerate(wanted.items())]).first()
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in wanted.items()}), {c: lost[f"l{i}"] for i, c in enumerate(wanted)}


def modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Commonest value of each column, the smallest of equals: one job for all numbers and texts, one a column of other types."""
    plain = [c for c in columns if isinstance(df.schema[c].dataType, T.IntegralType | T.DoubleType | T.FloatType | T.StringType)]
    out: dict[str, object] = dict.fromkeys(columns)
    if plain:
        least = F.min(F.struct((-F.col("n")).alias("n"), "whole", "real", "text"))
        for r in value_counts(df, plain).where("column is not null").groupBy("column").agg(least.alias("m")).collect():  # a row a column
            out[r["column"]] = next(v for v in (r["m"]["whole"], r["m"]["real"], r["m"]["text"]) if v is not None)
    for c in [c for c in columns if c not in plain]:
        top = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").limit(1).first()
        out[c] = None if top is None else top["v"]
    return out


def fit_fills(df: DataFrame, columns: Iterable[str], strategy: str, fill_value: object = None) -> dict[str, object]:
    """What to put for nulls: mean, median, mode, constant, missing_category, or auto (median for numbers, else mode)."""
    names, numbers = known(df, columns), numeric_columns(df)
    aggs, fills, medians = [], {}, []
    for c in names:
        kind = ("median" if c in numbers else "mode") if strategy == "auto" or strategy in ("mean", "median") and c not in numbers else strategy
        if kind in ("mean", "median"):
            if kind == "mean":
                aggs.append(F.avg(c).alias(c))
            else:
                medians.append(c)
        elif kind == "mode":
            fills |= modes(df, [c])
        elif kind == "constant":
            fills[c] = (0 if c in numbers else MISSING) if fill_value is None else fill_value
        elif kind == "missing_category":
            fills[c] = MISSING if c not in numbers else 0
    if aggs:
        fills |= df.agg(*aggs).first().asDict()
    if medians:
        fills |= {c: q[0] for c, q in column_quantiles(df, {c: F.col(c) for c in medians}, [0.5]).items()}
    return {c: v for c, v in fills.items() if v is not None}


def apply_fills(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    """Frozen fills: narrow expressions, the same for batches and streams. Whole-number columns become doubles where the fill is none."""
    out = {}
    for c, v in fills.items():
        if c in df.columns:
            x = F.col(c).cast("double") if isinstance(v, float) and isinstance(df.schema[c].dataType, T.IntegralType) else F.col(c)
            out[c] = F.coalesce(x, F.lit(v))
    return df.withColumns(out) if out else df


def impute(df: DataFrame, columns: Iterable[str], strategy: str = "auto", fill_value: object = None, target: str | None = None) -> tuple[DataFrame, dict[str, object]]:
    fills = fit_fills(df, _safe(df, columns, target), strategy, fill_value)
    return apply_fills(df, fills), fills


def directional_fill(df: DataFrame, columns: Iterable[str], order: list[str], group: list[str] = (), backward: bool = False, limit: int | None = None, leftovers: bool = True) -> DataFrame:
    """Forward or backward fill along ``order`` within ``group``, over at most ``limit`` rows; what is left gets the median or mode.

    Without a group rows are dealt by ranges of the order, which must tell them apart, and a range gets the last values before it.
    """
    if not group:
        names = known(df, columns)
        dealt = in_ranges(df, [F.col(o).desc() if backward else F.col(o).asc() for o in order])
        inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        rows = dealt.join(F.broadcast(last_before(dealt, names)), F.col("_range") == F.col("_of"))
        made = {}
        for i, c in enumerate(names):
            own = F.last(F.when(F.col(c).isNotNull(), F.col("_at")), ignorenulls=True).over(inside)
            value = F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_v{i}"))
            made[c] = F.coalesce(F.col(c), value if limit is None else F.when(F.col("_at") - F.coalesce(own, F.col(f"_p{i}")) <= limit, value))
        filled = rows.withColumns(made).select(*df.columns)
        return apply_fills(filled, fit_fills(filled, made, "auto")) if leftovers else filled
    keys = [F.col(o).desc() if backward else F.col(o).asc() for o in order]
    over = Window.partitionBy(*group).orderBy(*keys)
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for c in known(df, columns):
        value = F.last(c, ignorenulls=True).over(upto)
        if limit is not None:
            at = F.row_number().over(over)
            value = F.when(F.col("_at") - F.last(F.when(F.col(c).isNotNull(), F.col("_at")), ignorenulls=True).over(upto) <= limit, value)
            df = df.withColumn("_at", at)
        out[c] = F.coalesce(F.col(c), value)
    filled = df.withColumns(out).drop("_at")
    return apply_fills(filled, fit_fills(filled, out, "auto")) if leftovers else filled


def impute_by_type(df: DataFrame, columns: Iterable[str], order: list[str], group: list[str] = (), target: str | None = None) -> tuple[DataFrame, dict[str, object]]:
    """Each column by the default of its type, and the fills: the median for numbers, the last value along ``order`` for times (the mode for those before the first), else the mode."""
    safe = _safe(df, columns, target)
    times = [c for c in safe if isinstance(df.schema[c].dataType, TIMES)]
    fills = fit_fills(df, [c for c in safe if c not in times], "auto")
    return apply_fills(directional_fill(df, times, order, group) if times else df, fills), fills


def _both_ways(*part: str) -> tuple[WindowSpec, WindowSpec]:
    """Frames of the rows up to a row's number ``_at`` and, turned round, of those from it on: a running frame reads a part once, one that runs to the end reads it anew for every row."""
    over = Window.partitionBy(*part)
    return tuple(over.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("_at"), F.desc("_at")))


def interpolate(df: DataFrame, columns: Iterable[str], order: list[str], group: list[str] = ()) -> DataFrame:
    """Linear by row position within group, both ways; edges take the nearest value. Without a group by ranges, as ``directional_fill``."""
    if not group:
        wanted = [c for c in known(df, columns) if c in numeric_columns(df)]
        dealt = in_ranges(df, [F.col(o) for o in order])
        turned = dealt.select("_range", (-F.col("_at")).alias("_at"), *wanted).withColumn("_range", -F.col("_range"))
        after = last_before(turned, wanted)
        after = after.select((-F.col("_of")).alias("_of2"), *[x for i in range(len(wanted)) for x in (F.col(f"_v{i}").alias(f"_w{i}"), (-F.col(f"_p{i}")).alias(f"_q{i}"))])
        rows = dealt.join(F.broadcast(last_before(dealt, wanted)), F.col("_range") == F.col("_of")).join(F.broadcast(after), F.col("_range") == F.col("_of2"))
        back, ahead = _both_ways("_range")
        made = {}
        for i, c in enumerate(wanted):
            at = F.when(F.col(c).isNotNull(), F.col("_at"))
            p, pv = F.coalesce(F.last(at, ignorenulls=True).over(back), F.col(f"_p{i}")), F.coalesce(F.last(c, ignorenulls=True).over(back), F.col(f"_v{i}"))
            n, nv = F.coalesce(F.last(at, ignorenulls=True).over(ahead), F.col(f"_q{i}")), F.coalesce(F.last(c, ignorenulls=True).over(ahead), F.col(f"_w{i}"))
            made[c] = F.coalesce(F.col(c).cast("double"), pv + (nv - pv) * (F.col("_at") - p) / (n - p), pv, nv)
        return rows.withColumns(made).select(*df.columns)
    back, ahead = _both_ways(*group)
    names = [c for c in known(df, columns) if c in numeric_columns(df)]
    rows = df.withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    out = {}
    for c in names:
        at = F.when(F.col(c).isNotNull(), F.col("_at"))
        p, pv = F.last(at, ignorenulls=True).over(back), F.last(c, ignorenulls=True).over(back)
        n, nv = F.last(at, ignorenulls=True).over(ahead), F.last(c, ignorenulls=True).over(ahead)
        line = pv + (nv - pv) * (F.col("_at") - p) / (n - p)
        out[c] = F.coalesce(F.col(c).cast("double"), line, pv, nv)
    return rows.withColumns(out).drop("_at")


def knn_impute(df: DataFrame, columns: Iterable[str], key: str, k: int = 5, weights: str = "uniform", block: int = 4096) -> DataFrame:
    """Mean of the k nearest donors' values, by distance over the numbers both rows have, scaled to the number of columns.

    Donors are all rows that have the value and a key, ties by key. Rows with holes meet them in
    pairs of blocks, and only the k best of a block for each hole leave it. Where a block's worth of rows or more have
    the same columns, rows of equal numbers are one, and so far as they differ in these columns only the k first donors
    of each number meet them: what is equal in these columns is equally far. Rows of other patterns meet all donors.
    """
    names = [c for c in known(df, columns) if c in numeric_columns(df)]
    has = F.array_join(F.transform("v", lambda x: F.when(x.isNull() | F.isnan(x), "0").otherwise("1")), "")
    plain = spread(df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.array(*[F.col(c).cast("double") for c in names]).alias("v"))).withColumn("has", has)
    holes = plain.where(F.exists("v", lambda x: x.isNull()))
    common = [r["has"] for r in holes.groupBy("has").count().where(F.col("count") >= block).collect()]  # no more than there are blocks of holes
    rare = holes.where(~F.col("has").isin(common)) if common else holes
    found = _near_donors(plain.select("id", "v"), rare.select("id", "v"), len(names), k, block, dict(df.dtypes)[key])
    near = found.withColumn("_k", F.row_number().over(Window.partitionBy("id", "c").orderBy("dist", "donor"))).where(F.col("_k") <= k)
    if common:
        alike = durable(holes.where(F.col("has").isin(common)).groupBy("has", "v").agg(F.min("id").alias("one")))
        able = plain.select("id", "v", F.explode(F.array(*map(F.lit, common))).alias("of"))
        able = able.withColumn("w", F.transform("v", lambda x, i: F.when(F.substring("of", i + 1, F.lit(1)) == "1", x)))
        able = able.withColumn("c", F.explode(F.filter(F.sequence(F.lit(1), F.lit(len(names))), lambda i: (F.substring("of", i, F.lit(1)) == "0") & F.element_at("v", i).isNotNull() & ~F.isnan(F.element_at("v", i)))))
        first = able.withColumn("_k", F.row_number().over(Window.partitionBy("of", "c", "w").orderBy("id"))).where(F.col("_k") <= k)
        donors = durable(plain.join(first.select("id").distinct(), "id", "left_semi").select("id", "v"))
        found = _near_donors(donors, alike.select(F.col("one").alias("id"), "v"), len(names), k, block, dict(df.dtypes)[key])
        best = durable(found.withColumn("_k", F.row_number().over(Window.partitionBy("id", "c").orderBy("dist", "donor"))).where(F.col("_k") <= k))
        same = holes.join(alike, ["has", "v"]).select("id", "one")
        near = near.unionByName(same.join(best.withColumnRenamed("id", "one"), "one").select(*near.columns))
    w = F.lit(1.0) if weights == "uniform" else F.when(F.col("dist") == 0, 1e12).otherwise(1 / F.col("dist"))
    fills = near.groupBy("id", "c").agg((F.sum(F.col("value") * w) / F.sum(w)).alias("fill"))
    wide = fills.groupBy(F.col("id").alias("_id")).agg(*[F.max(F.when(F.col("c") == i, F.col("fill"))).alias(f"_fill{i}") for i in range(len(names))])
    out = df.join(wide, F.col(key) == F.col("_id"), "left").withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_fill{i}")) for i, c in enumerate(names)})
    return apply_fills(out, fit_fills(df, names, "mean")).select(*df.columns)


def _near_donors(plain: DataFrame, holes: DataFrame, width: int, k: int, block: int, of: str) -> DataFrame:
    """(id, c, dist, donor, value): for each hole the k best donors of every block of (id, v)."""
    nr, nq = (max(1, -(-x.count() // block)) for x in (plain, holes))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = plain.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(nr))).withColumn("qb", upto(nq)).withColumn("q", F.lit(False))
    right = holes.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(nq))).withColumn("b", upto(nr)).withColumn("q", F.lit(True))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[~pdf["q"]].sort_values("id"), pdf[pdf["q"]]
        ai, bi = a["id"].to_numpy(), b["id"].to_numpy()
        out = {"id": [], "c": [], "dist": [], "donor": [], "value": []}
        if len(a) and len(b):
            av, bv = (np.stack([np.asarray(v, dtype=float) for v in t["v"]]) for t in (a, b))
            has = ~np.isnan(av)
            for i, v in enumerate(bv):
                own = ~np.isnan(v)
                shared = (has & own).sum(1)
                square = np.where(has & own, (av - v) ** 2, 0.0).sum(1)
                dist = np.where((shared > 0) & (ai != bi[i]), np.sqrt(square * width / np.maximum(shared, 1)), np.inf)
                for j in np.flatnonzero(~own):
                    able = np.flatnonzero(has[:, j] & np.isfinite(dist))
                    if len(able) > k:
                        able = able[dist[able] <= np.partition(dist[able], k - 1)[k - 1]]
                    best = able[np.argsort(dist[able], kind="stable")[:k]]  # rows are in the key's order
                    out["id"] += [bi[i]] * len(best)
                    out["c"] += [int(j)] * len(best)
                    out["dist"] += dist[best].tolist()
                    out["donor"] += ai[best].tolist()
                    out["value"] += av[best, j].tolist()
        return pd.DataFrame(out)

    return left.unionByName(right).groupBy("b", "qb").applyInPandas(meet, f"id {of}, c int, dist double, donor {of}, value double")


def iterative_impute(df: DataFrame, columns: Iterable[str], rounds: int = 10, ridge: float = 1e-3) -> DataFrame:
    """Round robin: each column with holes is regressed on the others, filled from the fit, and so on; starts from means."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    names = [c for c in known(df, columns) if c in numeric_columns(df)]
    holes = [c for c in names if df.where(F.col(c).isNull()).limit(1).count()]
    now = df.withColumns({f"_m_{c}": F.col(c).isNull() for c in holes})
    now = durable(apply_fills(now.withColumns({c: F.col(c).cast("double") for c in names}), fit_fills(df, names, "mean")))
    for _ in range(min(rounds, 3) if len(holes) < 2 else rounds):
        for c in holes:
            make = VectorAssembler(inputCols=[x for x in names if x != c], outputCol="_x")
            fit = LinearRegression(featuresCol="_x", labelCol=c, predictionCol="_p", regParam=ridge, solver="normal").fit(make.transform(now.where(~F.col(f"_m_{c}"))))
            now = fit.transform(make.transform(now)).withColumn(c, F.when(F.col(f"_m_{c}"), F.col("_p")).otherwise(F.col(c))).drop("_x", "_p")
        now = durable(now)
    return now.select(*df.columns)


def coerce_grouped_numbers(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Text columns all of whose values are numbers in groups of three digits become doubles."""
    names = [c for c in known(df, columns) if c in string_columns(df)]
    if not names:
        return df
    form = r"^\s*[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?\s*$"
    all_fit = df.agg(*[F.bool_and(F.col(c).rlike(form)).alias(f"a{i}") for i, c in enumerate(names)]).first()
    return df.withColumns({c: F.regexp_replace(c, ",", "").try_cast("double") for i, c in enumerate(names) if all_fit[f"a{i}"]})


def coerce_dates(df: DataFrame, columns: Iterable[str] | None = None, min_parse_rate: float = 0.9, dayfirst: bool = False) -> DataFrame:
    """Text columns that look and parse like dates become timestamps, if at least three values do."""
    names = [c for c in known(df, columns) if c in string_columns(df)]
    if not names:
        return df
    parsed = parse_datetime(df, names, dayfirst=dayfirst)
    done = [c for c in names if parsed.schema[c].dataType != df.schema[c].dataType]
    look = r"^\s*([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}|[0-9]{1,2} [A-Za-z]{3} [0-9]{4}|[0-9]{8})"
    if not done:
        return df
    aggs = [x for i, c in enumerate(done) for x in (F.count(c).alias(f"n{i}"), F.count_if(F.col(c).rlike(look)).alias(f"l{i}"))]
    row, kept = df.agg(*aggs).first(), parsed.agg(*[F.count(c).alias(f"p{i}") for i, c in enumerate(done)]).first()
    good = [c for i, c in enumerate(done) if row[f"n{i}"] >= 3 and row[f"l{i}"] >= 0.9 * row[f"n{i}"] and kept[f"p{i}"] >= min_parse_rate * row[f"n{i}"] and kept[f"p{i}"] == row[f"n{i}"]]
    return parse_datetime(df, good, dayfirst=dayfirst)


