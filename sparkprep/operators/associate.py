"""Associations between columns: correlations, Cramér's V, correlation ratios, mutual information, and leakage findings built on them."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.tables import correlation, durable, global_running, known, numeric_columns, spread, to_long
from sparkprep.operators.profile import _numbers, _quantile_rows, column_counts, value_counts
from sparkprep.operators.windows import average_rank


def pearson_pairs(df: DataFrame, columns: Iterable[str] | None = None, min_periods: int = 8, max_columns: int = 150) -> DataFrame:
    """a, b, n, r of every pair, over the rows that have both, all from one aggregate."""
    names = [c for c in known(df, columns) if c in numeric_columns(df)][:max_columns]
    aggs, fields = [], {}
    for k, (a, b) in enumerate(combinations(names, 2)):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [F.count_if(both).alias(f"n{k}"), correlation(F.col(a), F.col(b)).alias(f"r{k}")]
        r = F.when(F.col(f"n{k}") >= min_periods, F.col(f"r{k}"))
        fields[f"{a}\x00{b}"] = {"a": F.lit(a), "b": F.lit(b), "n": F.col(f"n{k}"), "r": r}
    return to_long(df.agg(*aggs), fields, key="_pair").drop("_pair")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row n, rho: Pearson on average ranks of the rows that have both."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("x"), F.col(b).alias("y"))
    ranked = average_rank(average_rank(both, "x", "rx"), "y", "ry")
    return ranked.agg(F.count(F.lit(1)).alias("n"), correlation(F.col("rx"), F.col("ry")).alias("rho"))


def spearman_pairs(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """a, b, rho of every pair. Columns without holes are ranked once each and all their pairs are one aggregate; a pair with holes is ranked on the rows that have both."""
    names = list(columns)
    holes = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"h{i}") for i, c in enumerate(names)]).first()
    whole = [c for i, c in enumerate(names) if not holes[f"h{i}"]]
    ranked = df.select(*names)
    for i, c in enumerate(whole):
        ranked = average_rank(ranked, c, f"_rank{i}")
    aggs, fields = [], {}
    for k, (i, j) in enumerate(combinations(range(len(whole)), 2)):
        aggs.append(correlation(F.col(f"_rank{i}"), F.col(f"_rank{j}")).alias(f"r{k}"))
        fields[f"{whole[i]}\x00{whole[j]}"] = {"a": F.lit(whole[i]), "b": F.lit(whole[j]), "rho": F.col(f"r{k}")}
    out = to_long(ranked.agg(*aggs), fields, key="_pair").drop("_pair") if aggs else df.sparkSession.createDataFrame([], "a string, b string, rho double")
    for a, b in combinations(names, 2):
        if a not in whole or b not in whole:
            out = out.unionByName(spearman(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "rho"))
    return out


def _cells(df: DataFrame, pairs: list[tuple[str, str]], numbers: bool) -> DataFrame:
    """a, b, x, y of all the pairs' rows that have both: y as a number or as text."""
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("string").alias("x"), F.col(b).cast("double" if numbers else "string").alias("y")) for a, b in pairs]
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("x is not null and y is not null")


def cramers_v_pairs(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """a, b, v of every pair of columns, from one count of all their cells."""
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, v double")
    o = _cells(df, pairs, False).groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).cast("double").alias("o"))
    nx, ny = o.groupBy("a", "b", "x").agg(F.sum("o").alias("nx")), o.groupBy("a", "b", "y").agg(F.sum("o").alias("ny"))
    j = o.join(nx, ["a", "b", "x"]).join(ny, ["a", "b", "y"])
    one = j.groupBy("a", "b").agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("nx") * F.col("ny"))).alias("q"), F.count_distinct("x").alias("r"), F.count_distinct("y").alias("k"))
    return one.select("a", "b", _corrected_v().alias("v"))


def correlation_ratio_pairs(df: DataFrame, categories: Iterable[str], numbers: Iterable[str]) -> DataFrame:
    """a, b, eta of every category with every number, from one aggregate by level."""
    pairs = [(a, b) for b in numbers for a in categories]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, eta double")
    y = F.col("y")
    by = _cells(df, pairs, True).groupBy("a", "b", "x").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    t = by.groupBy("a", "b").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b2"))
    return t.select("a", "b", _corrected_eta("b2").alias("eta"))


def _corrected_v() -> Column:
    """Cramér's V from n, q (the sum of o² / (row total x column total)), r and k."""
    # chi2 / n = sum(o^2 / (na nb)) - 1
    n, r, k = F.col("n"), F.col("r"), F.col("k")
    phi = F.greatest(F.lit(0.0), F.col("q") - 1 - (k - 1) * (r - 1) / (n - 1))
    rc, kc = r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)
    least = F.least(rc - 1, kc - 1)
    return F.when((n >= 4) & (r >= 2) & (k >= 2) & (least > 0), F.sqrt(phi / least))


def _corrected_eta(b: str) -> Column:
    """The correlation ratio from n, k, s, q and the sum of s² / n by class."""
    n, k = F.col("n"), F.col("k")
    total, between = F.col("q") - F.col("s") * F.col("s") / n, F.col(b) - F.col("s") * F.col("s") / n
    msw = (F.col("q") - F.col(b)) / (n - k)
    return F.when((n >= 4) & (k >= 2) & (n - k >= 1) & (total > 0), F.sqrt(F.greatest(F.lit(0.0), (between - (k - 1) * msw) / total)))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row n, v: bias-corrected, null below four rows or two levels. Only the table of counts is ever regrouped."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("o"))
    ra, rb = cells.groupBy("a").agg(F.sum("o").alias("na")), cells.groupBy("b").agg(F.sum("o").alias("nb"))
    joined = cells.join(ra, "a").join(rb, "b")
    one = joined.agg(F.sum("o").alias("n"), F.sum(F.col("o") * F.col("o") / (F.col("na") * F.col("nb"))).alias("q"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("k"))
    return one.select(F.col("n").cast("long").alias("n"), _corrected_v().alias("v"))


def correlation_ratio(df: DataFrame, category: str, number: str) -> DataFrame:
    """One row n, eta: corrected for the number of classes."""
    x = F.col(number).cast("double")
    by = df.where(F.col(category).isNotNull() & x.isNotNull()).groupBy(category).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"))
    t = by.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    return t.select(F.col("n").cast("long").alias("n"), _corrected_eta("b").alias("eta"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row n, mi (nats), entropy_a, entropy_b, normalised (by b's entropy) of two discrete columns, over the rows that have both."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("o"))
    ra, rb = cells.groupBy("a").agg(F.sum("o").alias("na")), cells.groupBy("b").agg(F.sum("o").alias("nb"))
    n = cells.agg(F.sum("o").alias("n"))
    joined = cells.join(ra, "a").join(rb, "b").join(F.broadcast(n), how="cross")
    mi = joined.agg(F.max("n").alias("n"), F.sum(F.col("o") / F.col("n") * F.log(F.col("o") * F.col("n") / (F.col("na") * F.col("nb")))).alias("mi"))
    ent = lambda t, c: t.join(F.broadcast(n), how="cross").agg((-F.sum(F.col(c) / F.col("n") * F.log(F.col(c) / F.col("n")))).alias(f"entropy_{c[1]}"))
    out = mi.join(F.broadcast(ent(ra, "na")), how="cross").join(F.broadcast(ent(rb, "nb")), how="cross")
    return out.select(F.col("n").cast("long").alias("n"), "mi", "entropy_a", "entropy_b", F.coalesce(F.try_divide("mi", "entropy_b"), F.lit(0.0)).alias("normalised"))


def discretise(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """The column as the number of its quantile bin; the documented stand-in for a neighbour-based estimate of mutual information."""
    from sparkprep.operators.encode import bin_codes, fit_bins

    return bin_codes(df, column, fit_bins(df, column, bins)).withColumn(column, F.when(F.col(column).isNotNull(), F.col(f"{column}_bin"))).drop(f"{column}_bin")


def single_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row auc: the chance that a positive's value is above a negative's, ties half; from counts by value in a global order."""
    from sparkprep.functions.tables import global_running

    counted = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(label).cast("double")).alias("p"))
    run = global_running(counted, [F.col("s")], {"upto": F.col("n") - F.col("p")})
    t = run.agg(F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"), F.sum(F.col("p") * (F.col("upto") - (F.col("n") - F.col("p")) / 2)).alias("u"))
    return t.select(F.try_divide(F.col("u"), F.col("p") * F.col("q")).alias("auc"))


def _one(df: DataFrame, column: str) -> float | None:
    row = df.first()
    return None if row is None or row[column] is None or row[column] != row[column] else float(row[column])


def target_associations(df: DataFrame, target: str, columns: Iterable[str] | None = None, task: str = "classification", min_rows: int = 20, bins: int = 20) -> list[dict]:
    """column, method, score, coefficients of each feature against the target; the strongest measure is the score.

    All features go through the same few jobs, however many there are: counts by value for their levels and
    bin edges, one long table of (feature, level or bin, class) with counts and sums for the measures made of cells, and counts
    by (feature, value) in one global order for AUC or ranks. The rows are dealt over the cores and written once, as each job goes over them.
    A row a feature comes to the driver.
    """
    names = list(dict.fromkeys(c for c in known(df, columns) if c != target))
    if not names:
        return []
    df = spread(df.select(*names, target))
    numbers, whole = set(numeric_columns(df)), df.where(F.col(target).isNotNull())
    classes = task == "classification"
    by_value = durable(value_counts(_numbers(df, [c for c in [*names, target] if c in numbers]), [*names, target]))
    levels = {r["column"]: r for r in column_counts(df, [*names, target], counts=by_value).collect()}
    few = [c for c in names if c not in numbers and levels[c]["n_distinct"] <= max(20, 0.1 * levels[c]["n_rows"])]
    numeric = [c for c in names if c in numbers] if classes or target in numbers else []
    edges: dict[str, set] = {c: set() for c in [*numeric, *([] if classes else [target])]}
    for r in _quantile_rows(by_value.where(F.col("column").isin(list(edges))), [k / bins for k in range(bins + 1)]).collect():
        edges[r["column"]].add(r["q"])

    def binned(c: str) -> Column:
        inner = sorted(edges[c])[1:-1]
        return reduce(add, [(F.lit(e) <= F.col(c)).cast("int") for e in inner]).cast("string") if inner else F.when(F.col(c).isNotNull(), F.lit("0"))

    nothing, y = F.lit(None).cast("double"), F.col(target).cast("string") if classes else binned(target) if target in numbers else F.lit(None).cast("string")
    t = nothing if classes else F.col(target).cast("double")
    cells = [F.struct(F.lit(c).alias("f"), F.when(F.col(c).isNotNull(), binned(c) if c in numbers else F.col(c).cast("string")).alias("a"), (F.col(c).cast("double") if c in numbers else nothing).alias("x")) for c in [*numeric, *few]]
    if not cells:
        return []
    long = whole.select(y.alias("b"), t.alias("t"), F.explode(F.array(*cells)).alias("c")).select("c.*", "b", "t").where("a IS NOT NULL")
    values = [F.struct(F.lit(c).alias("f"), F.col(c).cast("double").alias("x")) for c in numeric]
    one = durable(long.groupBy("f", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("o"), *[v for k in "xt" for v in (F.sum(k).alias(f"s{k}"), F.sum(F.col(k) * F.col(k)).alias(f"q{k}"))]))
    sums = [F.sum("o").alias("o"), *[F.sum(f"{m}{k}").alias(f"{m}{k}") for k in "xt" for m in "sq"]]
    ra, rb = durable(one.groupBy("f", "a").agg(*sums)), durable(one.groupBy("f", "b").agg(*sums))
    n = rb.groupBy("f").agg(F.sum("o").alias("n"))  # a row a feature
    joined = one.select("f", "a", "b", "o").join(ra.select("f", "a", F.col("o").alias("na")), ["f", "a"]).join(rb.select("f", "b", F.col("o").alias("nb")), ["f", "b"]).join(n, "f")
    together = joined.groupBy("f").agg(
        F.max("n").alias("n"), F.sum(F.col("o") / F.col("n") * F.log(F.col("o") * F.col("n") / (F.col("na") * F.col("nb")))).alias("mi"),
        F.sum(F.col("o") * F.col("o") / (F.col("na") * F.col("nb"))).alias("q"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("k"),
    )
    entropy = rb.join(n, "f").groupBy("f").agg((-F.sum(F.col("o") / F.col("n") * F.log(F.col("o") / F.col("n")))).alias("entropy"))
    got = {r["f"]: r.asDict() for r in together.withColumn("v", _corrected_v()).join(entropy, "f").collect()}
    # the number's spread between classes, or the target's between levels
    within = (rb if classes else ra).select("f", F.col("o").alias("n"), F.col("sx" if classes else "st").alias("s"), F.col("qx" if classes else "qt").alias("q"))
    within = within.groupBy("f").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b2"))
    eta = {r["f"]: r["eta"] for r in within.select("f", _corrected_eta("b2").alias("eta")).collect()}
    ranked: dict[str, float | None] = {}
    linear: dict[str, float | None] = {}
    if classes and numeric:
        kinds = [r[0] for r in whole.select(target).distinct().orderBy(target).limit(3).collect()]
        if len(kinds) == 2:
            positive = y == F.lit(str(kinds[1])) if isinstance(kinds[1], str) else y == F.lit(kinds[1]).cast("string")
            ranked = _aucs(whole.select(positive.alias("p"), F.explode(F.array(*values)).alias("c")).where("c.x IS NOT NULL").select("c.f", F.col("c.x").alias("s"), "p"))
    elif numeric:
        pairs = whole.select(t.alias("t"), F.explode(F.array(*values)).alias("c")).where("c.x IS NOT NULL").select("c.*", "t")
        linear = {r["f"]: r["r"] for r in pairs.groupBy("f").agg(F.when(F.count(F.lit(1)) >= 8, correlation(F.col("x"), F.col("t"))).alias("r")).collect()}
        ranked = _rank_correlations(whole, target, {c: int(got[c]["n"]) for c in numeric if c in got}, levels[target]["n_rows"] - levels[target]["n_missing"])
    found = []
    for c, g in got.items():
        if g["n"] < min_rows:
            continue
        normalised = g["mi"] / g["entropy"] if g["entropy"] else 0.0
        if classes and c in numbers:
            auc = ranked.get(c)
            measures = {"mutual_information": normalised, "eta": eta[c], "auc": None if auc is None else 2 * abs(auc - 0.5)}
        elif classes:
            measures = {"mutual_information": normalised, "cramers_v": g["v"]}
        elif c in numbers:
            r, rho = linear.get(c), ranked.get(c)
            measures = {"pearson": None if r is None else abs(r), "spearman": None if rho is None else abs(rho), "mutual_information": (1 - math.exp(-2 * g["mi"])) ** 0.5 if g["mi"] > 0 else 0.0}
        else:
            measures = {"eta": eta[c]}
        kept = {k: v for k, v in measures.items() if v is not None and v == v}
        if kept:
            best = max(sorted(kept), key=kept.get)
            found.append({"column": c, "method": best, "score": kept[best], "coefficients": kept})
    return sorted(found, key=lambda x: (-x["score"], x["column"]))


def _aucs(long: DataFrame) -> dict[str, float | None]:
    """Feature -> AUC from rows of (f, s, p): counts by (feature, value) in one global order."""
    counted = long.groupBy("f", "s").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("p").cast("double")).alias("p"))
    run = global_running(counted, [F.col("f"), F.col("s")], {"upto": F.col("n") - F.col("p")})
    negatives = F.col("n") - F.col("p")
    one = run.groupBy("f").agg(F.sum("p").alias("p"), F.sum(negatives).alias("q"), F.min(F.col("upto") - negatives).alias("before"), F.sum(F.col("p") * (F.col("upto") - negatives / 2)).alias("u"))
    return {r["f"]: r["auc"] for r in one.select("f", F.try_divide(F.col("u") - F.col("before") * F.col("p"), F.col("p") * F.col("q")).alias("auc")).collect()}


def _rank_correlations(whole: DataFrame, target: str, counts: dict[str, int], n: int) -> dict[str, float | None]:
    """Feature -> Pearson's r of the average ranks of feature and target among the rows that have both. ``counts`` says how many these are, ``n`` how many rows there are; all have a target.

    The target's values run up once in a global order, with a count for all features without holes and one for each with, so a row meets its target's ranks in one join.
    A feature's part then is made of its values, how many rows each has and the sum of these rows' ranks, in one global order of (feature, value): no row is joined with its feature's rank.
    """
    names, t = list(counts), F.col(target).cast("double")
    if not names:
        return {}
    held = {f"n{k}": F.count_if(F.col(c).isNotNull()) for k, c in enumerate(names) if counts[c] < n} | {"n": F.count(F.lit(1))}
    size = {m: counts[names[int(m[1:])]] if m != "n" else n for m in held}
    by_target = whole.groupBy(t.alias("_t")).agg(*[v.alias(m) for m, v in held.items()])
    run = global_running(by_target, [F.col("_t")], {f"u{m}": F.col(m) for m in held})
    # the ranks of all rows have half their number as their mean
    centred = lambda m: F.col(f"u{m}") - (F.col(m) + F.lit(size[m])) / 2
    rows = whole.select(t.alias("t"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(names)]).join(run.select("_t", *[centred(m).alias(f"r{m}") for m in held]), F.col("t") == F.col("_t"))
    cells = [F.struct(F.lit(k).alias("k"), F.col(f"x{k}").alias("x"), F.col(f"rn{k}" if f"n{k}" in held else "rn").alias("r")) for k in range(len(names))]
    counted = rows.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("x IS NOT NULL").groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"))
    middle = F.get(F.array(*[F.lit(sum(counts[c] for c in names[:k]) + counts[name] / 2) for k, name in enumerate(names)]), F.col("k"))
    rank = F.col("upto") - F.col("n") / 2 - middle
    both = global_running(counted, [F.col("k"), F.col("x")], {"upto": F.col("n")}).select("k", "n", "s", "q", rank.alias("rank")).groupBy("k")
    both = both.agg(F.try_divide(F.sum(F.col("rank") * F.col("s")), F.sqrt(F.sum(F.col("n") * F.col("rank") * F.col("rank"))) * F.sqrt(F.sum("q"))).alias("rho"))
    return {names[r["k"]]: r["rho"] for r in both.collect()}


def _counts(df: DataFrame, columns: list[str]) -> DataFrame:
    from sparkprep.operators.profile import column_counts

    return column_counts(df, columns)


def exact_copies(df: DataFrame, target: str, columns: Iterable[str] | None = None, tolerance: float = 1e-9) -> list[str]:
    """Columns equal to the target in every row."""
    names = [c for c in known(df, columns) if c != target]
    numbers = numeric_columns(df)
    same = [F.bool_and(F.coalesce(F.abs(F.col(c) - F.col(target)) <= tolerance, F.col(c).isNull() & F.col(target).isNull()) if c in numbers and target in numbers else F.col(c).cast("string").eqNullSafe(F.col(target).cast("string"))) for c in names]
    row = df.agg(*[x.alias(f"s{i}") for i, x in enumerate(same)]).first() if names else []
    return [c for c, s in zip(names, row, strict=True) if s]


SEVERITIES = ("low", "medium", "high", "critical")


def leakage_findings(df: DataFrame, target: str, associations: list[dict], columns: Iterable[str] | None = None) -> DataFrame:
    """column, severity, reason, score: one row a column, the worst finding of each."""
    from sparkprep.functions.text import name_hints

    worst: dict[str, tuple[str, str, float]] = {}

    def note(column: str, severity: str, reason: str, score: float) -> None:
        if column not in worst or SEVERITIES.index(severity) > SEVERITIES.index(worst[column][0]):
            worst[column] = (severity, reason, score)

    for c in exact_copies(df, target, columns):
        note(c, "critical", "equal to the target", 1.0)
    for a in associations:
        c, s = a["column"], a["score"]
        for least, severity in ((0.995, "critical"), (0.97, "high"), (0.90, "medium")):
            if s >= least:
                note(c, severity, f"{a['method']} with the target", s)
                break
        rho = abs(a["coefficients"].get("spearman") or 0)
        if rho >= 0.9995:
            note(c, "critical", "monotone in the target", rho)
        if "post_outcome" in name_hints(c) and s >= 0.60:
            note(c, "high", "named like an outcome", s)
        if "identifier" in name_hints(c) and s >= 0.90:
            note(c, "high", "an identifier that tells the target", s)
    rows = [(c, *v) for c, v in sorted(worst.items())]
    return df.sparkSession.createDataFrame(rows, "column string, severity string, reason string, score double")


def correlation_report(df: DataFrame, columns: Iterable[str] | None = None, top: int = 40, max_categories: int = 30, max_levels: int = 50, collinear: float = 0.95) -> DataFrame:
    """a, b, method, value, collinear of the strongest pairs: Pearson, Spearman where it differs by 0.10, Cramér's V, correlation ratio."""
    from sparkprep.functions.tables import string_columns

    names = known(df, columns)
    numbers, texts = [c for c in names if c in numeric_columns(df)], [c for c in names if c in string_columns(df)]
    rows: list[tuple] = []
    if len(numbers) > 1:
        rho = {(r["a"], r["b"]): r["rho"] for r in spearman_pairs(df, numbers).collect()}  # a row a pair
        for r in pearson_pairs(df, numbers).where("r is not null").collect():
            rows.append((r["a"], r["b"], "pearson", r["r"]))
            other = rho.get((r["a"], r["b"]))
            if other is not None and other == other and abs(abs(other) - abs(r["r"])) >= 0.10:
                rows.append((r["a"], r["b"], "spearman", other))
    if texts:
        few = [r["column"] for r in _counts(df, texts).where(F.col("n_distinct") <= max_levels).orderBy("column").collect()][:max_categories]
        rows += [(r["a"], r["b"], "cramers_v", r["v"]) for r in cramers_v_pairs(df, few).where("v is not null").collect()]
        rows += [(r["a"], r["b"], "eta", r["eta"]) for r in correlation_ratio_pairs(df, few, numbers).where("eta is not null").collect()]
    out = df.sparkSession.createDataFrame(rows, "a string, b string, method string, value double")
    return out.withColumn("collinear", F.col("method").isin("pearson", "spearman") & (F.round(F.abs("value"), 2) >= collinear)).orderBy(F.desc(F.abs("value")), "a", "b", "method").limit(top)


def target_report(spark, associations: list[dict], target: str, top: int = 60) -> DataFrame:  # noqa: ANN001
    """a, b, method, value of the target's associations, Spearman only where it differs from Pearson by 0.10."""
    rows = []
    for a in associations:
        have = a["coefficients"]
        for method, value in have.items():
            if method != "spearman" or abs(value - (have.get("pearson") or 0)) >= 0.10:
                rows.append((a["column"], target, method, float(value)))
    return spark.createDataFrame(rows, "a string, b string, method string, value double").orderBy(F.desc(F.abs("value")), "a", "method").limit(top)


def name_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of names."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def drop_correlated(pairs: list[dict], strength: dict[str, float], threshold: float = 0.95) -> list[str]:
    """Of each collinear pair the member less correlated with the target; the left one stays on a tie."""
    gone: list[str] = []
    for p in sorted(pairs, key=lambda p: (-abs(p["r"]), p["a"], p["b"])):
        if abs(p["r"]) >= threshold and p["a"] not in gone and p["b"] not in gone:
            gone.append(p["b"] if strength.get(p["a"], 0.0) >= strength.get(p["b"], 0.0) else p["a"])
    return gone
