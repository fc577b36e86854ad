"""Data-quality findings, recommendations and task rules, on profile rows. A profile has a row a column, so these are small tables whatever the data's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.tables import TIMES, numeric_columns, string_columns
from sparkprep.functions.text import vocabulary_of
from sparkprep.operators import profile as P


def _findings(df: DataFrame, rules: list[tuple]) -> DataFrame:
    """code, severity, column, value of the rules that hold; a rule is (code, severity column, condition, value)."""
    cells = F.array(*[F.struct(F.lit(code).alias("code"), severity.alias("severity"), cond.alias("hit"), value.cast("double").alias("value")) for code, severity, cond, value in rules])
    return df.select("column", F.explode(cells).alias("r")).where("r.hit").select(F.col("r.code").alias("code"), F.col("r.severity").alias("severity"), "column", F.col("r.value").alias("value"))


def quality_findings(df: DataFrame, target: str | None = None, time: str | None = None) -> DataFrame:
    """code, severity, column, value. One row a finding; table-wide findings have a null column."""
    names = df.columns
    counts = P.column_counts(df, names)
    low, med, high, crit = (F.lit(x) for x in ("low", "medium", "high", "critical"))
    miss, card, distinct, n = F.col("missing_fraction"), F.col("cardinality_ratio"), F.col("n_distinct"), F.col("n_rows")
    texts, numbers = string_columns(df), numeric_columns(df)
    is_text = F.col("column").isin(*texts) if texts else F.lit(False)
    rules = [
        ("all_missing_column", high, (miss >= 1) & (n > 0), miss),
        ("high_missingness", F.when(miss >= 0.9, crit).when(miss >= 0.5, high).when(miss >= 0.2, med).otherwise(low), (miss >= 0.05) & (miss < 1), miss),
        ("constant_column", med, F.col("is_constant") & (miss < 1), distinct),
        ("high_cardinality_categorical", med, is_text & (distinct >= 50) & (card < 0.95), distinct),
        ("identifier_column", low, (card >= 0.999) & (n >= 20) & is_text, card),
    ]
    out = _findings(counts, rules)
    if numbers:
        m = P.moments(df, numbers).join(P.iqr_outliers(df, numbers), "column")
        skew = F.abs("skew")
        out = out.unionByName(_findings(m, [("skewed_numeric", F.when(skew >= 5, med).otherwise(low), skew >= 2, F.col("skew")), ("outlier_heavy", med, F.col("outlier_fraction") >= 0.10, F.col("outlier_fraction"))]))
        near = P.near_zero_variance(df, numbers).join(counts.select("column", "is_constant"), "column")
        out = out.unionByName(_findings(near, [("near_zero_variance", low, F.col("near_zero_variance") & ~F.col("is_constant"), F.coalesce("frequency_ratio", F.lit(0.0)))]))
        if len(numbers) > 1:
            from sparkprep.operators.associate import pearson_pairs

            pairs = pearson_pairs(df, numbers).where(F.round(F.abs("r"), 2) >= 0.95).select(F.lit("collinear_features").alias("code"), low.alias("severity"), F.concat_ws(",", "a", "b").alias("column"), F.col("r").alias("value"))
            out = out.unionByName(pairs)
    if texts:
        s = P.string_statistics(df, texts).join(counts, "column").join(P.number_text(df, texts).select("column", "n_numeric", "numeric_fraction", "mixed", "stored_as_text"), "column")
        out = out.unionByName(_findings(s, [
            ("numeric_stored_as_text", med, F.col("stored_as_text"), F.col("numeric_fraction")), ("mixed_types", med, F.col("mixed") & ~F.col("stored_as_text"), F.col("numeric_fraction")),
            ("blank_strings", low, F.try_divide(F.col("n_blank"), n) >= 0.01, F.col("n_blank")), ("untrimmed_strings", low, F.try_divide(F.col("n_untrimmed"), n) >= 0.01, F.col("n_untrimmed")),
        ]))
    over = P.table_overview(df).withColumn("column", F.lit(None).cast("string"))
    dup = F.try_divide(F.col("n_duplicates"), n)
    out = out.unionByName(_findings(over, [
        ("duplicate_rows", F.when(dup >= 0.20, high).when(dup >= 0.05, med).otherwise(low), F.col("n_duplicates") > 0, dup), ("tiny_dataset", high, n < 50, n), ("small_dataset", med, (n >= 50) & (n < 200), n),
        ("more_features_than_rows", high, F.col("n_columns") >= n, F.col("n_columns")), ("wide_dataset", med, (F.col("n_columns") > 0.5 * n) & (F.col("n_columns") < n), F.col("n_columns")), ("missing_cells", low, F.col("missing_fraction") >= 0.05, F.col("missing_fraction")),
    ]))
    if target:
        t = P.class_counts(df, target, max_classes=1_000_000).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"), F.max("imbalance").alias("imbalance"))
        t = t.join(counts.where(F.col("column") == target).select("column", "n_missing"), how="cross")
        few = F.col("k") <= 50
        out = out.unionByName(_findings(t, [
            ("target_missing_values", high, F.col("n_missing") > 0, F.col("n_missing")), ("target_constant", crit, F.col("k") <= 1, F.col("k")), ("target_single_row_class", high, few & (F.col("least") == 1), F.col("least")),
            ("target_rare_class", med, few & (F.col("least") > 1) & (F.col("least") < 10), F.col("least")), ("target_imbalanced", F.when(F.col("imbalance") > 10, high).otherwise(med), few & (F.col("imbalance") > 3), F.col("imbalance")),
        ]))
    if time:
        g = P.temporal_statistics(df, time).withColumn("column", F.lit(time))
        out = out.unionByName(_findings(g, [("datetime_gaps", low, F.col("n_gaps") > 0, F.col("n_gaps"))]))
    return out


def infer_task(df: DataFrame, target: str | None) -> dict:
    """task, metric, positive class: none is clustering, a continuous target regression, two classes binary, up to fifty multiclass."""
    from sparkprep.operators.metrics import DEFAULTS

    if target is None:
        return {"task": "clustering", "metric": DEFAULTS["clustering"], "positive": None}
    levels = P.class_counts(df, target, max_classes=51).collect()
    fractional = target in numeric_columns(df) and df.where(F.col(target) != F.floor(F.col(target))).limit(1).count() > 0
    if len(levels) > 50 or fractional and len(levels) > 2 or target in numeric_columns(df) and len(levels) > 20:
        return {"task": "regression", "metric": DEFAULTS["regression"], "positive": None}
    if len(levels) <= 2:
        return {"task": "binary", "metric": DEFAULTS["binary"], "positive": levels[-1]["label"] if levels else None}
    return {"task": "multiclass", "metric": DEFAULTS["multiclass"], "positive": None}


def recommend_cleaning(df: DataFrame, target: str | None = None, leaks: tuple[str, ...] = ()) -> list[dict]:
    """Decisions for the cleaning plan from the profile."""
    counts = {r["column"]: r for r in P.column_counts(df).collect()}
    numbers, texts = numeric_columns(df), string_columns(df)
    shape = {r["column"]: r for r in P.moments(df, numbers).collect()} if numbers else {}
    out = {r["column"]: r for r in P.iqr_outliers(df, numbers).collect()} if numbers else {}
    found = [{"action": "drop_duplicate_rows", "columns": []}] if P.table_overview(df).first()["n_duplicates"] else []
    if target:
        found.append({"action": "drop_rows_missing_target", "columns": [target]})
    for c, r in counts.items():
        if c == target:
            continue
        if c in leaks:
            found.append({"action": "drop_leakage_column", "columns": [c]})
        elif r["is_constant"]:
            found.append({"action": "drop_constant_column", "columns": [c]})
        elif r["missing_fraction"] >= 0.60:
            found.append({"action": "impute_missing", "columns": [c], "strategy": "drop_column"})
        elif r["n_missing"]:
            if c in numbers:
                strategy = "median" if abs(shape[c]["skew"] or 0) > 1 else "mean"
            elif c in texts:
                strategy = "missing_category" if r["n_distinct"] > 15 or r["missing_fraction"] > 0.15 else "mode"
            else:
                strategy = "forward_fill"
            # a time without an order of its own is filled along an identifier, else along all other columns
            order = [x for x, y in counts.items() if x != c and y["cardinality_ratio"] >= 0.999 and not y["n_missing"]][:1] or [x for x in df.columns if x != c]
            found.append({"action": "impute_missing", "columns": [c], "strategy": strategy} | ({"order": order} if strategy == "forward_fill" else {}))
        if c in out and (out[c]["outlier_fraction"] or 0) > 0.02 and not r["is_constant"] and c not in leaks:
            found.append({"action": "clip_outliers", "columns": [c]})
    return found


def recommend_features(df: DataFrame, target: str | None = None, task: str = "binary") -> list[dict]:
    """Decisions for the feature plan from the profile."""
    counts = {r["column"]: r for r in P.column_counts(df).collect()}
    numbers, texts = [c for c in numeric_columns(df) if c != target], [c for c in string_columns(df) if c != target]
    shape = {r["column"]: r for r in P.moments(df, numbers).collect()} if numbers else {}
    outs = {r["column"]: r for r in P.iqr_outliers(df, numbers).collect()} if numbers else {}
    words = {r["column"]: r for r in P.string_statistics(df, texts).collect()} if texts else {}
    found: list[dict] = []
    for f in df.schema:
        c, r = f.name, counts[f.name]
        if c == target or r["is_constant"]:
            continue
        if isinstance(f.dataType, TIMES):
            found += [{"op": "date_decompose", "columns": [c]}, {"op": "cyclical_encode", "columns": [c], "part": "month"}]
        elif c in numbers:
            if (shape[c]["skew"] or 0) > 1.5 and (shape[c]["minimum"] or 0) >= 0:
                found.append({"op": "log_transform", "columns": [c]})
            found.append({"op": "robust_scale" if (outs[c]["outlier_fraction"] or 0) > 0.02 else "standard_scale", "columns": [c]})
        elif c in texts:
            if (words[c]["mean_tokens"] or 0) >= 5 and r["cardinality_ratio"] > 0.5:
                found += [{"op": "text_length", "columns": [c]}, {"op": "tfidf", "columns": [c], "ngram_max": 2}]
            elif r["cardinality_ratio"] >= 0.95:
                continue
            elif r["n_distinct"] <= 64 and (scale := vocabulary_of(df, c))[0] == "ordinal":
                found.append({"op": "ordinal_encode", "columns": [c], "order": scale[1]})
            elif r["n_distinct"] <= 15:
                found.append({"op": "one_hot_encode", "columns": [c]})
            else:
                found.append({"op": "frequency_encode" if task == "multiclass" or target not in numeric_columns(df) else "target_encode", "columns": [c]})
    if len(numbers) > 1:
        found.append({"op": "drop_correlated", "columns": numbers, "threshold": 0.95})
    return found


def shortlist_models(task: str, n_rows: int, n_features: int, imbalanced: bool = False) -> list[dict]:
    """Candidates in order, the baseline first."""
    out = [{"family": "baseline"}]
    if task in ("binary", "multiclass"):
        out += [{"family": "logistic", "weighted": imbalanced}, {"family": "random_forest"}, {"family": "gradient_boosting"}]
        out += [{"family": "naive_bayes"}] if n_rows < 2000 else []
    elif task == "regression":
        out += [{"family": "ridge"}, {"family": "random_forest"}, {"family": "gradient_boosting"}]
        out += [{"family": "lasso"}] if n_features > 30 else []
    elif task == "clustering":
        out = [{"family": "kmeans"}, {"family": "gaussian_mixture"}, {"family": "dbscan"}]
    elif task == "anomaly":
        out = [{"family": "isolation_forest"}, {"family": "local_outlier_factor"}]
    else:
        out = [{"family": "seasonal_naive"}, {"family": "exponential_smoothing"}, {"family": "theta"}]
    return out


def grade(score: float, baseline: float, metric: str) -> str:
    """A to F: bounded scores by height, others by their gain over the baseline; no better than the baseline is F."""
    from sparkprep.operators.metrics import LOWER_IS_BETTER, better, metric_name

    name = metric_name(metric)
    if not better(name, score, baseline):
        return "F"
    if name in LOWER_IS_BETTER:
        gain = (baseline - score) / max(abs(baseline), 1e-12)
        return "A" if gain >= 0.40 else "B" if gain >= 0.25 else "C" if gain >= 0.10 else "D"
    return "A" if score >= 0.9 else "B" if score >= 0.8 else "C" if score >= 0.7 else "D" if score >= 0.6 else "F"
