"""Plans: decisions as data, fitted once on training rows, replayed frozen on batches and streams.

Each decision is a dict. Cleaning runs in one fixed safe order whatever the order of
the request; a step that fails is noted and the rest go on. What was fitted is a
JSON-able list of narrow steps, so replay is a chain of expressions (and joins with
mappings), the same for a batch and for a stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkprep.functions import scalar as S
from sparkprep.functions.tables import TIMES, allocate, global_running, numeric_columns, written
from sparkprep.operators import clean as C
from sparkprep.operators import encode as E

#: Levels that a frozen mapping holds itself; a larger one is a table in the shared folder, and below the model's own path when that is saved.
MOST_FROZEN = 10_000
#: A decision that does not fit the data or names what there is not; a failing job or a fault of the code is none and is raised.
IMPOSSIBLE = (ValueError, KeyError, IndexError, AnalysisException)
#: The safe order of cleaning actions.
ORDER = {
    "drop_constant_column": 0, "drop_leakage_column": 1, "drop_column": 2, "drop_duplicate_rows": 5, "drop_rows_missing_target": 6, "strip_whitespace": 10, "normalise_categories": 11, "parse_datetime": 20, "cast_dtype": 21,
    "impute_missing": 30, "clip_outliers": 40, "remove_outlier_rows": 50,
}


def coerce(value: object) -> object:
    """A parameter written as text: empty, null and none are None, true and false are booleans, else JSON, else the text."""
    if not isinstance(value, str):
        return value
    low = value.strip().lower()
    if low in ("", "null", "none"):
        return None
    if low in ("true", "false"):
        return low == "true"
    try:
        return json.loads(value)
    except ValueError:
        return value


def clean(df: DataFrame, decisions: Iterable[dict], target: str | None = None) -> tuple[DataFrame, list[dict], list[str]]:
    """(cleaned, frozen steps, notes). Row-dropping steps are not among the frozen steps: new rows are all scored."""
    frozen: list[dict] = []
    notes: list[str] = []
    for d in sorted(decisions, key=lambda d: ORDER.get(d["action"], 99)):
        p = {k: coerce(v) for k, v in d.items() if k not in ("action", "columns", "order", "group")} | {k: d[k] for k in ("order", "group") if k in d}
        columns = [c for c in d.get("columns") or [] if c in df.columns]
        missing = [c for c in d.get("columns") or [] if c not in df.columns]
        notes += [f"{d['action']}: no column {c}" for c in missing]
        if d.get("columns") and not columns:
            continue
        try:
            df = _clean_step(df, d["action"], columns, p, target, frozen)
        except IMPOSSIBLE as error:  # such a step does not end the plan
            notes.append(f"{d['action']} skipped: {str(error)[:120]}")
    return df, frozen, notes


def _clean_step(df: DataFrame, action: str, columns: list[str], p: dict, target: str | None, frozen: list[dict]) -> DataFrame:
    if action in ("drop_column", "drop_constant_column", "drop_leakage_column"):
        names = [c for c in columns if c != target]
        frozen.append({"do": "drop", "columns": names})
        return C.drop_columns(df, names, target)
    if action == "drop_duplicate_rows":
        return C.drop_duplicates(df, columns or None, p.get("keep", "first"))
    if action == "drop_rows_missing_target":
        return C.drop_rows_missing_target(df, target or columns[0])
    if action == "strip_whitespace":
        frozen.append({"do": "strip", "columns": columns})
        return C.strip_whitespace(df, columns or None)
    if action == "normalise_categories":
        frozen.append({"do": "normalise", "columns": columns, "mapping": p.get("mapping")})
        return C.normalise_categories(df, columns, mapping=p.get("mapping"))
    if action == "parse_datetime":
        how = {"format": p.get("format"), "unit": p.get("unit"), "dayfirst": bool(p.get("dayfirst"))}
        parsing = C.parsing_columns(df, columns, **how)  # the others are left as they are, here and in replays
        frozen.append({"do": "parse", "columns": parsing, **how})
        return C.apply_datetime(df, parsing, **how)
    if action == "cast_dtype":
        frozen.append({"do": "cast", "types": {c: p.get("dtype", "string") for c in columns}})
        return C.cast_types(df, {c: p.get("dtype", "string") for c in columns})[0]
    if action == "clip_outliers":
        bounds = {c: (p["lower"], p["upper"]) for c in columns} if p.get("lower") is not None and p.get("upper") is not None else None
        out, used = C.clip_outliers(df, columns, p.get("iqr_multiplier", p.get("k", 1.5)), bounds, target)
        frozen.append({"do": "clip", "bounds": {c: list(b) for c, b in used.items()}})
        return out
    if action == "remove_outlier_rows":
        return C.remove_outlier_rows(df, columns, p.get("iqr_multiplier", p.get("k", 1.5)), target=target)
    if action == "impute_missing":
        strategy = p.get("strategy", "auto")
        names = [c for c in columns if c != target]
        if strategy == "drop_column":
            frozen.append({"do": "drop", "columns": names})
            return C.drop_columns(df, names, target)
        if strategy == "drop_rows":
            return C.drop_rows_missing(df, names)
        if strategy == "leave_as_is":
            return df
        if strategy in ("forward_fill", "backward_fill", "interpolate"):
            order, group = p.get("order") or [c for c in df.columns if c not in names and c != FOLD], p.get("group") or []
            out = C.interpolate(df, names, order, group) if strategy == "interpolate" else C.directional_fill(df, names, order, group, strategy == "backward_fill", p.get("limit"))
            frozen.append({"do": "fill", "fills": C.fit_fills(df, names, "auto")})  # a new row has no neighbours: it gets the median or mode
            return out
        if strategy in ("knn", "iterative"):
            out = C.knn_impute(df, names, p["key"], int(p.get("n_neighbors", 5))) if strategy == "knn" else C.iterative_impute(df, names, int(p.get("max_iter", 10)))
            frozen.append({"do": "fill", "fills": C.fit_fills(df, names, "auto")})
            return out
        out, fills = C.impute(df, names, strategy, p.get("fill_value"), target)
        frozen.append({"do": "fill", "fills": fills})
        return out
    raise ValueError(f"no such action: {action}")


def replay(df: DataFrame, frozen: Iterable[dict]) -> DataFrame:
    """The frozen steps on new rows; a column that a fill or bound needs and that is not there is an error."""
    for step in frozen:
        do = step["do"]
        needs = {"fill": step.get("fills"), "clip": step.get("bounds")}.get(do) or {}
        lost = [c for c in needs if c not in df.columns]
        if lost:
            raise ValueError(f"missing columns: {', '.join(lost)}")
        if do == "drop":
            df = df.drop(*step["columns"])
        elif do == "strip":
            df = C.strip_whitespace(df, step["columns"] or None)
        elif do == "normalise":
            df = C.normalise_categories(df, step["columns"], mapping=step.get("mapping"))
        elif do == "parse":
            df = C.apply_datetime(df, step["columns"], step["format"], step["unit"], step["dayfirst"])
        elif do == "cast":
            df = df.withColumns({c: F.col(c).try_cast(C.TYPE_NAMES.get(t, t)) for c, t in step["types"].items() if c in df.columns})
        elif do == "clip":
            df = C.clip_outliers(df, step["bounds"], bounds={c: tuple(b) for c, b in step["bounds"].items()})[0]
        elif do == "fill":
            df = C.apply_fills(df, step["fills"])
    return df


#: Features made of several columns together.
TOGETHER = ("ratio", "interaction", "polynomial", "geo_distance")
#: What is done with all features when they are made, in this order.
POST = ("variance_threshold", "drop_correlated", "select_k_best", "pca", "truncated_svd")
#: Most feature columns of a plan.
MOST_FEATURES = 600
#: The column that tells a training row's fold while a plan is fitted. No other rows have folds.
FOLD = "_plan_fold"
FOLDS = 5


def with_fold(df: DataFrame, target: str | None) -> DataFrame:
    """A training row's fold by a digest of all it holds, so that equal rows share one; -1 for a row without the target."""
    if not target or target not in df.columns:
        return df.withColumn(FOLD, F.lit(-1))
    return df.withColumn(FOLD, F.when(F.col(target).isNull(), -1).otherwise(F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in sorted(df.columns)]), F.lit(FOLDS))).cast("int"))


def fit_features(train: DataFrame, decisions: Iterable[dict], target: str | None = None) -> tuple[list[dict], list[str]]:
    """(frozen feature steps, notes). Statistics come from training rows only.

    First the columns' features, then what is done with all of them: variance, collinear pairs, the k
    best, principal components, truncated singular vectors. At most MOST_FEATURES columns are made.
    """
    frozen: list[dict] = []
    notes: list[str] = []
    decisions = list(decisions)
    if FOLD not in train.columns:
        train = with_fold(train, target)
    for d in decisions:
        columns = [c for c in d.get("columns", []) if c in train.columns and c != target]
        for group in [columns] if d["op"] in TOGETHER else [[c] for c in columns]:
            if not group or d["op"] in POST:
                continue
            try:
                frozen.append(_fit_together(train, d, group) if d["op"] in TOGETHER else _fit_feature(train, d, group[0], target))
            except IMPOSSIBLE as error:  # such a feature does not end the plan
                notes.append(f"{d['op']} of {','.join(group)} skipped: {str(error)[:120]}")
    names = apply_features(train, frozen)[1]
    if len(names) > MOST_FEATURES:
        notes.append(f"{len(names) - MOST_FEATURES} features beyond {MOST_FEATURES} left out")
        frozen.append({"do": "keep", "of": names, "names": names[:MOST_FEATURES]})
    for d in sorted((d for d in decisions if d["op"] in POST), key=lambda d: POST.index(d["op"])):
        made, names = apply_features(train, frozen)
        step = _fit_post(made, [n for n in names if n in numeric_columns(made)], d, target)
        if step:
            frozen.append(step)
    return frozen, notes


def _fit_together(train: DataFrame, d: dict, columns: list[str]) -> dict:
    op, p = d["op"], {k: coerce(v) for k, v in d.items()}
    step = {"do": op, "columns": columns}
    if op == "ratio":
        return step | {"columns": columns[:2], "name": f"{columns[0]}_over_{columns[1]}"}
    if op == "interaction":
        numeric = all(c in numeric_columns(train) for c in columns)
        name = "_x_".join(columns)
        levels = [] if numeric else E.fit_levels(S.interaction(train, columns, False, name), name, min(50, int(p.get("max_categories", 50))))
        return step | {"numeric": numeric, "name": name, "levels": levels}
    if op == "polynomial":
        return step | {"degree": int(p.get("degree", 2)), "interactions": bool(p.get("interactions", True))}
    to = S.geo_distance(train, columns[0], columns[1], tuple(columns[2:4]) if len(columns) >= 4 else None)[1]
    return step | {"to": list(to)}


def _fit_post(made: DataFrame, names: list[str], d: dict, target: str | None) -> dict | None:
    """The step that a selection or projection of the made features freezes; None where there is nothing to do."""
    op, p = d["op"], {k: coerce(v) for k, v in d.items()}
    if not names:
        return None
    if op == "variance_threshold":
        low = set(E.low_variance_columns(made, names, float(p.get("threshold", 0.0))))
        return {"do": "keep", "of": names, "names": [n for n in names if n not in low]}
    if op == "drop_correlated":
        from sparkprep.operators.associate import drop_correlated, pearson_pairs

        pairs = [r.asDict() for r in pearson_pairs(made, names).where(F.col("r").isNotNull()).collect()]
        strength = {}
        if target in numeric_columns(made):
            strength = {r["column"]: abs(r["f"]) for r in E.regression_f(made, names, target).where("f is not null").collect()}
        gone = set(drop_correlated(pairs, strength, float(p.get("threshold", 0.95))))
        return {"do": "keep", "of": names, "names": [n for n in names if n not in gone]}
    if op == "select_k_best":
        few = made.where(F.col(target).isNotNull()).select(target).distinct().limit(51).count() <= 50
        scores = E.anova_f(made, names, target) if few else E.regression_f(made, names, target)
        return {"do": "keep", "of": names, "names": E.select_k_best(scores, int(p.get("k", 20)))}
    centred = op == "pca"
    return {"do": "project", "of": names, "name": "pca" if centred else "svd", **E.fit_projection(made, names, int(p.get("n_components", 2)), centred)}


def _fit_feature(train: DataFrame, d: dict, c: str, target: str | None) -> dict:
    op, p = d["op"], {k: coerce(v) for k, v in d.items()}
    if op == "date_decompose":
        return {"do": op, "column": c, "parts": S.decompose_date(train, c, p.get("parts"))[1]}
    if op == "cyclical_encode":
        return {"do": op, "column": c, "part": p.get("part", "month")}
    if op == "log_transform":
        low = train.agg(F.min(c)).first()[0]
        return {"do": op, "column": c, "signed": low is not None and low < 0}
    if op in ("standard_scale", "minmax_scale", "robust_scale"):
        return {"do": "scale", "column": c, "fitted": E.fit_scaler(train, [c], op.split("_")[0])}
    if op == "one_hot_encode":
        return {"do": op, "column": c, "levels": E.fit_levels(train, c, int(p.get("max_categories", 50)))}
    if op == "ordinal_encode":
        if p.get("order"):
            return {"do": op, "column": c, "levels": p["order"]}
        levels = train.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("level")).distinct()
        codes = global_running(levels, [F.col("level")], {}, number="n").select(F.lit(-1).alias("fold"), "level", (F.col("n") - 1).cast("double").alias("value"))
        return {"do": "fold_map", "column": c, "name": f"{c}_ordinal", "defaults": {"-1": -1.0}, "as": "long"} | _frozen(codes)
    if op == "target_encode":
        # the training rows of this fit are coded by the other folds, all others by all
        table, priors = E.fit_target_folds(train, c, target, FOLD)
        return {"do": "fold_map", "column": c, "name": f"{c}_target", "defaults": priors} | _frozen(table)
    if op == "frequency_encode":
        return {"do": "fold_map", "column": c, "name": f"{c}_frequency", "defaults": {"-1": 0.0}} | _frozen(E.fit_frequencies(train, c).select(F.lit(-1).alias("fold"), "level", F.col("frequency").alias("value")))
    if op == "quantile_transform":
        return {"do": op, "column": c, "grid": E.fit_quantile_grid(train, c, int(p.get("n_quantiles", 1000))), "normal": p.get("output", "normal") == "normal"}
    if op == "tfidf":
        from sparkprep.functions import text as X

        grams = int(p.get("ngram_max", 1))
        terms = X.tfidf_terms(train, c, int(p.get("max_features", 100)), grams, int(p.get("min_df", 2)))[0]
        return {"do": op, "column": c, "ngram_max": grams, "terms": [[r["term"], r["idf"]] for r in terms.orderBy("term").collect()]}
    if op == "group_aggregate":
        statistics = list(p.get("statistics") or ["mean"])
        from sparkprep.operators.profile import group_statistics

        by = p["by"]
        table = group_statistics(train.withColumn("level", E.level(by)), ["level"], [c], statistics)
        return {"do": op, "column": c, "by": by, "statistics": statistics, "table": written(table)}
    if op == "hash_encode":
        return {"do": op, "column": c, "n": int(p.get("n_buckets", p.get("n_features", 8)))}
    if op == "binning":
        return {"do": op, "column": c, "edges": E.fit_bins(train, c, int(p.get("n_bins", 5)), p.get("strategy", "quantile"))}
    if op in ("sqrt_transform", "text_length"):
        return {"do": op, "column": c}
    if op == "boxcox":
        return {"do": op, "column": c, "fitted": E.fit_power(train, c)}
    raise ValueError(f"no such feature: {op}")


def _frozen(table: DataFrame) -> dict:
    """All rows of (fold, level, value): few in the step itself, more as a table in the shared folder."""
    rows = table.limit(MOST_FROZEN + 1).collect()
    if len(rows) > MOST_FROZEN:
        return {"table": written(table)}
    return {"rows": sorted([r["fold"], r["level"], r["value"]] for r in rows)}


def apply_features(df: DataFrame, frozen: Iterable[dict]) -> tuple[DataFrame, list[str]]:
    """(df with the features, their names). Rows without a fold count as new."""
    names: list[str] = []
    own = FOLD in df.columns
    df = df if own else df.withColumn(FOLD, F.lit(-1))
    for s in frozen:
        if s["do"] in ("keep", "project"):
            df, names = _apply_post(df, s, names)
            continue
        before = set(df.columns)
        c = s.get("column") or s["columns"][0]
        lost = [x for x in [*s.get("columns", [c]), *([s["by"]] if "by" in s else [])] if x not in df.columns]
        if lost:
            raise ValueError(f"missing columns: {', '.join(lost)}")
        do: dict[str, Callable[[], DataFrame]] = {
            "date_decompose": lambda s=s, c=c, df=df: S.decompose_date(df, c, s["parts"])[0], "cyclical_encode": lambda s=s, c=c, df=df: S.cyclical(df, c, s["part"]),
            "log_transform": lambda s=s, c=c, df=df: S.log_transform(df, c, s["signed"]), "scale": lambda s=s, c=c, df=df: E.scale(df.withColumn(f"{c}_scaled", F.col(c)), {f"{c}_scaled": s["fitted"][c]}),
            "one_hot_encode": lambda s=s, c=c, df=df: E.one_hot(df, c, s["levels"]), "ordinal_encode": lambda s=s, c=c, df=df: E.ordinal(df, c, s["levels"]),
            "fold_map": lambda s=s, c=c, df=df: _fold_map(df, c, s),
            "quantile_transform": lambda s=s, c=c, df=df: E.quantile_transform(df, c, s["grid"], s["normal"]), "tfidf": lambda s=s, c=c, df=df: _tfidf(df, c, s), "group_aggregate": lambda s=s, c=c, df=df: _group_aggregate(df, c, s),
            "ratio": lambda s=s, df=df: S.ratio(df, *s["columns"], s["name"]), "polynomial": lambda s=s, df=df: S.polynomial(df, s["columns"], s["degree"], s["interactions"]),
            "interaction": lambda s=s, df=df: S.interaction(df, s["columns"], True, s["name"]) if s["numeric"] else E.one_hot(S.interaction(df, s["columns"], False, s["name"]), s["name"], s["levels"]).drop(s["name"]),
            "geo_distance": lambda s=s, df=df: S.geo_distance(df, s["columns"][0], s["columns"][1], tuple(s["to"]), allocate(df.columns, f"{s['columns'][0]}_distance_km"))[0],
            "hash_encode": lambda s=s, c=c, df=df: E.hash_encode(df, c, s["n"]), "binning": lambda s=s, c=c, df=df: E.bin_codes(df, c, s["edges"]), "sqrt_transform": lambda c=c, df=df: S.sqrt_transform(df, c),
            "text_length": lambda c=c, df=df: S.text_length(df, c), "boxcox": lambda s=s, c=c, df=df: E.power_transform(df, c, s["fitted"]),
        }
        df = do[s["do"]]()
        names += [n for n in df.columns if n not in before]
    return (df if own else df.drop(FOLD)), names


def _fold_map(df: DataFrame, c: str, s: dict) -> DataFrame:
    """The value of (fold, level); a level that a fold does not know gets the fold's default."""
    if "as" in s:
        kept = {k: v for k, v in s.items() if k != "as"}
        return _fold_map(df, c, kept).withColumn(s["name"], F.col(s["name"]).cast(s["as"]))
    fold = F.when(F.col(FOLD).cast("string").isin(*s["defaults"]), F.col(FOLD)).otherwise(F.lit(-1))
    default = F.try_element_at(F.create_map(*[F.lit(x) for k, v in s["defaults"].items() for x in (int(k), v)]), fold)
    if "rows" in s and len(s["rows"]) <= 500:
        if not s["rows"]:
            return df.withColumn(s["name"], default)
        known = F.create_map(*[F.lit(x) for k, v, x_ in s["rows"] for x in (f"{k}:{v}", x_)])
        return df.withColumn(s["name"], F.coalesce(F.try_element_at(known, F.concat(fold, F.lit(":"), E.level(c))), default))
    table = df.sparkSession.read.parquet(s["table"]) if "table" in s else F.broadcast(df.sparkSession.createDataFrame(s["rows"], "fold int, level string, value double"))  # at most MOST_FROZEN rows
    table = table.select(F.col("fold").alias("_f"), F.col("level").alias("_l"), F.col("value").alias("_v"))
    joined = df.withColumns({"_fk": fold, "_lk": E.level(c)}).join(table, (F.col("_fk") == F.col("_f")) & (F.col("_lk") == F.col("_l")), "left")
    return joined.withColumn(s["name"], F.coalesce("_v", default)).drop("_fk", "_lk", "_f", "_l", "_v")


def _tfidf(df: DataFrame, c: str, s: dict) -> DataFrame:
    """A column a frozen term: (1 + ln tf) * idf, of length 1 a row."""
    from sparkprep.functions import text as X

    if not s["terms"]:
        return df
    terms, idf = F.array(*[F.lit(t) for t, _ in s["terms"]]), F.array(*[F.lit(float(w)) for _, w in s["terms"]])
    words = df.withColumn("_w", X.tokens(F.col(c), s["ngram_max"]))
    counts = F.transform(terms, lambda t: F.size(F.filter("_w", lambda w: w == t)))
    raw = F.zip_with(counts, idf, lambda n, w: F.when(n > 0, (1 + F.log(n)) * w).otherwise(0.0))
    words = words.withColumn("_w", raw).withColumn("_n", F.sqrt(F.aggregate(F.transform("_w", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)))
    return words.withColumns({f"{c}_tfidf_{i}": F.coalesce(F.try_divide(F.col("_w")[i], F.col("_n")), F.lit(0.0)) for i in range(len(s["terms"]))}).drop("_w", "_n")


def _group_aggregate(df: DataFrame, c: str, s: dict) -> DataFrame:
    table = df.sparkSession.read.parquet(s["table"]).withColumnRenamed("level", "_by").withColumnsRenamed({f"{c}_{k}": f"{c}_by_{s['by']}_{k}" for k in s["statistics"]})
    return df.withColumn("_key", E.level(s["by"])).join(table, F.col("_key") == F.col("_by"), "left").drop("_key", "_by")


def _apply_post(df: DataFrame, s: dict, names: list[str]) -> tuple[DataFrame, list[str]]:
    lost = [n for n in s["of"] if n not in df.columns]
    if lost:
        raise ValueError(f"missing features: {', '.join(lost)}")
    if s["do"] == "keep":
        gone = set(s["of"]) - set(s["names"])
        return df.drop(*gone), [n for n in names if n not in gone]
    made = E.project(df, s["of"], s["centre"], s["scale"], s["components"], s["name"])
    return made.drop(*s["of"]), [n for n in names if n not in s["of"]] + [f"{s['name']}_{k + 1}" for k in range(len(s["components"]))]


class _Plan(Params):
    cleaning = Param(Params._dummy(), "cleaning", "cleaning decisions as JSON", TypeConverters.toString)
    features = Param(Params._dummy(), "features", "feature decisions as JSON", TypeConverters.toString)
    target = Param(Params._dummy(), "target", "the label's column", TypeConverters.toString)


class Preparation(Estimator, _Plan, DefaultParamsReadable, DefaultParamsWritable):
    """Cleaning and features fitted on a fold's own rows.

    Steps that drop rows, and features of a row's past, are no part of it. Fills along an
    order are replaced by the median or mode, since a new row has no neighbours; training rows are filled as new ones
    will be. ``fit_transform`` gives the training rows with target encodings out of fold; the model itself knows no
    folds and codes whatever rows it gets by all training rows, whether they hold the target or not. Where rows
    are split by time or group target encoding is left out.
    """

    def __init__(self, cleaning: Iterable[dict] = (), features: Iterable[dict] = (), target: str = "", strategy: str = "random") -> None:
        super().__init__()
        rows = {"drop_duplicate_rows", "drop_rows_missing_target", "remove_outlier_rows"}
        history = {"lag", "rolling", "diff", "expanding"} | ({"target_encode"} if strategy in ("temporal", "grouped") else set())
        kept = [d | ({"strategy": "auto"} if d.get("strategy") in ("forward_fill", "backward_fill", "interpolate") else {}) for d in cleaning if d["action"] not in rows and d.get("strategy") != "drop_rows"]
        self._set(cleaning=json.dumps(kept), features=json.dumps([d for d in features if d["op"] not in history]), target=target)

    def fit_transform(self, dataset: DataFrame) -> tuple[PreparationModel, DataFrame]:
        """(model, training rows with their features). A training row's fold is drawn here, once, and goes with it through all steps."""
        target = self.getOrDefault("target") or None
        dealt = with_fold(dataset, target)
        _, frozen, lost = clean(dealt, json.loads(self.getOrDefault("cleaning")), target)
        cleaned = replay(dealt, frozen)
        made, more = fit_features(cleaned, json.loads(self.getOrDefault("features")), target)
        coded, names = apply_features(cleaned, made)
        return PreparationModel(frozen, made, target or "", [*lost, *more], names), coded.drop(FOLD)

    def _fit(self, dataset: DataFrame) -> PreparationModel:
        return self.fit_transform(dataset)[0]


class _PreparationWriter(DefaultParamsWriter):
    """Mapping tables go below the model's own path, so that the model can be moved and outlives the folder it was fitted in."""

    def saveImpl(self, path: str) -> None:
        steps = json.loads(self.instance.getOrDefault("features"))
        for i, step in enumerate(steps):
            if "table" in step:
                self.sparkSession.read.parquet(step["table"]).write.parquet(f"{path}/tables/{i}")
                step["table"] = f"{i}"
        saved = self.instance.copy()
        saved._set(features=json.dumps(steps))
        DefaultParamsWriter(saved).saveImpl(path)

    def save(self, path: str) -> None:
        inside = [s["table"] for s in json.loads(self.instance.getOrDefault("features")) if s.get("table", "").startswith(f"{path.rstrip('/')}/")]
        if inside:
            raise ValueError(f"the model's own tables are in {path}: save it elsewhere")
        super().save(path)


class _PreparationReader(DefaultParamsReader):
    def load(self, path: str) -> PreparationModel:
        model = super().load(path)
        steps = json.loads(model.getOrDefault("features"))
        model._set(features=json.dumps([s | ({"table": f"{path.rstrip('/')}/tables/{s['table']}"} if "table" in s else {}) for s in steps]))
        return model


class PreparationModel(Model, _Plan, MLReadable, MLWritable):
    """Replays what was frozen, the same for a row whatever else it holds. ``notes`` says what of the plan could not be fitted, ``made`` names the features."""

    notes = Param(Params._dummy(), "notes", "what was skipped", TypeConverters.toListString)
    made = Param(Params._dummy(), "made", "names of the features", TypeConverters.toListString)

    def __init__(self, frozen: Iterable[dict] = (), features: Iterable[dict] = (), target: str = "", notes: Iterable[str] = (), made: Iterable[str] = ()) -> None:
        super().__init__()
        self._set(cleaning=json.dumps(list(frozen), default=str), features=json.dumps(list(features), default=str), target=target, notes=list(notes), made=list(made))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return apply_features(replay(dataset.drop(FOLD), json.loads(self.getOrDefault("cleaning"))), json.loads(self.getOrDefault("features")))[0]

    def write(self) -> _PreparationWriter:
        return _PreparationWriter(self)

    @classmethod
    def read(cls) -> _PreparationReader:
        return _PreparationReader(cls)


class Prepared:
    """A preparation and the pipeline after it: what is trained sees codes out of fold, what is scored the model's own."""

    def __init__(self, preparation: Preparation, then: Callable[[list[str]], Pipeline]) -> None:
        """``then`` makes the pipeline from the names of the features."""
        self.preparation, self.then = preparation, then

    def fit(self, train: DataFrame) -> PipelineModel:
        model, coded = self.preparation.fit_transform(train)
        rest = self.then(model.getOrDefault("made")).fit(coded)
        return PipelineModel([model, *rest.stages])


def initial_features(df: DataFrame, target: str | None, identifiers: Iterable[str] = (), constants: Iterable[str] = (), leaks: Iterable[str] = (), group: str | None = None) -> list[tuple[str, str]]:
    """(column, reason it is left out, or "")."""
    reasons = {**{c: "identifier" for c in identifiers}, **{c: "constant" for c in constants}, **{c: "leakage" for c in leaks}}
    if target:
        reasons[target] = "target"
    if group:
        reasons[group] = "group key"
    return [(f.name, reasons.get(f.name, "raw time" if isinstance(f.dataType, TIMES) else "")) for f in df.schema]


def profiled_features(df: DataFrame, target: str, group: str | None = None) -> list[tuple[str, str]]:
    """``initial_features`` with identifiers and constants from the columns' kinds, and as leaks what tells the target with critical severity."""
    from sparkprep.operators.associate import leakage_findings, target_associations
    from sparkprep.operators.profile import infer_kinds
    from sparkprep.operators.quality import infer_task

    kinds = {r["column"]: r["kind"] for r in infer_kinds(df).collect()}
    named = {kind: [c for c, k in kinds.items() if k == kind and c not in (target, group)] for kind in ("identifier", "constant")}
    rest = [c for c in df.columns if c not in (target, group, *named["identifier"], *named["constant"])]
    found = target_associations(df, target, rest, "regression" if infer_task(df, target)["task"] == "regression" else "classification")
    leaks = [r["column"] for r in leakage_findings(df, target, found, rest).where("severity = 'critical'").collect()]
    return initial_features(df, target, named["identifier"], named["constant"], leaks, group)


def default_treatment(df: DataFrame, columns: Iterable[str], max_levels: int = 50) -> dict[str, str]:
    """What becomes of columns no decision names: numbers pass, texts of one level are dropped, of few levels one-hot, others excluded."""
    names = list(columns)
    numbers = numeric_columns(df)
    out = {}
    for c in names:
        if c in numbers or dict(df.dtypes)[c] == "boolean":
            out[c] = "pass"
            continue
        levels = df.where(F.col(c).isNotNull()).select(c).distinct().limit(max_levels + 1).count()  # exact up to the limit
        out[c] = "drop" if levels <= 1 else "one_hot" if levels <= max_levels else "exclude"
    return out
