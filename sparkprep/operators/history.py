"""Run history as append-only tables: idempotent appends, look-ups, similarity of runs, cross-run leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.functions.tables import TIMES
from sparkprep.operators.associate import name_overlap
from sparkprep.operators.metrics import LOWER_IS_BETTER

#: Weights of the parts of a similarity.
WEIGHTS = {"task": 0.24, "shape": 0.18, "names": 0.18, "types": 0.16, "target": 0.10, "missing": 0.08, "imbalance": 0.06}


def append_once(spark: SparkSession, path: str, rows: DataFrame, key: list[str]) -> None:
    """Appends the rows whose key is not stored yet."""
    fresh = rows.dropDuplicates(key)
    try:
        stored = spark.read.parquet(path).select(*key)
    except Exception as error:  # noqa: BLE001  the first append makes the table
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
            raise
        stored = None
    (fresh if stored is None else fresh.join(stored, key, "left_anti")).write.mode("append").parquet(path)


#: The history's tables and what tells their rows apart.
TABLES = {"runs": ["run_id"], "experiments": ["run_id", "family"], "fingerprints": ["run_id"], "events": ["run_id", "sequence"]}


def record(spark: SparkSession, folder: str, table: str, rows: DataFrame) -> None:
    """Appends to one of the history's tables; what is stored already stays as it is."""
    append_once(spark, f"{folder.rstrip('/')}/{table}", rows, TABLES[table])


def history(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}")


def events_after(events: DataFrame, sequence: int, key: str = "sequence") -> DataFrame:
    return events.where(F.col(key) > sequence).orderBy(key)


def best_runs(experiments: DataFrame, limit: int = 20, project: str | None = None, family: str | None = None) -> DataFrame:
    """Experiments better first by each metric's own direction."""
    rows = experiments
    if project is not None:
        rows = rows.where(F.col("project") == project)
    if family is not None:
        rows = rows.where(F.col("family") == family)
    sign = F.when(F.col("metric").isin(*sorted(LOWER_IS_BETTER)), -1.0).otherwise(1.0)
    return rows.withColumn("_s", sign * F.col("score")).orderBy(F.desc_nulls_last("_s"), "run_id", "family").drop("_s").limit(limit)


def fingerprint(df: DataFrame, run_id: str, task: str, target: str | None = None, winner: str | None = None, features: tuple[str, ...] = ()) -> DataFrame:
    """One row: counts by kind, missing and duplicate shares, names, imbalance, and an id of the schema and size."""
    from pyspark.sql import types as T

    from sparkprep.operators.profile import class_counts, table_overview

    kinds = {"numeric": 0, "text": 0, "time": 0, "other": 0}
    for f in df.schema:
        kind = "numeric" if isinstance(f.dataType, T.NumericType) else "text" if isinstance(f.dataType, T.StringType) else "time" if isinstance(f.dataType, TIMES) else "other"
        kinds[kind] += 1
    over = table_overview(df)
    imbalance = class_counts(df, target).agg(F.max("imbalance").alias("imbalance")) if target else over.select(F.lit(None).cast("double").alias("imbalance"))
    shape = F.sha1(F.concat_ws("|", F.col("n_rows").cast("string"), F.lit(df.schema.simpleString())))
    return over.join(imbalance, how="cross").select(
        F.lit(run_id).alias("run_id"), F.lit(task).alias("task"), "n_rows", "n_columns", *[F.lit(v).cast("long").alias(f"n_{k}") for k, v in kinds.items()], "missing_fraction",
        F.try_divide("n_duplicates", "n_rows").alias("duplicate_fraction"), "imbalance", F.array(*[F.lit(c.lower()) for c in df.columns]).alias("names"), F.lit(winner).alias("winner"),
        F.array(*map(F.lit, features)).cast("array<string>").alias("features"), shape.alias("dataset_id"),
    )


def _near(a: Column, b: Column) -> Column:
    """1 for equal sizes, falling with their ratio."""
    return F.least(a, b) / F.greatest(a, b)


def similar_runs(one: DataFrame, history: DataFrame, limit: int = 5, floor: float = 0.45) -> DataFrame:
    """run_id, similarity of the stored runs most like one; parts that either side lacks are left out and the weights rescaled."""
    q = one.select(*[F.col(c).alias(f"q_{c}") for c in one.columns]).limit(1)
    t = history.join(F.broadcast(q), how="cross").where("run_id != q_run_id")
    mix = sum([F.abs(F.col(f"n_{k}") / F.col("n_columns") - F.col(f"q_n_{k}") / F.col("q_n_columns")) for k in ("text", "time", "other")], F.abs(F.col("n_numeric") / F.col("n_columns") - F.col("q_n_numeric") / F.col("q_n_columns")))
    parts = {
        "task": F.when(F.col("task") == F.col("q_task"), 1.0).otherwise(0.0), "shape": (_near(F.log1p("n_rows"), F.log1p("q_n_rows")) + _near(F.log1p("n_columns"), F.log1p("q_n_columns"))) / 2,
        "names": name_overlap(F.col("names"), F.col("q_names")), "types": 1 - mix / 2, "target": F.when(F.col("imbalance").isNull() == F.col("q_imbalance").isNull(), 1.0).otherwise(0.0),
        "missing": 1 - F.abs(F.col("missing_fraction") - F.col("q_missing_fraction")), "imbalance": _near(F.col("imbalance"), F.col("q_imbalance")),
    }
    top, total = F.lit(0.0), F.lit(0.0)
    for k, v in parts.items():
        top, total = top + F.coalesce(v, F.lit(0.0)) * WEIGHTS[k], total + F.when(v.isNotNull(), WEIGHTS[k]).otherwise(0.0)
    return t.withColumn("similarity", top / total).where(F.col("similarity") >= floor).orderBy(F.desc("similarity"), "run_id").limit(limit).select("run_id", "similarity", "winner", "features")


def recommend_from_history(matches: DataFrame, families: int = 4, features: int = 8) -> DataFrame:
    """kind, name, weight: winners and feature operators by summed similarity."""
    won = matches.where("winner is not null").groupBy(F.col("winner").alias("name")).agg(F.sum("similarity").alias("weight")).orderBy(F.desc("weight"), "name").limit(families)
    used = matches.select("similarity", F.explode("features").alias("name")).groupBy("name").agg(F.sum("similarity").alias("weight")).orderBy(F.desc("weight"), "name").limit(features)
    return won.select(F.lit("family").alias("kind"), "name", "weight").unionByName(used.select(F.lit("feature").alias("kind"), "name", "weight"))
