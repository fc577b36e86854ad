"""Splits and folds as columns: leak-free by time, entity or class, and the same under any partitioning."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkprep.functions.tables import digest as digest_of
from sparkprep.functions.tables import durable, global_running, unit


def choose_strategy(task: str, time: str | None = None, group: str | None = None) -> tuple[str, str]:
    """(strategy, reason)."""
    if task == "forecasting" and time:
        return "temporal", "a forecast is judged on later rows"
    if group:
        return "grouped", f"rows of one {group} stay together"
    if time:
        return "temporal", f"{time} orders the rows"
    if task in ("classification", "binary", "multiclass"):
        return "stratified", "classes keep their shares"
    return "random", "nothing orders or groups the rows"


def _named(place: Column, n: Column, test: float, validation: float) -> Column:
    """Names of rows by place 1..n: the last round(n * test) are test, those before them validation."""
    k_test, k_val = F.round(n * test), F.round(n * validation)
    return F.when(place > n - k_test, "test").when(place > n - k_test - k_val, "validation").otherwise("train")


def temporal_split(df: DataFrame, order: list[str], test: float = 0.2, validation: float = 0.15) -> DataFrame:
    """Later rows are test. ``order`` must tell rows apart; the global row number comes from ranges and their totals."""
    placed = global_running(df, [F.col(o) for o in order], {}, number="_place")
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    return placed.join(F.broadcast(n), how="cross").withColumn("split", _named(F.col("_place"), F.col("_n"), test, validation)).drop("_place", "_n")


def grouped_split(df: DataFrame, group: str, test: float = 0.2, validation: float = 0.15, seed: int = 0, digest: Column | None = None) -> DataFrame:
    """Whole groups by a digest of their name: shares of groups, not of rows. Fewer than three groups fall back to a random split by the group's rows."""
    key = digest_of(group, seed) if digest is None else digest
    groups = df.select(group).distinct().withColumn("_d", key)
    placed = global_running(groups, [F.col("_d"), F.col(group)], {}, number="_place")
    n = groups.agg(F.count(F.lit(1)).alias("_n"))
    k = F.ceil(F.col("_n") * test), F.ceil(F.col("_n") * validation)
    name = F.when(F.col("_place") <= k[0], "test").when(F.col("_place") <= k[0] + k[1], "validation").otherwise("train")
    named = placed.join(F.broadcast(n), how="cross").select(F.col(group).alias("_g"), name.alias("split"))
    return df.join(named, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.2, validation: float = 0.15, seed: int = 0, digest: Column | None = None) -> DataFrame:
    """Each class is cut at its own quotas in an order by digest of the key. Places within a class come from the global order of (class, digest), so a hot class is spread over tasks."""
    d = digest_of(key, seed) if digest is None else digest
    placed = global_running(df.withColumn("_d", d), [F.col(label).asc_nulls_first(), F.col("_d"), F.col(key)], {}, number="_at")
    sizes = placed.groupBy(F.col(label).alias("_l")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    joined = placed.join(sizes, F.col(label).eqNullSafe(F.col("_l")))
    return joined.withColumn("split", _named(F.col("_at") - F.col("_first") + 1, F.col("_n"), test, validation)).drop("_d", "_at", "_l", "_n", "_first")


def random_split(df: DataFrame, key: str, test: float = 0.2, validation: float = 0.15, seed: int = 0) -> DataFrame:
    """By digest of the key: narrow, repeatable, no shuffle; shares hold in expectation."""
    u = unit(key, seed)
    return df.withColumn("split", F.when(u < test, "test").when(u < test + validation, "validation").otherwise("train"))


def split(df: DataFrame, task: str, target: str, key: str, time: str | None = None, group: str | None = None, test: float = 0.2, validation: float = 0.15, seed: int = 0) -> tuple[DataFrame, dict]:
    """df without rows that lack a target and without repeated rows, with ``split``; and how it was made: strategy, reason, rows, the shares asked for, the sizes got and notes where they differ by a tenth. No validation part under 150 rows."""
    clean = durable(df.where(F.col(target).isNotNull()).dropDuplicates())
    test, n = min(0.5, max(0.05, test)), clean.count()
    validation = 0.0 if n < 150 or n * validation < 20 else min(0.4, validation)
    strategy, reason = choose_strategy(task, time, group)
    if strategy == "stratified" and clean.groupBy(target).count().where("count < 2").limit(1).count():
        strategy, reason = "random", "a class has fewer than two rows"
    if strategy == "grouped":
        g = clean.select(group).distinct().count()
        if g < 3 or g > 0.95 * n:
            strategy, reason = "random", "too few groups, or nearly one a row"
    made = {
        "temporal": lambda: temporal_split(clean, [time, key], test, validation), "grouped": lambda: grouped_split(clean, group, test, validation, seed),
        "stratified": lambda: stratified_split(clean, target, key, test, validation, seed), "random": lambda: random_split(clean, key, test, validation, seed),
    }[strategy]()
    made = durable(made)  # all that is made of the parts reads them
    sizes = {r["split"]: r["n"] for r in partition_sizes(made).collect()}  # three rows
    return made, {"strategy": strategy, "reason": reason, "rows": n, "test": test, "validation": validation, "sizes": sizes, "notes": size_deviations(sizes, {"test": test, "validation": validation})}


def size_deviations(sizes: dict[str, int], wanted: dict[str, float], tolerance: float = 0.1) -> list[str]:
    """A note for each part whose share of the rows is off the wanted one by more than ``tolerance`` of it: whole groups and classes cannot be cut anywhere."""
    n = sum(sizes.values())
    shares = {k: (sizes.get(k, 0) / n if n else 0.0, v) for k, v in wanted.items() if v > 0}
    return [f"{k} has {got:.1%} of the rows, {v:.1%} were wanted" for k, (got, v) in shares.items() if abs(got - v) > tolerance * v]


class Holdout:
    """Rows without repeats, split; the test part is sealed until ``finish``, which reads it once.

    ``open`` holds the train and validation rows, and ``profile`` looks at the train rows alone, so
    nothing that is decided before the end can come from a test row.
    """

    def __init__(self, df: DataFrame, task: str, target: str, key: str, **options) -> None:  # noqa: ANN003
        whole, self.how = split(df, task, target, key, **options)
        self.open = whole.where("split != 'test'")
        self._sealed: DataFrame | None = whole.where("split = 'test'").drop("split")

    @property
    def train(self) -> DataFrame:
        return self.open.where("split = 'train'").drop("split")

    @property
    def validation(self) -> DataFrame:
        return self.open.where("split = 'validation'").drop("split")

    def profile(self, columns: Iterable[str] | None = None) -> DataFrame:
        from sparkprep.operators.profile import profile_table

        return profile_table(self.train, columns)

    def finish(self, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """What ``score`` makes of the test rows; a second call is an error."""
        if self._sealed is None:
            raise RuntimeError("the holdout has been read")
        test, self._sealed = self._sealed, None
        return score(test)


def label_encode(df: DataFrame, label: str, name: str = "label_index") -> tuple[DataFrame, list[str]]:
    """Classes as 0..k-1 in text order, or as they are if they are 0..k-1 already; all of them, many by a join."""
    found = [r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).collect()]
    whole = found and all(isinstance(v, int) and not isinstance(v, bool) for v in found) and sorted(found) == list(range(len(found)))
    classes = [str(v) for v in found] if whole else sorted(str(v).lower() if isinstance(v, bool) else str(v) for v in found)
    if len(classes) > 500:
        table = df.sparkSession.createDataFrame(list(zip(classes, range(len(classes)), strict=True)), "_class string, _index int")
        return df.join(table, F.col(label).cast("string") == F.col("_class"), "left").withColumn(name, F.col("_index")).drop("_class", "_index"), classes
    index = F.array_position(F.array(*map(F.lit, classes)), F.col(label).cast("string")) - 1
    return df.withColumn(name, F.when(index >= 0, index.cast("int"))), classes


def folds(df: DataFrame, strategy: str, key: str, n: int = 5, label: str | None = None, group: str | None = None, time: str | None = None, seed: int = 0) -> DataFrame:
    """A ``fold`` column 0..n-1: hash, per-class place, group hash, or blocks of time (train on earlier folds)."""
    if strategy == "grouped":
        return df.withColumn("fold", F.floor(unit(group, seed) * n).cast("int"))
    if strategy == "stratified":
        placed = global_running(df.withColumn("_d", digest_of(key, seed)), [F.col(label).asc_nulls_first(), F.col("_d"), F.col(key)], {}, number="_at")
        return placed.withColumn("fold", ((F.col("_at") - 1) % n).cast("int")).drop("_d", "_at")
    if strategy == "temporal":
        placed = global_running(df, [F.col(time), F.col(key)], {}, number="_at")
        size = df.agg(F.count(F.lit(1)).alias("_n"))
        return placed.join(F.broadcast(size), how="cross").withColumn("fold", F.floor((F.col("_at") - 1) * n / F.col("_n")).cast("int")).drop("_at", "_n")
    return df.withColumn("fold", F.floor(unit(key, seed) * n).cast("int"))


def fold_parts(df: DataFrame, fold: int, strategy: str = "random") -> tuple[DataFrame, DataFrame]:
    """(train, test) of one fold; in time only earlier folds train."""
    train = F.col("fold") < fold if strategy == "temporal" else F.col("fold") != fold
    return df.where(train), df.where(F.col("fold") == fold)


def partition_sizes(df: DataFrame, by: Iterable[str] = ("split",)) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def shared_groups(df: DataFrame, group: str) -> DataFrame:
    """Groups that are in more than one part: empty for a sound grouped split."""
    return df.groupBy(group).agg(F.count_distinct("split").alias("parts")).where("parts > 1")


