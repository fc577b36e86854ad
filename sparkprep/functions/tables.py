"""Helpers that the operators share: reading, checkpoints, long results, row identity and global order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Types of time columns.
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a local master, all of whose tasks see /tmp, may do without."""
    context = spark.sparkContext
    set_to = context.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")


def digest(key: str, seed: int = 0) -> Column:
    """A hexadecimal digest of the key and the seed: an order by chance that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def unit(key: str, seed: int = 0) -> Column:
    """The digest as a number between 0 and 1."""
    return (F.conv(F.substring(digest(key, seed), 1, 13), 16, 10).cast("long") + 0.5) / 4503599627370496.0


def _shared_folder(df: DataFrame) -> str:
    """The checkpoint folder, which is the cluster's shared one unless another was set."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return context._jsc.sc().getCheckpointDir().get()


def durable(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    _shared_folder(df)
    return df.checkpoint()


#: Rows from which another task is worth its start.
SPREAD_ROWS = 16384


def spread(df: DataFrame) -> DataFrame:
    """A checkpoint dealt evenly over the cores, over fewer where there are few rows: what goes over the rows again and again then neither reads nor derives them anew, nor is left to the few tasks that a file of large row groups gives."""
    n = max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SPREAD_ROWS)))
    return durable(df.repartition(n))


def written(df: DataFrame) -> str:
    """Where in the shared folder df now is as Parquet; it stays there."""
    path = f"{_shared_folder(df)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing; Spark's aggregates would take it as a value."""
    fixes = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)}
    return df.withColumns(fixes) if fixes else df


def known(df: DataFrame, columns: Iterable[str] | None) -> list[str]:
    """The named columns that exist; unknown names are left out, as every operator does."""
    return list(df.columns) if columns is None else [c for c in columns if c in df.columns]


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r of the rows that have both; null where either has no spread."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def to_long(one: DataFrame, fields: Mapping[str, Mapping[str, Column]], key: str = "column", by: Iterable[str] = ()) -> DataFrame:
    """One row per entry of fields from a frame of wide aggregates."""
    rows = F.array(*[F.struct(F.lit(name).alias(key), *[v.alias(k) for k, v in entry.items()]) for name, entry in fields.items()])
    return one.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.*")


def global_running(df: DataFrame, order: list[Column], sums: Mapping[str, Column], number: str | None = None, partitions: int | None = None) -> DataFrame:
    """df with running sums over the whole frame in a global order, without a window over all rows.

    Rows are dealt by ranges of the order, totals are taken per range, and each
    range starts from the totals before it. ``order`` must tell all rows apart.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = {**sums, **({number: F.lit(1)} if number else {})}
    dealt = durable(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in named.items()])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in named])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # each range is a task of its own: by a hash of their numbers some tasks would get several and others none
    out = dealt.repartitionById(n, "_range").join(F.broadcast(offsets), "_range")  # as many rows as there are partitions
    out = out.withColumns({k: F.sum(v).over(inside) + F.col(f"_o_{k}") for k, v in named.items()})
    return out.select(*df.columns, *named)


def in_ranges(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """df with ``_range`` and ``_at``: rows dealt by ranges of the order, and their global number. ``order`` must tell all rows apart."""
    numbered = global_running(df, order, {}, number="_at", partitions=partitions)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return durable(numbered.repartitionByRange(n, "_at").withColumn("_range", F.spark_partition_id()))


def with_rows_before(dealt: DataFrame, reach: int) -> DataFrame:
    """dealt and, as ``_edge`` rows, for each range the ``reach`` rows before it: a frame of so many rows then needs its own range only.

    The last rows of the ranges, ``reach`` each, are all that can be before another; they are numbered, and each goes to the few ranges that begin within ``reach`` of it.
    """
    back = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc("_at")))
    tails = dealt.withColumn("_back", back).where(F.col("_back") <= reach).drop("_back")
    starts = dealt.groupBy(F.col("_range").alias("_to")).agg(F.min("_at").alias("_start"))  # a row a range
    near = tails.join(F.broadcast(starts), (F.col("_range") < F.col("_to")) & (F.col("_at") >= F.col("_start") - reach))
    edge = near.withColumn("_range", F.col("_to")).drop("_to", "_start").withColumn("_edge", F.lit(True))
    return dealt.withColumn("_edge", F.lit(False)).unionByName(edge)


def last_before(dealt: DataFrame, columns: Iterable[str]) -> DataFrame:
    """_of, then for each column i ``_v{i}`` and ``_p{i}``: the last value there is in earlier ranges and its number. A row a range."""
    names = list(columns)
    ends = dealt.groupBy(F.col("_range").alias("_of")).agg(*[x for i, c in enumerate(names) for x in (F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"v{i}"), F.max(F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"p{i}"))])
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("_of", *[F.last(f"{x}{i}", ignorenulls=True).over(before).alias(f"_{x}{i}") for i in range(len(names)) for x in "vp"])


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A row number by the content of all columns: the same however the rows are partitioned; equal rows take their numbers in any order."""
    order = [F.col(c) if not isinstance(df.schema[c].dataType, T.MapType) else F.to_json(c) for c in df.columns]
    return global_running(df, order, {}, number=name)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows without replacement by a digest of the key: repeatable under any partitioning."""
    return df.orderBy(digest(key, seed), key).limit(n)


def align(df: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """df with the other columns of made on the rows of the same key; rows that made does not have get nulls, and names that df has are left out."""
    new = [c for c in made.columns if c != key and c not in df.columns]
    return df.join(made.select(F.col(key).alias("_key"), *new), F.col(key) == F.col("_key"), "left").drop("_key")


def capped(df: DataFrame, max_rows: int, order: list[str]) -> tuple[DataFrame, bool]:
    """(first max_rows rows in order, whether more existed)."""
    head = df.orderBy(*order).limit(max_rows + 1)
    truncated = head.count() > max_rows
    return head.limit(max_rows) if truncated else head, truncated


def allocate(taken: Iterable[str], hint: str) -> str:
    """A column name that is not taken: hint, hint_2, hint_3..."""
    have = set(taken)
    if hint not in have:
        return hint
    k = 2
    while f"{hint}_{k}" in have:
        k += 1
    return f"{hint}_{k}"
