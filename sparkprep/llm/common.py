"""What several corpus operators share: white space, checkpoints, token digests
over Arrow buffers, and connected components as Spark joins.

White space is ``[\\x20\\x09-\\x0D]`` everywhere and words are the runs between it.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters, and the pattern of a word.
BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"

#: Odd 64-bit multipliers of the polynomial digests and of the final mix.
_BYTE_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_WORD_BASES = (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
#: Texts are digested in slices of about this many bytes, so that temporary arrays stay small.
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session has it. Only a local master, as in tests, may do without: all its tasks see /tmp."""
    context = spark.sparkContext
    set_to = context.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")


#: Shuffle files of a query are removed when it has ended, not when the driver happens to collect garbage.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here free their shuffles."""
    was = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, was)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that the cluster shares, and free the shuffles that led to it."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    with freed_shuffles(spark):
        return df.select("*").checkpoint()


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(_MIX[0])
    x ^= x >> np.uint64(33)
    x *= np.uint64(_MIX[1])
    x ^= x >> np.uint64(33)
    return x


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def spans_digest(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial digest modulo 2**64 of values[start:end] for each span, by one prefix sum."""
    n = len(values)
    inverse = pow(base, -1, 1 << 64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _powers(base, n), dtype=np.uint64, out=sums[1:])
    return (sums[ends] - sums[starts]) * _powers(inverse, n + 1)[starts]


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[ord(c) for c in BLANKS]] = True


def text_slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of rows in them) for slices of a string array; a null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, side="right")) - 1)
        last = min(last, len(texts))
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_spans(raw: np.ndarray, at: np.ndarray, gaps: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, offsets of rows among the words) of the words of a slice; ``gaps`` has the bytes that are in no word."""
    blank = gaps[raw]
    n = len(raw)
    edge = np.zeros(n + 1, dtype=bool)  # a new row begins here
    edge[at] = True
    before = np.ones(n, dtype=bool)
    before[1:] = blank[:-1]
    after = np.ones(n, dtype=bool)
    after[:-1] = blank[1:]
    starts = np.flatnonzero(~blank & (before | edge[:n]))
    ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def bytes_digest(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit digest of each span of bytes."""
    digest = spans_digest(raw.astype(np.uint64) + np.uint64(1), starts, ends, _BYTE_BASES[which])
    return mix(digest ^ (ends - starts).astype(np.uint64))


def word_digests(raw: np.ndarray, at: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit digest of each word, offsets of rows among the words)."""
    starts, ends, rows = word_spans(raw, at)
    return bytes_digest(raw, starts, ends, which), rows


def word_base(which: int) -> int:
    return _WORD_BASES[which]


def by_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches sorted by that key."""
    kept: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if kept and keys[start] != last:
                yield pa.Table.from_batches(kept)
                kept = []
            last = keys[start]
            kept.append(batch.slice(start, end - start))
    if kept:
        yield pa.Table.from_batches(kept)


#: Keys of a join that go apart from the others, by broadcast.
HOT_KEYS = 1024


def join_hot_apart(left: DataFrame, right: DataFrame, key: str, weight: str, how: str) -> DataFrame:
    """left joined (left, inner or left_semi) with right, which has each key once and in ``weight`` how many rows of left hold it.

    The HOT_KEYS keys of the greatest weights are joined by a broadcast of so many rows, so their
    rows of left stay where they are; the others are shuffled, and none of them can hold more
    than one row in HOT_KEYS of all. ``right`` should be durable, it is read three times.
    """
    hot = right.orderBy(F.desc(weight), key).limit(HOT_KEYS)
    apart = left.join(F.broadcast(hot.drop(weight)), key, "inner" if how == "left" else how)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return apart.unionByName(rest.join(right.drop(weight), key, how))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; a component is named by its smallest node.

    Contraction: each node joins the smallest node of its neighbourhood, edges
    are rewritten to the joined nodes, and loops and repeats go. Nodes should be
    digests: in their random order a star is gone in two rounds and a chain loses
    a share of its nodes in each (a chain of rising numbers would lose one). A
    round is one pre-aggregated minimum and two equi-joins, whose hot keys adaptive
    execution splits. Nothing is gathered on the driver but whether edges are left.
    """
    now = durable(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b")).distinct())
    levels: list[DataFrame] = []
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up"))
        parent = durable(parent)
        levels.append(parent)
        left = parent.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        now = durable(
            now.join(left, "a")
            .join(right, "b")
            .where(F.col("ua") != F.col("ub"))
            .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
            .distinct()
        )
    if not levels:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = levels[-1].select("node", F.col("up").alias("component"))
    for parent in reversed(levels[:-1]):
        above = found.select(F.col("node").alias("up"), F.col("component").alias("over"))
        found = parent.join(above, "up", "left").select("node", F.coalesce("over", "up").alias("component"))
    return found


class Sealed:
    """A frame whose columns have names of their own, so that no name an operator uses inside can clash with one of the data.

    ``df`` has the columns under the sealed names, ``self[name]`` is the sealed name
    of a column, and ``reopen`` gives the original names back. A column of the data
    that has the name of an output is replaced by the output.
    """

    def __init__(self, df: DataFrame) -> None:
        self.names = df.columns
        self.df = df.toDF(*[f"sealed{i}" for i in range(len(self.names))])

    def __getitem__(self, name: str) -> str:
        if name in self.names:
            return f"sealed{self.names.index(name)}"
        return f"sealed{[n.lower() for n in self.names].index(name.lower())}"

    def reopen(self, df: DataFrame, replaced: dict[str, Column] | None = None, added: dict[str, Column] | None = None) -> DataFrame:
        replaced, added = replaced or {}, added or {}
        taken = {n.lower() for n in added}
        kept = [(replaced[n] if n in replaced else F.col(f"sealed{i}")).alias(n) for i, n in enumerate(self.names) if n.lower() not in taken]
        return df.select(*kept, *[v.alias(n) for n, v in added.items()])
