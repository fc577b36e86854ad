"""Exact top-k by inner product over an impact-ordered index, score at a time.

Vectors are dealt into blocks of about ``block`` rows and queries into blocks of
``query_block``; each pair of blocks is one task's unit, so both sides are bounded
and every query meets every row. A block's index is built once a block of queries. In it
each dimension's rows are sorted by value and cut into ``levels`` posting segments of one quantised
impact, the segment's least and greatest value. For a query the segments of all dimensions
are processed by descending impact, the most they can add or take away. A row's score is then
bounded by the segments it was met in, plus, for the dimensions in which it was not,
the product of what is left of the query's and of the row's own length
(Cauchy-Schwarz). Processing stops only when
it is proven that no more than ``slack`` times k rows can still be among the best k,
or when no segment is left; the rows that still can be are scored exactly.

Components become floor(scale * x) with x as double; inner products are integers in
64 bits. A vector that is null, or holds a null or non-finite component, takes no
part. A shorter vector counts as ending in zeros. Ties go to the smaller id. Rows
that share an id are candidates each; a query leaves out all rows of its own id, and queries
of one id that differ are one query, whose best k are the best of all of theirs. Repeated queries
are asked once. An empty table, or one without a query, gives an empty result. Extra columns are ignored.
Where sums could leave the exact doubles, no bound is taken and all rows are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.llm import common as c


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v array<bigint>) of the vectors that take part."""
    sound = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


class ImpactIndex:
    """Posting segments of one block of vectors: by dimension and level, rows and the least and greatest value."""

    def __init__(self, vectors: np.ndarray, levels: int) -> None:
        self.vectors = vectors
        n, d = vectors.shape
        order = np.argsort(vectors, axis=0, kind="stable")
        cuts = np.unique(np.linspace(0, n, min(levels, n) + 1).astype(int))
        self.rows = order.T.ravel()  # dimension by dimension, by value
        self.lengths = np.tile(np.diff(cuts), d)
        self.ends = np.cumsum(self.lengths)
        self.dims = np.repeat(np.arange(d), len(cuts) - 1)
        ordered = np.take_along_axis(vectors, order, axis=0).T.astype(np.float64)
        self.low, self.high = ordered[:, cuts[:-1]].ravel(), ordered[:, cuts[1:] - 1].ravel()
        self.impact = np.maximum(np.abs(self.low), np.abs(self.high))
        #: The least square a row of the segment has in its dimension.
        self.sure = np.where(self.low * self.high <= 0, 0.0, np.minimum(np.abs(self.low), np.abs(self.high))) ** 2
        self.energy = (vectors.astype(np.float64) ** 2).sum(axis=1)

    def possible(self, query: np.ndarray, k: int, slack: int, steps: int = 8) -> np.ndarray:
        """Rows that can be among the k best of this block, by proof."""
        n, d = self.vectors.shape
        whole = query.astype(np.float64)
        q, length = whole[self.dims], float((whole**2).sum())
        if n <= k * slack or not d or max(length, self.energy.max()) >= 2.0**51 or (np.abs(q) * self.impact).sum() >= 2.0**51:
            return np.arange(n)
        least, most = np.minimum(q * self.low, q * self.high), np.maximum(q * self.low, q * self.high)
        lower, upper = np.zeros(n), np.zeros(n)
        query_left, row_left = np.full(n, length), self.energy.copy()
        order = np.argsort(-np.abs(q) * self.impact, kind="stable")
        for part in np.array_split(order, steps):
            lengths = self.lengths[part]
            within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            rows = self.rows[np.repeat(self.ends[part] - lengths, lengths) + within]
            for sums, add in ((lower, least), (upper, most), (query_left, -(q**2)), (row_left, -self.sure)):
                sums += np.bincount(rows, weights=np.repeat(add[part], lengths), minlength=n)
            left = np.sqrt(np.maximum(query_left, 0) * np.maximum(row_left, 0)) * (1 + 1e-9) + 1e-3
            left[query_left < 0.5] = 0.0  # met in every dimension that counts
            can = np.flatnonzero(upper + left >= np.partition(lower - left, n - k)[n - k])
            if len(can) <= k * slack:
                break
        return can


def _search(k: int, levels: int, slack: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in c.by_runs(batches, "unit"):
            is_query = unit.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
            ids = unit.column("id").to_numpy()
            flat = unit.column("v").combine_chunks()
            flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
            sizes = np.diff(flat.offsets.to_numpy())
            width = int(sizes.max(initial=0))
            values = np.zeros((len(ids), width), dtype=np.int64)
            values[np.arange(width)[None, :] < sizes[:, None]] = flat.flatten().to_numpy()
            own_ids, index = ids[~is_query], ImpactIndex(values[~is_query], levels) if (~is_query).any() else None
            if index is None:
                continue
            out: list[list] = [[], [], []]
            for qid, q in zip(ids[is_query].tolist(), values[is_query], strict=True):
                same = int((own_ids == qid).sum())
                rows = index.possible(q, min(len(own_ids), k + same), slack)
                rows = rows[own_ids[rows] != qid]
                score = index.vectors[rows] @ q
                best = np.lexsort((own_ids[rows], -score))[:k]
                out[0] += [qid] * len(best)
                out[1] += own_ids[rows[best]].tolist()
                out[2] += score[best].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "id", "score"])

    return run


def exact_top_k(
    vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, block: int = 4096, query_block: int = 16_384, levels: int = 64, slack: int = 8
) -> DataFrame:
    """(query_id, rank, id, score) of the rows for which ``queries`` holds, against all rows."""
    whole = integer_vectors(vectors, id_col, vector_col, scale)
    asked = integer_vectors(vectors.where(queries), id_col, vector_col, scale).distinct()
    n, m = whole.count(), asked.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // query_block))

    def upto(n: int) -> Column:
        return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))

    # every row's block meets every block of queries
    rows = whole.select("id", "v", F.lit(0).alias("is_query"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).alias("b"), F.explode(upto(query_blocks)).alias("qb"))
    ask = asked.select("id", "v", F.lit(1).alias("is_query"), F.explode(upto(blocks)).alias("b"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(query_blocks)).alias("qb"))
    units = rows.unionByName(ask).withColumn("unit", F.col("b") * query_blocks + F.col("qb")).select("unit", "is_query", "id", "v")
    found = units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_search(k, levels, slack), "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op7_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(c.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::DOUBLE) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
