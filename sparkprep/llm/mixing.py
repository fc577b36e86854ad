"""Mixing sources to target weights by Pareto order sampling.

Source weights turn into targets (water filling under a cap on repeats). Every
document of a source is taken ``floor(target / source_size)`` times for certain. The
words still needed are drawn as a sample of unequal inclusion probabilities: a longer
document is likelier to be drawn, ``p = min(1, level * appeal)`` with an appeal that
grows with its size over the source's mean size, and the level is such that the words
expected are the words needed. Documents of ``p = 1`` are certain once more; the
others are ranked by random odds over inclusion odds, ``u / (1 - u)`` divided by
``p / (1 - p)``, and the smallest ranks are taken until one more document would lead
away from the words needed, so the sample's size, in words, is fixed. Then one row a
source may change sides to come nearest. ``u`` is a digest of the seed, the id and the
text, so reruns agree under any partitioning.

Rows of the same id, text and source are one unit with a count; of a unit's rows any
number may be taken, and they can't be told apart. So a group of copies is one row
before anything is ordered. The running total over a source is never one window:
ranks fall into ``bins`` by their first digits, totals by bin are summed first, and only
the units of the bin in which the need is met are ordered one by one. The level comes
from sums by appeal, of which there are ``LEVELS`` a source.

Null, empty and blank texts have size 0 and are taken 0 times. A null source is a source
of its own, last in order. Rows of one id and different texts draw each for itself, null
ids too. Equal ranks are ordered by size, id and the text's digest. An empty table gives
an empty result. Extra columns are ignored. Built of DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkprep.llm import common as c

#: Steps of the appeal.
LEVELS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(c.WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, n_rows, target), one row a source, from (source, size, n).

    Sources in code point order, null last, weigh ``weights``, repeating. Targets
    share the total size by weight; a target stops at ``cap`` times its source's
    size and the excess is shared again by weight among the others. The windows
    here run over one row a source.
    """
    by_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n_rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("double")
    ranked = by_source.withColumn("weight", weight).withColumn("limit", F.lit(cap) * F.col("source_size"))
    # the first to reach their limits come first; levels fall from the first one at which the rest stay within their limits
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("all_weight", F.sum("weight").over(everything))
    level = (F.col("total") - F.coalesce(F.sum("limit").over(fill), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(fill), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(everything))
    target = F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    return ranked.select("source", "source_size", "n_rows", target.alias("target"))


def _levels(placed: DataFrame) -> DataFrame:
    """(source, level): with ``p = min(1, level * appeal)`` the words expected are the words needed. At most LEVELS rows a source are ordered."""
    by_appeal = placed.where("need > 0 and size > 0").groupBy("source", "appeal").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.max("need").alias("need"))
    above = Window.partitionBy("source").orderBy(F.desc("appeal")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("source").orderBy("appeal").rowsBetween(Window.unboundedPreceding, 0)
    certain = F.coalesce(F.sum("words").over(above), F.lit(0))  # those of more appeal are certain
    expected = F.sum(F.col("words") * F.col("appeal")).over(upto)
    tried = by_appeal.withColumn("level", (F.col("need") - certain) * LEVELS / expected)
    # of the levels at which this appeal is not above certainty the one of the largest appeal holds
    fits = tried.where(F.col("level") * F.col("appeal") <= LEVELS)
    return fits.groupBy(F.col("source").alias("l_source")).agg(F.max_by("level", "appeal").alias("level"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0, seed: str = "mix", bins: int = 4096
) -> DataFrame:
    """(id, text_key, size, source, source_size, target, inclusion, copies, taken): one row a row of docs.

    ``inclusion`` is the probability of a copy beyond the certain ones; ``text_key`` a digest of the text, which tells rows of one id apart.
    """
    name = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text_col), F.lit("")))
    unit = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("text_key"), word_count(F.col(text_col)).alias("size"), ((unit + 0.5) / 4503599627370496.0).alias("u"))
    units = c.durable(rows.groupBy("id", "source", "text_key", "size", "u").agg(F.count(F.lit(1)).alias("n")))
    targets = source_targets(units, weights, cap).withColumnRenamed("source", "t_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = units.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).withColumn("whole", F.floor(rate)).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    # size / (size + mean size), in steps
    scaled = F.col("size") * F.col("n_rows")
    placed = placed.withColumn("appeal", 1 + F.when(F.col("size") > 0, F.floor((scaled * (LEVELS - 1)) / (scaled + F.col("source_size")))).otherwise(0)).drop("t_source", "n_rows")
    placed = placed.join(_levels(placed), F.col("source").eqNullSafe(F.col("l_source")), "left").drop("l_source")
    drawn = (F.col("need") > 0) & (F.col("size") > 0)
    placed = placed.withColumn("part", F.when(drawn, F.least(F.lit(1.0), F.col("level") * F.col("appeal") / LEVELS)).otherwise(F.lit(0.0)))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("part") / (1 - F.col("part")))
    placed = placed.withColumn("rank", F.when(F.col("part") >= 1, F.lit(0.0)).when(F.col("part") > 0, odds)).withColumn("bin", F.when(F.col("part") >= 1, F.lit(-1)).otherwise(F.floor(F.col("rank") / (1 + F.col("rank")) * bins)))
    by_bin = placed.where("rank is not null").groupBy("source", "bin").agg(F.sum(F.col("size") * F.col("n")).alias("bin_size"), F.max("need").alias("need"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most bins + 1 rows a source
    by_bin = by_bin.withColumn("before", F.coalesce(F.sum("bin_size").over(upto), F.lit(0)))
    # a bin wholly below the need is taken, one above it is not, one across it is ordered by unit
    by_bin = by_bin.select(
        F.col("source").alias("b_source"),
        F.col("bin").alias("b_bin"),
        "before",
        F.when((F.col("bin") < 0) | (F.col("before") + F.col("bin_size") <= F.col("need")), "all").when(F.col("before") >= F.col("need"), "none").otherwise("some").alias("state"),
    )
    placed = placed.join(by_bin, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("bin") == F.col("b_bin")), "left")
    within = Window.partitionBy("source").orderBy("rank", "size", "id", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    some = placed.where("state = 'some'").withColumn("ahead", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(within), F.lit(0)))
    # of a unit's rows as many are taken as bring the total nearest the need
    some = some.withColumn("extra", F.least(F.col("n"), F.greatest(F.lit(0), F.floor((F.col("need") - F.col("ahead")) / F.col("size") + 0.5)))).drop("ahead")
    rest = placed.where("state is null or state != 'some'").withColumn("extra", F.when(F.col("state") == "all", F.col("n")).otherwise(F.lit(0).cast("long")))
    ranked = c.durable(rest.unionByName(some).select("id", "text_key", "size", "n", "source", "source_size", "target", "whole", "need", "part", "rank", "extra"))
    settled = _settle(ranked).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = F.when(F.col("size") > 0, F.col("whole") + (F.col("nth") <= F.col("extra")).cast("long")).otherwise(0).cast("long")
    return settled.select(F.col("id").alias(id_col), "text_key", "size", "source", "source_size", "target", F.col("part").alias("inclusion"), copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def _settle(ranked: DataFrame) -> DataFrame:
    """One row a source changes sides where that brings the words taken nearest the target; it matters for small sources with a long document at the cut."""
    drawn = ranked.where("rank is not null")
    gaps = drawn.groupBy("source").agg((F.max("need") - F.sum(F.col("extra") * F.col("size"))).alias("gap")).withColumnRenamed("source", "g_source")
    off = F.abs(F.abs("gap") - F.col("size"))
    moves = (
        drawn.join(gaps, F.col("source").eqNullSafe(F.col("g_source")))
        .where(F.when(F.col("gap") > 0, F.col("extra") < F.col("n")).otherwise(F.col("extra") > 0) & (off < F.abs("gap")))
        .groupBy("source")
        .agg(F.min(F.struct(off.alias("off"), "rank", "size", "id", "text_key", (F.signum("gap").cast("long")).alias("step"))).alias("move"))
        .select(F.col("source").alias("m_source"), F.col("move.id").alias("m_id"), F.col("move.text_key").alias("m_key"), F.col("move.step").alias("step"))
    )
    moved = ranked.join(moves, F.col("source").eqNullSafe(F.col("m_source")), "left")
    same = F.col("rank").isNotNull() & F.col("id").eqNullSafe(F.col("m_id")) & (F.col("text_key") == F.col("m_key"))
    return moved.withColumn("extra", F.when(F.coalesce(same, F.lit(False)), F.col("extra") + F.col("step")).otherwise(F.col("extra")))


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(c.read(spark, sf_dir, "documents")).select("doc_id", "size", "source", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (count(*) FILTER (size > 0))::BIGINT AS n_rows, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum(3.0::DOUBLE * source_size) OVER w, 0) AS caps, coalesce(sum(weight) OVER w, 0) AS ws
  FROM s WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT *, (total - caps) / (all_weight - ws) AS lvl FROM f
), t AS (
  SELECT source, source_size, n_rows, least(cap, coalesce(max(CASE WHEN lvl * weight <= cap THEN lvl END) OVER () * weight, cap)) AS target FROM g
), p AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(target / t.source_size) ELSE 0 END AS whole,
         1 + CASE WHEN size > 0 THEN floor((size * n_rows * 63)::DOUBLE / (size * n_rows + t.source_size)::DOUBLE)::BIGINT ELSE 0 END AS appeal
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, target - whole * source_size AS need FROM p
), ap AS (
  SELECT source, appeal, sum(size)::BIGINT AS words, max(need) AS need FROM q WHERE need > 0 AND size > 0 GROUP BY ALL
), tr AS (
  SELECT source, appeal,
         (need - coalesce(sum(words) OVER (PARTITION BY source ORDER BY appeal DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) * 64
         / (sum(words * appeal) OVER (PARTITION BY source ORDER BY appeal ROWS UNBOUNDED PRECEDING))::BIGINT AS level
  FROM ap
), lv AS (
  SELECT source, arg_max(level, appeal) AS level FROM tr WHERE level * appeal <= 64 GROUP BY source
), pr AS (
  SELECT q.*, CASE WHEN need > 0 AND size > 0 THEN least(1.0::DOUBLE, level * appeal / 64) ELSE 0 END AS part FROM q LEFT JOIN lv ON q.source IS NOT DISTINCT FROM lv.source
), r AS (
  SELECT *, CASE WHEN part >= 1 THEN 0.0::DOUBLE WHEN part > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS rk FROM pr
), c AS (
  SELECT *, sum(CASE WHEN rk IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rk NULLS LAST, size, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM r
), e AS (
  SELECT *, CASE WHEN rk IS NOT NULL AND (part >= 1 OR upto - size / 2.0::DOUBLE <= need) THEN 1 ELSE 0 END AS extra FROM c
), gap AS (
  SELECT source, max(need) - sum(extra * size) AS gap FROM e WHERE rk IS NOT NULL GROUP BY source
), mv AS (
  SELECT e.source, e.doc_id, row_number() OVER (PARTITION BY e.source ORDER BY abs(abs(gap) - size), rk, size, doc_id) AS k
  FROM e JOIN gap ON e.source IS NOT DISTINCT FROM gap.source
  WHERE rk IS NOT NULL AND (CASE WHEN gap > 0 THEN extra = 0 ELSE extra = 1 END) AND abs(abs(gap) - size) < abs(gap)
)
SELECT e.doc_id, size, e.source, source_size, target,
       (CASE WHEN size > 0 THEN (whole + CASE WHEN mv.doc_id IS NOT NULL THEN 1 - extra ELSE extra END) * size ELSE 0 END)::BIGINT AS taken
FROM e LEFT JOIN mv ON e.doc_id = mv.doc_id AND e.source IS NOT DISTINCT FROM mv.source AND mv.k = 1
"""
