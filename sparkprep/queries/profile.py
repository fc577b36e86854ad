"""Profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkprep.functions.tables import global_running, nan_to_null, read, sample_rows
from sparkprep.operators import profile as P
from sparkprep.queries.base import Book

book = Book()
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: The same lineitem on both engines: nulls put in by rule.
HOLES = "SELECT * REPLACE (CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag) FROM lineitem"


def lineitem(spark, sf_dir):  # noqa: ANN001, ANN201
    df = nan_to_null(read(spark, sf_dir, "lineitem"))
    return df.withColumn("l_discount", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_discount"))).withColumn("l_returnflag", F.when(F.col("l_partkey") % 11 != 0, F.col("l_returnflag")))


def each(sql: str, columns: list[str], source: str = HOLES) -> str:
    """The SQL with {c} as each column, one after another."""
    return " UNION ALL ".join(sql.format(c=c, src=f"({source})") for c in columns)


COUNTS = """SELECT '{c}' AS "column", count(*) AS n_rows, count(*) - count({c}) AS n_missing, (count(*) - count({c})) / count(*)::DOUBLE AS missing_fraction,
  count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) / count({c})::DOUBLE AS cardinality_ratio, count(DISTINCT {c}) <= 1 AS is_constant FROM {src}"""
MOMENTS = """SELECT '{c}' AS "column", count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, var_samp({c}) AS variance, min({c})::DOUBLE AS minimum, max({c})::DOUBLE AS maximum,
  skewness({c}) AS skew, kurtosis({c}) AS kurtosis, avg(({c} = 0)::INT) AS zero_fraction, avg(({c} < 0)::INT) AS negative_fraction FROM {src}"""
QUANTILES = "SELECT '{c}' AS \"column\", " + ", ".join(f"quantile_cont({{c}}, {p})::DOUBLE AS q{round(p * 100):02d}" for p in P.QUANTILES) + " FROM {src}"
OUTLIERS = """SELECT '{c}' AS "column", min(lo) AS lower, min(hi) AS upper, count(*) FILTER (b > a AND ({c} < lo OR {c} > hi)) AS n_outliers,
  count(*) FILTER (b > a AND ({c} < lo OR {c} > hi)) / count({c})::DOUBLE AS outlier_fraction
  FROM (SELECT {c}, a, b, CASE WHEN b > a THEN a - 1.5 * (b - a) ELSE a END AS lo, CASE WHEN b > a THEN b + 1.5 * (b - a) ELSE b END AS hi
        FROM {src}, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {src}))"""
QS = " ".join(f"q{round(p * 100):02d}" for p in P.QUANTILES)

book.add("a1_column_counts", lambda s, d: P.column_counts(lineitem(s, d), [*NUMBERS, "l_returnflag", "l_linestatus"]), each(COUNTS, [*NUMBERS, "l_returnflag", "l_linestatus"]), "missing_fraction cardinality_ratio")
book.add("a2_moments", lambda s, d: P.moments(lineitem(s, d), NUMBERS), each(MOMENTS, NUMBERS), "mean std variance minimum maximum skew kurtosis zero_fraction negative_fraction")
book.add("a3_quantiles", lambda s, d: P.quantiles(lineitem(s, d), NUMBERS), each(QUANTILES, NUMBERS), QS)
book.add(
    "a3_quantiles_by_rank",
    lambda s, d: P.quantiles_by_rank(lineitem(s, d), "l_extendedprice"),
    " UNION ALL ".join(f"SELECT {p}::DOUBLE AS probability, quantile_cont(l_extendedprice, {p})::DOUBLE AS value FROM lineitem" for p in P.QUANTILES),
    "probability value",
)
book.add("a4_iqr_outliers", lambda s, d: P.iqr_outliers(lineitem(s, d), NUMBERS), each(OUTLIERS, NUMBERS), "lower upper outlier_fraction")
book.add(
    "a_profile_lineitem",
    lambda s, d: P.profile_table(lineitem(s, d), NUMBERS),
    f"""SELECT * FROM ({each(COUNTS, NUMBERS)}) JOIN (SELECT * EXCLUDE n FROM ({each(MOMENTS, NUMBERS)})) USING ("column") JOIN ({each(QUANTILES, NUMBERS)}) USING ("column") JOIN ({each(OUTLIERS, NUMBERS)}) USING ("column")""",
    f"missing_fraction cardinality_ratio mean std variance minimum maximum skew kurtosis zero_fraction negative_fraction {QS} lower upper outlier_fraction",
)
TOP = """SELECT '{c}' AS "column", row_number() OVER (ORDER BY count(*) DESC, {c}::VARCHAR)::INT AS place, {c}::VARCHAR AS value, count(*) AS n, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share
  FROM {src} WHERE {c} IS NOT NULL GROUP BY {c} QUALIFY place <= 12"""
book.add("a5_top_values", lambda s, d: P.top_values(lineitem(s, d), ["l_returnflag", "l_linenumber", "l_suppkey"]), each(TOP, ["l_returnflag", "l_linenumber", "l_suppkey"]), "share")
NZV = """SELECT '{c}' AS "column", n1 / n2::DOUBLE AS frequency_ratio, u AS unique_ratio, coalesce(d <= 1 OR (n1 / n2::DOUBLE > 19 AND u < 0.1) OR {flat}, false) AS near_zero_variance
  FROM (SELECT max(n) FILTER (k = 1) AS n1, max(n) FILTER (k = 2) AS n2 FROM (SELECT count(*) AS n, row_number() OVER (ORDER BY count(*) DESC) AS k FROM {src} WHERE {c} IS NOT NULL GROUP BY {c})),
       (SELECT count(DISTINCT {c}) AS d, count(DISTINCT {c}) / count({c})::DOUBLE AS u, {spread} FROM {src})"""
NZV_NUMBER = NZV.replace("{flat}", "coalesce(sd = 0 OR abs(sd / m) < 1e-4, false)").replace("{spread}", "stddev_samp({c}) AS sd, avg({c}) AS m")
NZV_TEXT = NZV.replace("{flat}", "false").replace("{spread}", "1 AS one")
book.add(
    "a6_near_zero_variance",
    lambda s, d: P.near_zero_variance(lineitem(s, d), ["l_quantity", "l_tax", "l_returnflag", "l_linestatus"]),
    each(NZV_NUMBER, ["l_quantity", "l_tax"]) + " UNION ALL " + each(NZV_TEXT, ["l_returnflag", "l_linestatus"]),
    "frequency_ratio unique_ratio",
)
STRINGS = r"""SELECT '{c}' AS "column", avg(length({c})) AS mean_length, max(length({c})) AS max_length, avg(len(regexp_extract_all({c}, '\S+'))) AS mean_tokens,
  count(*) FILTER (NOT regexp_matches({c}, '\S')) AS n_blank, count(*) FILTER (regexp_matches({c}, '^\s|\s$') AND regexp_matches({c}, '\S')) AS n_untrimmed FROM {src}"""
PADDED = "SELECT *, CASE WHEN p_partkey % 11 = 0 THEN ' ' || p_name || ' ' WHEN p_partkey % 13 = 0 THEN '  ' ELSE p_name END AS padded FROM part"
book.add(
    "a7_string_statistics",
    lambda s, d: P.string_statistics(
        read(s, d, "part").withColumn("padded", F.expr("CASE WHEN p_partkey % 11 = 0 THEN ' ' || p_name || ' ' WHEN p_partkey % 13 = 0 THEN '  ' ELSE p_name END")), ["p_name", "p_brand", "padded"]
    ),
    each(STRINGS, ["p_name", "p_brand", "padded"], PADDED),
    "mean_length mean_tokens",
)
book.add(
    "a8_temporal_statistics",
    lambda s, d: P.temporal_statistics(read(s, d, "orders"), "o_orderdate").withColumn("minimum", F.date_format("minimum", "yyyy-MM-dd")).withColumn("maximum", F.date_format("maximum", "yyyy-MM-dd")),
    """WITH t AS (SELECT DISTINCT o_orderdate AS t FROM orders), s AS (SELECT t, epoch(t) - epoch(lag(t) OVER (ORDER BY t)) AS step FROM t),
  m AS (SELECT step FROM s WHERE step IS NOT NULL GROUP BY step ORDER BY count(*) DESC, step LIMIT 1)
  SELECT strftime(min(t), '%Y-%m-%d') AS minimum, strftime(max(t), '%Y-%m-%d') AS maximum, (epoch(max(t)) - epoch(min(t))) / 86400.0 AS span_days, count(*) AS n_stamps,
    (SELECT step::DOUBLE FROM m) AS modal_step_seconds, count(*) FILTER (step > 1.5 * (SELECT step FROM m)) AS n_gaps, CASE WHEN (SELECT step FROM m) = 86400 THEN 'D' END AS frequency FROM s""",
    "span_days modal_step_seconds",
)
DUPLICATED = "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount FROM lineitem"
book.add(
    "a9_table_overview",
    lambda s, d: P.table_overview(lineitem(s, d).select("l_orderkey", "l_linenumber", "l_discount")),
    f"""SELECT count(*) AS n_rows, 3::BIGINT AS n_columns, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({DUPLICATED}))) AS n_duplicates,
  count(*) FILTER (l_discount IS NULL) AS n_missing_cells, count(*) FILTER (l_discount IS NULL) / (count(*) * 3)::DOUBLE AS missing_fraction FROM ({DUPLICATED})""",
    "missing_fraction",
)
MIXED = "CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' WHEN o_orderkey % 3 = 0 THEN '1,234.5' ELSE CAST(o_custkey AS STRING) END"
book.add(
    "a10_a11_number_text",
    lambda s, d: P.number_text(read(s, d, "orders").withColumn("mixed", F.expr(MIXED)).withColumn("number", F.col("o_custkey").cast("string")), ["mixed", "number", "o_orderstatus"]),
    each(
        """SELECT '{c}' AS "column", count({c}) AS n, count(try_cast(replace({c}, ',', '') AS DOUBLE)) AS n_numeric, count(try_cast(replace({c}, ',', '') AS DOUBLE)) / count({c})::DOUBLE AS numeric_fraction,
  count(try_cast(replace({c}, ',', '') AS DOUBLE)) BETWEEN 1 AND count({c}) - 1 AS mixed, count(try_cast(replace({c}, ',', '') AS DOUBLE)) >= 0.9 * count({c}) AS stored_as_text FROM {src}""",
        ["mixed", "number", "o_orderstatus"],
        f"SELECT o_orderstatus, {MIXED.replace('STRING', 'VARCHAR')} AS mixed, o_custkey::VARCHAR AS number FROM orders",
    ),
    "numeric_fraction",
)
book.add(
    "a12_class_counts",
    lambda s, d: P.class_counts(read(s, d, "events"), "event_type"),
    """SELECT event_type AS label, count(*) AS n, count(*) / (sum(count(*)) OVER ())::DOUBLE AS share, max(count(*)) OVER () / (min(count(*)) OVER ())::DOUBLE AS imbalance,
  max(count(*)) OVER () / (min(count(*)) OVER ())::DOUBLE > 3 AS imbalanced FROM events GROUP BY event_type""",
    "share imbalance",
)
book.add(
    "a19_group_statistics",
    lambda s, d: P.group_statistics(lineitem(s, d), ["l_returnflag", "l_linestatus"], ["l_extendedprice"], ["mean", "std", "min", "max", "sum", "count", "nunique", "median", "skew"]),
    f"""SELECT l_returnflag, l_linestatus, avg(l_extendedprice) AS l_extendedprice_mean, stddev_samp(l_extendedprice) AS l_extendedprice_std, min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max,
  sum(l_extendedprice) AS l_extendedprice_sum, count(l_extendedprice) AS l_extendedprice_count, count(DISTINCT l_extendedprice) AS l_extendedprice_nunique, quantile_cont(l_extendedprice, 0.5) AS l_extendedprice_median,
  skewness(l_extendedprice) AS l_extendedprice_skew FROM ({HOLES}) GROUP BY ALL""",
    " ".join(f"l_extendedprice_{x}" for x in ("mean", "std", "min", "max", "sum", "median", "skew")),
)
book.add(
    "t1_global_order",
    lambda s, d: global_running(read(s, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), [F.col("o_orderdate"), F.col("o_orderkey")], {"running_price": F.col("o_totalprice").cast("long")}, number="place").select("o_orderkey", "place", "running_price"),
    """SELECT o_orderkey, row_number() OVER w AS place, sum(trunc(o_totalprice)::BIGINT) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS running_price FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)""",

)
book.add("t6_sample_rows", lambda s, d: sample_rows(read(s, d, "orders"), 100, "o_orderkey").select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('0:' || o_orderkey::VARCHAR), o_orderkey LIMIT 100", "o_totalprice")

book.add(
    "a12_numeric_target",
    lambda s, d: P.target_summary(lineitem(s, d), "l_discount", 5),
    f"SELECT * FROM ({each(MOMENTS, ['l_discount'])}) JOIN ({each(QUANTILES, ['l_discount'])}) USING (\"column\")",
    "mean std variance minimum maximum skew kurtosis zero_fraction negative_fraction " + QS,
)


def reported(spark, sf_dir):  # noqa: ANN001, ANN201
    """The parts of a report on orders, each brought to (part, name, value)."""
    r = P.profile_report(read(spark, sf_dir, "orders"), "o_orderstatus", 3)
    parts = [
        r["table"].select(F.lit("table").alias("part"), F.lit("n_duplicates").alias("name"), F.col("n_duplicates").cast("double").alias("value")),
        r["columns"].select(F.lit("columns"), F.concat_ws(" ", "column", "kind"), F.col("n_distinct").cast("double")), r["top"].where("column = 'o_orderpriority'").select(F.lit("top"), "value", F.col("n").cast("double")),
        r["correlations"].select(F.lit("correlations"), F.concat_ws(" ", "a", "b"), "r"), r["target"].select(F.lit("target"), "label", F.col("n").cast("double")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_NUM = ("o_orderkey", "o_custkey", "o_totalprice")
book.add(
    "a18_report",
    reported,
    """WITH k AS (SELECT 'o_orderkey' AS c, count(DISTINCT o_orderkey) AS d, CASE WHEN count(DISTINCT o_orderkey) >= 0.999 * count(*) AND count(*) >= 20 THEN 'identifier' ELSE 'numeric_discrete' END AS kind FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), 'numeric_discrete' FROM orders
  UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus), 'categorical_nominal' FROM orders UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), 'numeric_continuous' FROM orders UNION ALL SELECT 'o_orderdate', count(DISTINCT o_orderdate), 'datetime' FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), 'categorical_nominal' FROM orders)
  SELECT 'table' AS part, 'n_duplicates' AS name, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)))::DOUBLE AS value FROM orders UNION ALL SELECT 'columns', c || ' ' || kind, d::DOUBLE FROM k
  UNION ALL (SELECT 'top', o_orderpriority, count(*)::DOUBLE FROM orders GROUP BY o_orderpriority ORDER BY count(*) DESC, o_orderpriority LIMIT 3) UNION ALL SELECT 'target', o_orderstatus, count(*)::DOUBLE FROM orders GROUP BY o_orderstatus UNION ALL """
    + " UNION ALL ".join(f"SELECT 'correlations', '{a} {b}', corr({a}, {b}) FROM orders" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :]),
    "value",
)
