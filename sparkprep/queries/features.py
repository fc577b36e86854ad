"""Feature queries: dates, arithmetic, text, encoders, scalers, selectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkprep.functions import scalar as S
from sparkprep.functions import text as X
from sparkprep.functions.tables import read
from sparkprep.operators import encode as E
from sparkprep.plans.prepare import Preparation, apply_features, fit_features
from sparkprep.queries.base import Book

book = Book()
ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderkey % 5 AS fold, CAST(o_orderstatus = 'F' AS INT) AS y, o_orderstatus FROM {orders}"
DUCK = f"({ORDERS.format(orders='orders')})"


def orders(spark, sf_dir):  # noqa: ANN001, ANN201
    return spark.sql(ORDERS, orders=read(spark, sf_dir, "orders"))


PARTS = [*S.BASIC_PARTS, "dayofyear", "is_month_start", "is_month_end", "is_quarter_start", "is_quarter_end", "epoch_days", "hour", "minute", "second"]
PART_SQL = {
    "year": "year(ts)", "month": "month(ts)", "day": "day(ts)", "dayofweek": "isodow(ts) - 1", "quarter": "quarter(ts)", "week": "week(ts)", "is_weekend": "(isodow(ts) >= 6)::INT", "dayofyear": "dayofyear(ts)",
    "is_month_start": "(day(ts) = 1)::INT", "is_month_end": "(ts::DATE = last_day(ts::DATE))::INT", "is_quarter_start": "(ts::DATE = date_trunc('quarter', ts)::DATE)::INT",
    "is_quarter_end": "(ts::DATE = (date_trunc('quarter', ts) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE)::INT", "epoch_days": "(ts::DATE - DATE '1970-01-01')", "hour": "hour(ts)", "minute": "minute(ts)", "second": "second(ts)",
}
book.add("d1_decompose_date", lambda s, d: S.decompose_date(read(s, d, "events"), "ts", PARTS)[0].select("event_id", *[F.col(f"ts_{p}").cast("long").alias(f"ts_{p}") for p in PARTS]), "SELECT event_id, " + ", ".join(f"({PART_SQL[p]})::BIGINT AS ts_{p}" for p in PARTS) + " FROM events")
book.add(
    "d2_cyclical",
    lambda s, d: S.cyclical(S.cyclical(read(s, d, "events").select("event_id", "ts"), "ts", "hour"), "ts", "dayofweek").drop("ts"),
    "SELECT event_id, sin(2 * pi() / 24 * hour(ts)) AS ts_hour_sin, cos(2 * pi() / 24 * hour(ts)) AS ts_hour_cos, sin(2 * pi() / 7 * (isodow(ts) - 1)) AS ts_dayofweek_sin, cos(2 * pi() / 7 * (isodow(ts) - 1)) AS ts_dayofweek_cos FROM events",
    "ts_hour_sin ts_hour_cos ts_dayofweek_sin ts_dayofweek_cos",
)
LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
book.add(
    "m1_ratio",
    lambda s, d: S.ratio(read(s, d, "lineitem"), "l_extendedprice", "l_discount", "r").select(*LINE.split(", "), "r"),
    f"SELECT {LINE}, l_extendedprice / nullif(l_discount, 0) AS r FROM lineitem",
    "r",
)
book.add(
    "m2_interaction",
    lambda s, d: S.interaction(S.interaction(read(s, d, "lineitem"), ["l_quantity", "l_tax"], True, "product"), ["l_returnflag", "l_linestatus"], False, "crossed").select(*LINE.split(", "), "product", "crossed"),
    f"SELECT {LINE}, l_quantity * l_tax AS product, l_returnflag || '|' || l_linestatus AS crossed FROM lineitem",
    "product",
)
book.add(
    "m3_polynomial",
    lambda s, d: S.polynomial(read(s, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 3).drop("p_size", "p_retailprice"),
    "SELECT p_partkey, pow(p_size, 2) AS p_size_pow2, pow(p_size, 3) AS p_size_pow3, pow(p_retailprice, 2) AS p_retailprice_pow2, pow(p_retailprice, 3) AS p_retailprice_pow3, p_size * p_retailprice AS p_size_x_p_retailprice FROM part",
    "p_size_pow2 p_size_pow3 p_retailprice_pow2 p_retailprice_pow3 p_size_x_p_retailprice",
)
book.add(
    "m4_m5_log_sqrt",
    lambda s, d: S.sqrt_transform(S.log_transform(S.log_transform(read(s, d, "customer").withColumn("key", F.col("c_custkey")), "c_acctbal"), "key"), "c_acctbal").select("c_custkey", "c_acctbal_log", "key_log", "c_acctbal_sqrt"),
    "SELECT c_custkey, sign(c_acctbal) * ln(1 + abs(c_acctbal)) AS c_acctbal_log, ln(1 + c_custkey) AS key_log, sign(c_acctbal) * sqrt(abs(c_acctbal)) AS c_acctbal_sqrt FROM customer",
    "c_acctbal_log key_log c_acctbal_sqrt",
)
book.add(
    "m7_great_circle",
    lambda s, d: S.geo_distance(read(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 170 - 85).alias("lat"), (F.col("c_custkey") * 7 % 360 - 180).alias("lon")), "lat", "lon")[0].select("c_custkey", "distance_km"),
    """WITH p AS (SELECT c_custkey, (c_custkey % 170 - 85)::DOUBLE AS lat, (c_custkey * 7 % 360 - 180)::DOUBLE AS lon FROM customer), m AS (SELECT avg(lat) AS a, avg(lon) AS b FROM p)
  SELECT c_custkey, 2 * 6371.0088 * asin(sqrt(pow(sin((radians(a) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(a)) * pow(sin((radians(b) - radians(lon)) / 2), 2))) AS distance_km FROM p, m""",
    "distance_km",
)
book.add(
    "x1_text_length",
    lambda s, d: S.text_length(read(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text")), "text").drop("text"),
    r"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE length(text) END AS text_chars, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) END AS text_words FROM documents",
)
book.add(
    "x2_tfidf_terms",
    lambda s, d: X.tfidf_terms(read(s, d, "documents"), "text", max_features=50, ngram_max=1, stop_words=())[0],
    r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
  f AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY term HAVING count(DISTINCT doc_id) >= 2 ORDER BY tf DESC, term LIMIT 50)
  SELECT term, df, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1 AS idf FROM f""",
    "idf",
)
book.add(
    "x4_semantic_type",
    lambda s, d: X.semantic_types(read(s, d, "pages").select("url", F.concat(F.col("page_id").cast("string"), F.lit("@x.org")).alias("mail"), F.concat(F.col("page_id") % 99, F.lit("%")).alias("rate"), F.col("html").alias("head"))),
    " UNION ALL ".join(
        f"SELECT '{name}' AS \"column\", CASE WHEN m >= {least} THEN '{kind}' END AS semantic_type, CASE WHEN m >= {least} THEN m END AS match_fraction FROM (SELECT avg(regexp_matches({value}, '{X.PATTERNS[kind]}')::INT) AS m FROM pages)"
        for name, value, kind, least in (("url", "url", "url", 0.85), ("mail", "page_id || '@x.org'", "email", 0.85), ("rate", "page_id % 99 || '%'", "percentage", 0.85), ("head", "html", "url", 0.85))
    ),
    "match_fraction",
)
book.add(
    "e1_one_hot",
    lambda s, d: E.one_hot(o := orders(s, d), "priority", E.fit_levels(o, "priority", 3)).select("o_orderkey", *[F.col(f"`priority={v}`").alias(f"p{i}") for i, v in enumerate(E.fit_levels(o, "priority", 3))], F.col("`priority=infrequent`").alias("other")),
    f"""WITH v AS (SELECT priority, row_number() OVER (ORDER BY count(*) DESC, priority) AS k FROM {DUCK} WHERE priority IS NOT NULL GROUP BY priority QUALIFY k <= 3)
  SELECT o_orderkey, (priority IS NULL OR coalesce(o.k = 1, false))::INT AS p0, coalesce(o.k = 2, false)::INT AS p1, coalesce(o.k = 3, false)::INT AS p2, (o.k IS NULL AND priority IS NOT NULL)::INT AS other
  FROM (SELECT d.o_orderkey, d.priority, v.k FROM {DUCK} d LEFT JOIN v USING (priority)) o""",
)
book.add(
    "e2_ordinal",
    lambda s, d: E.ordinal(orders(s, d), "priority", ["1-URGENT", "2-HIGH", "3-MEDIUM"]).select("o_orderkey", "priority_ordinal"),
    f"SELECT o_orderkey, (coalesce(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], priority), 0) - 1)::BIGINT AS priority_ordinal FROM {DUCK}",
)
book.add(
    "e3_target_encode_folds",
    lambda s, d: E.target_encode_out_of_fold(orders(s, d), "priority", "y", "fold").select("o_orderkey", "priority_target"),
    f"""WITH o AS (SELECT *, coalesce(priority, '__MISSING__') AS k FROM {DUCK}), b AS (SELECT k, fold, sum(y) AS s, count(y) AS n FROM o GROUP BY ALL),
  t AS (SELECT b.k, b.fold, sum(x.s) FILTER (x.fold <> b.fold) AS s, sum(x.n) FILTER (x.fold <> b.fold) AS n FROM b JOIN b x USING (k) GROUP BY b.k, b.fold),
  p AS (SELECT f.fold, avg(y) AS prior FROM (SELECT DISTINCT fold FROM o) f JOIN o ON o.fold <> f.fold GROUP BY f.fold)
  SELECT o_orderkey, (coalesce(s, 0) + 10 * prior) / (coalesce(n, 0) + 10) AS priority_target FROM o JOIN t USING (k, fold) JOIN p USING (fold)""",
    "priority_target",
)
book.add(
    "e3_j1_target_encode_map",
    lambda s, d: E.look_up(o := orders(s, d), "o_custkey", E.fit_target_means(o.where("fold != 0"), "o_custkey", "y")[0], "encoded", "encoded", E.fit_target_means(o.where("fold != 0"), "o_custkey", "y")[1]).select("o_orderkey", "encoded"),
    f"""WITH o AS (SELECT * FROM {DUCK}), p AS (SELECT avg(y) AS prior FROM o WHERE fold <> 0), m AS (SELECT o_custkey, (sum(y) + 10 * any_value(prior)) / (count(y) + 10) AS e FROM o, p WHERE fold <> 0 GROUP BY o_custkey)
  SELECT o_orderkey, coalesce(e, prior) AS encoded FROM o LEFT JOIN m USING (o_custkey), p""",
    "encoded",
)
book.add(
    "e4_frequency_encode",
    lambda s, d: E.frequency_encode(o := orders(s, d), "priority", E.fit_frequencies(o, "priority")).select("o_orderkey", "priority_frequency"),
    f"SELECT o_orderkey, count(*) OVER (PARTITION BY priority) / (count(*) OVER ())::DOUBLE AS priority_frequency FROM {DUCK}",
    "priority_frequency",
)
book.add("e5_hash_encode", lambda s, d: E.hash_encode(orders(s, d), "priority", 8, expand=False).select("o_orderkey", "priority_hash"), f"SELECT o_orderkey, ('0x' || substr(md5(coalesce(priority, '__MISSING__')), 1, 8))::BIGINT % 8 AS priority_hash FROM {DUCK}")
book.add(
    "e6_bins_quantile",
    lambda s, d: E.bin_codes(o := orders(s, d), "price", E.fit_bins(o, "price", 4)).select("o_orderkey", "price_bin"),
    f"SELECT o_orderkey, ((price >= a)::INT + (price >= b)::INT + (price >= c)::INT) AS price_bin FROM {DUCK}, (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.5) AS b, quantile_cont(price, 0.75) AS c FROM {DUCK})",
)
book.add(
    "e6_bins_uniform",
    lambda s, d: E.bin_codes(p := read(s, d, "part"), "p_size", E.fit_bins(p, "p_size", 7, "uniform")).select("p_partkey", "p_size_bin"),
    "SELECT p_partkey, least(6, floor((p_size - a) / ((b - a) / 7.0)))::INT AS p_size_bin FROM part, (SELECT min(p_size) AS a, max(p_size) AS b FROM part)",
)
FILLED = f"(SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM {DUCK})) AS x FROM {DUCK})"
for method, centre, spread in (("standard", "avg(x)", "stddev_pop(x)"), ("minmax", "min(x)", "max(x) - min(x)"), ("robust", "quantile_cont(x, 0.5)", "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)")):
    book.add(
        f"e7_scale_{method}",
        lambda s, d, method=method: E.scale(o := orders(s, d), E.fit_scaler(o, ["price"], method)).select("o_orderkey", "price"),
        f"SELECT o_orderkey, (x - c) / w AS price FROM {FILLED}, (SELECT {centre} AS c, {spread} AS w FROM {FILLED})",
        "price",
    )
book.add(
    "e10_anova_f",
    lambda s, d: E.anova_f(orders(s, d), ["o_totalprice", "price"], "o_orderstatus"),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) AS f FROM (SELECT count({c}) AS n, avg({c}) AS m, var_pop({c}) * count({c}) AS w FROM {DUCK} GROUP BY o_orderstatus), (SELECT avg({c}) AS g FROM {DUCK})"""
        for c in ("o_totalprice", "price")
    ),
    "f",
)
book.add(
    "e10_regression_f",
    lambda s, d: E.regression_f(orders(s, d), ["o_custkey", "price"], "o_totalprice").where("column = 'o_custkey'"),
    f"SELECT 'o_custkey' AS \"column\", pow(corr(o_custkey, o_totalprice), 2) * (count(*) - 2) / (1 - pow(corr(o_custkey, o_totalprice), 2)) AS f FROM {DUCK}",
    "f",
)
book.add(
    "e11_low_variance",
    lambda s, d: s.createDataFrame([(c,) for c in E.low_variance_columns(read(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], 0.01)], "column string"),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\" FROM lineitem HAVING var_pop({c}) <= 0.01" for c in ("l_quantity", "l_discount", "l_tax")),
)
book.add(
    "j2_group_profile",
    lambda s, d: E.group_profile(o := orders(s, d), "o_custkey", "price", ["mean", "count"], o.where("fold != 0")).select("o_orderkey", "price_by_o_custkey_mean", "price_by_o_custkey_count"),
    f"""SELECT o_orderkey, m AS price_by_o_custkey_mean, n AS price_by_o_custkey_count FROM {DUCK} LEFT JOIN (SELECT o_custkey, avg(price) AS m, count(price) AS n FROM {DUCK} WHERE fold <> 0 GROUP BY 1) USING (o_custkey)""",
    "price_by_o_custkey_mean",
)


# transforms fitted on all rows
GRID = ", ".join(f"quantile_cont(price, {k / 4}) AS g{k}" for k in range(5))
book.add(
    "e8_quantile_transform",
    lambda s, d: E.quantile_transform(o := orders(s, d), "price", E.fit_quantile_grid(o, "price", 4), normal=False).select("o_orderkey", "price_quantile"),
    f"""SELECT o_orderkey, CASE WHEN price IS NULL THEN NULL WHEN price < g1 THEN (price - g0) / (g1 - g0) / 4 WHEN price < g2 THEN 0.25 + (price - g1) / (g2 - g1) / 4 WHEN price < g3 THEN 0.5 + (price - g2) / (g3 - g2) / 4 ELSE 0.75 + (price - g3) / (g4 - g3) / 4 END AS price_quantile
  FROM {DUCK}, (SELECT {GRID} FROM {DUCK})""",
    "price_quantile",
)
book.add(
    "e8_quantile_normal_scores",
    lambda s, d: E.quantile_transform(o := orders(s, d), "price", E.fit_quantile_grid(o, "price")).select("o_orderkey", "price_quantile"),
)
book.add("m6_power_transform", lambda s, d: E.power_transform(o := orders(s, d), "o_totalprice", E.fit_power(o, "o_totalprice")).select("o_orderkey", "o_totalprice_power"))
book.add(
    "e9_pca",
    lambda s, d: E.pca(read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_quantity") * F.col("l_quantity")).alias("square")), ["l_quantity", "square"], 1)[0].select("l_orderkey", "l_linenumber", "pca_1"),
    "SELECT l_orderkey, l_linenumber, ((l_quantity - a) / s + (l_quantity * l_quantity - b) / t) / sqrt(2) AS pca_1 FROM lineitem, (SELECT avg(l_quantity) AS a, stddev_samp(l_quantity) AS s, avg(l_quantity * l_quantity) AS b, stddev_samp(l_quantity * l_quantity) AS t FROM lineitem)",
    "pca_1",
)
TURN = "(SELECT 0.5 * atan2(2 * sum(l_quantity * l_tax), sum(l_quantity * l_quantity) - sum(l_tax * l_tax)) AS w FROM lineitem)"
book.add(
    "e9_truncated_svd",
    lambda s, d: E.truncated_svd(read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"], 1)[0].select("l_orderkey", "l_linenumber", "svd_1"),
    f"SELECT l_orderkey, l_linenumber, cos(w) * l_quantity + sin(w) * l_tax AS svd_1 FROM lineitem, {TURN}",
    "svd_1",
)
book.add(
    "x2_tfidf_weights",
    lambda s, d: X.tfidf(t := read(s, d, "documents"), "text", "doc_id", X.tfidf_terms(t, "text", max_features=20, stop_words=())[0], stop_words=()),
    r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
  f AS (SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY term HAVING count(DISTINCT doc_id) >= 2 ORDER BY count(*) DESC, term LIMIT 20),
  r AS (SELECT doc_id, term, (1 + ln(count(*))) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + any_value(df))::DOUBLE) + 1) AS raw FROM t JOIN f USING (term) GROUP BY ALL)
  SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM r""",
    "weight",
)
book.add(
    "x5_datetime_likeness",
    lambda s, d: X.datetime_likeness(read(s, d, "orders").select(F.when(F.col("o_orderkey") % 9 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon").alias("day"), F.col("o_orderpriority").alias("order_date"))),
    """SELECT 'day' AS "column", avg((o_orderkey % 9 <> 0)::INT) AS shape_fraction, avg((o_orderkey % 9 <> 0)::INT) AS parse_fraction, avg((o_orderkey % 9 <> 0)::INT) >= 0.85 AS is_datetime FROM orders
  UNION ALL SELECT 'order_date', avg(regexp_matches(o_orderpriority, '^\\s*([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4})')::INT), 0.0, false FROM orders""",
    "shape_fraction parse_fraction",
)
SIZED = "CASE WHEN p_size < 17 THEN ' Small' WHEN p_size < 34 THEN 'MEDIUM' ELSE 'large' END"


def vocabularies(spark, sf_dir):  # noqa: ANN001, ANN201
    p = read(spark, sf_dir, "part").selectExpr(f"{SIZED} AS sized", "p_brand AS brand", "CASE WHEN p_size > 25 THEN 'yes' ELSE 'no' END AS big")
    return spark.createDataFrame([(c, *X.vocabulary_of(p, c)) for c in p.columns], "column string, vocabulary string, levels array<string>").select("column", "vocabulary", F.concat_ws(",", "levels").alias("levels"))


book.add(
    "x6_vocabulary",
    vocabularies,
    f"""SELECT 'sized' AS "column", CASE WHEN bool_and(v IN ('small', 'medium', 'large')) AND count(DISTINCT v) >= 2 THEN 'ordinal' END AS vocabulary, string_agg(DISTINCT v, ',' ORDER BY list_position(['small', 'medium', 'large'], v)) AS levels FROM (SELECT lower(trim({SIZED})) AS v FROM part)
  UNION ALL SELECT 'brand', CASE WHEN bool_and(lower(p_brand) IN ('yes', 'no', 'true', 'false')) THEN 'boolean' END, '' FROM part
  UNION ALL SELECT 'big', CASE WHEN count(DISTINCT v) <= 2 THEN 'boolean' END, string_agg(DISTINCT v, ',' ORDER BY v) FROM (SELECT CASE WHEN p_size > 25 THEN 'yes' ELSE 'no' END AS v FROM part)""",
)


def planned(spark, sf_dir):  # noqa: ANN001, ANN201
    """A feature plan with features of several columns, a group's mean, words' weights and a selection, fitted on four folds and applied to the fifth."""
    o = orders(spark, sf_dir)
    decisions = [
        {"op": "ratio", "columns": ["o_totalprice", "o_custkey"]}, {"op": "interaction", "columns": ["o_custkey", "fold"]}, {"op": "polynomial", "columns": ["fold"], "degree": 2}, {"op": "interaction", "columns": ["o_orderstatus", "one"]},
        {"op": "group_aggregate", "columns": ["o_totalprice"], "by": "o_orderstatus", "statistics": ["mean"]}, {"op": "log_transform", "columns": ["one"]}, {"op": "variance_threshold", "threshold": 0.0},
    ]
    o = o.withColumn("one", F.lit(1))
    frozen, notes = fit_features(o.where("fold != 0"), decisions)
    made, names = apply_features(o.where("fold = 0"), frozen)
    assert not notes and "one_log" not in names, notes
    return made.select("o_orderkey", F.col("o_totalprice_over_o_custkey").alias("ratio"), F.col("o_custkey_x_fold").alias("product"), F.col("`o_orderstatus_x_one=F|1`").cast("int").alias("crossed"), F.col("o_totalprice_by_o_orderstatus_mean").alias("group_mean"))


book.add(
    "e12_feature_plan",
    planned,
    f"""WITH o AS (SELECT * FROM {DUCK}), g AS (SELECT o_orderstatus, avg(o_totalprice) AS m FROM o WHERE fold <> 0 GROUP BY 1)
  SELECT o_orderkey, o_totalprice / nullif(o_custkey, 0) AS ratio, (o_custkey * fold)::DOUBLE AS product, (o_orderstatus = 'F')::INT AS crossed, m AS group_mean FROM o JOIN g USING (o_orderstatus) WHERE fold = 0""",
    "ratio product group_mean",
)


def coded(spark, sf_dir, target: bool):  # noqa: ANN001, ANN201
    """Target encoding in a preparation of a label by chance: as all rows get it from the model, or how it goes with the label on training rows."""
    o = orders(spark, sf_dir).select("o_orderkey", "o_custkey", (F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 4), 16, 10).cast("long") % 2).cast("double").alias("chance"))
    model, trained = Preparation((), [{"op": "target_encode", "columns": ["o_custkey"]}], "chance").fit_transform(o)
    if not target:
        return model.transform(o.drop("chance")).select("o_orderkey", "o_custkey_target")
    return trained.agg((F.abs(F.corr("chance", "o_custkey_target")) < 0.1).alias("independent"), F.count("o_custkey_target").alias("n"))


CHANCE = "(SELECT o_orderkey, o_custkey, (('0x' || substr(md5(o_orderkey::VARCHAR), 1, 4))::BIGINT % 2)::DOUBLE AS chance FROM orders)"
book.add(
    "e13_many_levels",
    lambda s, d: coded(s, d, False),
    f"SELECT o_orderkey, (sum(chance) OVER w + 10 * p) / (count(*) OVER w + 10) AS o_custkey_target FROM {CHANCE}, (SELECT avg(chance) AS p FROM {CHANCE}) WINDOW w AS (PARTITION BY o_custkey)",
    "o_custkey_target",
)
book.add("e13_target_fold", lambda s, d: coded(s, d, True), "SELECT true AS independent, count(*) AS n FROM orders")
