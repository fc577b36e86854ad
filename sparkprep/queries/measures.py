"""Association and metric queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from sparkprep.functions.tables import read
from sparkprep.operators import associate as A
from sparkprep.operators import metrics as G
from sparkprep.queries.base import Book

book = Book()
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
HOLED = "SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS holed, l_quantity * l_quantity AS square FROM {lineitem}"
DUCK = f"({HOLED.format(lineitem='lineitem')})"


def line(spark, sf_dir):  # noqa: ANN001, ANN201
    return spark.sql(HOLED, lineitem=read(spark, sf_dir, "lineitem"))


PAIRS = ["l_quantity", "l_extendedprice", "holed", "square"]
book.add(
    "a13_pearson",
    lambda s, d: A.pearson_pairs(line(s, d), PAIRS),
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS r FROM {DUCK}" for a, b in combinations(PAIRS, 2)),
    "r",
)
RANKS = "(SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS y FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
book.add("a14_spearman", lambda s, d: A.spearman(line(s, d), "l_quantity", "holed"), f"SELECT count(*) AS n, corr(x, y) AS rho FROM {RANKS.format(a='l_quantity', b='holed', t=DUCK)}", "rho")
book.add(
    "a15_cramers_v",
    lambda s, d: A.cramers_v(line(s, d), "l_returnflag", "l_linenumber"),
    """WITH c AS (SELECT l_returnflag AS a, l_linenumber AS b, count(*)::DOUBLE AS o FROM lineitem GROUP BY ALL), j AS (SELECT *, sum(o) OVER (PARTITION BY a) AS na, sum(o) OVER (PARTITION BY b) AS nb, sum(o) OVER () AS n FROM c),
  t AS (SELECT max(n) AS n, sum((o - na * nb / n) ** 2 / (na * nb / n)) / max(n) AS phi, count(DISTINCT a) AS r, count(DISTINCT b) AS k FROM j)
  SELECT n::BIGINT AS n, sqrt(greatest(0, phi - (k - 1) * (r - 1) / (n - 1)) / least(r - (r - 1) ** 2 / (n - 1) - 1, k - (k - 1) ** 2 / (n - 1) - 1)) AS v FROM t""",
    "v",
)
book.add(
    "a16_correlation_ratio",
    lambda s, d: A.correlation_ratio(line(s, d), "l_returnflag", "square"),
    f"""WITH g AS (SELECT avg(square) AS m FROM {DUCK}), b AS (SELECT count(*) AS n, avg(square) AS m, var_pop(square) * count(*) AS w FROM {DUCK} GROUP BY l_returnflag),
  t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * (b.m - g.m) ** 2) AS ssb, sum(w) AS ssw FROM b, g)
  SELECT n::BIGINT AS n, sqrt(greatest(0, (ssb - (k - 1) * ssw / (n - k)) / (ssb + ssw))) AS eta FROM t""",
    "eta",
)
ETA = f"""WITH g AS (SELECT avg({{x}}) AS m FROM {DUCK}), b AS (SELECT count({{x}}) AS n, avg({{x}}) AS m, var_pop({{x}}) * count({{x}}) AS w FROM {DUCK} GROUP BY l_returnflag), t AS (SELECT sum(n) AS n, count(*) AS k, sum(n * (b.m - g.m) ** 2) AS ssb, sum(w) AS ssw FROM b, g)
  SELECT 'l_returnflag' AS a, '{{x}}' AS b, 'eta' AS method, sqrt(greatest(0, (ssb - (k - 1) * ssw / (n - k)) / (ssb + ssw))) AS value, false AS collinear FROM t"""
STEEP = f"(SELECT *, pow(l_quantity, 8) AS steep FROM {DUCK})"
_PEARSON = "SELECT '{a}' AS a, '{b}' AS b, 'pearson' AS method, corr({a}, {b}) AS value FROM {t}"
_SPEARMAN = "SELECT '{a}' AS a, '{b}' AS b, 'spearman' AS method, rho AS value FROM (SELECT corr(x, y) AS rho FROM {ranks}), (SELECT corr({a}, {b}) AS r FROM {t}) WHERE abs(abs(rho) - abs(r)) >= 0.10"
_STEPS = list(combinations(["l_quantity", "square", "steep"], 2))
book.add(
    "a17_correlation_report",
    lambda s, d: A.correlation_report(line(s, d).withColumn("steep", F.pow("l_quantity", F.lit(8.0))), ["l_quantity", "square", "steep", "l_returnflag"]).withColumn("value", F.round("value", 6)),
    "SELECT a, b, method, round(value, 6) AS value, method <> 'eta' AND round(abs(value), 2) >= 0.95 AS collinear FROM ("
    + " UNION ALL ".join([_PEARSON.format(a=a, b=b, t=STEEP) for a, b in _STEPS] + [_SPEARMAN.format(a=a, b=b, t=STEEP, ranks=RANKS.format(a=a, b=b, t=STEEP)) for a, b in _STEPS] + ["SELECT * FROM (" + ETA.replace(DUCK, STEEP).format(x=x).replace(", false AS collinear", "") + ")" for x in ("l_quantity", "square", "steep")])
    + ")",
    "value",
)
MI = """WITH c AS (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS o FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL), j AS (SELECT *, sum(o) OVER (PARTITION BY a) AS na, sum(o) OVER (PARTITION BY b) AS nb, sum(o) OVER () AS n FROM c),
  h AS (SELECT -sum(p * ln(p)) AS h FROM (SELECT sum(o) / (SELECT sum(o) FROM c) AS p FROM c GROUP BY b)), g AS (SELECT -sum(p * ln(p)) AS h FROM (SELECT sum(o) / (SELECT sum(o) FROM c) AS p FROM c GROUP BY a)), m AS (SELECT max(n)::BIGINT AS n, sum(o / n * ln(o * n / (na * nb))) AS mi FROM j)
  SELECT n, mi, g.h AS entropy_a, h.h AS entropy_b, mi / h.h AS normalised FROM m, h, g"""
book.add("l2_mutual_information", lambda s, d: A.mutual_information(line(s, d), "l_linenumber", "l_returnflag"), MI.format(a="l_linenumber", b="l_returnflag", t=DUCK), "mi entropy_a entropy_b normalised")
SCORED = "SELECT o_orderkey, CAST(o_orderkey * 37 % 1000 AS DOUBLE) / 1000 AS score, CAST((o_orderkey * 37 % 1000 + o_custkey * 13 % 700) > 900 AS INT) AS label, CAST(o_orderkey * 37 % 1000 > 500 AS INT) AS prediction, o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN 'P' ELSE o_orderstatus END AS called, o_totalprice AS y, o_totalprice * (0.8 + (o_orderkey % 40) / 100.0) AS yhat, o_orderpriority FROM {orders}"
DS = f"({SCORED.format(orders='orders')})"


def scored(spark, sf_dir):  # noqa: ANN001, ANN201
    return spark.sql(SCORED, orders=read(spark, sf_dir, "orders"))


book.add("l1_single_feature_auc", lambda s, d: A.single_auc(scored(s, d), "score", "label"), f"SELECT (sum(r) FILTER (label = 1) - p * (p + 1) / 2.0) / (p * q) AS auc FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r, sum(label) OVER () AS p, sum(1 - label) OVER () AS q FROM {DS}) GROUP BY p, q", "auc")
book.add("l3_exact_copies", lambda s, d: s.createDataFrame([(c,) for c in A.exact_copies(scored(s, d).withColumn("copy", F.col("y")), "y", ["copy", "yhat", "score"])], "column string"), f"SELECT 'copy' AS \"column\" FROM (SELECT bool_and(y = y) AS ok FROM {DS}) WHERE ok")
book.add(
    "l3_leakage_findings",
    lambda s, d: A.leakage_findings(t := scored(s, d).withColumns({"leak": F.col("y") * 2 + 1, "log_leak": F.log("y")}), "y", A.target_associations(t, "y", ["leak", "log_leak", "score"], "regression"), ["leak", "log_leak", "score"]).select("column", "severity"),
    "SELECT * FROM (VALUES ('leak', 'critical'), ('log_leak', 'critical')) t(\"column\", severity)",
)
book.add("g1_confusion", lambda s, d: G.confusion(scored(s, d), "o_orderstatus", "called"), f"SELECT o_orderstatus AS label, called AS prediction, count(*) AS n FROM {DS} GROUP BY ALL")
KLASS = """(SELECT c, coalesce(a, 0) AS a, coalesce(h, 0) AS h, coalesce(k, 0) AS k, coalesce(h / nullif(k, 0)::DOUBLE, 0) AS p, coalesce(h / nullif(a, 0)::DOUBLE, 0) AS r, coalesce(2 * h / nullif(k + a, 0)::DOUBLE, 0) AS f
  FROM (SELECT {y} AS c, count(*) AS a, count(*) FILTER ({y} = {z}) AS h FROM {t} GROUP BY 1) FULL JOIN (SELECT {z} AS c, count(*) AS k FROM {t} GROUP BY 1) USING (c))"""
METRICS = """SELECT sum(a)::BIGINT AS n, sum(h) / sum(a) AS accuracy, avg(r) FILTER (a > 0) AS balanced_accuracy, avg(p) AS precision_macro, avg(r) AS recall_macro, avg(f) AS f1_macro, sum(p * a) / sum(a) AS precision_weighted, sum(r * a) / sum(a) AS recall_weighted,
  sum(f * a) / sum(a) AS f1_weighted, sum(h) / sum(a) AS f1_micro, {binary} (sum(h) * sum(a) - sum(a * k)) / sqrt((sum(a)::DOUBLE ** 2 - sum(k * k)) * (sum(a)::DOUBLE ** 2 - sum(a * a))) AS matthews_corrcoef,
  (sum(h) / sum(a) - sum(a * k) / sum(a)::DOUBLE ** 2) / (1 - sum(a * k) / sum(a)::DOUBLE ** 2) AS cohen_kappa FROM """
MD = "accuracy balanced_accuracy precision_macro recall_macro f1_macro precision_weighted recall_weighted f1_weighted f1_micro matthews_corrcoef cohen_kappa"
book.add("g1_g2_multiclass", lambda s, d: G.classification_metrics(scored(s, d), "o_orderstatus", "called"), METRICS.format(binary="") + KLASS.format(y="o_orderstatus", z="called", t=DS), MD)
book.add(
    "g1_g2_binary",
    lambda s, d: G.classification_metrics(scored(s, d), "label", "prediction", positive="1"),
    METRICS.format(binary="max(p) FILTER (c = 1) AS precision, max(r) FILTER (c = 1) AS recall, max(f) FILTER (c = 1) AS f1,") + KLASS.format(y="label", z="prediction", t=DS),
    MD + " precision recall f1",
)
AP = f"""(WITH c AS (SELECT score, count(*) AS n, sum(label) AS p FROM {DS} GROUP BY score), r AS (SELECT *, sum(n) OVER w AS u, sum(p) OVER w AS h, sum(p) OVER () AS t FROM c WINDOW w AS (ORDER BY score DESC)) SELECT sum(p / t::DOUBLE * h / u) FROM r)"""
book.add(
    "g3_g4_ranking",
    lambda s, d: G.ranking_metrics(scored(s, d)),
    f"SELECT (sum(r) FILTER (label = 1) - p * (p + 1) / 2.0) / (p * q) AS roc_auc, {AP} AS average_precision FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r, sum(label) OVER () AS p, sum(1 - label) OVER () AS q FROM {DS}) GROUP BY p, q",
    "roc_auc average_precision",
)
OVR = {"F": "score", "O": "prediction", "P": "rest"}
RESTED = f"(SELECT *, 1 - score AS rest FROM {DS})"
ONE = "SELECT '{k}' AS c, (sum(r) FILTER (y = 1) - p * (p + 1) / 2.0) / (p * q) AS auc, p AS n, ap FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r, sum(y) OVER () AS p, sum(1 - y) OVER () AS q FROM (SELECT {v} AS s, (o_orderstatus = '{k}')::INT AS y FROM {t})), (SELECT sum(m / t::DOUBLE * h / u) AS ap FROM (SELECT *, sum(n) OVER w AS u, sum(m) OVER w AS h, sum(m) OVER () AS t FROM (SELECT {v} AS s, count(*) AS n, sum((o_orderstatus = '{k}')::INT) AS m FROM {t} GROUP BY 1) WINDOW w AS (ORDER BY s DESC))) GROUP BY p, q, ap"
book.add(
    "g3_g4_one_vs_rest",
    lambda s, d: G.one_vs_rest(scored(s, d).withColumn("rest", 1 - F.col("score")), "o_orderstatus", OVR),
    f"SELECT avg(auc) AS roc_auc_ovr, sum(auc * n) / sum(n) AS roc_auc_ovr_weighted, avg(ap) AS average_precision_macro FROM ({' UNION ALL '.join(ONE.format(k=k, v=v, t=RESTED) for k, v in OVR.items())})",
    "roc_auc_ovr roc_auc_ovr_weighted average_precision_macro",
)
book.add(
    "g5_probabilities",
    lambda s, d: G.probability_metrics(scored(s, d)),
    f"SELECT avg(-(label * ln(greatest(least(score, 1 - 1e-15), 1e-15)) + (1 - label) * ln(1 - greatest(least(score, 1 - 1e-15), 1e-15)))) AS log_loss, avg((score - label) ** 2) AS brier_score FROM {DS}",
    "log_loss brier_score",
)
REG = """count(*) AS n, sqrt(avg((y - yhat) ** 2)) AS rmse, avg((y - yhat) ** 2) AS mse, avg(abs(y - yhat)) AS mae, 1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*)) AS r2, 1 - var_pop(y - yhat) / var_pop(y) AS explained_variance,
  quantile_cont(abs(y - yhat), 0.5) AS median_absolute_error, max(abs(y - yhat)) AS max_error, avg(abs(y - yhat) / abs(y)) AS mape, avg(2 * abs(y - yhat) / (abs(y) + abs(yhat))) AS smape"""
RD = "rmse mse mae r2 explained_variance median_absolute_error max_error mape smape"
book.add("g6_g7_regression", lambda s, d: G.regression_metrics(scored(s, d), "y", "yhat"), f"SELECT {REG} FROM {DS}", RD)
book.add("q4_fairness_regression", lambda s, d: G.regression_metrics(scored(s, d), "y", "yhat", ["o_orderpriority"]), f"SELECT o_orderpriority, {REG} FROM {DS} GROUP BY 1", RD)
CLUSTERS = "(SELECT c_custkey % 5 - 1 AS k, c_acctbal + 900 * (c_custkey % 5) AS a, c_nationkey * 1.0 AS b FROM customer)"
book.add(
    "g8_clustering",
    lambda s, d: G.clustering_metrics(read(s, d, "customer").selectExpr("c_custkey % 5 - 1 AS k", "c_acctbal + 900 * (c_custkey % 5) AS a", "c_nationkey * 1.0D AS b"), ["a", "b"], "k").drop("silhouette"),
    f"""WITH t AS (SELECT * FROM {CLUSTERS} WHERE k <> -1), c AS (SELECT k, count(*) AS n, avg(a) AS ca, avg(b) AS cb FROM t GROUP BY k), g AS (SELECT avg(a) AS ga, avg(b) AS gb, count(*) AS n FROM t),
  s AS (SELECT c.k, any_value(c.n) AS n, any_value(ca) AS ca, any_value(cb) AS cb, sum((a - ca) ** 2 + (b - cb) ** 2) AS w, avg(sqrt((a - ca) ** 2 + (b - cb) ** 2)) AS s FROM t JOIN c USING (k) GROUP BY c.k)
  SELECT (SELECT avg((k = -1)::INT) FROM {CLUSTERS}) AS noise_fraction, (SELECT count(*) FROM s) AS n_clusters, (SELECT sum(s.n * ((ca - ga) ** 2 + (cb - gb) ** 2)) / (count(*) - 1) / (sum(w) / (max(g.n) - count(*))) FROM s, g) AS calinski_harabasz,
    (SELECT avg(r) FROM (SELECT x.k, max((x.s + y.s) / sqrt((x.ca - y.ca) ** 2 + (x.cb - y.cb) ** 2)) AS r FROM s x JOIN s y ON x.k <> y.k GROUP BY x.k)) AS davies_bouldin""",
    "noise_fraction calinski_harabasz davies_bouldin",
)
book.add("g8_silhouette", lambda s, d: G.clustering_metrics(read(s, d, "customer").selectExpr("c_custkey % 5 - 1 AS k", "c_acctbal + 900 * (c_custkey % 5) AS a", "c_nationkey * 1.0D AS b"), ["a", "b"], "k").select("silhouette"), f"""WITH t AS (SELECT *, row_number() OVER () AS id FROM {CLUSTERS} WHERE k <> -1), m AS (SELECT x.id, x.k AS own, y.k AS k, sum(sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2)) / nullif(count(*) - (x.k = y.k)::INT, 0) AS d FROM t x, t y GROUP BY x.id, x.k, y.k)
  SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS silhouette FROM (SELECT id, max(d) FILTER (k = own) AS a, min(d) FILTER (k <> own) AS b FROM m GROUP BY id)""", "silhouette")
book.add(
    "g9_anomaly",
    lambda s, d: G.anomaly_metrics(scored(s, d), "prediction", "score", "label"),
    f"""SELECT avg(prediction) AS outlier_fraction, avg(score) AS mean_score, avg(score) FILTER (prediction = 0) - avg(score) FILTER (prediction = 1) AS score_separation, count(*) FILTER (prediction = 1 AND label = 1) / sum(prediction)::DOUBLE AS precision,
  count(*) FILTER (prediction = 1 AND label = 1) / sum(label)::DOUBLE AS recall, 2 * count(*) FILTER (prediction = 1 AND label = 1) / (sum(label) + sum(prediction))::DOUBLE AS f1,
  (SELECT (sum(r) FILTER (label = 1) - any_value(p) * (any_value(p) + 1) / 2.0) / (any_value(p) * any_value(q)) FROM (SELECT label, rank() OVER (ORDER BY -score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r, sum(label) OVER () AS p, sum(1 - label) OVER () AS q FROM {DS})) AS roc_auc,
  {AP.replace('ORDER BY score DESC', 'ORDER BY score')} AS average_precision FROM {DS}""",
    "outlier_fraction mean_score score_separation precision recall f1 roc_auc average_precision",
)
BINS = f"(SELECT greatest(1, ceil(score * 10))::INT AS bin, count(*) AS n, avg(score) AS confidence, avg(label) AS accuracy FROM {DS} GROUP BY 1)"
book.add("q2_k6_calibration", lambda s, d: G.calibration(scored(s, d)), f"SELECT * FROM {BINS}", "confidence accuracy")
book.add("q2_calibration_error", lambda s, d: G.expected_calibration_error(scored(s, d)), f"SELECT e AS ece, CASE WHEN e <= 0.05 THEN 'good' WHEN e <= 0.1 THEN 'fair' ELSE 'poor' END AS band FROM (SELECT sum(n * abs(confidence - accuracy)) / sum(n) AS e FROM {BINS})", "ece")
book.add(
    "w9_k6_score_curve",
    lambda s, d: G.score_curve(scored(s, d)),
    f"SELECT score, n, positives, (sum(n) OVER w)::BIGINT AS upto, (sum(positives) OVER w)::BIGINT AS hits FROM (SELECT score, count(*) AS n, sum(label)::BIGINT AS positives FROM {DS} GROUP BY score) WINDOW w AS (ORDER BY score DESC)",
    "score",
)
SEGMENTS = "(SELECT c_nationkey, list(DISTINCT c_mktsegment) FILTER (c_acctbal > 5000) AS a, list(DISTINCT c_mktsegment) FILTER (c_acctbal < 0) AS b FROM customer GROUP BY 1)"
book.add(
    "u4_name_overlap",
    lambda s, d: read(s, d, "customer").groupBy("c_nationkey").agg(F.collect_set(F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment"))).alias("a"), F.collect_set(F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment"))).alias("b")).select("c_nationkey", A.name_overlap(F.col("a"), F.col("b")).alias("jaccard")),
    f"SELECT c_nationkey, coalesce(len(list_intersect(coalesce(a, []), coalesce(b, []))) / nullif(len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), 0)::DOUBLE, 0.0) AS jaccard FROM {SEGMENTS}",
    "jaccard",
)


SHARES = {"F": "pf", "O": "po", "P": "pp"}
SHARED = f"(SELECT *, score / 2 AS pf, (1 - score) / 2 AS po, 0.5 AS pp FROM {DS})"


def shared(spark, sf_dir):  # noqa: ANN001, ANN201
    return scored(spark, sf_dir).withColumns({"pf": F.col("score") / 2, "po": (1 - F.col("score")) / 2, "pp": F.lit(0.5)})


OWN = "CASE o_orderstatus WHEN 'F' THEN pf WHEN 'O' THEN po ELSE pp END"
book.add(
    "g5_class_probabilities",
    lambda s, d: G.class_probability_metrics(shared(s, d), "o_orderstatus", SHARES),
    f"SELECT avg(-ln(greatest(least({OWN}, 1 - 1e-15), 1e-15))) AS log_loss, avg((pf - (o_orderstatus = 'F')::INT) ** 2 + (po - (o_orderstatus = 'O')::INT) ** 2 + (pp - (o_orderstatus = 'P')::INT) ** 2) AS brier_score FROM {SHARED}",
    "log_loss brier_score",
)
book.add(
    "q2_class_calibration",
    lambda s, d: G.calibration(G.top_class(scored(s, d).withColumns({"pf": F.col("score"), "po": 1 - F.col("score")}), "o_orderstatus", {"F": "pf", "O": "po"}), "hit", "confidence"),
    f"""SELECT greatest(1, ceil(c * 10))::INT AS bin, count(*) AS n, avg(c) AS confidence, avg(h) AS accuracy FROM (SELECT greatest(score, 1 - score) AS c, (o_orderstatus = CASE WHEN score >= 1 - score THEN 'F' ELSE 'O' END)::INT AS h FROM {DS}) GROUP BY 1""",
    "confidence accuracy",
)
book.add(
    "p7_drop_correlated",
    lambda s, d: s.createDataFrame(
        [(c,) for t in [line(s, d)] for c in A.drop_correlated([r.asDict() for r in A.pearson_pairs(t, ["l_quantity", "square", "l_tax"]).collect()], {r["a"]: abs(r["r"]) for r in A.pearson_pairs(t, ["l_quantity", "square", "l_tax", "l_extendedprice"]).where("b = 'l_extendedprice'").collect()})],
        "dropped string",
    ),
    f"SELECT CASE WHEN abs(corr(l_quantity, l_extendedprice)) >= abs(corr(square, l_extendedprice)) THEN 'square' ELSE 'l_quantity' END AS dropped FROM {DUCK} HAVING abs(corr(l_quantity, square)) >= 0.95",
)


def judged(spark, sf_dir):  # noqa: ANN001, ANN201
    """Each priority's accuracy on even and odd orders as if they were trained on and held out, with the grade over the share of the larger class."""
    from sparkprep.operators.diagnose import fit_verdict
    from sparkprep.operators.quality import grade

    hit = (F.col("label") == F.col("prediction")).cast("double")
    even = F.col("o_orderkey") % 2 == 0
    rows = scored(spark, sf_dir).groupBy("o_orderpriority").agg(F.avg(F.when(even, hit)).alias("train"), F.avg(F.when(~even, hit)).alias("held"), F.avg("label").alias("p")).collect()
    return spark.createDataFrame([(r["o_orderpriority"], fit_verdict(r["train"], r["held"], "accuracy"), grade(r["held"], max(r["p"], 1 - r["p"]), "accuracy")) for r in rows], "o_orderpriority string, verdict string, grade string")


book.add(
    "q1_l9_verdict_and_grade",
    judged,
    f"""WITH t AS (SELECT o_orderpriority, avg((label = prediction)::INT) FILTER (o_orderkey % 2 = 0) AS a, avg((label = prediction)::INT) FILTER (o_orderkey % 2 <> 0) AS b, greatest(avg(label), 1 - avg(label)) AS base FROM {DS} GROUP BY 1)
  SELECT o_orderpriority, CASE WHEN a - b >= 0.02 AND (a - b) / a >= 0.15 THEN 'overfitting' WHEN a < 0.6 THEN 'underfitting' ELSE 'good' END AS verdict,
  CASE WHEN b <= base THEN 'F' WHEN b >= 0.9 THEN 'A' WHEN b >= 0.8 THEN 'B' WHEN b >= 0.7 THEN 'C' WHEN b >= 0.6 THEN 'D' ELSE 'F' END AS grade FROM t""",
)
