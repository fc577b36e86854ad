"""Cleaning and history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkprep.functions.tables import read
from sparkprep.operators import clean as C
from sparkprep.operators import windows as W
from sparkprep.queries.base import Book

book = Book()
#: Orders with nulls, blanks, placeholders, outliers and repeated rows put in by rule, written once for both engines.
MESSY = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN o_totalprice * 100 ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 11 = 0 THEN ' N/A ' WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN concat('  ', o_orderpriority, ' ') ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 17 = 0 THEN 'x' ELSE CAST(o_custkey AS {text}) END AS code, 1 AS one FROM orders"""
SPARK_MESSY, DUCK_MESSY = MESSY.format(text="STRING"), f"({MESSY.format(text='VARCHAR')})"


def messy(spark, sf_dir):  # noqa: ANN001, ANN201
    return spark.sql(SPARK_MESSY.replace("FROM orders", "FROM {orders}"), orders=read(spark, sf_dir, "orders"))


def doubled(spark, sf_dir):  # noqa: ANN001, ANN201
    df = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return df.unionAll(df.where("o_orderkey % 50 = 0"))


DOUBLED = "(SELECT o_orderkey, o_custkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 50 = 0)"
FENCED = "(SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM {m})".replace("{m}", DUCK_MESSY)
TOKENS = ", ".join(f"'{t}'" for t in C.NULL_TOKENS)

book.add("p1_drop_constant", lambda s, d: C.drop_columns(m := messy(s, d), C.constant_columns(m), target="price").select("o_orderkey", "price"), f"SELECT o_orderkey, price FROM {DUCK_MESSY}", "price")
book.add("p2_drop_missing_target", lambda s, d: C.drop_rows_missing_target(messy(s, d), "price").select("o_orderkey", "price"), f"SELECT o_orderkey, price FROM {DUCK_MESSY} WHERE price IS NOT NULL", "price")
book.add("p3_drop_missing_rows", lambda s, d: C.drop_rows_missing(messy(s, d), ["price", "priority", "no_such"]).select("o_orderkey"), f"SELECT o_orderkey FROM {DUCK_MESSY} WHERE price IS NOT NULL AND priority IS NOT NULL")
book.add(
    "p4_remove_outliers",
    lambda s, d: C.remove_outlier_rows(messy(s, d), ["price"]).select("o_orderkey", "price"),
    f"SELECT o_orderkey, price FROM {DUCK_MESSY}, {FENCED} WHERE price IS NULL OR NOT (price < a - 1.5 * (b - a) OR price > b + 1.5 * (b - a))",
    "price",
)
book.add("c2_drop_duplicates", lambda s, d: C.drop_duplicates(doubled(s, d)), f"SELECT DISTINCT * FROM {DOUBLED}", "o_totalprice")
for keep, how in (("first", "ASC"), ("last", "DESC")):
    book.add(
        f"c2_duplicates_by_key_{keep}",
        lambda s, d, keep=keep: C.drop_duplicates(doubled(s, d), ["o_custkey"], keep=keep, order=["o_orderkey"]),
        f"SELECT o_orderkey, o_custkey, o_totalprice FROM {DOUBLED} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey {how}) = 1",
        "o_totalprice",
    )
book.add("c2_duplicates_by_key_none", lambda s, d: C.drop_duplicates(doubled(s, d), ["o_custkey"], keep="none"), f"SELECT o_orderkey, o_custkey, o_totalprice FROM {DOUBLED} QUALIFY count(*) OVER (PARTITION BY o_custkey) = 1", "o_totalprice")
book.add("c3_strip_whitespace", lambda s, d: C.strip_whitespace(messy(s, d), ["priority"]).select("o_orderkey", "priority"), rf"SELECT o_orderkey, regexp_replace(priority, '^\s+|\s+$', '', 'g') AS priority FROM {DUCK_MESSY}")
book.add(
    "c4_normalise_categories",
    lambda s, d: C.normalise_categories(messy(s, d), ["priority"], mapping={"1-urgent": "now"}).select("o_orderkey", "priority"),
    rf"""SELECT o_orderkey, CASE WHEN p NOT IN ({TOKENS}) THEN CASE WHEN p = '1-urgent' THEN 'now' ELSE p END END AS priority
  FROM (SELECT o_orderkey, regexp_replace(lower(regexp_replace(priority, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g') AS p FROM {DUCK_MESSY})""",
)
book.add(
    "c5_parse_datetime",
    lambda s, d: C.parse_datetime(read(s, d, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 9 = 0 THEN 'soon' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS day")), ["day"]).select("o_orderkey", F.date_format("day", "yyyy-MM-dd HH:mm").alias("day")),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d 00:00') END AS day FROM orders",
)
book.add("c6_cast_types", lambda s, d: C.cast_types(messy(s, d), {"code": "int64"})[0].select("o_orderkey", "code"), f"SELECT o_orderkey, try_cast(code AS BIGINT) AS code FROM {DUCK_MESSY}")
for name, sql in (("mean", "avg(price)"), ("median", "quantile_cont(price, 0.5)")):
    book.add(f"c7_impute_{name}", lambda s, d, name=name: C.impute(messy(s, d), ["price"], name)[0].select("o_orderkey", "price"), f"SELECT o_orderkey, coalesce(price, (SELECT {sql} FROM {DUCK_MESSY})) AS price FROM {DUCK_MESSY}", "price")
book.add(
    "c8_impute_mode",
    lambda s, d: C.impute(messy(s, d), ["priority"], "mode")[0].select("o_orderkey", "priority"),
    f"SELECT o_orderkey, coalesce(priority, (SELECT priority FROM {DUCK_MESSY} WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)) AS priority FROM {DUCK_MESSY}",
)
book.add(
    "c9_impute_constant",
    lambda s, d: C.impute(C.impute(messy(s, d), ["price"], "constant", -1.0)[0], ["priority"], "missing_category")[0].select("o_orderkey", "price", "priority"),
    f"SELECT o_orderkey, coalesce(price, -1.0) AS price, coalesce(priority, 'MISSING') AS priority FROM {DUCK_MESSY}",
    "price",
)
book.add("c12_impute_by_type", lambda s, d: C.impute(messy(s, d), ["price", "code"], "auto")[0].select("o_orderkey", "price", "code"), f"SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM {DUCK_MESSY})) AS price, code FROM {DUCK_MESSY}", "price")
GAPS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 AND o_orderkey > 20 THEN o_orderdate::DATE END AS day, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS priority FROM orders)"
book.add(
    "c12_default_by_type",
    lambda s, d: C.impute_by_type(
        read(s, d, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 7 > 0 AND o_orderkey > 20 THEN CAST(o_orderdate AS DATE) END AS day", "CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS price", "CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS priority"),
        ["day", "price", "priority"], ["o_orderkey"],
    )[0],
    f"""WITH g AS {GAPS}, f AS (SELECT * REPLACE (last_value(day IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS day) FROM g)
  SELECT o_orderkey, coalesce(day, (SELECT day FROM f WHERE day IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, day LIMIT 1)) AS day, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM g)) AS price,
    coalesce(priority, (SELECT priority FROM g WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, priority LIMIT 1)) AS priority FROM f""",
    "price",
)
EVENTS = "(SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 OR event_id % 4 = 0 THEN NULL ELSE value END AS value FROM events)"


def gappy(spark, sf_dir):  # noqa: ANN001, ANN201
    return read(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(~((F.col("event_id") % 3 == 0) | (F.col("event_id") % 4 == 0)), F.col("value")).alias("value"))


ORDER = ["ts", "event_id"]
for name, back in (("forward", False), ("backward", True)):
    w = f"PARTITION BY user_id ORDER BY ts {'DESC' if back else 'ASC'}, event_id {'DESC' if back else 'ASC'} ROWS UNBOUNDED PRECEDING"
    book.add(
        f"c10_{name}_fill",
        lambda s, d, back=back: C.directional_fill(gappy(s, d), ["value"], ORDER, ["user_id"], backward=back, leftovers=False).select("event_id", "value"),
        f"SELECT event_id, last_value(value IGNORE NULLS) OVER ({w}) AS value FROM {EVENTS}",
        "value",
    )
    book.add(
        f"c10_{name}_fill_limit",
        lambda s, d, back=back: C.directional_fill(gappy(s, d), ["value"], ORDER, ["user_id"], backward=back, limit=1).select("event_id", "value"),
        f"""WITH n AS (SELECT *, row_number() OVER ({w.replace(' ROWS UNBOUNDED PRECEDING', '')}) AS k FROM {EVENTS}),
  f AS (SELECT event_id, coalesce(value, CASE WHEN k - last_value(CASE WHEN value IS NOT NULL THEN k END IGNORE NULLS) OVER ({w}) <= 1 THEN last_value(value IGNORE NULLS) OVER ({w}) END) AS value FROM n)
  SELECT event_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM f)) AS value FROM f""",
        "value",
    )
book.add(
    "c11_interpolate",
    lambda s, d: C.interpolate(gappy(s, d), ["value"], ORDER, ["user_id"]).select("event_id", "value"),
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM {EVENTS}),
  m AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN value IS NOT NULL THEN k END IGNORE NULLS) OVER b AS p,
    first_value(value IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN value IS NOT NULL THEN k END IGNORE NULLS) OVER a AS q FROM n
    WINDOW b AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT event_id, coalesce(value, pv + (nv - pv) * (k - p) / (q - p)::DOUBLE, pv, nv) AS value FROM m""",
    "value",
)
book.add(
    "c15_clip_outliers",
    lambda s, d: C.clip_outliers(messy(s, d), ["price"])[0].select("o_orderkey", "price"),
    f"SELECT o_orderkey, CASE WHEN price < a - 1.5 * (b - a) THEN a - 1.5 * (b - a) WHEN price > b + 1.5 * (b - a) THEN b + 1.5 * (b - a) ELSE price END AS price FROM {DUCK_MESSY}, {FENCED}",
    "price",
)
book.add(
    "s13_grouped_numbers",
    lambda s, d: C.coerce_grouped_numbers(read(s, d, "orders").select("o_orderkey", F.format_number(F.col("o_totalprice") + 1000, 2).alias("price"), "o_orderpriority")),
    "SELECT o_orderkey, round(o_totalprice + 1000, 2) AS price, o_orderpriority FROM orders",
    "price",
)
ES = "PARTITION BY user_id ORDER BY ts, event_id"
book.add(
    "w1_lags",
    lambda s, d: W.lag_features(gappy(s, d), "value", [1, -2, 3], ORDER, ["user_id"]).drop("ts", "user_id", "value"),
    f"SELECT event_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 2) OVER w AS value_lag_2, lag(value, 3) OVER w AS value_lag_3 FROM {EVENTS} WINDOW w AS ({ES})",
    "value_lag_1 value_lag_2 value_lag_3",
)
STATS = {"mean": "avg", "sum": "sum", "min": "min", "max": "max", "std": "stddev_samp", "count": "count", "median": "median"}


def _windowed(prefix: str, frame: str) -> str:
    cols = ", ".join(f"{'nullif(count(value) OVER w, 0)' if k == 'count' else f'{v}(value) OVER w'} AS {prefix}_{k}" for k, v in STATS.items())
    return f"SELECT event_id, {cols} FROM {EVENTS} WINDOW w AS ({ES} ROWS BETWEEN {frame})"


for shift in (0, 1):
    book.add(
        f"w2_rolling_shift{shift}",
        lambda s, d, shift=shift: W.rolling_features(gappy(s, d), "value", [3], STATS, ORDER, ["user_id"], shift).drop("ts", "user_id", "value"),
        _windowed("value_roll_3", f"{2 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'}"),
        " ".join(f"value_roll_3_{k}" for k in STATS),
    )
    book.add(
        f"w4_expanding_shift{shift}",
        lambda s, d, shift=shift: W.expanding_features(gappy(s, d), "value", STATS, ORDER, ["user_id"], shift).drop("ts", "user_id", "value"),
        _windowed("value_expanding", f"UNBOUNDED PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'}"),
        " ".join(f"value_expanding_{k}" for k in STATS),
    )
    book.add(
        f"w3_diff_shift{shift}",
        lambda s, d, shift=shift: W.diff_features(gappy(s, d), "value", [1, 2], ORDER, ["user_id"], shift).drop("ts", "user_id", "value"),
        f"SELECT event_id, lag(value, {shift}) OVER w - lag(value, {shift + 1}) OVER w AS value_diff_1, lag(value, {shift}) OVER w - lag(value, {shift + 2}) OVER w AS value_diff_2 FROM {EVENTS} WINDOW w AS ({ES})",
        "value_diff_1 value_diff_2",
    )
book.add(
    "w6_average_rank",
    lambda s, d: W.average_rank(read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", "r").groupBy("l_quantity", "r").count(),
    "SELECT l_quantity, r, count(*) AS count FROM (SELECT l_quantity, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS r FROM lineitem) GROUP BY ALL",
    "l_quantity r",
)
book.add(
    "w8_top_per_group",
    lambda s, d: W.top_per_group(read(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).drop("o_totalprice"),
    "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS place FROM orders QUALIFY place <= 2",
)

# the same without a group: one order over the whole table, in ranges
EW = "ORDER BY ts, event_id"
book.add(
    "w1_lags_ungrouped",
    lambda s, d: W.lag_features(gappy(s, d), "value", [1, -2, 7], ORDER).drop("ts", "user_id", "value"),
    f"SELECT event_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 2) OVER w AS value_lag_2, lag(value, 7) OVER w AS value_lag_7 FROM {EVENTS} WINDOW w AS ({EW})",
    "value_lag_1 value_lag_2 value_lag_7",
)


def _whole(prefix: str, frame: str, stats: dict[str, str]) -> str:
    cols = ", ".join(f"{'nullif(count(value) OVER w, 0)' if k == 'count' else f'{v}(value) OVER w'} AS {prefix}_{k}" for k, v in stats.items())
    return f"SELECT event_id, {cols} FROM {EVENTS} WINDOW w AS ({EW} ROWS BETWEEN {frame})"


for shift in (0, 1):
    book.add(
        f"w2_rolling_ungrouped_shift{shift}",
        lambda s, d, shift=shift: W.rolling_features(gappy(s, d), "value", [3], STATS, ORDER, (), shift).drop("ts", "user_id", "value"),
        _whole("value_roll_3", f"{2 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'}", STATS),
        " ".join(f"value_roll_3_{k}" for k in STATS),
    )
    book.add(
        f"w3_diff_ungrouped_shift{shift}",
        lambda s, d, shift=shift: W.diff_features(gappy(s, d), "value", [1, 2], ORDER, (), shift).drop("ts", "user_id", "value"),
        f"SELECT event_id, lag(value, {shift}) OVER w - lag(value, {shift + 1}) OVER w AS value_diff_1, lag(value, {shift}) OVER w - lag(value, {shift + 2}) OVER w AS value_diff_2 FROM {EVENTS} WINDOW w AS ({EW})",
        "value_diff_1 value_diff_2",
    )
    book.add(
        f"w4_expanding_ungrouped_shift{shift}",
        lambda s, d, shift=shift: W.expanding_features(gappy(s, d), "value", STATS, ORDER, (), shift).drop("ts", "user_id", "value"),
        _whole("value_expanding", f"UNBOUNDED PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'}", STATS),
        " ".join(f"value_expanding_{k}" for k in STATS),
    )
for back, name in ((False, "forward"), (True, "backward")):
    w = f"ORDER BY ts {'DESC' if back else 'ASC'}, event_id {'DESC' if back else 'ASC'} ROWS UNBOUNDED PRECEDING"
    book.add(
        f"c10_{name}_fill_ungrouped",
        lambda s, d, back=back: C.directional_fill(gappy(s, d), ["value"], ORDER, backward=back, limit=1, leftovers=False).select("event_id", "value"),
        f"""WITH n AS (SELECT *, row_number() OVER ({w.replace(' ROWS UNBOUNDED PRECEDING', '')}) AS k FROM {EVENTS})
  SELECT event_id, coalesce(value, CASE WHEN k - last_value(CASE WHEN value IS NOT NULL THEN k END IGNORE NULLS) OVER ({w}) <= 1 THEN last_value(value IGNORE NULLS) OVER ({w}) END) AS value FROM n""",
        "value",
    )
book.add(
    "c11_w5_interpolate_ungrouped",
    lambda s, d: C.interpolate(gappy(s, d), ["value"], ORDER).select("event_id", "value"),
    f"""WITH n AS (SELECT *, row_number() OVER ({EW}) AS k FROM {EVENTS}),
  m AS (SELECT *, last_value(value IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN value IS NOT NULL THEN k END IGNORE NULLS) OVER b AS p,
    first_value(value IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN value IS NOT NULL THEN k END IGNORE NULLS) OVER a AS q FROM n
    WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  SELECT event_id, coalesce(value, pv + (nv - pv) * (k - p) / (q - p)::DOUBLE, pv, nv) AS value FROM m""",
    "value",
)
book.add(
    "s14_coerce_dates",
    lambda s, d: C.coerce_dates(read(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority")).select("o_orderkey", F.col("day").cast("date").alias("day"), "o_orderpriority"),
    "SELECT o_orderkey, o_orderdate::DATE AS day, o_orderpriority FROM orders",
)
