"""Queries of the general data-processing problems (p1 to p5) and their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import normalised
from ..operators.features import feature_table, kinds_of
from ..operators.orphans import orphan_report, orphans
from ..operators.rolling import rolling_totals
from ..operators.sessions import sessions
from ..operators.skew import heavy_keys, keyed_results

YEAR_END = dt.date(2026, 12, 31)


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_rolling(spark, d):
    """Every user and calendar day to the end of the year."""
    return rolling_totals(_read(spark, d, "shop_orders"), "user_id", "created_at", "amount", (7, 30), "id", YEAR_END).select(
        F.col("entity").alias("user_id"), F.date_format("day", "yyyy-MM-dd").alias("on_day"), *[c for s in (7, 30) for c in (F.col(f"rows_{s}"), F.col(f"total_{s}").cast("double").alias(f"total_{s}"), F.col(f"average_{s}"), F.col(f"least_{s}").cast("double").alias(f"least_{s}"), F.col(f"most_{s}").cast("double").alias(f"most_{s}"))]
    )


def p1_found(spark, d):
    rows = rolling_totals(_read(spark, d, "shop_orders").where("user_id != 0"), "user_id", "created_at", "amount", (7, 30), "id", YEAR_END, emit="active")
    holds = F.filter(F.array(F.when(F.col("total_7") >= 600, 7), F.when(F.col("total_30") >= 1500, 30)), lambda x: x.isNotNull())
    return rows.where("rows_on_day = 0").select(F.col("entity").alias("user_id"), F.date_format("day", "yyyy-MM-dd").alias("on_day"), F.explode(holds).alias("span_days"))


def _log(spark, d):
    return _read(spark, d, "access_log").withColumn("action", normalised("action"))


def p2_features(spark, d):
    """One row per user with columns for every action."""
    log = _log(spark, d)
    return feature_table(log, "user_id", "action", "created_at", "id", as_of=dt.datetime(2027, 1, 1), kinds=kinds_of(log, "action")).withColumnRenamed("entity", "user_id")


def p2_cells(spark, d):
    """The features of p2 one by one, for comparison with SQL."""
    t = feature_table(_log(spark, d), "user_id", "action", "created_at", "id", as_of=dt.datetime(2027, 1, 1))
    t = t.select(F.col("entity").alias("user_id"), "events", "types", F.explode("features").alias("action", "x"))
    return t.select("user_id", "events", "types", "action", F.col("x.n").alias("n"), F.date_format("x.last_at", "yyyy-MM-dd HH:mm:ss").alias("last_at"), F.coalesce(F.col("x.recency_s").cast("bigint"), F.lit(-1)).alias("recency_s"))


def p2_wide_cells(spark, d):
    """The columns of p2_features turned back to rows, for comparison with SQL."""
    t = p2_features(spark, d)
    kinds = [c[2:] for c in t.columns if c.startswith("n_")]
    cells = F.array(*[F.struct(F.lit(k).alias("action"), F.col(f"`n_{k}`").alias("n"), F.col(f"`last_{k}`").alias("l"), F.col(f"`recency_{k}`").alias("r")) for k in kinds])
    t = t.select("user_id", "events", "types", F.inline(F.filter(cells, lambda x: x["n"] > 0)))
    return t.select("user_id", "events", "types", "action", "n", F.date_format("l", "yyyy-MM-dd HH:mm:ss").alias("last_at"), F.coalesce(F.col("r").cast("bigint"), F.lit(-1)).alias("recency_s"))


def p2_found(spark, d):
    log = _log(spark, d).where("user_id != 0 and created_at is not null")
    t = feature_table(log, "user_id", "action", "created_at", "id").select(F.col("entity").alias("user_id"), F.explode("features").alias("action", "x"))
    return t.where((F.col("x.n") >= 3) & (F.col("x.last_at") >= F.lit(dt.datetime(2026, 12, 1)).cast("timestamp_ntz"))).select("user_id", "action")


def _orphans(spark, d):
    refs = [(n, _read(spark, d, n), "id", "user_id", "created_at") for n in ("shop_orders", "access_log")]
    return orphans(refs, _read(spark, d, "users"), "id", (_read(spark, d, "user_change"), "user_id", "change_kind", "changed_at", "change_id"), no_key=0)


def p3_found(spark, d):
    return _orphans(spark, d).select("table_name", "row_id")


def p3_report(spark, d):
    return orphan_report(_orphans(spark, d))


def _texts(*names):
    return [F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n) for n in names]


def p4_sessions(spark, d):
    log = _log(spark, d).withColumn("action", F.when(F.col("action") != "", F.col("action")))
    return sessions(log, "user_id", "created_at", 1800, "id", "action").select(F.col("entity").alias("user_id"), *_texts("start_at", "end_at"), "duration_s", "events", F.col("kinds").alias("actions"))


def p4_found(spark, d):
    return sessions(_read(spark, d, "access_log").where("user_id != 0"), "user_id", "created_at", 1800, "id").select(F.col("entity").alias("user_id"), *_texts("start_at", "end_at"))


def _regions(spark, d):
    return keyed_results(_read(spark, d, "region_order").withColumn("region", normalised("region")), "region", "amount", ident="id")


def _buyers(spark, d):
    return keyed_results(_read(spark, d, "shop_orders"), "user_id", "amount", ident="id")


def _plain(df, name):
    return df.select(F.col("key").alias(name), "rows", "values", *[F.col(c).cast("double").alias(c) for c in ("total", "least", "most", "q50", "q90", "q99")], F.round("share", 9).alias("share"), "heavy")


def p5_regions(spark, d):
    return _plain(_regions(spark, d), "region")


def p5_users(spark, d):
    return _plain(_buyers(spark, d), "user_id")


def p5_found(spark, d):
    regions = heavy_keys(_read(spark, d, "region_order").select("id", normalised("region").alias("region")), "region", 0.05, "id").where("key != ''")
    buyers = heavy_keys(_read(spark, d, "shop_orders"), "user_id", 0.05, "id").where("key != 0")
    return regions.select(F.lit("region_order").alias("table_name"), F.col("key").alias("key_value")).unionAll(buyers.select(F.lit("shop_orders"), F.col("key").cast("string")))


QUERIES = {f.__name__: f for f in (p1_found, p1_rolling, p2_found, p2_features, p2_cells, p2_wide_cells, p3_found, p3_report, p4_found, p4_sessions, p5_found, p5_regions, p5_users)}

_ORDERS = "orders_once AS (SELECT id, max(user_id) AS user_id, max(amount) AS amount, max(created_at) AS created_at FROM shop_orders GROUP BY id)"
_DAILY = _ORDERS + """, daily AS (SELECT user_id, CAST(created_at AS DATE) AS d, count(*) AS n, count(amount) AS v, sum(coalesce(amount, 0)) AS s, min(amount) AS lo, max(amount) AS hi
  FROM orders_once WHERE created_at IS NOT NULL AND created_at < TIMESTAMP '2027-01-01' GROUP BY 1, 2),
days AS (SELECT user_id, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), TIMESTAMP '2026-12-31', INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT user_id, min(d) AS a FROM daily GROUP BY 1)),
full_days AS (SELECT y.user_id, y.d, coalesce(n, 0) AS n, coalesce(v, 0) AS v, coalesce(s, 0) AS s, lo, hi FROM days y LEFT JOIN daily x ON y.user_id = x.user_id AND y.d = x.d),
rolled AS (SELECT user_id, d, n, """ + ", ".join(
    f"sum(n) OVER w{s} AS n{s}, sum(v) OVER w{s} AS v{s}, sum(s) OVER w{s} AS s{s}, min(lo) OVER w{s} AS lo{s}, max(hi) OVER w{s} AS hi{s}" for s in (7, 30)
) + " FROM full_days WINDOW " + ", ".join(f"w{s} AS (PARTITION BY user_id ORDER BY d ROWS BETWEEN {s - 1} PRECEDING AND CURRENT ROW)" for s in (7, 30)) + ")"
_LOG = "log AS (SELECT id, max(user_id) AS user_id, max(lower(trim(action, ' \t'))) AS action, max(created_at) AS created_at FROM access_log GROUP BY id)"
_ORPHANS = _ORDERS + """, log AS (SELECT id, max(user_id) AS user_id, max(created_at) AS created_at FROM access_log GROUP BY id),
refs AS (SELECT 'shop_orders' AS table_name, id, user_id, created_at FROM orders_once UNION ALL SELECT 'access_log', id, user_id, created_at FROM log),
ch AS (SELECT change_id, max(user_id) AS user_id, max(changed_at) AS changed_at, max(lower(trim(change_kind, ' \t'))) AS kind FROM user_change GROUP BY change_id),
firsts AS (SELECT user_id, arg_min(kind, changed_at) AS kind FROM ch GROUP BY 1),
known AS (SELECT DISTINCT id FROM users),
judged AS (SELECT r.*, c.kind AS latest, f.kind AS first_kind, k.id IS NOT NULL AS has_row
  FROM refs r ASOF LEFT JOIN ch c ON r.user_id = c.user_id AND r.created_at >= c.changed_at LEFT JOIN firsts f ON r.user_id = f.user_id LEFT JOIN known k ON r.user_id = k.id WHERE r.user_id <> 0),
gone AS (SELECT * FROM judged WHERE CASE WHEN created_at IS NULL THEN NOT has_row WHEN latest IS NOT NULL THEN latest = 'delete' WHEN first_kind IS NOT NULL THEN first_kind = 'create' ELSE NOT has_row END)"""
_SESSIONS = "timed AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM log WHERE created_at IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY created_at, id)), numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY created_at, id) AS s FROM timed)"


def _keyed(table, key, name):
    q = lambda p: f"CAST(list_extract(vs, greatest(1, CAST(ceil({p} * len(vs) - 1e-9) AS BIGINT))) AS DOUBLE)"
    return f"""WITH once AS (SELECT id, max({key}) AS k, max(amount) AS amount FROM {table} GROUP BY id), t AS (SELECT k, count(*) AS n, count(amount) AS v, sum(amount) AS s, min(amount) AS lo, max(amount) AS hi, list_sort(list(amount) FILTER (WHERE amount IS NOT NULL)) AS vs FROM once GROUP BY k)
SELECT k AS {name}, n AS rows, v AS "values", CAST(s AS DOUBLE) AS total, CAST(lo AS DOUBLE) AS least, CAST(hi AS DOUBLE) AS most, {q(0.5)} AS q50, {q(0.9)} AS q90, {q(0.99)} AS q99, round(n / (SELECT sum(n) FROM t), 9) AS share, n / (SELECT sum(n) FROM t) > 0.05 AS heavy FROM t"""


SQL = {
    "p1_rolling": f"WITH {_DAILY} SELECT user_id, strftime(d, '%Y-%m-%d') AS on_day, " + ", ".join(f"CAST(n{s} AS BIGINT) AS rows_{s}, CAST(s{s} AS DOUBLE) AS total_{s}, CAST(s{s} AS DOUBLE) / nullif(v{s}, 0) AS average_{s}, CAST(lo{s} AS DOUBLE) AS least_{s}, CAST(hi{s} AS DOUBLE) AS most_{s}" for s in (7, 30)) + " FROM rolled",
    "p1_found": f"WITH {_DAILY} SELECT user_id, strftime(d, '%Y-%m-%d') AS on_day, x AS span_days FROM rolled, (SELECT unnest([7, 30]) AS x) WHERE user_id <> 0 AND n = 0 AND (x = 7 AND s7 >= 600 OR x = 30 AND s30 >= 1500)",
    "p2_found": f"WITH {_LOG} SELECT user_id, action FROM log WHERE user_id <> 0 AND action <> '' AND created_at IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3 AND max(created_at) >= TIMESTAMP '2026-12-01'",
    "p2_cells": f"WITH {_LOG}, c AS (SELECT user_id, action, count(*) AS n, max(created_at) AS l FROM log WHERE action <> '' GROUP BY 1, 2) SELECT user_id, CAST(sum(n) OVER (PARTITION BY user_id) AS BIGINT) AS events, count(*) OVER (PARTITION BY user_id) AS types, action, n, strftime(l, '%Y-%m-%d %H:%M:%S') AS last_at, coalesce(CAST(epoch(TIMESTAMP '2027-01-01' - l) AS BIGINT), -1) AS recency_s FROM c",
    "p3_found": f"WITH {_ORPHANS} SELECT table_name, id AS row_id FROM gone",
    "p3_report": f"WITH {_ORPHANS} SELECT table_name, strftime(created_at, '%Y-%m') AS month, count(*) AS orphan_rows, count(DISTINCT user_id) AS orphan_keys FROM gone GROUP BY 1, 2",
    "p4_found": f"WITH {_LOG}, {_SESSIONS} SELECT user_id, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS start_at, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS end_at FROM numbered WHERE user_id <> 0 GROUP BY user_id, s",
    "p4_sessions": f"WITH {_LOG}, {_SESSIONS} SELECT user_id, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS start_at, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS end_at, CAST(epoch(max(created_at) - min(created_at)) AS BIGINT) AS duration_s, count(*) AS events, count(DISTINCT nullif(action, '')) AS actions FROM numbered GROUP BY user_id, s",
    "p5_regions": _keyed("region_order", "lower(trim(region, ' \t'))", "region"),
    "p5_users": _keyed("shop_orders", "user_id", "user_id"),
    "p5_found": """WITH r AS (SELECT id, max(lower(trim(region, ' \t'))) AS k FROM region_order GROUP BY id), s AS (SELECT id, max(user_id) AS k FROM shop_orders GROUP BY id)
SELECT 'region_order' AS table_name, k AS key_value FROM r GROUP BY k HAVING k <> '' AND count(*) > 0.05 * (SELECT count(*) FROM r)
UNION ALL SELECT 'shop_orders', CAST(k AS VARCHAR) FROM s GROUP BY k HAVING k <> 0 AND count(*) > 0.05 * (SELECT count(*) FROM s)""",
}
SQL["p2_wide_cells"] = SQL["p2_cells"]
