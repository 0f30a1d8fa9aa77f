"""Queries of the sharding engine, one per operator, and their SQL."""

from __future__ import annotations

import atexit
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..engine import Engine
from ..functions import strategies as S
from ..errors import ShardingError
from ..functions.text import TABLE_PATTERN, operation_expr, table_of_expr
from ..operators.common import shared_folder
from ..plans.predicate import ALL
from ..plans.rules import Router, ShardCatalog, ShardingRule
from ..sources.routing import Operation, RandomPolicy, RoundRobinPolicy, log, select_pool

_ENGINES: dict[tuple, Engine] = {}


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """A fresh folder below the one the cluster shares, removed when the program ends."""
    path = f"{shared_folder(spark)}/shardloom-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def remove():
        try:
            files.delete(where, True)
        except Exception:  # the session has ended before the program
            pass

    atexit.register(remove)
    return path


def _modulo(n: int) -> S.CustomStrategy:
    # remainders have the sign of the key, in both forms
    return S.CustomStrategy(lambda v: f"_{abs(int(v)) % n * (1 if v >= 0 else -1)}", lambda c: F.concat(F.lit("_"), (c % n).cast("string")))


def build(spark: SparkSession, d: str, tables: tuple[str, ...] = ("orders",), replicas: bool = False) -> Engine:
    """An engine over fresh copies of tables of ``d``: orders and customer by customer key in 4 databases of 10 tables,
    lineitem in ranges of the order key, events in daily tables."""
    root = _folder(spark)
    routers = lambda: [Router(f"db{i}", [f"{root}/source"], [f"{root}/replica"] if replicas else []) for i in range(4)]
    bounds = S.RangeStrategy([0, 1000, 5000, 10000])
    catalog = ShardCatalog(spark, f"{root}/default")
    catalog.add_rule(ShardingRule("o_custkey", table_strategy=_modulo(10), database_strategy=_modulo(4), routers=routers()), "orders")
    catalog.add_rule(ShardingRule("c_custkey", table_strategy=_modulo(10), database_strategy=_modulo(4), routers=routers()), "customer")
    catalog.add_rule(ShardingRule("l_orderkey", table_strategy=bounds, database_strategy=bounds, routers=routers()), "lineitem")
    catalog.add_rule(ShardingRule("ts", table_strategy=S.DateStrategy("20060102")), "events")
    catalog.add_table("nation")
    engine = Engine(catalog)
    for t in tables:
        engine.write(_read(spark, d, t), t)
    return engine


def shared(spark: SparkSession, d: str, *tables: str) -> Engine:
    """The engine over these tables, written once per session."""
    key = (spark.sparkContext.applicationId, d, tables)
    if key not in _ENGINES:
        _ENGINES[key] = build(spark, d, tables)
    return _ENGINES[key]


def _placed(df: DataFrame, key: str, strategy, *keep: str, name: str = "suffix") -> DataFrame:
    return df.select(*keep, strategy.expr(F.col(key), df.schema[key].dataType).alias(name))


# shard functions


def hash_numeric(spark, d):
    return _placed(_read(spark, d, "orders"), "o_custkey", S.HashStrategy(4), "o_orderkey", "o_custkey")


def hash_string(spark, d):
    return _placed(_read(spark, d, "customer"), "c_name", S.HashStrategy(10), "c_custkey", "c_name")


def hash_negative_float(spark, d):
    return _placed(_read(spark, d, "supplier"), "s_acctbal", S.HashStrategy(10), "s_suppkey")


def default_padded(spark, d):
    return _placed(_read(spark, d, "orders"), "o_custkey", S.PaddedModulo(16), "o_orderkey", "o_custkey")


def default_negative(spark, d):
    return _placed(_read(spark, d, "supplier").withColumn("k", S.int64_expr(F.col("s_acctbal"), T.DoubleType())), "k", S.PaddedModulo(4), "s_suppkey", "k")


def default_string(spark, d):
    a = _read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("k"))
    b = _read(spark, d, "customer").select(F.col("c_name").alias("k"))
    return _placed(a.unionAll(b), "k", S.PaddedModulo(16), "k")


def enum_default(spark, d):
    return _placed(_read(spark, d, "region"), "r_name", S.EnumStrategy({"AFRICA": "_af", "ASIA": "_as", "EUROPE": "_eu"}, "_other"), "r_regionkey", "r_name")


def enum_strict(spark, d):
    """Without a default a value that is not listed would be an error; all are."""
    listed = {"AFRICA": "_af", "AMERICA": "_am", "ASIA": "_as", "EUROPE": "_eu", "MIDDLE EAST": "_me"}
    return _placed(_read(spark, d, "region"), "r_name", S.EnumStrategy(listed), "r_regionkey", "r_name")


def date_daily(spark, d):
    return _placed(_read(spark, d, "events"), "ts", S.DateStrategy(), "event_id")


def date_monthly(spark, d):
    return _placed(_read(spark, d, "orders"), "o_orderdate", S.DateStrategy("200601"), "o_orderkey")


def date_unix(spark, d):
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("bigint")
    return _placed(_read(spark, d, "events").withColumn("n", seconds), "n", S.DateStrategy(), "event_id", "n")


def date_rfc3339(spark, d):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))
    return _placed(_read(spark, d, "events").withColumn("s", text), "s", S.DateStrategy("2006010215"), "event_id", "s")


def range_basic(spark, d):
    return _placed(_read(spark, d, "lineitem"), "l_orderkey", S.RangeStrategy([0, 1000, 5000, 10000]), "l_orderkey", "l_linenumber")


def range_custom(spark, d):
    return _placed(_read(spark, d, "lineitem"), "l_orderkey", S.RangeStrategy([0, 100, 500], lambda i: f"_range_{i}"), "l_orderkey", "l_linenumber")


def no_sharding(spark, d):
    return _placed(_read(spark, d, "customer"), "c_custkey", S.NoSharding(), "c_custkey")


def custom_last_two(spark, d):
    rule = S.CustomStrategy(lambda v: f"_{int(v) % 100 % 4}", lambda c: F.concat(F.lit("_"), (c % 100 % 4).cast("string")))
    return _placed(_read(spark, d, "customer"), "c_custkey", rule, "c_custkey")


def custom_python(spark, d):
    """The user's Python function without a native form, through Arrow."""
    return _placed(_read(spark, d, "customer"), "c_custkey", S.CustomStrategy(lambda v: f"_{int(v) % 7}"), "c_custkey")


def _values(spark, name, *rows):
    return spark.createDataFrame([(x,) for x in rows], f"{name} string")


_SUFFIXES = ("_0", "_07", "_bj", "", "_-3", "12", "_12.5", "__4")


def suffix_to_index(spark, d):
    return _values(spark, "suffix", *_SUFFIXES).select("suffix", S.suffix_to_index_expr(F.col("suffix")).cast("bigint").alias("db_index"))


# routing and scans


def route_two_level(spark, d):
    rows = shared(spark, d, "orders").scan("orders")
    return rows.groupBy(F.col("_db").cast("bigint").alias("db"), F.col("_tbl").alias("tbl")).agg(F.count(F.lit(1)).alias("n"))


_ORDER = "o_orderkey, o_custkey, o_totalprice"


def _orders(sql, **kw):
    return lambda spark, d: shared(spark, d, "orders").sql(f"SELECT {_ORDER} FROM orders {sql}", **kw)


def order_limit(spark, d):
    return shared(spark, d, "orders").sql(f"SELECT {_ORDER} FROM orders WHERE o_custkey = 5 ORDER BY orders.o_totalprice DESC, orders.o_orderkey LIMIT 5")


def ignore_flag(spark, d):
    """The table without suffix under the default root, past the rule."""
    engine = build(spark, d, ())
    _read(spark, d, "orders").write.parquet(f"{engine.catalog.default_root}/orders")
    return engine.table("orders", ignore_sharding=True).select(*_ORDER.split(", "))


def range_scan(spark, d):
    return shared(spark, d, "lineitem").sql("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey >= 1200 AND l_orderkey < 4800 AND l_quantity > 40")


def date_scan(spark, d):
    return shared(spark, d, "events").sql("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP_NTZ '2024-01-05 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-07 12:00:00'")


def shard_agg_all(spark, d):
    return shared(spark, d, "orders").sql("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")


def shard_window(spark, d):
    return shared(spark, d, "orders").sql("SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2")


def co_shard_join(spark, d):
    return shared(spark, d, "orders", "customer").sql("SELECT c_custkey, c_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name")


def pruned_join(spark, d):
    """The key's value reaches both tables: each reads one shard."""
    return shared(spark, d, "orders", "customer").sql("SELECT c_name, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey = 7")


# changes


def _insert(spark, d, keys):
    engine = build(spark, d, ())
    engine.catalog.entry("orders").schema = _read(spark, d, "orders").schema
    values = ", ".join(f"({900_000 + i}, {k}, 'O', {i}.5)" for i, k in enumerate(keys))
    engine.sql(f"INSERT INTO orders (o_orderkey, o_custkey, o_orderstatus, o_totalprice) VALUES {values}")
    return engine.scan("orders").select("o_orderkey", "o_custkey", F.col("_db").cast("bigint").alias("db"), F.col("_tbl").alias("tbl"))


def insert_route(spark, d):
    return _insert(spark, d, (1, 11, 2, 1001, 2002, 3003, 4004, 5005, 10001))


def insert_select(spark, d):
    engine = build(spark, d, ())
    engine.catalog.entry("orders").schema = _read(spark, d, "orders").schema
    _read(spark, d, "orders").createOrReplaceTempView("incoming_orders")
    engine.sql("INSERT INTO orders SELECT * FROM incoming_orders")
    return engine.scan("orders").select("o_orderkey", "o_custkey", F.col("_db").cast("bigint").alias("db"), F.col("_tbl").alias("tbl"))


def insert_diff_suffix(spark, d):
    """Whether a strict INSERT refuses a batch of keys."""
    engine, out = build(spark, d, ()), []
    engine.catalog.entry("orders").schema = _read(spark, d, "orders").schema
    for batch, keys in (("same", (1, 11)), ("mixed", (1, 2))):
        try:
            engine.sql("INSERT INTO orders (o_orderkey, o_custkey) VALUES " + ", ".join(f"({k}, {k})" for k in keys), strict=True)
            out.append((batch, False))
        except ShardingError:
            out.append((batch, True))
    return spark.createDataFrame(out, "batch string, different boolean")


_WRONG = (
    ("SELECT * FROM orders WHERE o_totalprice > 5", True, "MissingShardingKey"), ("SELECT * FROM orders WHERE o_custkey = 1 OR o_custkey = 2", True, "MissingShardingKey"),
    ("INSERT INTO orders (o_orderkey) VALUES (1)", False, "MissingShardingKey"), ("INSERT INTO orders (o_orderkey, o_custkey) VALUES (1, 1), (2, 2)", True, "DifferentSuffix"),
    ("INSERT INTO orders (o_orderkey, o_custkey) VALUES (1)", False, "ShardingError"), ("DROP TABLE orders", False, "NotImplementedError"), ("SELECT * FROM orders WHERE o_custkey = 5", True, ""),
)


def error_contract(spark, d):
    """The errors of statements that a rule refuses; the last one is none."""
    engine, out = build(spark, d), []
    for sql, strict, _ in _WRONG:
        try:
            engine.sql(sql, strict=strict)
            out.append((sql, ""))
        except Exception as e:
            out.append((sql, type(e).__name__))
    return spark.createDataFrame(out, "stmt string, error string")


def update_rows(spark, d):
    engine = build(spark, d)
    engine.sql("UPDATE orders SET o_totalprice = o_totalprice * 2, o_orderstatus = ? WHERE o_custkey IN (5, 6) AND o_totalprice > 1000", args=["X"])
    return engine.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))


def update_key(spark, d):
    """Rows whose key changes move to the key's shard."""
    engine = build(spark, d)
    engine.sql("UPDATE orders SET o_custkey = o_custkey + 1 WHERE o_custkey = 5")
    return engine.scan("orders").select("o_orderkey", "o_custkey", F.col("_db").cast("bigint").alias("db"), F.col("_tbl").alias("tbl"))


def delete_rows(spark, d):
    engine = build(spark, d)
    engine.sql("DELETE FROM orders WHERE o_custkey = 5 OR o_custkey BETWEEN 100 AND 120 AND o_totalprice < 50000")
    return engine.table("orders").select(*_ORDER.split(", "))


def delete_subquery(spark, d):
    """Keys from another table and a bound from the table itself, right after a pruned query on it."""
    engine = build(spark, d, ("orders", "customer"))
    engine.sql("SELECT * FROM orders WHERE o_custkey = 5")
    engine.sql("DELETE FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 2000) AND o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
    return engine.table("orders").select(*_ORDER.split(", "))


def update_subquery(spark, d):
    engine = build(spark, d, ("orders", "customer"))
    engine.sql("SELECT * FROM orders WHERE o_custkey = 5")
    engine.sql("UPDATE orders o SET o_totalprice = (SELECT max(c_acctbal) FROM customer), o_orderstatus = 'Z' WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_nationkey = 3)")
    return engine.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


# statements


_STATEMENTS = (
    "SELECT * FROM order_info WHERE id=1", "  select * from t", "delete from `order_info` where id=1", "UPDATE order_info SET a=1",
    "INSERT INTO order_info (user_id) VALUES (1)", "INSERT IGNORE INTO order_info (a) values(1)", "INSERT INTO order_info(user_id) VALUES (1)",
    "SELECT * FROM db.order_info", "select * from order_info;", "SELECT EXTRACT(YEAR FROM ctime) FROM order_info", "select 1", "SELECT 1",
    "SELECT * FROM t WHERE k = 1 FOR UPDATE", "SELECT * FROM t WHERE k = 1 FOR UPDATE;", "WITH c AS (SELECT 1) SELECT * FROM c", "DELETE FROM t",
)


def classify_op(spark, d):
    return _values(spark, "stmt", *_STATEMENTS).select("stmt", operation_expr(F.col("stmt")).alias("op"))


def extract_table(spark, d):
    return _values(spark, "stmt", *_STATEMENTS).select("stmt", table_of_expr(F.col("stmt")).alias("tbl"))


def missing_key(spark, d):
    """Which predicates leave all shards, by the planner."""
    engine, out = shared(spark, d, "orders"), []
    for cond in ("o_custkey = 5", "o_custkey IN (5, 6)", "o_custkey = 1 OR o_custkey = 2", "o_totalprice > 5", "NOT o_custkey = 5", "o_custkey = 1 AND o_custkey = 2"):
        shards = engine.resolve(f"SELECT * FROM orders WHERE {cond}")[1].shards.get("orders", frozenset())
        out.append((cond, -1 if shards is ALL else len(shards)))
    return spark.createDataFrame(out, "cond string, shards bigint")


# read and write splitting


def resolver_precedence(spark, d):
    """Where the rows of a table are read from: by the router named, the table's router or the one that serves all."""
    root = _folder(spark)
    routers = [Router("main", [f"{root}/main"], database=0), Router("audit", [f"{root}/audit"], tables=["log"], database=0), Router("special", [f"{root}/special"], tables=["rare"], database=0)]
    engine = Engine(ShardCatalog(spark, f"{root}/default").add_rule(ShardingRule("r_regionkey", table_strategy=_modulo(2), routers=routers), "log", "orders"))
    cases, out = (("special", "log"), ("", "log"), ("", "orders"), ("audit", "orders")), None
    for use, table in cases:
        engine.write(_read(spark, d, "region"), table, use=use or None)
    for use, table in cases:
        rows = engine.table(table, use=use or None).select(F.lit(use).alias("use_name"), F.lit(table).alias("tbl"), F.regexp_extract(F.input_file_name(), "/(main|audit|special|default)/", 1).alias("router")).distinct()
        out = rows if out is None else out.unionAll(rows)
    return out


def default_fallback(spark, d):
    routers = {"both": Router("r", ["s"], ["p"]), "no_replica": Router("r", ["s"]), "none": Router("r")}
    return spark.createDataFrame([(n, o.value, select_pool(r, o, "default")[0]) for n, r in routers.items() for o in Operation], "router string, op string, pool string")


def round_robin(spark, d):
    return RoundRobinPolicy.assign(_read(spark, d, "nation").select("n_nationkey"), 3, "n_nationkey", name="pick")


def strict_round_robin(spark, d):
    from ..sources.routing import StrictRoundRobinPolicy

    policy = StrictRoundRobinPolicy()
    return spark.createDataFrame([(i, policy.pick(4)) for i in range(1, 11)], "turn bigint, pick bigint")


def random_policy(spark, d):
    return _read(spark, d, "nation").select("n_nationkey", RandomPolicy(3).expr(3).alias("pick"))


def _split(engine):
    engine.sync_replicas("orders")
    engine.sql("DELETE FROM orders WHERE o_custkey = 5")
    sql = "SELECT o_orderkey FROM orders WHERE o_custkey = 5"
    read, write = engine.sql(sql), engine.sql(sql + " FOR UPDATE")
    return read.select(F.lit("replica").alias("pool"), "o_orderkey").unionAll(write.select(F.lit("source"), "o_orderkey"))


def rw_split(spark, d):
    """Reads see the replicas' snapshot, writes and FOR UPDATE the source."""
    return _split(build(spark, d, ("orders",), replicas=True))


def table_only_split(spark, d):
    """The same with a rule that has no database function: its rows are the first router's."""
    root = _folder(spark)
    rule = ShardingRule("o_custkey", table_strategy=_modulo(10), routers=[Router("only", [f"{root}/source"], [f"{root}/replica"])])
    engine = Engine(ShardCatalog(spark, f"{root}/default").add_rule(rule, "orders"))
    engine.write(_read(spark, d, "orders"), "orders")
    return _split(engine)


_DSNS = ("a", "a/", "/a", "b", "b", "c")


def _pools(spark, d):
    """Six databases on three roots; a table is written and read through their pools, then one root is given up."""
    root = _folder(spark)
    rule = ShardingRule("r_regionkey", table_strategy=S.NoSharding(), database_strategy=_modulo(6), routers=[Router(f"db{i}", [f"{root}/{x}"]) for i, x in enumerate(_DSNS)])
    engine = Engine(ShardCatalog(spark, f"{root}/default").add_rule(rule, "region"))
    engine.write(_read(spark, d, "region"), "region")
    engine.table("region")
    pools = engine.catalog.pools
    assert "region" in pools.pool(f"{root}/a").tables
    pools.release(f"{root}/c")
    return {k.replace(root, "/data"): n for k, n in pools.stats().items()}, pools.count()


def pool_stats(spark, d):
    return spark.createDataFrame(sorted(_pools(spark, d)[0].items()), "root string, refs bigint")


def pool_count(spark, d):
    return spark.createDataFrame([(_pools(spark, d)[1],)], "pools bigint")


_TRACED = ("SELECT count(*) FROM orders WHERE o_custkey = 5", "SELECT * FROM orders WHERE o_custkey = 5 FOR UPDATE", "DELETE FROM orders WHERE o_custkey = -1", "UPDATE orders SET o_orderstatus = 'X' WHERE o_custkey = -1")


def trace_label(spark, d):
    """The lines an engine logs for statements on a traced table."""
    engine, lines = build(spark, d, ("orders",), replicas=True), []
    engine.sync_replicas("orders")
    engine.catalog.entry("orders").rule.routers[0].trace = True
    keep, level = logging.Handler(), log.level
    keep.emit = lambda r: lines.append((r.getMessage(),))
    log.addHandler(keep)
    log.setLevel(logging.INFO)
    try:
        for sql in _TRACED:
            engine.sql(sql)
    finally:
        log.removeHandler(keep)
        log.setLevel(level)
    return spark.createDataFrame(lines, "line string").where("line LIKE '[%'")


QUERIES = {
    f.__name__: f
    for f in (
        hash_numeric, hash_string, hash_negative_float, default_padded, default_negative, default_string, enum_default, enum_strict, date_daily, date_monthly, date_unix, date_rfc3339, range_basic, range_custom, no_sharding, custom_last_two, custom_python, suffix_to_index,
        route_two_level, order_limit, ignore_flag, range_scan, date_scan, shard_agg_all, shard_window, co_shard_join, pruned_join, insert_route, insert_select, insert_diff_suffix, error_contract, update_rows, update_key, delete_rows, delete_subquery, update_subquery, classify_op, extract_table, missing_key,
        resolver_precedence, default_fallback, round_robin, strict_round_robin, random_policy, rw_split, table_only_split, pool_stats, pool_count, trace_label,
    )
}
#: Plain queries on sharded orders: the same WHERE in both dialects.
_WHERE = {
    "point_lookup": "WHERE o_custkey = 5",
    "point_qualified": "WHERE orders.o_custkey = 5",
    "point_reversed": "WHERE 5 = o_custkey AND o_totalprice > 100",
    "in_list": "WHERE o_custkey IN (5, 17, 203, 1001)",
    "or_union": "WHERE o_custkey = 1 OR o_custkey = 2",
    "not_eq": "WHERE NOT o_custkey = 5",
    "contradiction": "WHERE o_custkey = 1 AND o_custkey = 2",
    "range_pred": "WHERE o_custkey BETWEEN 100 AND 110",
    "other_column": "WHERE o_totalprice > 150000",
}
QUERIES |= {k: _orders(w) for k, w in _WHERE.items()}
QUERIES["point_bind"] = _orders("WHERE o_custkey = ? AND o_totalprice > ?", args=[5, 1000.0])
QUERIES["no_hint_full_scan"] = lambda spark, d: shared(spark, d, "orders").sql(f"SELECT /*+ nosharding */ {_ORDER} FROM orders WHERE o_custkey = 5")


def _crc(s: str) -> str:
    return (
        f"xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(1, octet_length(encode({s})) + 1), lambda i: ('0x' || hex(encode({s}))[2*i-1:2*i])::bigint)), "
        "lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)), 4294967295::bigint)"
    )


def _union(name: str, rows) -> str:
    return "(VALUES " + ", ".join("('" + x.replace("'", "''") + "')" for x in rows) + f") t({name})"


#: The fixed pattern in DuckDB's spelling: quotes doubled, ``$`` for the end, case ignored by an option.
_TABLE = TABLE_PATTERN.removeprefix("(?i)").replace(r"\z", "$").replace("'", "''")
_SHARDED = "CAST(o_custkey % 4 AS BIGINT) AS db, '_' || (o_custkey % 10) AS tbl"
SQL = {
    "hash_numeric": "SELECT o_orderkey, o_custkey, '_' || abs(o_custkey % 4) AS suffix FROM orders",
    "hash_string": f"SELECT c_custkey, c_name, '_' || ({_crc('c_name')} % 10) AS suffix FROM customer",
    "hash_negative_float": "SELECT s_suppkey, '_' || abs(CAST(trunc(s_acctbal) AS BIGINT) % 10) AS suffix FROM supplier",
    "default_padded": "SELECT o_orderkey, o_custkey, printf('_%02d', o_custkey % 16) AS suffix FROM orders",
    "default_negative": "SELECT s_suppkey, CAST(trunc(s_acctbal) AS BIGINT) AS k, printf('_%01d', CAST(trunc(s_acctbal) AS BIGINT) % 4) AS suffix FROM supplier",
    "default_string": f"SELECT k, printf('_%02d', CASE WHEN regexp_full_match(k, '[+-]?[0-9]+') THEN TRY_CAST(k AS BIGINT) ELSE {_crc('k')} END % 16) AS suffix FROM (SELECT CAST(o_custkey AS VARCHAR) AS k FROM orders UNION ALL SELECT c_name FROM customer)",
    "enum_default": "SELECT r_regionkey, r_name, CASE r_name WHEN 'AFRICA' THEN '_af' WHEN 'ASIA' THEN '_as' WHEN 'EUROPE' THEN '_eu' ELSE '_other' END AS suffix FROM region",
    "enum_strict": "SELECT r_regionkey, r_name, CASE r_name WHEN 'AFRICA' THEN '_af' WHEN 'AMERICA' THEN '_am' WHEN 'ASIA' THEN '_as' WHEN 'EUROPE' THEN '_eu' WHEN 'MIDDLE EAST' THEN '_me' END AS suffix FROM region",
    "date_daily": "SELECT event_id, strftime(ts, '_%Y%m%d') AS suffix FROM events",
    "date_monthly": "SELECT o_orderkey, strftime(o_orderdate, '_%Y%m') AS suffix FROM orders",
    "date_unix": "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS n, strftime(ts, '_%Y%m%d') AS suffix FROM events",
    "date_rfc3339": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+08:00') AS s, strftime(ts, '_%Y%m%d%H') AS suffix FROM events",
    "range_basic": "SELECT l_orderkey, l_linenumber, '_' || greatest(0, len(list_filter([0, 1000, 5000, 10000], lambda b: b <= l_orderkey)) - 1) AS suffix FROM lineitem",
    "range_custom": "SELECT l_orderkey, l_linenumber, '_range_' || greatest(0, len(list_filter([0, 100, 500], lambda b: b <= l_orderkey)) - 1) AS suffix FROM lineitem",
    "no_sharding": "SELECT c_custkey, '' AS suffix FROM customer",
    "custom_last_two": "SELECT c_custkey, '_' || (c_custkey % 100 % 4) AS suffix FROM customer",
    "custom_python": "SELECT c_custkey, '_' || (c_custkey % 7) AS suffix FROM customer",
    "suffix_to_index": f"SELECT suffix, coalesce(CASE WHEN regexp_full_match(x, '[+-]?[0-9]+') THEN TRY_CAST(x AS BIGINT) END, 0) AS db_index FROM (SELECT suffix, regexp_replace(suffix, '^_', '') AS x FROM {_union('suffix', _SUFFIXES)})",
    "route_two_level": f"SELECT {_SHARDED}, count(*) AS n FROM orders GROUP BY 1, 2",
    "order_limit": f"SELECT {_ORDER} FROM orders WHERE o_custkey = 5 ORDER BY o_totalprice DESC, o_orderkey LIMIT 5",
    "ignore_flag": f"SELECT {_ORDER} FROM orders",
    "range_scan": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey >= 1200 AND l_orderkey < 4800 AND l_quantity > 40",
    "date_scan": "SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07 12:00:00'",
    "shard_agg_all": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus",
    "shard_window": "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn FROM orders) WHERE rn <= 2",
    "co_shard_join": "SELECT c_custkey, c_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name",
    "pruned_join": "SELECT c_name, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey = 7",
    "insert_route": f"SELECT CAST(900000 + i AS BIGINT) AS o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, {_SHARDED} FROM (VALUES (0, 1), (1, 11), (2, 2), (3, 1001), (4, 2002), (5, 3003), (6, 4004), (7, 5005), (8, 10001)) t(i, o_custkey)",
    "insert_select": f"SELECT o_orderkey, o_custkey, {_SHARDED} FROM orders",
    "insert_diff_suffix": "SELECT batch, count(DISTINCT k % 10) > 1 AS different FROM (VALUES ('same', 1), ('same', 11), ('mixed', 1), ('mixed', 2)) t(batch, k) GROUP BY batch",
    "update_rows": "SELECT o_orderkey, o_custkey, CASE WHEN h THEN 'X' ELSE o_orderstatus END AS o_orderstatus, round(CASE WHEN h THEN o_totalprice * 2 ELSE o_totalprice END, 2) AS o_totalprice FROM (SELECT *, o_custkey IN (5, 6) AND o_totalprice > 1000 AS h FROM orders)",
    "update_key": f"SELECT o_orderkey, o_custkey, {_SHARDED} FROM (SELECT o_orderkey, CASE WHEN o_custkey = 5 THEN 6 ELSE o_custkey END AS o_custkey FROM orders)",
    "delete_rows": f"SELECT {_ORDER} FROM orders WHERE NOT (o_custkey = 5 OR o_custkey BETWEEN 100 AND 120 AND o_totalprice < 50000)",
    "error_contract": "SELECT * FROM (VALUES " + ", ".join(f"('{sql}', '{error}')" for sql, _, error in _WRONG) + ") t(stmt, error)",
    "delete_subquery": f"SELECT {_ORDER} FROM orders WHERE NOT (o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 2000) AND o_totalprice > (SELECT avg(o_totalprice) FROM orders))",
    "update_subquery": "SELECT o_orderkey, o_custkey, CASE WHEN h THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN h THEN (SELECT max(c_acctbal) FROM customer) ELSE o_totalprice END AS o_totalprice FROM (SELECT *, o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) AS h FROM orders)",
    "classify_op": f"SELECT stmt, CASE WHEN octet_length(encode(trim(stmt))) > 10 AND lower(trim(stmt)[1:6]) = 'select' AND lower(right(trim(stmt), 10)) <> 'for update' THEN 'read' ELSE 'write' END AS op FROM {_union('stmt', _STATEMENTS)}",
    "extract_table": f"SELECT stmt, regexp_extract(stmt, '{_TABLE}', 1, 'i') AS tbl FROM {_union('stmt', _STATEMENTS)}",
    "missing_key": "SELECT * FROM (VALUES ('o_custkey = 5', 1::BIGINT), ('o_custkey IN (5, 6)', 2), ('o_custkey = 1 OR o_custkey = 2', 2), ('o_totalprice > 5', -1), ('NOT o_custkey = 5', -1), ('o_custkey = 1 AND o_custkey = 2', 0)) t(cond, shards)",
    "resolver_precedence": "SELECT use_name, tbl, CASE WHEN use_name <> '' THEN use_name WHEN tbl = 'log' THEN 'audit' ELSE 'main' END AS router FROM (VALUES ('special', 'log'), ('', 'log'), ('', 'orders'), ('audit', 'orders')) t(use_name, tbl)",
    "default_fallback": "SELECT router, op, CASE WHEN router = 'none' THEN 'default' WHEN router = 'both' AND op = 'read' THEN 'p' ELSE 's' END AS pool FROM (VALUES ('both'), ('no_replica'), ('none')) t(router), (VALUES ('read'), ('write')) o(op)",
    "round_robin": "SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) % 3 AS pick FROM nation",
    "strict_round_robin": "SELECT i AS turn, i % 4 AS pick FROM range(1, 11) t(i)",
    "rw_split": "SELECT 'replica' AS pool, o_orderkey FROM orders WHERE o_custkey = 5",
    "table_only_split": "SELECT 'replica' AS pool, o_orderkey FROM orders WHERE o_custkey = 5",
    "pool_stats": "SELECT root, count(*) AS refs FROM (VALUES ('/data/a'), ('/data/a'), ('/data/a'), ('/data/b'), ('/data/b')) t(root) GROUP BY root",
    "pool_count": "SELECT count(DISTINCT root) AS pools FROM (VALUES ('/data/a'), ('/data/b')) t(root)",
    "trace_label": "SELECT CASE WHEN stmt LIKE 'SELECT%' AND stmt NOT LIKE '%FOR UPDATE' THEN '[replica] ' ELSE '[source] ' END || stmt AS line FROM " + _union("stmt", _TRACED),
    "point_bind": f"SELECT {_ORDER} FROM orders WHERE o_custkey = 5 AND o_totalprice > 1000.0",
    "no_hint_full_scan": f"SELECT {_ORDER} FROM orders WHERE o_custkey = 5",
} | {k: f"SELECT {_ORDER} FROM orders {w}" for k, w in _WHERE.items()}
