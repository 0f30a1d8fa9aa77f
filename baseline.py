"""Own baseline figures of the engine, on a table large enough for pruning to tell: one JSON line of median seconds.

BENCH_SF_DIR names the data, BENCH_CPUS the cores, BENCH_COPIES how often orders are repeated (with other order keys);
with BENCH_LOOKUPS it ends after the lookups.
"""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from shardloom.engine import Engine
from shardloom.functions import strategies as S
from shardloom.plans.rules import Router, ShardCatalog, ShardingRule
from shardloom.queries.sharding import _folder, _modulo


def main() -> None:
    d, cpus, copies = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_COPIES", "200"))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    root, took = _folder(spark), {}

    def timed(name, run, repeat=5):
        times = []
        for _ in range(repeat + 1):  # the first run warms up
            t = time.perf_counter()
            run()
            times.append(time.perf_counter() - t)
        took[name] = round(median(times[1:]), 3)

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    orders = spark.read.parquet(f"{d}/orders.parquet")
    n = orders.count()
    many = orders.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("o_orderkey", F.col("o_orderkey") + F.col("copy") * n).drop("copy").repartition(int(cpus))
    many.write.parquet(f"{root}/plain")
    many = spark.read.parquet(f"{root}/plain")
    routers = lambda: [Router(f"db{i}", [f"{root}/source"]) for i in range(4)]
    catalog = ShardCatalog(spark, f"{root}/default")
    for table, key in (("orders", "o_custkey"), ("customer", "c_custkey")):
        catalog.add_rule(ShardingRule(key, table_strategy=_modulo(10), database_strategy=_modulo(4), routers=routers()), table)
    engine = Engine(catalog)
    t = time.perf_counter()
    engine.write(many, "orders")
    took["sharded write"] = round(time.perf_counter() - t, 3)
    engine.write(spark.read.parquet(f"{d}/customer.parquet"), "customer")
    spark.read.parquet(f"{d}/customer.parquet").createOrReplaceTempView("plain_customer")
    many.createOrReplaceTempView("plain_orders")
    point, some = "o_custkey = 5 AND o_totalprice > 1000", "o_custkey IN (5, 17, 203, 1001)"
    for name, cond in (("point lookup", point), ("IN lookup", some)):
        timed(f"{name}, pruned", lambda c=cond: drain(engine.sql(f"SELECT * FROM orders WHERE {c}")))
        timed(f"{name}, all shards", lambda c=cond: drain(engine.sql(f"SELECT /*+ nosharding */ * FROM orders WHERE {c}")))
    timed("point lookup, planning only", lambda: engine.sql(f"SELECT * FROM orders WHERE {point}"))
    if os.environ.get("BENCH_LOOKUPS"):
        return print(json.dumps({"metric": "own baseline, lookups", "unit": "sec", "rows": n * copies, "cpus": int(cpus), "seconds": took}))
    timed("aggregate over all shards", lambda: drain(engine.sql("SELECT o_orderstatus, count(*), sum(o_totalprice) FROM orders GROUP BY o_orderstatus")))
    timed("aggregate, unsharded", lambda: drain(spark.sql("SELECT o_orderstatus, count(*), sum(o_totalprice) FROM plain_orders GROUP BY o_orderstatus")))
    join = "SELECT c_mktsegment, count(*), sum(o_totalprice) FROM {o} JOIN {c} ON o_custkey = c_custkey GROUP BY c_mktsegment"
    timed("join on the key, sharded", lambda: drain(engine.sql(join.format(o="orders", c="customer"))))
    timed("join, unsharded", lambda: drain(spark.sql(join.format(o="plain_orders", c="plain_customer"))))
    names = many.select(F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")).alias("k"))
    kind = names.schema["k"].dataType
    native, python = S.HashStrategy(16), S.CustomStrategy(S.HashStrategy(16).suffix)
    timed("hash of a text key, native", lambda: drain(names.select(native.expr(F.col("k"), kind).alias("s"))))
    timed("hash of a text key, Python", lambda: drain(names.select(python.expr(F.col("k"), kind).alias("s"))), 1)
    print(json.dumps({"metric": "own baseline", "unit": "sec", "rows": n * copies, "cpus": int(cpus), "seconds": took}))


if __name__ == "__main__":
    main()
