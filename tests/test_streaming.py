import datetime as dt

from shardloom.engine import Engine
from shardloom.functions import strategies as S
from shardloom.plans.rules import ShardCatalog, ShardingRule
from shardloom.streaming.sink import sessions_of_stream, sharded_sink


def test_sharded_sink_writes_each_batch_once(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(50).selectExpr("id", "id % 7 as k").repartition(3).write.parquet(source)
    engine = Engine(ShardCatalog(spark, str(tmp_path / "out")).add_rule(ShardingRule("k", table_strategy=S.HashStrategy(4)), "stream_item"))
    sink = sharded_sink(engine, "stream_item", "s")
    q = spark.readStream.schema("id bigint, k bigint").option("maxFilesPerTrigger", 1).parquet(source).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert engine.table("stream_item").count() == 50
    sink(spark.range(5).selectExpr("id", "id as k"), 0)
    assert engine.table("stream_item").count() == 50


def test_sessions_of_stream(spark, tmp_path):
    t = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, t(0)), (1, t(10)), (1, t(100)), (2, None), (9, t(5000))], "u bigint, at timestamp").coalesce(1).write.parquet(source)
    q = sessions_of_stream(spark.readStream.schema("u bigint, at timestamp").parquet(source), "u", "at", "30 minutes", "1 minute").writeStream.format("memory").queryName("got_sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.entity, r.start_at, r.end_at, r.events) for r in spark.table("got_sessions").collect()) == [(1, t(0), t(10), 2), (1, t(100), t(100), 1)]
