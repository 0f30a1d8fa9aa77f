import pytest

from shardloom.errors import MissingShardingKey, ShardingError
from shardloom.functions import strategies as S
from shardloom.plans.predicate import ALL
from shardloom.plans.rules import Router, ShardingRule
from shardloom.queries.sharding import _modulo
from shardloom.sources.jdbc import JdbcShards
from shardloom.sources.routing import Operation

ROWS = [(i, i * 7 % 40 - 3, None if i % 9 == 0 else i % 5) for i in range(200)]


@pytest.fixture(scope="module")
def shards(spark):
    """Four databases of the embedded engine that Spark brings along."""
    try:
        spark._jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    except Exception:
        pytest.skip("needs Derby")
    urls = [f"jdbc:derby:memory:shard{i};create=true" for i in range(4)]
    rule = ShardingRule("k", table_strategy=S.HashStrategy(3), database_strategy=_modulo(4), routers=[Router(f"db{i}", [u]) for i, u in enumerate(urls)])
    s = JdbcShards(spark, rule, "item", "jdbc:derby:memory:other;create=true", driver="org.apache.derby.jdbc.EmbeddedDriver")
    df = spark.createDataFrame(ROWS, "id bigint, k bigint, name int")
    assert s.write(df) == 200
    return s


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_rows_are_in_their_shards(shards):
    rows = shards.scan().collect()
    assert sorted((r.id, r.k, r.name) for r in rows) == sorted(ROWS, key=lambda r: r[0])
    assert all((r["_db"], r["_tbl"]) == shards.rule.place(r.k) for r in rows)
    assert shards.tables("jdbc:derby:memory:shard1")["_2"].lower() == "item_2"


@pytest.mark.parametrize("cond, want", [("k = 5", {(1, "_2")}), ("k IN (1, 13)", {(1, "_1")}), ("k = 1 AND k = 2", set()), ("name = 1", ALL), ("NOT k = 5", ALL), ("k = 5 OR name IS NULL", ALL)])
def test_conditions_choose_shards_and_lose_nothing(shards, spark, cond, want):
    assert shards.shards(cond) == want
    df = spark.createDataFrame(ROWS, "id bigint, k bigint, name int")
    assert ids(shards.where(cond)) == ids(df.where(cond))


def test_predicates_are_pushed_down(shards):
    plan = shards.where("k = 5")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(k), *EqualTo(k,5)]" in plan and plan.count("JDBCRelation") == 1


def test_errors(shards, spark):
    with pytest.raises(MissingShardingKey):
        shards.write(spark.range(2))
    rule = ShardingRule("k", table_strategy=S.NoSharding(), database_strategy=_modulo(4))
    with pytest.raises(ShardingError):
        JdbcShards(spark, rule, "nothing").write(spark.range(2).selectExpr("id as k"))
    with pytest.raises(ShardingError):
        JdbcShards(spark, rule, "nothing", "jdbc:derby:memory:other;create=true").scan(op=Operation.WRITE)
