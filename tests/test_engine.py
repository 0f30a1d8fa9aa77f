import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardloom.engine import Engine, bind
from shardloom.errors import DifferentSuffix, MissingShardingKey, ShardingError
from shardloom.functions import strategies as S
from shardloom.functions.text import operation, table_of
from shardloom.plans.predicate import ALL
from shardloom.plans.rules import Router, ShardCatalog, ShardingRule
from shardloom.queries.sharding import _modulo
from shardloom.sources.registry import PoolRegistry
from shardloom.sources.routing import Operation, PolicyFunc, RandomPolicy, RoundRobinPolicy, StrictRoundRobinPolicy, find_router, select_pool


def order_rows(n=200):
    return [(i, i * 7 % 40 - 3, f"n{i % 5}" if i % 9 else None, float(i)) for i in range(n)]


def make(spark, path, rows=None, replicas=False):
    routers = [Router(f"db{i}", [f"{path}/s"], [f"{path}/r"] if replicas else []) for i in range(4)]
    catalog = ShardCatalog(spark, f"{path}/default")
    catalog.add_rule(ShardingRule("k", table_strategy=S.HashStrategy(10), database_strategy=S.HashStrategy(4), routers=routers), "item")
    catalog.add_rule(ShardingRule("day", table_strategy=S.DateStrategy("200601")), "visit").add_rule(ShardingRule("code", table_shards=5), "coded").add_rule(ShardingRule("k", table_strategy=S.RangeStrategy([0, 10, 20])), "ranged")
    engine = Engine(catalog)
    engine.write(spark.createDataFrame(order_rows() if rows is None else rows, "id bigint, k bigint, name string, v double"), "item")
    return engine


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = make(spark, tmp_path_factory.mktemp("e"))
    e.write(spark.createDataFrame(order_rows(), "id bigint, k bigint, name string, v double"), "ranged")
    e.write(spark.createDataFrame([(i, dt.datetime(2026, 1 + i % 12, 1 + i % 28)) for i in range(100)], "id bigint, day timestamp_ntz"), "visit")
    e.write(spark.createDataFrame([(i, f"{i % 20:02d}") for i in range(100)], "id bigint, code string"), "coded")
    return e


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def brute(cond):
    return sorted(r[0] for r in order_rows() if cond(*r))


POINTS = st.integers(-5, 45)
ATOMS = st.one_of(
    st.builds("k = {}".format, POINTS), st.builds("{} = k".format, POINTS), st.builds("k <=> {}".format, POINTS), st.builds("k in ({}, {})".format, POINTS, POINTS), st.builds("k between {} and {}".format, POINTS, POINTS), st.builds("k < {}".format, POINTS),
    st.builds("k >= {}".format, POINTS), st.just("name = 'n1'"), st.just("v > 100"), st.just("k is null"), st.builds("k = {}.0D".format, POINTS), st.builds("k = '{}'".format, POINTS), st.just("name is null"), st.just("k = v"), st.just("k = null"),
)
PREDICATES = st.recursive(ATOMS, lambda p: st.builds("({} and {})".format, p, p) | st.builds("({} or {})".format, p, p) | st.builds("(not {})".format, p), max_leaves=4)


@settings(max_examples=40, deadline=None)
@given(cond=PREDICATES)
def test_pruning_never_changes_a_result(spark, engine, cond):
    for table in ("item", "ranged"):
        assert ids(engine.where(table, cond)) == ids(engine.table(table).where(cond))


@pytest.mark.parametrize("cond, shards", [("k = 5", {(1, "_5")}), ("5 = k AND v > 1", {(1, "_5")}), ("k = 1 OR k = 2", {(1, "_1"), (2, "_2")}), ("k IN (1, 11)", {(1, "_1"), (3, "_1")}), ("k = 1 AND k = 2", set()), ("NOT k = 1", ALL), ("v = 1", ALL), ("k = 1 OR v = 1", ALL)])
def test_shard_sets(engine, cond, shards):
    assert engine.resolve(f"SELECT * FROM item WHERE {cond}")[1].shards.get("item", set()) == shards


def test_partition_filters_reach_the_scan(engine):
    plan = engine.where("item", "k = 5")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_tbl" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert engine.resolve("SELECT * FROM ranged WHERE k >= 12 AND k < 15")[1].shards["ranged"] == {(None, "_1")}
    assert engine.resolve("SELECT * FROM visit WHERE day >= timestamp_ntz'2026-02-03 00:00:00' AND day < timestamp_ntz'2026-03-05 00:00:00'")[1].shards["visit"] == {(None, "_202602"), (None, "_202603")}


def test_text_keys_compared_as_numbers_are_not_pruned(engine):
    assert engine.resolve("SELECT * FROM coded WHERE code = 5")[1].shards["coded"] is ALL
    assert len(ids(engine.sql("SELECT * FROM coded WHERE code = 5"))) == 5
    assert len(engine.resolve("SELECT * FROM coded WHERE code = '05'")[1].shards["coded"]) == 1


def test_queries_across_shards(engine):
    got = engine.sql("SELECT a.id FROM item a JOIN item b ON a.k = b.k AND a.id = b.id WHERE a.k = 4 AND b.v > 10")
    assert ids(got) == brute(lambda i, k, n, v: k == 4 and v > 10)
    inner = engine.sql("SELECT id FROM item WHERE k = (SELECT max(k) FROM item)")
    assert ids(inner) == brute(lambda i, k, n, v: k == max(r[1] for r in order_rows()))
    assert engine.sql("SELECT count(*) AS n FROM item WHERE k = ? OR name = ?", args=[3, "n2"]).first().n == len(brute(lambda i, k, n, v: k == 3 or n == "n2"))
    assert engine.sql("SELECT /*+ nosharding */ id FROM item WHERE k = 5").count() == 5
    assert engine.catalog.entry("item").last_query.endswith("k = 5")


def test_strict_mode(engine):
    assert ids(engine.sql("SELECT * FROM item WHERE k = 5 AND v > 0", strict=True)) == brute(lambda i, k, n, v: k == 5 and v > 0)
    for cond in ("v = 1", "k IN (1, 2)", "k = 1 OR k = 2", "k > 5"):
        with pytest.raises(MissingShardingKey):
            engine.sql(f"SELECT * FROM item WHERE {cond}", strict=True)


def test_unsupported_statements(engine):
    for sql in ("CREATE TABLE x (a int)", "DROP TABLE item", ""):
        with pytest.raises(NotImplementedError):
            engine.sql(sql)
    with pytest.raises(Exception):
        engine.sql("SELECT * FROM item WHERE k = = 1")


def test_insert(spark, tmp_path):
    e = make(spark, tmp_path, [])
    out = e.sql("INSERT INTO item (id, k, name) VALUES (?, 1, 'a?b'), (2, 11, ?)", args=[1, "it's"])
    assert out.rows == 2
    assert sorted(map(tuple, e.scan("item").select("id", "k", "name", "v", "_db", "_tbl").collect())) == [(1, 1, "a?b", None, 1, "_1"), (2, 11, "it's", None, 3, "_1")]
    with pytest.raises(DifferentSuffix):
        e.sql("INSERT INTO item (id, k) VALUES (3, 1), (4, 2)", strict=True)
    with pytest.raises(MissingShardingKey):
        e.sql("INSERT INTO item (id) VALUES (3)")
    with pytest.raises(ShardingError):
        e.sql("INSERT INTO item (id, k) VALUES (3)")
    with pytest.raises(Exception, match="null"):
        e.sql("INSERT INTO item (id, k) VALUES (3, NULL)")
    e.sql("INSERT INTO item SELECT id + 10, k, name, v FROM item WHERE k = 11")
    assert ids(e.table("item")) == [1, 2, 12]


def test_update_and_delete(spark, tmp_path):
    e = make(spark, tmp_path)
    assert e.sql("UPDATE item SET v = v + 1000, name = 'x' WHERE k = 5 AND v < 100").rows == len(brute(lambda i, k, n, v: k == 5 and v < 100))
    assert ids(e.where("item", "v >= 1000")) == brute(lambda i, k, n, v: k == 5 and v < 100)
    e.sql("UPDATE item SET k = 6 WHERE k = 5")
    assert ids(e.where("item", "k = 6")) == brute(lambda i, k, n, v: k in (5, 6))
    assert e.scan("item").where("k = 6 and _tbl != '_6'").count() == 0
    n = e.sql("DELETE FROM item WHERE k = 6 OR name IS NULL AND k > 20").rows
    assert n == len(brute(lambda i, k, n, v: k in (5, 6) or n is None and k > 20))
    assert ids(e.table("item")) == brute(lambda i, k, n, v: not (k in (5, 6) or n is None and k > 20))
    assert e.sql("DELETE FROM item WHERE k = 999").rows == 0
    e.sql("DELETE FROM item")
    assert e.table("item").count() == 0
    with pytest.raises(ShardingError):
        e.sql("UPDATE item SET nope = 1")


def test_read_write_splitting(spark, tmp_path):
    e = make(spark, tmp_path, replicas=True)
    with pytest.raises(ShardingError, match="does not hold item"):  # not synced yet: an error, not an empty table
        e.where("item", "k = 5")
    e.sync_replicas("item")
    e.sql("DELETE FROM item WHERE k = 5")
    assert (e.where("item", "k = 5").count(), e.where("item", "k = 5", op=Operation.WRITE).count(), e.sql("SELECT id FROM item WHERE k = 5 FOR UPDATE").count()) == (5, 0, 0)
    assert e.resolve("SELECT id FROM item WHERE k = 5")[1].labels == {"item": "replica"}
    e.sync_replicas("item")
    assert e.where("item", "k = 5").count() == 0


def test_traces_and_roots(spark, tmp_path, caplog):
    e = make(spark, tmp_path, replicas=True)
    e.sync_replicas("item")
    with caplog.at_level("INFO", "shardloom"):
        assert e.first("SELECT count(*) AS n FROM item WHERE k = 5").n == 5
        e.catalog.entry("item").rule.routers[0].trace = True
        e.sql("SELECT id FROM item WHERE k = 5 FOR UPDATE")
        with pytest.raises(Exception):
            e.sql("SELECT nope FROM item")
    said = [r.getMessage() for r in caplog.records]
    assert said[0] == "SELECT count(*) AS n FROM item WHERE k = 5" and said[1] == "[source] SELECT id FROM item WHERE k = 5 FOR UPDATE" and "nope" in said[2]
    assert e.roots("item") == [f"{tmp_path}/{x}" for x in ("default", "s", "r")]


def test_empty_suffix_and_no_router(spark, tmp_path):
    c = ShardCatalog(spark, str(tmp_path)).add_rule(ShardingRule("k", table_strategy=S.NoSharding(), database_strategy=_modulo(4)), "plain")
    e = Engine(c)
    e.write(spark.createDataFrame([(1, 2)], "id bigint, k bigint"), "plain")
    assert [tuple(r) for r in e.scan("plain").collect()] == [(1, 2, -1, "_none")]
    assert ids(e.where("plain", "k = 2")) == [1]
    with pytest.raises(ShardingError):
        Engine(ShardCatalog(spark, str(tmp_path)).add_rule(ShardingRule("k"), "broken"))


def test_policies_and_routers():
    rr, strict = RoundRobinPolicy(), StrictRoundRobinPolicy()
    assert [rr.pick(3) for _ in range(4)] == [1, 2, 0, 1] == [strict.pick(3) for _ in range(4)]
    assert {RandomPolicy(1).pick(5) for _ in range(3)} <= set(range(5))
    r = Router("a", ["s0", "s1"], [], source_policy=PolicyFunc(lambda n: 1), replica_policy=PolicyFunc(lambda n: 0))
    assert select_pool(r, Operation.WRITE, "d") == ("s1", "source") and select_pool(r, Operation.READ, "d")[0] == "s0"
    assert select_pool(Router("b"), Operation.WRITE, "d")[0] == "d"
    with pytest.raises(ShardingError):
        find_router([r], "zzz")
    with pytest.raises(ShardingError):
        select_pool(Router("c", ["x", "y"], source_policy=PolicyFunc(lambda n: 9)), Operation.WRITE, "d")
    p = PoolRegistry()
    a = p.get_or_create("s3://b//x/")
    assert a is p.get_or_create("s3://b/x") and p.stats() == {"s3://b/x": 2}
    p.release("s3://b/x"), p.release("s3://b/x"), p.release("s3://b/x")
    assert p.count() == 0


# statements and their classes are fixed values
@pytest.mark.parametrize("sql, op, table", [("SELECT * FROM order_info WHERE id=1", "read", "order_info"), ("delete from `order_info` where id=1", "write", "order_info"), ("INSERT INTO order_info(user_id) VALUES (1)", "write", ""), ("SELECT * FROM db.order_info", "read", ""), ("SELECT 1", "write", ""), ("SELECT * FROM t FOR UPDATE", "write", "t"), ("SELECT * FROM t FOR UPDATE;", "read", "t"), ("SELECT EXTRACT(YEAR FROM ctime) FROM order_info", "read", "ctime")])
def test_statement_texts(sql, op, table):
    assert operation(sql) == op and table_of(sql) == table


def test_bind():
    assert bind("a = ? and b = '?' -- ?\n and c = ?", [1, "x'y"]) == "a = 1 and b = '?' -- ?\n and c = 'x\\'y'"
    for sql, args in (("?", []), ("a", [1])):
        with pytest.raises(ShardingError):
            bind(sql, args)


def compiled(key, **kw):
    rule = ShardingRule(key, routers=[Router(f"db{i}") for i in range(4)], **kw)
    rule.compile()
    return rule


def test_demo_tables():
    """Placement of the example tables: orders by user, people by id number, regions, monthly logs, users by range (keys and
    shards are fixed values)."""
    order = compiled("user_id", table_strategy=_modulo(10), database_strategy=_modulo(4))
    assert [order.place(k) for k in (1001, 2002, 3003, 4004, 5005, 10001)] == [(1, "_1"), (2, "_2"), (3, "_3"), (0, "_4"), (1, "_5"), (1, "_1")]
    person = compiled("id_no", table_strategy=S.NoSharding(), database_strategy=S.CustomStrategy(lambda v: f"_{int(v[-2:]) % 4}"))
    assert [person.place(k)[0] for k in ("1234567890120", "1234567890121", "1234567890122", "1234567890123", "1234567890124", "1234567890125", "1234567890128", "9876543210980", "9876543210986")] == [0, 1, 2, 3, 0, 1, 0, 0, 2]
    region = compiled("region", table_strategy=S.NoSharding(), database_strategy=S.EnumStrategy({"beijing": "_0", "shanghai": "_1", "guangzhou": "_2", "shenzhen": "_3"}, "_0"))
    assert [region.place(k)[0] for k in ("beijing", "shanghai", "guangzhou", "shenzhen", "hangzhou")] == [0, 1, 2, 3, 0]
    log = compiled("created_at", table_strategy=S.DateStrategy("200601"), database_strategy=S.NoSharding())
    assert [log.place(dt.datetime(2026, m, 15, 10)) for m in (1, 2, 3)] == [(0, "_202601"), (0, "_202602"), (0, "_202603")]
    user = compiled("id", table_strategy=S.NoSharding(), database_strategy=S.RangeStrategy([0, 10_000, 50_000, 100_000]))
    assert [user.place(k)[0] for k in (1, 5000, 15_000, 60_000, 100_000, 10**9, -1)] == [0, 0, 1, 2, 3, 3, 0]
    assert compiled("k", table_strategy=_modulo(2), database_strategy=S.HashStrategy(9)).place(8) == (-1, "_0")
    assert compiled("k", table_shards=10, database_shards=3).place(7) == (1, "_07")


def test_views_of_the_session_are_not_touched(spark, engine):
    """A plain query after a pruned one sees what it saw before; names in texts and comments are no tables."""
    spark.range(7).createOrReplaceTempView("item")
    before = {t.name for t in spark.catalog.listTables()}
    assert len(ids(engine.sql("SELECT id, 'item k' AS s FROM item /* coded */ WHERE k = 5 -- ranged"))) == 5
    assert spark.sql("SELECT count(*) AS n FROM item").first().n == 7 and {t.name for t in spark.catalog.listTables()} == before
    assert engine.resolve("SELECT 'ranged' AS s FROM item -- coded")[1].tables == ["item"]
    assert engine.sql("WITH item AS (SELECT 1 AS k) SELECT * FROM item").collect() == [(1,)]
    spark.catalog.dropTempView("item")


def test_threads_read_their_own_shards(spark, engine):
    from concurrent.futures import ThreadPoolExecutor

    keys = list(range(-3, 37)) * 2
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda k: ids(engine.sql("SELECT id FROM item WHERE k = ?", args=[k])), keys))
    assert got == [brute(lambda i, x, n, v, k=k: x == k) for k in keys]


def test_changes_with_subqueries(spark, tmp_path):
    e = make(spark, tmp_path)
    e.write(spark.createDataFrame([(5, "a"), (6, "b"), (None, "c")], "k2 bigint, c string").where("k2 is not null").selectExpr("k2 as id", "k2 as k", "c as name", "0D as v"), "ranged")
    e.sql("SELECT * FROM item WHERE k = 5").count()
    n = e.sql("DELETE FROM item i WHERE i.k IN (SELECT k FROM ranged WHERE name = 'a') AND v > (SELECT avg(v) FROM item)").rows
    hit = lambda i, k, n, v: k == 5 and v > 99.5
    assert n == len(brute(hit)) > 0 and ids(e.table("item")) == brute(lambda *r: not hit(*r))
    n = e.sql("UPDATE item SET v = (SELECT max(k) FROM ranged) + 0.5, name = concat('where, ', name) WHERE k NOT IN (SELECT k FROM ranged WHERE k > ?) AND EXISTS (SELECT 1 FROM ranged r WHERE r.k = item.k)", args=[5]).rows
    assert n == len(brute(lambda i, k, n, v: k == 5 and v <= 99.5)) > 0
    assert {r.v for r in e.where("item", "k = 5").collect()} == {6.5} and all(r.name is None or r.name.startswith("where, ") for r in e.where("item", "k = 5").collect())
    assert len(ids(e.table("item"))) == len(brute(lambda *r: not hit(*r)))
    assert e.sql("DELETE FROM item WHERE k NOT IN (SELECT CAST(NULL AS BIGINT) FROM ranged)").rows == 0


def test_a_failing_rename_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    e = make(spark, tmp_path, replicas=True)
    e.sync_replicas("item")
    before = sorted(map(tuple, e.scan("item", op=Operation.WRITE).collect()))
    for fail_at in range(1, 12, 2):
        done, rename = [], e._rename

        def failing(fs, source, target):
            done.append(source)
            if len(done) == fail_at:
                raise ShardingError("no rename")
            rename(fs, source, target)

        monkeypatch.setattr(e, "_rename", failing)
        for change in ("UPDATE item SET v = -1 WHERE k IN (5, 6, 7, 8)", "DELETE FROM item WHERE k IN (5, 6, 7, 8)"):
            done.clear()
            with pytest.raises(ShardingError, match="no rename"):
                e.sql(change)
                raise AssertionError(f"only {len(done)} renames")
            assert sorted(map(tuple, e.scan("item", op=Operation.WRITE).collect())) == before
        monkeypatch.undo()
    assert not [p for p in (tmp_path / "s").rglob("*") if p.name.startswith(".") and not p.name.endswith(".crc") or "staging" in p.name]


def test_missing_roots_are_errors(spark, tmp_path):
    import shutil

    e = make(spark, tmp_path)
    assert e.table("item").count() == 200
    shutil.rmtree(tmp_path / "s" / "item")
    e.refresh("item")
    with pytest.raises(ShardingError, match="does not hold item"):
        e.table("item")
    c = ShardCatalog(spark, f"{tmp_path}/new").add_rule(ShardingRule("k", table_shards=3), "fresh")
    c.entry("fresh").schema = spark.range(1).selectExpr("id as k").schema
    assert Engine(c).table("fresh").count() == 0  # nothing was written yet


def test_routers_of_tables(spark, tmp_path):
    """Of a database's routers the one that serves a table takes it; rules without a database function have one database."""
    main, audit = Router("main", [f"{tmp_path}/main"], database=0), Router("audit", [f"{tmp_path}/audit"], [f"{tmp_path}/audit_replica"], tables=["log"], database=0)
    c = ShardCatalog(spark, f"{tmp_path}/default")
    c.add_rule(ShardingRule("k", table_strategy=_modulo(3), routers=[main, audit]), "log", "item")
    e = Engine(c)
    for t in ("log", "item"):
        e.write(spark.createDataFrame([(i, i) for i in range(9)], "id bigint, k bigint"), t)
    assert (tmp_path / "audit" / "log" / "_db=0" / "_tbl=_1").is_dir() and (tmp_path / "main" / "item" / "_db=0").is_dir()
    assert not (tmp_path / "main" / "log").exists() and not (tmp_path / "audit" / "item").exists()
    e.sync_replicas("log")
    e.sql("DELETE FROM log WHERE k = 4")
    assert (e.where("log", "k = 4").count(), e.where("log", "k = 4", op=Operation.WRITE).count()) == (1, 0)
    assert e.resolve("SELECT * FROM log WHERE k = 4")[1].shards == {"log": {(0, "_1")}}
    with pytest.raises(ShardingError, match="does not hold log"):
        e.table("log", use="main")
    for bad in ([main, Router("other", database=0)], [Router("a", tables=["x"])], [Router("a", database=1)], [main, audit, Router("b", tables=["LOG"], database=0)]):
        with pytest.raises(ShardingError):
            Engine(ShardCatalog(spark, str(tmp_path)).add_rule(ShardingRule("k", table_shards=2, routers=bad), "log"))
