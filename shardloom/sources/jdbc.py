"""Shards that are tables of databases: each router's sources and replicas are JDBC URLs, a shard is ``<table><suffix>``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MissingShardingKey, ShardingError
from ..operators.common import ensure_checkpoint_dir
from ..plans.predicate import ALL, Pruner, scans
from ..plans.rules import DEFAULT_DB, NO_SUFFIX, ShardingRule
from .routing import Operation, select_pool


class JdbcShards:
    """One logical table over JDBC. Predicates choose the shards and are pushed down to their databases; rows are appended
    each to its own shard. ``default_url`` holds the rows that no router takes. ``options`` are those of Spark's JDBC
    source (user, driver, fetchsize, batchsize ...)."""

    def __init__(self, spark: SparkSession, rule: ShardingRule, table: str, default_url: str | None = None, **options: str):
        rule.compile()
        self.spark, self.rule, self.table, self.default_url, self.options = spark, rule, table, default_url, options

    def _urls(self, op: Operation) -> dict[int, str]:
        """URL of every database for an operation."""
        urls = {i: select_pool(self.rule.router(i, self.table), op, self.default_url or "")[0] for i in range(len(self.rule.databases))}
        return urls | ({DEFAULT_DB: self.default_url} if self.default_url else {})

    def _name(self, suffix: str) -> str:
        return self.table if suffix == NO_SUFFIX else self.table + suffix

    def tables(self, url: str) -> dict[str, str]:
        """Suffix -> physical table of the logical table's shards in a database, from its own catalog."""
        properties = self.spark._jvm.java.util.Properties()
        for k, v in self.options.items():
            properties.setProperty(k, v)
        connection = self.spark._jvm.java.sql.DriverManager.getConnection(url, properties)
        try:
            found, out = connection.getMetaData().getTables(None, None, "%", None), {}
            while found.next():
                name = found.getString("TABLE_NAME")
                if name.lower() == self.table.lower() or name.lower().startswith(self.table.lower() + "_"):
                    out[name[len(self.table) :].lower() or NO_SUFFIX] = name
            return out
        finally:
            connection.close()

    def _read(self, url: str, name: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(url=url, dbtable=name, **self.options).load()

    def scan(self, shards=ALL, op: Operation = Operation.READ, condition: str | None = None) -> DataFrame:
        """Rows of some shards with their ``_db`` and ``_tbl``; those that meet a condition, which the databases apply."""
        out = None
        for db, url in self._urls(op).items():
            wanted = None if shards is ALL else [t for d, t in shards if d in (None, db)]
            if wanted == []:
                continue
            for suffix, name in sorted(self.tables(url).items()):
                if wanted is None or None in wanted or suffix in [t.lower() for t in wanted]:
                    one = self._read(url, name)
                    one = (one if condition is None else one.where(condition)).withColumns({"_db": F.lit(db), "_tbl": F.lit(suffix)})
                    out = one if out is None else out.unionByName(one)
        if out is not None:
            return out
        for url in self._urls(op).values():
            for name in self.tables(url).values():
                return self._read(url, name).withColumns({"_db": F.lit(DEFAULT_DB), "_tbl": F.lit("")}).limit(0)
        raise ShardingError(f"no database holds {self.table}")

    def shards(self, condition: str, op: Operation = Operation.READ):
        """The shards a condition can match, from Catalyst's plan of it over one of the shards."""
        for url in self._urls(op).values():
            for name in self.tables(url).values():
                probe = self._read(url, name)
                key = [f for f in probe.schema.fields if f.name.lower() == self.rule.key.lower()]
                if not key:
                    raise MissingShardingKey(f"{name} has no column {self.rule.key}")
                found = scans(probe.where(condition)._jdf.queryExecution().optimizedPlan())
                if not found:
                    return frozenset()  # the condition holds for no row
                cond, relation = found[0]
                if cond is None:
                    return ALL
                it = relation.output().iterator()
                ids = []
                while it.hasNext():
                    a = it.next()
                    ids += [a.exprId().id()] if a.name() == key[0].name else []
                return Pruner(self.rule, ids[0], key[0].dataType, self.spark.conf.get("spark.sql.session.timeZone")).shards(cond)
        return frozenset()

    def where(self, condition: str, op: Operation = Operation.READ) -> DataFrame:
        """Rows that meet a condition, from the shards it can match."""
        return self.scan(self.shards(condition, op), op, condition).drop("_db", "_tbl")

    def write(self, df: DataFrame) -> int:
        """Append rows, each to its own shard; the number of rows. The placed rows are written to the checkpoint folder
        once, then a job per shard that gets some sends them; every job is a transaction per partition, not in all."""
        ensure_checkpoint_dir(self.spark)
        key = [f for f in df.schema.fields if f.name.lower() == self.rule.key.lower()]
        if not key:
            raise MissingShardingKey(f"the rows have no column {self.rule.key}")
        db, tbl = self.rule.place_exprs(F.col(key[0].name), key[0].dataType)
        placed, urls = df.withColumns({"_db": db, "_tbl": tbl}).checkpoint(), self._urls(Operation.WRITE)
        hit = placed.groupBy("_db", "_tbl").count().collect()  # a row per shard
        if missing := {r["_db"] for r in hit} - urls.keys():
            raise ShardingError(f"no router takes rows of database {min(missing)}")
        for r in hit:
            one = placed.where((F.col("_db") == r["_db"]) & (F.col("_tbl") == r["_tbl"])).drop("_db", "_tbl")
            one.write.format("jdbc").mode("append").options(url=urls[r["_db"]], dbtable=self._name(r["_tbl"]), **self.options).save()
        return sum(r["count"] for r in hit)
