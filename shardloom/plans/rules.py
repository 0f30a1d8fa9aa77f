"""Sharding rules, routers and the catalog of sharded tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ShardingError
from ..functions.strategies import PaddedModulo, Strategy, suffix_to_index, suffix_to_index_expr
from ..sources.registry import PoolRegistry
from ..sources.routing import Policy, RandomPolicy, find_router

#: Directory value of the empty suffix.
NO_SUFFIX = "_none"
#: Database number of rows that no router takes; they live under the catalog's default root.
DEFAULT_DB = -1


@dataclass
class Router:
    """One database: roots of its sources and replicas, and how one of them is chosen. A router with ``tables`` serves
    those only. Routers of one ``database`` number are alternatives for it; without a number each opens the next one."""

    name: str
    sources: Sequence[str] = ()
    replicas: Sequence[str] = ()
    source_policy: Policy | None = None
    replica_policy: Policy | None = None
    trace: bool = False
    tables: Sequence[str] = ()
    database: int | None = None

    def __post_init__(self):
        self.source_policy = self.source_policy or RandomPolicy()
        self.replica_policy = self.replica_policy or RandomPolicy()


@dataclass
class ShardingRule:
    """One key column and the functions that give its table suffix and its database."""

    key: str
    table_shards: int = 0
    database_shards: int = 0
    table_strategy: Strategy | None = None
    database_strategy: Strategy | None = None
    routers: list[Router] = field(default_factory=list)

    def add_router(self, router: Router) -> ShardingRule:
        self.routers.append(router)
        return self

    def compile(self) -> None:
        """Fill in the default functions; raises if a rule says neither a number of table shards nor a function."""
        if self.table_strategy is None:
            self.table_strategy = PaddedModulo(self.table_shards)
        if self.database_strategy is None and self.database_shards > 0:
            self.database_strategy = PaddedModulo(self.database_shards)
        if len({r.name for r in self.routers}) < len(self.routers):
            raise ShardingError("two routers have one name")
        for i, routers in enumerate(self.databases):
            if not routers:
                raise ShardingError(f"database {i} has no router")
            served = [t.lower() for r in routers for t in r.tables]
            if sum(not r.tables for r in routers) > 1 or len(set(served)) < len(served):
                raise ShardingError(f"the routers of database {i} conflict: two serve the same tables")

    @property
    def databases(self) -> list[list[Router]]:
        """The routers of each database."""
        out: list[list[Router]] = []
        for r in self.routers:
            at = len(out) if r.database is None else r.database
            out += [[] for _ in range(at + 1 - len(out))]
            out[at].append(r)
        return out

    def router(self, database: int, table: str, use: str | None = None) -> Router | None:
        """The router of a database for a table: the one named by ``use`` (wherever it stands), then the one that serves
        the table, then the one that serves all."""
        return find_router(self.routers, use) if use else find_router(self.databases[database], None, table)

    def _in_range(self, index: int) -> int:
        return index if 0 <= index < len(self.databases) else DEFAULT_DB

    def place(self, value: Any) -> tuple[int, str]:
        """Database and table directory of a key value."""
        suffix = self.table_strategy.suffix(value)
        # without a database function all rows are in the first database, as with one that gives no suffix
        db = self._in_range(0 if self.database_strategy is None else suffix_to_index(self.database_strategy.suffix(value)))
        return db, suffix or NO_SUFFIX

    def place_exprs(self, key: Column, kind: T.DataType) -> tuple[Column, Column]:
        """Column forms of ``place``."""
        suffix = self.table_strategy.expr(key, kind)
        table = F.when(suffix == "", NO_SUFFIX).otherwise(suffix)
        if self.database_strategy is None:
            return F.lit(self._in_range(0)), table
        index = suffix_to_index_expr(self.database_strategy.expr(key, kind))
        return F.when((index >= 0) & (index < len(self.databases)), index).otherwise(F.lit(DEFAULT_DB)).cast("int"), table


@dataclass
class Entry:
    """A logical table of the catalog."""

    name: str
    rule: ShardingRule | None
    schema: T.StructType | None = None
    last_query: str = ""


class ShardCatalog:
    """Logical tables, their rules and the roots they live under."""

    def __init__(self, spark: SparkSession, default_root: str):
        self.spark, self.default_root = spark, default_root.rstrip("/")
        self.entries: dict[str, Entry] = {}
        self.pools = PoolRegistry()

    name = "shardloom"

    def add_rule(self, rule: ShardingRule, *tables: str) -> ShardCatalog:
        """Attach a rule to tables; the last rule of a table holds."""
        for t in tables:
            self.entries[t.lower()] = Entry(t.lower(), rule)
        return self

    def add_table(self, table: str) -> ShardCatalog:
        """A table that is not sharded."""
        self.entries[table.lower()] = Entry(table.lower(), None)
        return self

    def initialize(self) -> ShardCatalog:
        """Check and complete the rules and open every root once."""
        for e in self.entries.values():
            if e.rule is not None:
                e.rule.compile()
                for i in range(len(e.rule.databases)):
                    if e.rule.router(i, e.name) is None:
                        raise ShardingError(f"no router of database {i} serves {e.name}")
                for r in e.rule.routers:
                    for root in (*r.sources, *r.replicas):
                        self.pools.get_or_create(root)
        return self

    def entry(self, table: str) -> Entry:
        try:
            return self.entries[table.lower()]
        except KeyError:
            raise ShardingError(f"{table} is no table of the catalog") from None

    def schema_of(self, entry: Entry, df: DataFrame | None = None) -> T.StructType:
        if df is not None and entry.schema is None:
            entry.schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        if entry.schema is None:
            raise ShardingError(f"{entry.name} has no schema yet: write to it or declare one")
        return entry.schema
