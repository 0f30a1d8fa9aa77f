"""The engine: SQL and DataFrame access to sharded tables.

A table lives under a root as ``<root>/<table>/_db=<database>/_tbl=<suffix>``; each router names the roots of its
database's sources and replicas. Reads scan only the shards a predicate can match (partition filters of one scan per
root), writes are placed row by row, updates and deletes rewrite the shards they touch.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import DifferentSuffix, MissingShardingKey, ShardingError
from .functions.text import operation
from .plans.predicate import ALL, Pruner, either, scans
from .plans.rules import DEFAULT_DB, Entry, Router, ShardCatalog
from .plans.statements import QUOTED, Reference, references, renamed, split_change
from .sources.routing import Operation, select_pool, trace

_HINT = re.compile(r"/\*\+[^*]*\bnosharding\b[^*]*\*/", re.I)
_FOR_UPDATE = re.compile(r"\s+for\s+update\s*;?\s*\Z", re.I)
_INSERT = re.compile(r"\s*insert\s+(?:ignore\s+)?into\s+(?:table\s+)?`?(\w+)`?\s*(?:\(([^()]*)\))?\s*(?=values\b|select\b|with\b|table\b|from\b|\()", re.I | re.S)


@dataclass
class Resolution:
    """What a statement was resolved to."""

    statement: str
    tables: list[str]
    operation: Operation
    shards: dict[str, Any] = field(default_factory=dict)
    labels: dict[str, str] = field(default_factory=dict)
    rows: int | None = None


def quote(value: Any) -> str:
    """A Python value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return f"{value}L" if not -(1 << 31) <= value < 1 << 31 else str(value)
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    if isinstance(value, Decimal):
        return f"{value:f}BD"
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP_NTZ '{value:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, dt.date):
        return f"DATE '{value:%Y-%m-%d}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(sql: str, args: Sequence[Any]) -> str:
    """``sql`` with its ``?`` outside of quotes and comments replaced by literals."""
    out, rest = [], list(args)
    for part in QUOTED.split(sql):
        if part[:1] in ("'", '"', "`") or part[:2] in ("--", "/*"):
            out.append(part)
            continue
        pieces = part.split("?")
        for i, piece in enumerate(pieces):
            if i:
                if not rest:
                    raise ShardingError("the statement has more parameters than values")
                out.append(quote(rest.pop(0)))
            out.append(piece)
    if rest:
        raise ShardingError("the statement has fewer parameters than values")
    return "".join(out)


class Engine:
    """Entry point; needs a classic session (the planner reads Catalyst's plans). File listings are kept until the engine
    changes a table or ``refresh`` is called."""

    def __init__(self, catalog: ShardCatalog):
        self.catalog, self.spark = catalog.initialize(), catalog.spark
        self._jvm, self._session = self.spark._jvm, self.spark._jsparkSession

    # files

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._session.sessionState().newHadoopConf())

    def _exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def _shard_dirs(self, root: str, table: str) -> dict[tuple[int, str], str]:
        base = f"{root}/{table}"
        found = self._fs(base).globStatus(self._path(f"{base}/_db=*/_tbl=*")) if self._exists(base) else None
        out = {}
        for s in found or ():
            parts = s.getPath().toString().rsplit("/", 2)
            unescape = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
            out[int(parts[1].removeprefix("_db=")), unescape(parts[2].removeprefix("_tbl="))] = s.getPath().toString()
        return out

    # routing

    def _router(self, entry: Entry, db: int, use: str | None = None) -> Router | None:
        return entry.rule.router(db, entry.name, use) if 0 <= db < len(entry.rule.databases) else None

    def _roots(self, entry: Entry, op: Operation, use: str | None = None) -> tuple[dict[int, str], str]:
        """Root of every database for an operation, and the label of the pools: of each database's routers the one named
        by ``use``, then the one that serves the table, then the one that serves all."""
        labels, roots = [], {DEFAULT_DB: self.catalog.default_root}
        for i in range(len(entry.rule.databases)):
            roots[i], label = select_pool(self._router(entry, i, use), op, self.catalog.default_root)
            labels.append(label)
        return roots, labels[0] if labels else ("source" if op is Operation.WRITE else "replica")

    def _stored(self, schema: T.StructType) -> T.StructType:
        return T.StructType([*schema.fields, T.StructField("_db", T.IntegerType()), T.StructField("_tbl", T.StringType())])

    def scan(self, table: str, shards=ALL, op: Operation = Operation.READ, use: str | None = None, roots: dict[int, str] | None = None) -> DataFrame:
        """The table's rows in ``shards`` with their ``_db`` and ``_tbl``: one scan per root, with partition filters. A root
        that does not hold the table though another one does (a replica never synced, a lost folder) is an error; a table
        that nothing was written to yet is empty."""
        entry = self.catalog.entry(table)
        schema = self._stored(self.catalog.schema_of(entry))
        if roots is None:
            roots = self._roots(entry, op, use)[0]
        known = entry.name, tuple(roots.items())
        if shards is ALL and known in self.catalog.pools.whole:
            return self.catalog.pools.whole[known]
        by_root: dict[str, list[int]] = {}
        for db, root in roots.items():
            if shards is ALL or any(d in (None, db) for d, _ in shards):
                by_root.setdefault(root, []).append(db)
        out, missing = None, []
        for root, dbs in by_root.items():
            one = self._listed(root, entry.name, schema)
            if one is None:
                missing.append(root)
                continue
            if len(dbs) < len(roots):
                one = one.where(f"_db IN ({', '.join(map(str, dbs))})")
            if shards is not ALL:
                one = one.where(_shard_filter(shards))
            out = one if out is None else out.unionByName(one)
        if missing and any(self._exists(f"{r}/{entry.name}") for r in self.roots(entry.name)):
            raise ShardingError(f"{', '.join(missing)} does not hold {entry.name}: sync_replicas makes replicas")
        if out is None:
            return self.spark.createDataFrame([], schema)
        if shards is ALL:
            self.catalog.pools.whole[known] = out
        return out

    def _listed(self, root: str, table: str, schema: T.StructType) -> DataFrame | None:
        """The table's files under a root, listed once for as long as the root's pool keeps them."""
        kept, base = self.catalog.pools.pool(root).tables, f"{root}/{table}"
        if table not in kept and self._exists(base):
            kept[table] = self.spark.read.schema(schema).option("basePath", base).parquet(base)
        return kept.get(table)

    def refresh(self, table: str) -> None:
        """Forget the listed files of a table, after something else has changed them."""
        self.catalog.pools.forget(table.lower())

    def table(self, name: str, op: Operation = Operation.READ, use: str | None = None, ignore_sharding: bool = False) -> DataFrame:
        """The whole logical table; with ``ignore_sharding`` the table without suffix under the default root."""
        entry = self.catalog.entry(name)
        if entry.rule is None or ignore_sharding:
            return self.spark.read.parquet(f"{self.catalog.default_root}/{entry.name}")
        return self.scan(name, op=op, use=use).drop("_db", "_tbl")

    def where(self, name: str, condition: str, op: Operation = Operation.READ, strict: bool = False, use: str | None = None) -> DataFrame:
        """Rows of a table that meet a condition, from the shards it can match."""
        return self.sql(f"SELECT * FROM {name} WHERE {condition}", op=op, strict=strict, use=use)

    # queries

    def _kind(self, entry: Entry):
        return self.catalog.schema_of(entry)[self._key(entry)].dataType

    def _key(self, entry: Entry) -> str:
        names = [f.name for f in self.catalog.schema_of(entry).fields if f.name.lower() == entry.rule.key.lower()]
        if not names:
            raise ShardingError(f"{entry.name} has no column {entry.rule.key}")
        return names[0]

    def _references(self, sql: str) -> list[Reference]:
        """The statement's mentions of tables of the catalog."""
        return [r for r in references(self._session.sessionState().sqlParser(), sql) if r.name in self.catalog.entries]

    def _run(self, sql: str, args: Sequence[Any], tables: list[tuple[Reference, DataFrame]]) -> DataFrame:
        """A query over frames in place of tables. Each frame is a view of its own name while the query is analysed, so
        views of the session, and queries of other threads, are not touched."""
        catalog, names = self._session.sessionState().catalog(), []
        views: dict[int, str] = {}
        try:
            for r, df in tables:
                if id(df) not in views:
                    views[id(df)] = f"_shardloom_{uuid.uuid4().hex}"
                    df.createOrReplaceTempView(views[id(df)])
                names.append((r, views[id(df)]))
            return self.spark.sql(renamed(sql, names), args=list(args) or None)
        finally:
            for name in views.values():
                catalog.dropTempView(name)

    def _prune(self, df: DataFrame, entries, strict: bool):
        """Shard sets of the sharded tables of an analysed query."""
        zone, sets = self.spark.conf.get("spark.sql.session.timeZone"), {}
        for cond, relation in scans(df._jdf.queryExecution().optimizedPlan()):
            path = relation.relation().location().rootPaths().head().toString()
            entry = next((e for e in entries if e.rule is not None and path.endswith("/" + e.name)), None)
            if entry is None:
                continue
            ids = [a.exprId().id() for a in _seq(relation.output()) if a.name() == self._key(entry)]
            pruner = Pruner(entry.rule, ids[0], self._kind(entry), zone) if ids else None
            if strict:
                if cond is None or pruner is None:
                    raise MissingShardingKey(f"the statement names no value of {entry.rule.key}")
                pruner.point(cond)
            own = ALL if cond is None or pruner is None else pruner.shards(cond)
            sets[entry.name] = either(sets[entry.name], own) if entry.name in sets else own
        return sets

    def resolve(self, sql: str, args: Sequence[Any] = (), op: Operation | None = None, strict: bool = False, use: str | None = None) -> tuple[DataFrame, Resolution]:
        """A query's DataFrame over the shards it needs, and what was decided for it."""
        df, result = self._resolve(sql, args, op, strict, use)
        for name in result.tables:
            self._said(self.catalog.entries[name], result.labels.get(name, result.operation.value), sql)
        return df, result

    def _resolve(self, sql: str, args: Sequence[Any], op: Operation | None, strict: bool, use: str | None = None, placed: str | None = None) -> tuple[DataFrame, Resolution]:
        """``resolve`` without a trace. The table called ``placed`` shows the ``_db`` and ``_tbl`` of its rows."""
        text = _FOR_UPDATE.sub("", sql)
        if op is None:
            op = Operation.WRITE if text != sql else Operation(operation(sql))
        refs = self._references(text)
        entries = [self.catalog.entries[n] for n in dict.fromkeys(r.name for r in refs)]
        chosen = {e.name: self._roots(e, op, use) for e in entries if e.rule is not None}
        roots = {n: r for n, (r, _) in chosen.items()}
        result = Resolution(sql, [e.name for e in entries], op, labels={n: label for n, (_, label) in chosen.items()})

        def over(shards):
            frames = {e.name: self.table(e.name) if e.rule is None else self.scan(e.name, shards.get(e.name, ALL), roots=roots[e.name]) for e in entries}
            frames = {n: df if n == placed or self.catalog.entries[n].rule is None else df.drop("_db", "_tbl") for n, df in frames.items()}
            return self._run(text, args, [(r, frames[r.name]) for r in refs])

        df = over({})
        if not _HINT.search(text) and chosen:
            result.shards = self._prune(df, entries, strict)
            if any(s is not ALL for s in result.shards.values()):
                df = over(result.shards)
        return df, result

    def _said(self, entry: Entry, label: str, sql: str) -> None:
        """Keep and log a statement; the pool's label goes before it if a router of the table traces."""
        entry.last_query = sql
        trace(label if entry.rule is not None and any(r.trace for r in entry.rule.routers) else "", sql)

    def first(self, sql: str, args: Sequence[Any] = (), **kw):
        """The first row of a query, or None."""
        return self.sql(sql, args, **kw).first()

    def roots(self, table: str) -> list[str]:
        """Every root of a table's databases, sources before replicas, each once: to visit all of them."""
        routers = self.catalog.entry(table).rule.routers
        return list(dict.fromkeys([self.catalog.default_root, *[s for r in routers for s in r.sources], *[s for r in routers for s in r.replicas]]))

    def sql(self, sql: str, args: Sequence[Any] = (), op: Operation | None = None, strict: bool = False, use: str | None = None):
        """Run a statement: a DataFrame for queries, a Resolution with the number of rows for INSERT, UPDATE, DELETE."""
        word = re.sub(r"/\*.*?\*/|--[^\n]*", " ", sql, flags=re.S).split(None, 1)[0].lower() if sql.strip() else ""
        try:
            if word == "insert":
                return self._insert_sql(sql, args, strict)
            if word in ("update", "delete"):
                return self._change_sql(sql, args, strict)
            if word not in ("select", "with", "values", "from", "("):
                raise NotImplementedError(f"{word or 'an empty text'} is no statement for sharded tables")
            return self.resolve(sql, args, op, strict, use)[0]
        except Exception as e:
            trace("write" if word in ("insert", "update", "delete") else "read", sql, e)
            raise

    # changes

    def _placed(self, entry: Entry, df: DataFrame) -> DataFrame:
        db, tbl = entry.rule.place_exprs(F.col(self._key(entry)), df.schema[self._key(entry)].dataType)
        return df.withColumns({"_db": db, "_tbl": tbl})

    def _rename(self, fs, source: str, target: str) -> None:
        if not fs.rename(self._path(source), self._path(target)):
            raise ShardingError(f"{source} could not be renamed to {target}")

    def _files(self, fs, folder: str) -> list[str]:
        return [f.getPath().getName() for f in fs.listStatus(self._path(folder)) if not f.getPath().getName().startswith((".", "_"))]

    def _commit(self, moves: list[tuple[str, str]], drop: list[str]) -> None:
        """Put the files of folders into other folders of the same file system and remove the files of ``drop``.

        New files arrive under names that scans do not see; then old files get such names and new ones their own; old
        files are deleted last. Whatever fails before that is undone, so the old rows stay. Readers that list a folder
        between two renames may see neither or both of its old and new files: several renames are not atomic together.
        """
        mark, undo, old = f".{uuid.uuid4().hex}-", [], []

        def rename(fs, source, target):
            self._rename(fs, source, target)
            undo.append((fs, target, source))

        try:
            arrived = []
            for source, target in moves:
                fs = self._fs(target)
                if not fs.mkdirs(self._path(target)):
                    raise ShardingError(f"{target} could not be made")
                for name in self._files(fs, source):
                    rename(fs, f"{source}/{name}", f"{target}/{mark}{name}")
                    arrived.append((fs, f"{target}/{mark}{name}", f"{target}/{name}"))
            for folder in drop:
                fs = self._fs(folder)
                for name in self._files(fs, folder):
                    rename(fs, f"{folder}/{name}", f"{folder}/{mark}old-{name}")
                    old.append((fs, f"{folder}/{mark}old-{name}"))
            for fs, source, target in arrived:
                rename(fs, source, target)
        except BaseException:
            for fs, source, target in reversed(undo):
                fs.rename(self._path(source), self._path(target))
            raise
        for fs, path in old:
            fs.delete(self._path(path), False)
        for folder in drop:
            fs = self._fs(folder)
            if not len(fs.listStatus(self._path(folder))):
                fs.delete(self._path(folder), False)

    def _stage(self, rows: DataFrame, roots: dict[int, str], table: str) -> dict[str, str]:
        """Rows written beside the table, on each file system of the roots: (staging folder by file system)."""
        by: dict[str, list[int]] = {}
        for db, root in roots.items():
            by.setdefault(self._fs(root).getUri().toString(), []).append(db)
        out = {}
        for dbs in by.values():
            # databases of routers first: the default root is often empty
            home = roots[max(dbs, key=lambda d: (d != DEFAULT_DB, -d))]
            out[home] = f"{home}/{table}.staging-{uuid.uuid4().hex}"
            part = rows if len(by) == 1 else rows.where(F.col("_db").isin(dbs))
            part.write.partitionBy("_db", "_tbl").parquet(out[home])
        return out

    def _replace(self, entry: Entry, placed: DataFrame, roots: dict[int, str], drop=()) -> int:
        """Write placed rows beside the table in one job (one per file system), then put them in place of the shards in
        ``drop``; the number of rows written. A change that fails leaves the table as it was."""
        staged: dict[str, str] = {}
        try:
            # rebalance joins small pieces and splits shards that hold a large part of the rows
            staged = self._stage(placed.hint("rebalance", "_db", "_tbl"), roots, entry.name)
            rows = sum(self.spark.read.schema(placed.schema).parquet(x).count() for x in staged.values())  # from the files' footers
            for root in dict.fromkeys(roots.values()):
                self._fs(root).mkdirs(self._path(f"{root}/{entry.name}"))  # an empty table, not a missing one
            gone = [path for root in dict.fromkeys(roots.values()) for shard, path in self._shard_dirs(root, entry.name).items() if shard in drop and roots.get(shard[0]) == root]
            moves = [(path, f"{roots[shard[0]]}/{entry.name}/" + "/".join(path.rsplit("/", 2)[1:])) for home, x in staged.items() for shard, path in self._shard_dirs(home, x[len(home) + 1 :]).items()]
            self._commit(moves, gone)
            return rows
        finally:
            self.refresh(entry.name)
            for x in staged.values():
                self._fs(x).delete(self._path(x), True)

    def write(self, df: DataFrame, table: str, strict: bool = False, use: str | None = None) -> Resolution:
        """Append rows, each to its own shard; a null key fails the job, in strict mode so do rows of several shards."""
        entry = self.catalog.entry(table)
        if entry.rule is None:
            df.write.mode("append").parquet(f"{self.catalog.default_root}/{entry.name}")
            return Resolution("", [entry.name], Operation.WRITE)
        schema = self.catalog.schema_of(entry, df)
        if not any(c.lower() == entry.rule.key.lower() for c in df.columns):
            raise MissingShardingKey(f"the rows have no column {entry.rule.key}")
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        placed = self._placed(entry, df)
        if strict and placed.select("_tbl").distinct().limit(2).count() > 1:
            raise DifferentSuffix("the rows belong to different table shards")
        roots, label = self._roots(entry, Operation.WRITE, use)
        return Resolution("", [entry.name], Operation.WRITE, labels={entry.name: label}, rows=self._replace(entry, placed, roots))

    def _insert_sql(self, sql, args, strict):
        m = _INSERT.match(sql)
        if not m:
            raise NotImplementedError("this form of INSERT is not supported")
        entry = self.catalog.entry(m[1])
        schema = self.catalog.schema_of(entry)
        names = [c.strip().strip("`") for c in m[2].split(",")] if m[2] else schema.names
        body = sql[m.end() :].rstrip().rstrip(";")
        rows = self.resolve(bind(body, args), op=Operation.WRITE)[0]
        if len(rows.columns) != len(names):
            raise ShardingError(f"{len(rows.columns)} values for {len(names)} columns")
        known = {n.lower(): n for n in schema.names}
        if any(n.lower() not in known for n in names):
            raise ShardingError(f"{entry.name} has no such columns: {', '.join(n for n in names if n.lower() not in known)}")
        if entry.rule is not None and entry.rule.key.lower() not in [n.lower() for n in names]:
            raise MissingShardingKey(f"the statement gives no {entry.rule.key}")
        out = self.write(rows.toDF(*[known[n.lower()] for n in names]), entry.name, strict)
        out.statement = sql
        self._said(entry, out.labels.get(entry.name, "source"), sql)
        return out

    def _change_sql(self, sql, args, strict):
        text = bind(sql, args).rstrip().rstrip(";")
        refs = references(self._session.sessionState().sqlParser(), text)
        if not refs:
            raise NotImplementedError("this form of UPDATE or DELETE is not supported")
        entry = self.catalog.entry(refs[0].name)
        if entry.rule is None:
            raise NotImplementedError(f"{entry.name} is not sharded: rewrite it with DataFrames")
        alias, changes, cond = split_change(text[refs[0].stop :])
        out = self.update(entry.name, changes, cond, strict, alias) if changes else self.delete(entry.name, cond, strict, alias)
        out.statement = sql
        self._said(entry, out.labels.get(entry.name, "source"), sql)
        return out

    def _affected(self, entry: Entry, condition: str, strict: bool, alias: str):
        """Roots, label, shards that hold rows of a condition, and how many rows: one scan of the shards it can match."""
        roots, label = self._roots(entry, Operation.WRITE)
        df, _ = self._resolve(f"SELECT {alias}._db, {alias}._tbl, count(*) AS n FROM {entry.name} AS {alias} WHERE {condition} GROUP BY 1, 2", (), Operation.WRITE, strict, placed=entry.name)
        hit = df.collect()  # a row per touched shard
        return roots, label, [(r["_db"], r["_tbl"]) for r in hit], sum(r.n for r in hit)

    def _of(self, entry: Entry, what: str, condition: str, alias: str, shards, roots) -> DataFrame:
        """Columns of the rows of some shards that meet a condition; tables in subqueries are read whole."""
        text = f"SELECT {what} FROM {entry.name} AS {alias} WHERE {condition}"
        refs = self._references(text)
        own = self.scan(entry.name, frozenset(shards), roots=roots)
        return self._run(text, (), [(r, own if k == 0 else self.table(r.name, Operation.WRITE)) for k, r in enumerate(sorted(refs, key=lambda r: r.start != text.index(f" FROM {entry.name} AS ") + 6))])

    def delete(self, table: str, condition: str = "true", strict: bool = False, alias: str | None = None) -> Resolution:
        """Delete rows, rewriting the shards that hold some; the number of rows is in the result. The condition may have
        subqueries on tables of the catalog, which it sees as they were."""
        entry, alias = self.catalog.entry(table), alias or table
        roots, label, hit, n = self._affected(entry, condition, strict, alias)
        if n:
            self._replace(entry, self._of(entry, f"{alias}.*", f"NOT coalesce(({condition}), false)", alias, hit, roots), roots, hit)
        return Resolution("", [entry.name], Operation.WRITE, {entry.name: None}, {entry.name: label}, n)

    def update(self, table: str, changes: dict[str, str], condition: str = "true", strict: bool = False, alias: str | None = None) -> Resolution:
        """Set columns to SQL expressions where a condition holds; rows whose key changes move to their new shard.
        Condition and expressions may have subqueries on tables of the catalog, which they see as they were."""
        entry, alias = self.catalog.entry(table), alias or table
        schema = self.catalog.schema_of(entry)
        known = {n.lower(): n for n in schema.names}
        changes = {known.get(k.lower(), k): v for k, v in changes.items()}
        if unknown := [k for k in changes if k not in schema.names]:
            raise ShardingError(f"{table} has no such columns: {', '.join(unknown)}")
        roots, label, hit, n = self._affected(entry, condition, strict, alias)
        if n:
            new = ", ".join(f"CAST(({changes[f.name]}) AS {f.dataType.simpleString()}) AS `{f.name}`" if f.name in changes else f"{alias}.`{f.name}`" for f in schema.fields)
            old = ", ".join(f"{alias}.`{f.name}`" for f in schema.fields)
            rows = self._of(entry, new, f"({condition})", alias, hit, roots).unionAll(self._of(entry, old, f"NOT coalesce(({condition}), false)", alias, hit, roots))
            self._replace(entry, self._placed(entry, rows), roots, hit)
        return Resolution("", [entry.name], Operation.WRITE, {entry.name: None}, {entry.name: label}, n)

    def sync_replicas(self, table: str) -> None:
        """Make every replica of a table's databases a snapshot of its source as it is now. Executors copy the rows, file
        by file; a replica is switched when its copy is whole, and stays as it was if the copy fails."""
        entry = self.catalog.entry(table)
        self.refresh(table)
        schema = self._stored(self.catalog.schema_of(entry))
        pairs: dict[tuple[str, str], list[int]] = {}
        for db in range(len(entry.rule.databases)):
            r = self._router(entry, db)
            for replica in r.replicas:
                pairs.setdefault(((list(r.sources) or [self.catalog.default_root])[0], replica), []).append(db)
        for (source, replica), dbs in pairs.items():
            rows = self._listed(source, entry.name, schema)
            fs, staging = self._fs(replica), f"{replica}/{entry.name}.sync-{uuid.uuid4().hex}"
            try:
                fs.mkdirs(self._path(f"{replica}/{entry.name}"))
                if rows is not None:
                    rows.where(F.col("_db").isin(dbs)).write.partitionBy("_db", "_tbl").parquet(staging)
                gone = [path for (db, _), path in self._shard_dirs(replica, entry.name).items() if db in dbs]
                self._commit([(path, f"{replica}/{entry.name}/" + "/".join(path.rsplit("/", 2)[1:])) for path in self._shard_dirs(replica, staging[len(replica) + 1 :]).values()], gone)
            finally:
                fs.delete(self._path(staging), True)
        self.refresh(table)


def _shard_filter(shards) -> str:
    """A set of shards as a condition on the partition columns."""
    wanted: dict[int | None, set] = {}
    for d, t in shards:
        wanted.setdefault(d, set()).add(t)
    parts = []
    for d, ts in wanted.items():
        here = [f"_db = {d}"] if d is not None else []
        if None not in ts:
            here.append(f"_tbl IN ({', '.join(map(quote, sorted(ts)))})")
        parts.append(" AND ".join(here) or "true")
    return " OR ".join(f"({p})" for p in parts) or "false"


def _seq(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()
