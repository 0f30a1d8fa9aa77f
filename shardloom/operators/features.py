"""One wide row per entity from events of many types."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, gathered, starts_of_runs

#: Rows a task gathers before it adds them up ahead of the shuffle.
COMBINE_ROWS = 524_288
#: An entity with more rows, and with more than one in MOST_HOT of all rows, is hot: its partial counters are merged by
#: groups of types, one per HOT_ROWS rows, before they meet in one wide row.
HOT_ROWS, MOST_HOT = 10_000_000, 10_000
#: Most event types that get columns of their own; beyond it only the map layout is offered.
MOST_KINDS = 5_000


def _partial_type(entity_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("entity", entity_type), T.StructField("kind", T.StringType()), T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("first_at", T.TimestampNTZType()), T.StructField("last_at", T.TimestampNTZType())])


def _once(batches):
    """Tables of rows sorted by ``ident`` without repeats: of each column the largest non-null value of an ident's rows.
    Rows without ident all stay."""
    held = None
    for t in gathered(batches, COMBINE_ROWS):
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        ids = column(t, "ident")
        new = starts_of_runs(ids.fill_null(0) if pa.types.is_integer(ids.type) else ids.cast(pa.string()).fill_null("")) | ids.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= ids.is_null().to_numpy(zero_copy_only=False)[:-1]
        cut = int(np.flatnonzero(new)[-1])  # the last ident may go on
        held = t.slice(cut)
        if cut:
            yield _largest(t.slice(0, cut), new[:cut])
    if held is not None:
        held = held.combine_chunks()
        yield _largest(held, np.arange(held.num_rows) == 0)


def _largest(t: pa.Table, new: np.ndarray) -> pa.Table:
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, t.num_rows))
    single = t.take(pa.array(first[size == 1]))
    if len(single) == t.num_rows:
        return single
    many = t.take(pa.array(np.flatnonzero(np.repeat(size > 1, size)))).combine_chunks()
    run = pa.array(np.repeat(np.arange((size > 1).sum()), size[size > 1]))
    starts = pa.array(np.append(0, np.cumsum(size[size > 1])[:-1]))
    cols = {}
    for name in t.column_names:
        by = pa.table({"run": run, "x": column(many, name)})
        order = pc.sort_indices(by, sort_keys=[("run", "ascending"), ("x", "descending")], null_placement="at_end")
        cols[name] = column(many, name).take(order).take(starts)
    return pa.concat_tables([single, pa.table(cols, schema=single.schema)])


def _runs(t: pa.Table) -> pa.Table:
    """Adjacent rows of one entity and type added up."""
    first = np.flatnonzero(starts_of_runs(column(t, "entity"), column(t, "kind")))
    if len(first) == t.num_rows:
        return t
    big, small = np.iinfo(np.int64).max, np.iinfo(np.int64).min

    def time(name, fill, op):
        x = op.reduceat(column(t, name).cast(pa.int64()).fill_null(fill).to_numpy(zero_copy_only=False), first)
        return pa.array(x, mask=x == fill).cast(pa.timestamp("us"))

    at = pa.array(first)
    return pa.table({"entity": column(t, "entity").take(at), "kind": column(t, "kind").take(at), "n": pa.array(np.add.reduceat(column(t, "n").to_numpy(), first)), "total": pa.array(np.add.reduceat(column(t, "total").to_numpy(), first)), "first_at": time("first_at", big, np.minimum), "last_at": time("last_at", small, np.maximum)})


def feature_table(df: DataFrame, entity: str, kind: str, at: str, ident: str | None = None, value: str | None = None, as_of: dt.datetime | None = None, kinds: Sequence[str] | None = None) -> DataFrame:
    """One row per entity with count, total, latest time and recency of each event type.

    Columns: ``entity``, ``events``, ``types``, ``total``, ``first_at``, ``last_at`` and the features, as a map
    ``features`` from type to (``n``, ``total``, ``last_at``, ``recency_s``), or, if ``kinds`` lists the types, as the
    columns ``n_<type>``, ``total_<type>`` (with ``value``), ``last_<type>``, ``recency_<type>``. Types outside a given
    list count in the entity's totals only. Recency is the seconds from the latest event to ``as_of`` (null without it).

    Cases: rows without entity are left out, as are null or empty types; rows without time count but give no latest
    time; null values add nothing; rows with the same ``ident`` count once (rows without one all count); an empty table
    gives no row.

    Plan: after a shuffle by ``ident`` the stage that drops repeated rows also adds up per entity and type before the one
    shuffle by entity, so a hot entity arrives as one row per type and task; partitions sorted by entity and type are
    streamed as runs straight into wide rows, without another shuffle. Entities with very many rows (HOT_ROWS; fewer than
    MOST_HOT of them, by their share) have their partial counters merged once more before, by groups of types.
    """
    entity_type = df.schema[entity].dataType
    rows = df.select(*([F.col(ident).alias("ident")] if ident else []), F.col(entity).alias("entity"), F.col(kind).alias("kind"), F.col(at).cast("timestamp_ntz").alias("at"), *([F.col(value).cast("double").alias("value")] if value else []))
    if ident:  # repeats of an id may differ in what is left out below, so they are dropped first
        rows = rows.withColumn("_row", F.when(F.col("ident").isNull(), F.monotonically_increasing_id())).repartition("ident", "_row").drop("_row").sortWithinPartitions("ident")
    part, listed = _partial_type(entity_type), list(dict.fromkeys(kinds)) if kinds is not None else None
    now_us = None if as_of is None else round((as_of - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    if listed is not None and len(listed) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} types: leave kinds out to get a map")

    def combine(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(part)
        for t in _once(batches) if ident else gathered(batches, COMBINE_ROWS):
            t = t.filter(pc.and_(column(t, "entity").is_valid(), pc.fill_null(pc.not_equal(column(t, "kind"), ""), False))).combine_chunks()
            if not t.num_rows:
                continue
            t = t.append_column("v", column(t, "value").fill_null(0.0) if value else pa.array(np.zeros(t.num_rows)))
            g = t.group_by(["entity", "kind"], use_threads=False).aggregate([("v", "count"), ("v", "sum"), ("at", "min"), ("at", "max")])
            g = pa.table([column(g, c) for c in ("entity", "kind", "v_count", "v_sum", "at_min", "at_max")], schema=schema)
            yield from g.to_batches(max_chunksize=65_536)

    out = T.StructType([T.StructField("entity", entity_type), T.StructField("events", T.LongType()), T.StructField("types", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("first_at", T.TimestampNTZType()), T.StructField("last_at", T.TimestampNTZType())])
    cell = T.StructType([T.StructField("n", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("last_at", T.TimestampNTZType())])
    if listed is None:
        out = out.add("features", T.MapType(T.StringType(), cell))
    else:
        for k in listed:  # with their final names: a projection over a thousand columns costs more than making them
            out = out.add(f"n_{k}", T.LongType())
            out = out.add(f"total_{k}", T.DoubleType()) if value else out
            out = out.add(f"last_{k}", T.TimestampNTZType()).add(f"recency_{k}", T.DoubleType())

    def emit(t, schema):
        """Wide rows from runs of whole entities."""
        t = _runs(t)
        first = np.flatnonzero(starts_of_runs(column(t, "entity")))
        big, small = np.iinfo(np.int64).max, np.iinfo(np.int64).min
        n, total = column(t, "n").to_numpy(), column(t, "total").to_numpy()
        last = column(t, "last_at").cast(pa.int64()).fill_null(small).to_numpy(zero_copy_only=False)
        early = np.minimum.reduceat(column(t, "first_at").cast(pa.int64()).fill_null(big).to_numpy(zero_copy_only=False), first)
        late = np.maximum.reduceat(last, first)
        cols = [column(t, "entity").take(pa.array(first)), pa.array(np.add.reduceat(n, first)), pa.array(np.diff(np.append(first, t.num_rows)).astype(np.int64)), pa.array(np.add.reduceat(total, first)), pa.array(early, mask=early == big).cast(pa.timestamp("us")), pa.array(late, mask=late == small).cast(pa.timestamp("us"))]
        if listed is None:
            kind_of_map = schema.field("features").type
            cells = pa.StructArray.from_arrays([column(t, "n"), column(t, "total"), column(t, "last_at")], fields=list(kind_of_map.item_type))
            cols.append(pa.MapArray.from_arrays(pa.array(np.append(first, t.num_rows).astype(np.int32)), column(t, "kind"), cells, type=kind_of_map))
        else:
            where = pc.index_in(column(t, "kind"), value_set=pa.array(listed, pa.string()))
            of = np.cumsum(starts_of_runs(column(t, "entity"))) - 1
            ok = where.is_valid().to_numpy(zero_copy_only=False)
            r, c = of[ok], where.fill_null(0).to_numpy(zero_copy_only=False)[ok]
            ns, ts, ls = (np.full((len(listed), len(first)), f, d) for f, d in ((0, np.int64), (0.0, np.float64), (small, np.int64)))
            ns[c, r], ts[c, r], ls[c, r] = n[ok], total[ok], last[ok]
            for i in range(len(listed)):
                none = ls[i] == small
                cols += [pa.array(ns[i]), *([pa.array(ts[i])] if value else []), pa.array(ls[i], mask=none).cast(pa.timestamp("us"))]
                cols.append(pa.nulls(len(none), pa.float64()) if now_us is None else pa.array((now_us - np.where(none, 0, ls[i])) / 1e6, mask=none))
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    def stream(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, held = to_arrow_schema(out), None
        size = 131_072 if listed is None else max(2_048, 8_000_000 // max(1, len(listed)) // 8)
        for t in gathered(batches, size):
            t = _runs(pa.concat_tables([held, t]).combine_chunks() if held is not None else t)
            cut = int(np.flatnonzero(starts_of_runs(column(t, "entity")))[-1])  # the last entity may go on
            held = t.slice(cut)
            if cut:
                yield emit(t.slice(0, cut).combine_chunks(), schema)
        if held is not None:
            yield emit(held.combine_chunks(), schema)

    def merge(batches):
        held = None
        for t in gathered(b.select(part.names) for b in batches):
            t = _runs(pa.concat_tables([held, t]).combine_chunks() if held is not None else t)
            held = t.slice(t.num_rows - 1)
            yield from t.slice(0, t.num_rows - 1).to_batches()
        if held is not None:
            yield from held.combine_chunks().to_batches()

    per = df.where(F.col(entity).isNotNull()).groupBy(F.col(entity).alias("e")).agg(F.count(F.lit(1)).alias("rows"))
    size = per.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"), F.coalesce(F.max("rows"), F.lit(0)).alias("most")).first()
    least = max(HOT_ROWS, size.n // MOST_HOT)
    if size.most > least:  # fewer than MOST_HOT entities have so many rows
        hot = F.broadcast(per.where(F.col("rows") > least).select("e", F.ceil(F.col("rows") / HOT_ROWS).alias("salts")))
        shared = rows.join(hot.select("e"), F.col("entity") == F.col("e"), "left_semi").mapInArrow(combine, part)
        salted = shared.join(hot, F.col("entity") == F.col("e")).withColumn("salt", F.pmod(F.xxhash64("kind"), F.col("salts"))).drop("e", "salts")
        merged = salted.repartition("entity", "salt").sortWithinPartitions("entity", "salt", "kind").mapInArrow(merge, part)
        partial = rows.join(hot.select("e"), F.col("entity") == F.col("e"), "left_anti").mapInArrow(combine, part).unionAll(merged)
    else:
        partial = rows.mapInArrow(combine, part)
    wide = partial.repartition("entity").sortWithinPartitions("entity", "kind").mapInArrow(stream, out)
    if listed is not None:
        return wide
    now = F.lit(as_of).cast("timestamp_ntz").cast("timestamp")
    recency = lambda c: (F.unix_micros(now) - F.unix_micros(c.cast("timestamp"))).cast("double") / 1e6
    return wide.withColumn("features", F.transform_values("features", lambda _, x: x.withField("recency_s", recency(x["last_at"]))))


def kinds_of(df: DataFrame, kind: str, most: int = MOST_KINDS) -> list[str]:
    """The sorted event types, for the wide layout; raises if there are more than ``most`` (the checked size)."""
    got = [r[0] for r in df.where(F.col(kind) != "").select(kind).distinct().limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"more than {most} types: use the map layout")
    return sorted(got)
