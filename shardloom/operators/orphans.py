"""References to records that do not exist, by bitmaps per key range and period.

Keys are 64-bit integers and serve as their own codes; other keys are encoded by ``dictionary`` first. A key splits into
its range (the upper bits) and its place in the range (the lower ones). The places of a range and period form a container:
a sorted list while they are few, 65,536 bits where there are many. A range is so wide that it holds thousands of keys,
16 lower bits for dense keys and more for sparse ones (hashes), so the number of containers follows the number of keys.
``references AND NOT parents`` leaves the keys to look at; only rows of those are compared with the exact times of the
parents' changes.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, ensure_checkpoint_dir, gathered, normalised, once_per_id

#: Places above which a container of 16-bit places is kept as bits (65,536 bits take as much as 4,096 places).
DENSE = 4096
#: What a container holds; references follow from REFERENCE on, one number per table.
ROW, CHANGED, BASE, UNTIL, FROM, WITHIN, REFERENCE = range(7)
#: The period of rows without time.
UNTIMED = -1
#: Most surviving keys and periods that are sent to every task; more meet the rows in a shuffled join.
MOST_CASES = 500_000

_CONTAINER = T.StructType([T.StructField("key_range", T.LongType()), T.StructField("what", T.IntegerType()), T.StructField("period", T.IntegerType()), T.StructField("places", T.BinaryType())])
_SURVIVOR = T.StructType([T.StructField("what", T.IntegerType()), T.StructField("period", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("changed", T.BooleanType())])


class Places:
    """Containers of ranges of 2^``shift`` keys: arrays of places in order, or packed bits."""

    def __init__(self, shift: int):
        self.shift = shift
        self.kind = np.uint16 if shift <= 16 else np.uint32 if shift <= 32 else np.uint64

    @classmethod
    def of(cls, keys: int, least: int, most: int) -> Places:
        """For so many keys from ``least`` to ``most``: a range holds DENSE of them on average, 65,536 places at least."""
        spread = (most - least + 1) * DENSE // max(1, keys) // (1 << 16)
        return cls(min(48, 16 + max(0, spread.bit_length() - 1)))

    def split(self, key: np.ndarray):
        return key >> self.shift, (key & np.int64((1 << self.shift) - 1)).astype(self.kind)

    def keys(self, key_range: int, places) -> np.ndarray:
        return (np.int64(key_range) << self.shift) | self.listed(places).astype(np.int64)

    def packed(self, places) -> bytes:
        if places.dtype == np.uint8:
            return b"b" + places.tobytes()
        return b"b" + self.bits(places).tobytes() if self.shift <= 16 and len(places) > DENSE else b"a" + places.tobytes()

    def unpacked(self, body: bytes):
        return np.frombuffer(body, np.uint8 if body[:1] == b"b" else self.kind, offset=1)

    @staticmethod
    def bits(places) -> np.ndarray:
        if places.dtype == np.uint8:
            return places
        flags = np.zeros(65_536, dtype=bool)
        flags[places] = True
        return np.packbits(flags, bitorder="little")

    @staticmethod
    def listed(places) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(places, bitorder="little")) if places.dtype == np.uint8 else places

    def either(self, parts: list):
        """Union."""
        if len(parts) == 1:
            return parts[0]
        if any(x.dtype == np.uint8 for x in parts):
            return np.bitwise_or.reduce([self.bits(x) for x in parts])
        return np.unique(np.concatenate(parts))

    @staticmethod
    def has(places, among) -> np.ndarray:
        """Which of the listed ``among`` are in a container."""
        if places.dtype == np.uint8:
            return (places[among >> 3] >> (among & 7) & 1).astype(bool)
        if not len(places):
            return np.zeros(len(among), bool)
        return places[np.minimum(np.searchsorted(places, among), len(places) - 1)] == among

    def without(self, places, cover):
        """``places`` AND NOT ``cover``."""
        if places.dtype == np.uint8:
            return places & ~self.bits(cover)
        return places[~self.has(cover, places)]


def _containers(of: Places):
    """Containers of (what, period, key) rows, one per kind, period and key range of a chunk of a task."""

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(_CONTAINER)
        for t in gathered(batches, 524_288):
            what, period, key = (column(t, c).to_numpy() for c in ("what", "period", "key"))
            order = np.lexsort((key, period, what))
            what, period, key = what[order], period[order], key[order]
            new = np.ones(len(key), dtype=bool)
            new[1:] = (key[1:] != key[:-1]) | (period[1:] != period[:-1]) | (what[1:] != what[:-1])
            what, period, key = what[new], period[new], key[new]
            rng, low = of.split(key)
            new = np.ones(len(key), dtype=bool)
            new[1:] = (rng[1:] != rng[:-1]) | (period[1:] != period[:-1]) | (what[1:] != what[:-1])
            first = np.flatnonzero(new)
            bodies = [of.packed(low[a:b]) for a, b in zip(first, np.append(first[1:], len(key)))]
            for i in range(0, len(first), 1024):
                at = first[i : i + 1024]
                yield pa.RecordBatch.from_arrays([pa.array(rng[at]), pa.array(what[at]), pa.array(period[at]), pa.array(bodies[i : i + 1024], pa.binary())], schema=schema)

    return run


def _merged(of: Places):
    """Sorted containers with those of one kind, period and key range joined to one."""

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, mine, parts = to_arrow_schema(_CONTAINER), None, []

        def one():
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*mine, of.packed(of.either(parts))), schema)], schema=schema)

        for b in batches:
            for *at, body in zip(*(b.column(c).to_pylist() for c in ("key_range", "what", "period", "places"))):
                if at != mine:
                    if parts:
                        yield one()
                    mine, parts = at, []
                parts.append(of.unpacked(body))
                if len(parts) >= 64:
                    parts = [of.either(parts)]
        if parts:
            yield one()

    return run


def _and_not(of: Places):
    """Merged containers of whole key ranges, parents first: the references that no parent covers, decoded to keys."""

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, none, here = to_arrow_schema(_SURVIVOR), np.zeros(0, of.kind), None
        by: dict = {}
        covers: dict = {}

        def cover(period):
            """What covers references of a period: parents alive through all of it."""
            if period not in covers:
                if period == UNTIMED:
                    parts = [x for (kind, _), x in by.items() if kind == ROW]
                else:
                    parts = [x for (kind, p), x in by.items() if kind == BASE or kind == FROM and p <= period or kind == UNTIL and p >= period or kind == WITHIN and p == period]
                covers[period] = of.either(parts) if parts else none
            return covers[period]

        for b in batches:
            out = []
            for rng, what, period, body in zip(*(b.column(c).to_pylist() for c in ("key_range", "what", "period", "places"))):
                if rng != here:
                    here, by, covers = rng, {}, {}
                if what < REFERENCE:
                    by[what, period] = of.unpacked(body)
                    continue
                left = of.listed(of.without(of.unpacked(body), cover(period)))
                if len(left):
                    changed = of.has(by.get((CHANGED, 0), none), left.astype(of.kind))
                    out.append((np.full(len(left), what, np.int32), np.full(len(left), period, np.int32), of.keys(rng, left), changed))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=schema)

    return run


def month_of(c) -> F.Column:
    """Months since year 0; rows without time get UNTIMED."""
    return F.coalesce(F.year(c) * 12 + F.month(c) - 1, F.lit(UNTIMED)).cast("int")


def dictionary(keys: DataFrame, key: str) -> DataFrame:
    """``key`` -> ``code``: distinct non-null keys numbered by range of key order, for keys that are no integers.

    The numbers are dense within a partition of the sorted keys, so a key range of the bitmaps holds neighbours. The
    table is written to the checkpoint folder: later stages must all see the same numbers. Empty input gives no row.
    """
    ensure_checkpoint_dir(keys.sparkSession)
    return keys.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key).sortWithinPartitions(key).withColumn("code", F.monotonically_increasing_id()).checkpoint()


def existence(changes: DataFrame, key: str, kind: str, at: str, ident: str) -> DataFrame:
    """Intervals ``[lo, hi)`` of a parent's state: ``key``, ``lo``, ``hi`` (null: open), ``exists``.

    The latest change at or before a time decides: delete ends existence, create and restore begin it. Before the first
    change the parent exists unless that change is a create. Cases: changes without key, time or a known kind are left
    out; repeated idents count once; of changes at one time the one with the larger ident comes later.
    """
    flag = F.when(normalised(kind) == "delete", 0).when(normalised(kind) == "restore", 1).when(normalised(kind) == "create", 2)
    rows = once_per_id(changes.select(F.col(ident).alias("ident"), F.col(key).alias("key"), F.col(at).alias("lo"), flag.alias("flag")), "ident")
    rows = rows.where(F.col("key").isNotNull() & F.col("lo").isNotNull() & F.col("flag").isNotNull())
    # neighbours within a month, then over the months: a parent with very many changes is not one task's work
    rows = rows.withColumn("month", month_of(F.col("lo")))
    w = Window.partitionBy("key", "month").orderBy("lo", "ident")
    months = Window.partitionBy("key").orderBy("month")
    edges = rows.groupBy("key", "month").agg(F.min("lo").alias("starts")).select("key", "month", F.lead("starts").over(months).alias("next"), F.lag("starts").over(months).alias("last"))
    rows = rows.withColumns({"hi": F.lead("lo").over(w), "before": F.lag("lo").over(w)}).join(edges, ["key", "month"])
    rows = rows.withColumns({"hi": F.coalesce("hi", "next"), "before": F.coalesce("before", "last")})
    later = F.struct(F.col("lo"), F.col("hi"), (F.col("flag") > 0).alias("exists"))
    first = F.struct(F.lit(None).cast("timestamp_ntz").alias("lo"), F.col("lo").alias("hi"), (F.col("flag") != 2).alias("exists"))
    parts = F.when(F.col("before").isNull(), F.array(first, later)).otherwise(F.array(later))
    return rows.select("key", F.explode(parts).alias("x")).select("key", "x.lo", "x.hi", "x.exists")


def orphans(refs: Sequence[tuple[str, DataFrame, str, str, str]], parents: DataFrame, parent_key: str, changes: tuple[DataFrame, str, str, str, str], no_key: int | None = None) -> DataFrame:
    """Rows whose key names no parent existing at the row's time: ``table_name``, ``row_id``, ``key``, ``at``, ``period``
    (months since year 0, -1 without time).

    ``refs`` lists (table name, table, id column, key column, time column); ``changes`` is (table, key, kind, time, id)
    of the parents' changes. The latest change at or before the row's time decides; if all changes are later, the parent
    exists unless the first of them is a create; a key without any change exists if ``parents`` has a row of it. A row
    without time is an orphan if ``parents`` has no row of its key.

    Keys that are no integers are encoded by ``dictionary`` and decoded in the result.

    Cases: rows whose key is null or ``no_key`` refer to nothing and are left out; rows with the same id come out once;
    null ids come out as they are; empty tables give no row, and with empty parents every reference is an orphan.

    Plan: partial bitmaps per task shrink a hot key to one bit before a shuffle; containers are merged by range, kind and
    period, so that a range with all keys is not one task's work, and only merged ones meet by range. The surviving keys
    are written and counted. Up to MOST_CASES of them are sent to every task, and no row is shuffled; more meet the rows
    in a merge join, in which Spark splits a hot key's rows. Only orphans are shuffled after that, to drop repeats.
    """
    if not all(isinstance(df.schema[key].dataType, T.IntegralType) for _, df, _, key, _ in refs):
        return _orphans_of_other_keys(refs, parents, parent_key, changes, no_key)
    rows = None
    for n, (name, df, ident, key, at) in enumerate(refs):
        one = df.select(F.lit(n).alias("n"), F.lit(name).alias("table_name"), F.col(ident).cast("bigint").alias("row_id"), F.col(key).cast("bigint").alias("key"), F.col(at).cast("timestamp_ntz").alias("at"))
        rows = one if rows is None else rows.unionAll(one)
    rows = rows.where(F.col("key").isNotNull() & (F.lit(True) if no_key is None else F.col("key") != no_key)).withColumn("period", month_of(F.col("at")))
    ensure_checkpoint_dir(parents.sparkSession)
    spans = existence(*changes).withColumn("key", F.col("key").cast("bigint")).checkpoint()
    have = parents.select(F.col(parent_key).cast("bigint").alias("key")).where(F.col("key").isNotNull()).distinct()
    changed = spans.select("key").distinct()
    n, least, most = have.agg(F.count(F.lit(1)), F.min("key"), F.max("key")).first()
    of = Places.of(n, least, most) if n else Places(16)
    a, b = month_of(F.col("lo")), month_of(F.col("hi"))
    months = F.when(F.col("lo").isNull(), F.array(F.struct(F.lit(UNTIL).alias("what"), (b - 1).alias("period"))))
    months = months.when(F.col("hi").isNull(), F.array(F.struct(F.lit(FROM).alias("what"), (a + 1).alias("period"))))
    months = months.when(b - a > 1, F.transform(F.sequence(a + 1, F.greatest(a + 1, b - 1)), lambda m: F.struct(F.lit(WITHIN).alias("what"), m.alias("period"))))
    alive = spans.where("exists").select("key", F.explode(months).alias("x")).select("x.what", "x.period", "key")
    zero = F.lit(0).alias("period")
    bits = have.select(F.lit(ROW).alias("what"), zero, "key")
    bits = bits.unionAll(changed.select(F.lit(CHANGED).alias("what"), zero, "key"))
    bits = bits.unionAll(have.join(changed, "key", "left_anti").select(F.lit(BASE).alias("what"), zero, "key"))
    bits = bits.unionAll(alive).unionAll(rows.select((F.col("n") + REFERENCE).alias("what"), "period", "key"))
    order = ("key_range", "what", "period")
    packed = bits.mapInArrow(_containers(of), _CONTAINER).repartition(*order).sortWithinPartitions(*order).mapInArrow(_merged(of), _CONTAINER)
    left = packed.repartition("key_range").sortWithinPartitions(*order).mapInArrow(_and_not(of), _SURVIVOR).withColumn("n", F.col("what") - REFERENCE)
    gone = spans.where(~F.col("exists")).select(F.col("key").alias("k"), "lo", "hi", a.alias("m1"), F.coalesce(F.nullif(b, F.lit(UNTIMED)), F.lit(1_000_000)).alias("m2"))
    timed = F.col("changed") & (F.col("period") != UNTIMED)
    cases = left.join(gone, (F.col("key") == F.col("k")) & timed & (F.col("period") >= F.col("m1")) & (F.col("period") <= F.col("m2")), "left").where(~timed | F.col("k").isNotNull())
    cases = cases.select("n", "period", "key", "lo", "hi").checkpoint()
    inside = (F.col("c.lo").isNull() | (F.col("r.at") >= F.col("c.lo"))) & (F.col("c.hi").isNull() | (F.col("r.at") < F.col("c.hi")))
    same = [F.col(f"r.{c}") == F.col(f"c.{c}") for c in ("n", "period", "key")]
    few = cases.limit(MOST_CASES + 1).count() <= MOST_CASES
    found = rows.alias("r").join(F.broadcast(cases.alias("c")) if few else cases.alias("c").hint("merge"), [*same, inside], "inner").select("r.table_name", "r.row_id", "r.key", "r.at", "r.period")
    with_id = found.where(F.col("row_id").isNotNull()).groupBy("table_name", "row_id").agg(*[F.max(c).alias(c) for c in ("key", "at", "period")])
    return with_id.unionByName(found.where(F.col("row_id").isNull()))


def _orphans_of_other_keys(refs, parents, parent_key, changes, no_key) -> DataFrame:
    """``orphans`` for keys that are no integers: they are encoded by one dictionary, and decoded in the result."""
    changed, change_key = changes[:2]
    keys = [df.select(F.col(k).alias("key")) for df, k in [(df, key) for _, df, _, key, _ in refs] + [(parents, parent_key), (changed, change_key)]]
    both = keys[0]
    for k in keys[1:]:
        both = both.unionAll(k)
    codes = dictionary(both if no_key is None else both.where(F.col("key") != no_key), "key")

    def coded(df, key, *keep):
        rows = df.select(F.col(key).alias("key"), *keep)
        return rows.join(codes, "key").select(F.col("code").alias("coded"), *keep)

    out = orphans(
        [(name, coded(df, key, ident, at), ident, "coded", at) for name, df, ident, key, at in refs],
        coded(parents, parent_key), "coded", (coded(changed, change_key, *changes[2:]), "coded", *changes[2:]),
    )
    return out.withColumnRenamed("key", "code").join(codes, "code").select("table_name", "row_id", "key", "at", "period")


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan rows and keys per table and period: ``table_name``, ``month`` (yyyy-MM, null without time), ``orphan_rows``,
    ``orphan_keys``. An empty input gives no row."""
    month = F.when(F.col("period") >= 0, F.format_string("%04d-%02d", F.floor(F.col("period") / 12).cast("int"), F.col("period") % 12 + 1))
    per_key = found.groupBy("table_name", "period", "key").agg(F.count(F.lit(1)).alias("rows"))  # counts keys without gathering them
    return per_key.groupBy("table_name", "period").agg(F.sum("rows").alias("orphan_rows"), F.count(F.lit(1)).alias("orphan_keys")).select("table_name", month.alias("month"), "orphan_rows", "orphan_keys")
