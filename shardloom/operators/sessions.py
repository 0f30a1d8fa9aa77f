"""Sessions separated by gaps, built per time chunk and merged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, gathered, starts_of_runs


def _distinct_per_group(group: np.ndarray, kinds: pa.Array):
    """Sorted distinct non-null kinds per group as offsets and values; groups are numbered from 0 without holes."""
    coded = kinds.dictionary_encode()
    names, codes = coded.dictionary, coded.indices
    ok = codes.is_valid().to_numpy(zero_copy_only=False)
    pair = np.unique(group[ok].astype(np.int64) * max(1, len(names)) + codes.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[ok])
    g, k = np.divmod(pair, max(1, len(names)))
    n = int(group[-1]) + 1 if len(group) else 0
    return np.searchsorted(g, np.arange(n + 1)).astype(np.int32), names.take(pa.array(k))


def sessions(df: DataFrame, entity: str, at: str, gap_seconds: int, ident: str | None = None, kind: str | None = None, chunk_seconds: int = 3_600) -> DataFrame:
    """One row per session of an entity: ``entity``, ``start_at``, ``end_at``, ``duration_s``, ``events`` and, if
    ``kind`` is given, ``kinds`` (number of different non-null kinds).

    A row belongs to the session of the entity's row before it if at most ``gap_seconds`` lie between them.

    Cases: rows without entity or time are left out; rows that repeat entity, time and ``ident`` are deliveries of one
    record and count once, with the largest non-null kind delivered (rows with a null ident all count); rows of one time
    form one session; an empty table gives no row. Deliveries of one id that disagree in entity or time are different rows here: run ``once_per_id`` first if
    that can happen.

    Plan: rows are shuffled by entity and time chunk, so an entity that holds a third of all rows spreads over as many
    tasks as it has chunks; each chunk becomes partial sessions, of which an entity has at most one per gap of its
    lifetime, and only those are shuffled by entity, sorted and merged where the gap over the chunk boundary is small
    enough.
    """
    base = [F.col(entity).alias("entity"), F.col(at).cast("timestamp_ntz").alias("at")]
    base += [F.col(ident).cast("string").alias("ident") if not isinstance(df.schema[ident].dataType, T.IntegralType) else F.col(ident).cast("bigint").alias("ident")] if ident else []
    base += [F.col(kind).alias("kind")] if kind else []
    rows = df.select(base).where(F.col("entity").isNotNull() & F.col("at").isNotNull())
    micros = F.unix_micros(F.col("at").cast("timestamp"))  # both casts use the session's zone, so the chunk only needs to be a function of the time
    chunk = F.floor(micros / F.lit(chunk_seconds * 1_000_000)).cast("bigint")
    rows = rows.withColumn("chunk", chunk)
    # of the deliveries of a record the first is kept: the one with the largest kind, whatever the order of arrival
    order = [F.col(c) for c in ("entity", "chunk", "at", *(["ident"] if ident else []))] + ([F.col("kind").desc_nulls_last()] if ident and kind else [])
    rows = rows.repartition("entity", "chunk").sortWithinPartitions(*order)
    entity_type, gap = df.schema[entity].dataType, gap_seconds * 1_000_000
    part = T.StructType([T.StructField("entity", entity_type), T.StructField("start_at", T.TimestampNTZType()), T.StructField("end_at", T.TimestampNTZType()), T.StructField("events", T.LongType())])
    if kind:
        part = part.add("kinds", T.ArrayType(T.StringType(), False))

    def times(t, name):
        return column(t, name).cast(pa.int64()).to_numpy()

    def local(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, before = to_arrow_schema(part), None
        for t in gathered(batches):
            # Partial sessions may also end with a batch; the merge joins them.
            when = times(t, "at")
            new = starts_of_runs(column(t, "entity"), column(t, "chunk"))
            if ident:
                import pyarrow.compute as pc

                ids = column(t, "ident")
                same = np.zeros(len(when), dtype=bool)
                same[1:] = ~new[1:] & (when[1:] == when[:-1]) & pc.equal(ids.slice(1), ids.slice(0, len(ids) - 1)).fill_null(False).to_numpy(zero_copy_only=False)
                first = (column(t, "entity")[0].as_py(), when[0], ids[0].as_py())
                same[0] = before is not None and first[2] is not None and before == first
                before = (column(t, "entity")[-1].as_py(), when[-1], ids[-1].as_py())
                if same.any():
                    t = t.filter(pa.array(~same))
                    if not t.num_rows:
                        continue
                    when, new = times(t, "at"), starts_of_runs(column(t, "entity"), column(t, "chunk"))
            new[1:] |= when[1:] - when[:-1] > gap
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(when)) - 1
            cols = [column(t, "entity").take(pa.array(first)), pa.array(when[first]).cast(pa.timestamp("us")), pa.array(when[last]).cast(pa.timestamp("us")), pa.array((last - first + 1).astype(np.int64))]
            if kind:
                offsets, values = _distinct_per_group(np.cumsum(new) - 1, column(t, "kind"))
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), values, type=schema.field("kinds").type))
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    done = T.StructType([*part.fields[:4], *([T.StructField("kinds", T.LongType())] if kind else [])])

    def merge(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, held = to_arrow_schema(done), None

        def merged(t):
            """The merged sessions of sorted partial ones, in the partial form."""
            start, end = times(t, "start_at"), times(t, "end_at")
            new = starts_of_runs(column(t, "entity"))
            new[1:] |= start[1:] - end[:-1] > gap
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(start)) - 1
            cols = {"entity": column(t, "entity").take(pa.array(first)), "start_at": pa.array(start[first]).cast(pa.timestamp("us")), "end_at": pa.array(end[last]).cast(pa.timestamp("us")), "events": pa.array(np.add.reduceat(column(t, "events").to_numpy(), first))}
            if kind:
                lists = column(t, "kinds")
                group = np.repeat(np.cumsum(new) - 1, lists.value_lengths().to_numpy(zero_copy_only=False))
                offsets, values = _distinct_per_group(np.append(group, len(first) - 1), pa.concat_arrays([lists.flatten(), pa.array([None], lists.type.value_type)]))
                cols["kinds"] = pa.ListArray.from_arrays(pa.array(offsets), values, type=lists.type)
            return pa.table(cols)

        def final(t):
            cols = [column(t, c) for c in ("entity", "start_at", "end_at", "events")]
            if kind:
                cols.append(column(t, "kinds").value_lengths().cast(pa.int64()))
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

        for t in gathered(batches):
            t = merged(pa.concat_tables([held, t]).combine_chunks() if held is not None else t)
            held = t.slice(t.num_rows - 1)
            if t.num_rows > 1:
                yield final(t.slice(0, t.num_rows - 1))
        if held is not None:
            yield final(held)

    partial = rows.mapInArrow(local, part)
    out = partial.repartition("entity").sortWithinPartitions("entity", "start_at").mapInArrow(merge, done)
    duration = (F.unix_micros(F.col("end_at").cast("timestamp")) - F.unix_micros(F.col("start_at").cast("timestamp"))) / 1e6
    return out.select("entity", "start_at", "end_at", duration.cast("bigint").alias("duration_s"), "events", *(["kinds"] if kind else []))
