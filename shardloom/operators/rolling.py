"""Totals over trailing periods per entity and day (two-stack monoid queue).

A trailing window over days is a queue: a day enters at the back, the oldest leaves at the front. The two-stack queue
keeps a running aggregate of the back stack and, for the front stack, the aggregate of every suffix; when the front runs
empty the back is turned over into it. It needs an associative operation with an identity and never an inverse, so
minimum and maximum work like sums. Over a gapless calendar a window of ``s`` days turns over exactly every ``s`` days,
so both stacks of all entities of a chunk are computed at once: the front stack is the suffix aggregate and the back
stack the prefix aggregate of each block of ``s`` days, and a window is ``front[i-s+1] + back[i]``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, gathered, once_per_id, starts_of_runs

#: Calendar days expanded at once by a task.
DENSE_DAYS = 1_000_000
EPOCH = dt.date(1970, 1, 1)


def two_stack(values: np.ndarray, span: int, op: np.ufunc, identity) -> np.ndarray:
    """``op`` over the trailing ``span`` positions of each position; ``op`` is associative, an inverse is not needed."""
    n = len(values)
    padded = np.full(-(-n // span) * span, identity, dtype=values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, span)
    back = op.accumulate(blocks, axis=1).reshape(-1)
    front = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    out = back[:n].copy()
    at = np.arange(span, n)
    at = at[at % span != span - 1]  # there the queue has just been turned over: the block is the window
    out[at] = op(front[at - span + 1], out[at])
    return out


def _segments(day, new_entity, widest, until, active):
    """First row, first day and number of calendar days of each stretch that is expanded without a gap."""
    new = new_entity.copy()
    if active:  # after `widest` days without a row the queue is empty
        new[1:] |= (day[1:] - day[:-1]) >= widest
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(day)) - 1
    # The last widest-1 days of a stretch hold no row, so windows never reach into the stretch before.
    length = (day[last] if active else np.maximum(until, day[last])) - day[first] + widest
    return first, day[first], length


def _expand(t: pa.Table, new_entity, spans, until, active, exact, schema):
    day = column(t, "day").cast(pa.int32()).to_numpy().astype(np.int64)
    first, from_day, length = _segments(day, new_entity, max(spans), until, active)
    bounds = np.append(first, len(day))
    done = 0
    while done < len(first):
        ahead = np.cumsum(length[done:])
        k = max(1, int(np.searchsorted(ahead, DENSE_DAYS, side="right")))
        lo, hi, seg = bounds[done], bounds[done + k], slice(done, done + k)
        start, total = np.concatenate([[0], ahead[: k - 1]]), int(ahead[k - 1])
        of = np.repeat(np.arange(k), np.diff(bounds[done : done + k + 1]))
        at = start[of] + day[lo:hi] - from_day[seg][of]
        dense = np.repeat(np.arange(k), length[seg])
        on = np.arange(total) - start[dense] + from_day[seg][dense]
        num = np.int64 if exact else np.float64
        least, most = (np.iinfo(np.int64).min, np.iinfo(np.int64).max) if exact else (-np.inf, np.inf)

        def spread(name, fill, dtype):
            x = np.full(total, fill, dtype=dtype)
            c = column(t, name).slice(lo, hi - lo)
            x[at] = c.fill_null(fill).to_numpy(zero_copy_only=False)
            return x

        rows, values, sums = spread("rows", 0, np.int64), spread("vals", 0, np.int64), spread("total", 0, num)
        lows, highs = spread("least", most, num), spread("most", least, num)
        keep = on <= until
        cols = {"entity": column(t, "entity").take(pa.array(first[seg][dense[keep]])), "day": pa.array(on[keep].astype(np.int32)).cast(pa.date32()), "rows_on_day": pa.array(rows[keep])}
        if exact and max(abs(int(sums.max())), abs(int(sums.min()))) * max(spans) >= 1 << 63:  # may not fit 64 bits
            for s in spans:
                if float(np.abs(two_stack(sums.astype(np.float64), s, np.add, 0.0)).max()) >= 2.0**63 * (1 - 1e-12):
                    raise OverflowError(f"a total over {s} days does not fit 64 bits")
        for s in spans:
            n = two_stack(values, s, np.add, 0)[keep]
            none = n == 0
            cols[f"rows_{s}"] = pa.array(two_stack(rows, s, np.add, 0)[keep])
            cols[f"values_{s}"] = pa.array(n)
            cols[f"total_{s}"] = pa.array(two_stack(sums, s, np.add, 0)[keep])
            cols[f"least_{s}"] = pa.array(two_stack(lows, s, np.minimum, most)[keep], mask=none)
            cols[f"most_{s}"] = pa.array(two_stack(highs, s, np.maximum, least)[keep], mask=none)
        yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema], schema=schema)
        done += k


def rolling_totals(df: DataFrame, entity: str, at: str, value: str, spans: Sequence[int] = (7, 30), ident: str | None = None, until: dt.date | None = None, emit: str = "calendar") -> DataFrame:
    """Per entity and calendar day: rows, total, average, least and most of ``value`` over each trailing span of days.

    The day itself belongs to its spans. ``emit="calendar"`` gives every day from the entity's first row to ``until``,
    with zero totals where nothing happened; ``emit="active"`` leaves out days whose widest span is empty. Columns:
    ``entity``, ``day``, ``rows_on_day`` and for each span ``s`` ``rows_s``, ``values_s`` (non-null values), ``total_s``
    (0 if none), ``average_s`` (per value), ``least_s``, ``most_s`` (null if none).

    Cases: rows without entity or time are left out; a null value counts as a row and adds nothing to a total; rows with
    the same ``ident`` count once (rows without one all count); days after ``until`` are neither read nor emitted; an
    empty table gives no row. Decimal and integer values are added exactly as 64-bit integers of the last decimal place
    (a day's or a span's total beyond that is an overflow error), others as doubles.

    Plan: one shuffle by ``ident`` to drop repeated rows, partial sums per entity and day before the next shuffle (a hot
    entity shrinks to at most one row a day and task), then sorted partitions by entity streamed through the queue.
    """
    if emit not in ("calendar", "active"):
        raise ValueError("emit is 'calendar' or 'active'")
    spans = sorted({int(s) for s in spans})
    if not spans or spans[0] < 1:
        raise ValueError("spans are numbers of days of at least 1")
    if until is None:
        if emit == "calendar":
            raise ValueError("a calendar needs its last day: until")
        until = dt.date(9999, 12, 31)
    kind, entity_type = df.schema[value].dataType, df.schema[entity].dataType
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    exact = isinstance(kind, (T.DecimalType, T.IntegralType))
    units = (F.col(value) * F.lit(10**scale)).cast("bigint") if scale else F.col(value).cast("bigint" if exact else "double")
    rows = df.select(*([F.col(ident).alias("ident")] if ident else []), F.col(entity).alias("entity"), F.to_date(at).alias("day"), units.alias("value"))
    rows = rows.where(F.col("entity").isNotNull() & F.col("day").isNotNull() & (F.col("day") <= F.lit(until)))
    if ident:
        rows = once_per_id(rows, "ident").drop("ident")
    daily = rows.groupBy("entity", "day").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("vals"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))
    # A few bytes become many days: keep the number of partitions, which would be joined by their small size otherwise.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    daily = daily.repartition(tasks, "entity").sortWithinPartitions("entity", "day")
    num = T.LongType() if exact else T.DoubleType()
    out = T.StructType([T.StructField("entity", entity_type), T.StructField("day", T.DateType()), T.StructField("rows_on_day", T.LongType())])
    for s in spans:
        for name, t in (("rows", T.LongType()), ("values", T.LongType()), ("total", num), ("least", num), ("most", num)):
            out.add(f"{name}_{s}", t)
    last, active = (until - EPOCH).days, emit == "active"

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, held = to_arrow_schema(out), None
        for t in gathered(batches):
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            new = starts_of_runs(column(t, "entity"))
            cut = int(np.flatnonzero(new)[-1])  # the last entity may go on in the next batch; it has one row a day
            held = t.slice(cut)
            if cut:
                yield from _expand(t.slice(0, cut), new[:cut], spans, last, active, exact, schema)
        if held is not None:
            yield from _expand(held.combine_chunks(), starts_of_runs(column(held, "entity")), spans, last, active, exact, schema)

    wide = daily.mapInArrow(run, out)
    if scale:
        back = lambda c: (F.col(c).cast("decimal(38,0)") / F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast(f"decimal(38,{scale})")
    else:
        back = F.col
    cols = [F.col("entity"), F.col("day"), F.col("rows_on_day")]
    for s in spans:
        cols += [F.col(f"rows_{s}"), F.col(f"values_{s}"), back(f"total_{s}").alias(f"total_{s}")]
        average = back(f"total_{s}").cast("double") / F.when(F.col(f"values_{s}") > 0, F.col(f"values_{s}"))
        cols += [average.alias(f"average_{s}"), back(f"least_{s}").alias(f"least_{s}"), back(f"most_{s}").alias(f"most_{s}")]
    return wide.select(cols)
