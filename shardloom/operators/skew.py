"""Exact per-key results when a few keys hold most rows: distributed selection by refined histograms.

A rank is looked for in a range of values. One pass over the rows counts them in at most 256 bins of the range, in each
task first, so that a hot key sends one row per bin and task however many rows it has; the bin that holds the rank, cut
to the least and the most value seen in it, is the next range. The rank is resolved when its range is a single value.
Rows, or values, of a hot key are never gathered, and no table of (key, value) counts is made.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ensure_checkpoint_dir, once_per_id

#: Bits of a range that a pass tells apart.
STEP = 8
#: A key with fewer rows sends them as they are: they are no more than the bins of a few passes would be.
COLD_ROWS = 1_024
#: Most keys that are refined at once; a key is hot only with more than this part of all rows, so there are fewer.
MOST_HOT = 100_000


def _digits(x: Column) -> Column:
    """Binary digits of a 64-bit number, 0 for 0 and 64 for negative ones."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def _rank(q: Column, n: Column) -> Column:
    # q*n may miss the exact product by a rounding of doubles; 1e-9 keeps ranks such as 0.9 * 10 at 9
    return F.greatest(F.lit(1), F.ceil(q * n - 1e-9))


def resolve_ranks(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The values at some ranks: ``state`` with ``lo`` = ``hi`` = the value.

    ``rows`` has ``key`` and the 64-bit ``v``; ``state`` has ``key``, ``q``, ``rank`` (from 1, among the rows of the key
    from ``lo`` to ``hi``), ``lo`` and ``hi``. The state is broadcast: its callers bound its rows. It is written to the
    checkpoint folder after each pass. Every pass leaves at most 2^(bits - STEP) values of a range, so there are at most 8.
    """
    state = state.select("key", "q", F.col("rank").cast("bigint").alias("rank"), "lo", "hi").checkpoint()
    while not (still := state.where("lo < hi")).isEmpty():
        ranges = still.select(F.col("key").alias("k"), "lo", "hi").distinct()
        shift = F.greatest(F.lit(0), _digits(F.col("lo").bitwiseXOR(F.col("hi"))) - STEP)
        inside = rows.join(F.broadcast(ranges.withColumn("shift", shift)), F.col("key").eqNullSafe(F.col("k")) & (F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        bins = inside.groupBy("k", F.col("lo").alias("from"), F.expr("shiftright(v, shift)").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        bins = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("k", "from").orderBy("bin")))  # at most 256 rows
        both = still.join(bins, F.col("key").eqNullSafe(F.col("k")) & (F.col("lo") == F.col("from"))).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        state = state.where("lo = hi").unionAll(both.select("key", "q", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), F.col("least").alias("lo"), F.col("most").alias("hi"))).checkpoint()
    return state


def heavy_keys(df: DataFrame, key: str, share: float = 0.05, ident: str | None = None) -> DataFrame:
    """The keys with more than ``share`` of all rows: ``key``, ``rows``, ``share``.

    In the order of any 64-bit code of the keys, a key with more than ``share`` of the rows covers one of the ranks at
    multiples of ``share``. These ranks are resolved by histograms of the codes; the rows of the few codes found are then
    counted by key. What is shuffled depends on ``share`` alone, not on the number of keys.

    Cases: null is a key of its own; rows with the same ``ident`` count once (rows without one all count); an empty table
    gives no row; keys with exactly ``share`` of the rows are not heavy.
    """
    if not 0 < share < 1:
        raise ValueError("share lies between 0 and 1")
    rows = df.select(*([F.col(ident).alias("ident")] if ident else []), F.col(key).alias("key"))
    if ident:
        rows = once_per_id(rows, "ident").drop("ident")
    ensure_checkpoint_dir(df.sparkSession)
    rows = rows.checkpoint()
    coded = rows.select(F.lit(0).alias("key"), F.xxhash64("key").alias("v"))
    n, least, most = coded.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if not n:
        return rows.select("key", F.lit(0).cast("bigint").alias("rows"), F.lit(0.0).alias("share"))
    width = max(1, math.floor(share * n))  # so many neighbouring rows hold one of the ranks; a heavy key has more
    ranks = df.sparkSession.createDataFrame([(0, i, r, least, most) for i, r in enumerate(range(width, n + 1, width))], "key int, q int, rank bigint, lo bigint, hi bigint") if n // width <= MOST_HOT else None
    if ranks is None:
        raise ValueError(f"share asks for more than {MOST_HOT} ranks")
    codes = resolve_ranks(coded, ranks).select(F.col("lo").alias("code")).distinct()
    few = rows.join(F.broadcast(codes), F.xxhash64("key") == F.col("code"), "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    return few.where(F.col("rows") > share * n).select("key", "rows", (F.col("rows") / n).alias("share"))


def keyed_results(df: DataFrame, key: str, value: str, quantiles: Sequence[float] = (0.5, 0.9, 0.99), ident: str | None = None, heavy_share: float = 0.05) -> DataFrame:
    """Per key: ``key``, ``rows``, ``values`` (non-null), ``total``, ``least``, ``most``, one column ``q<percent>`` per
    quantile, ``share`` of all rows and ``heavy`` (share above ``heavy_share``).

    A quantile q of n values is the value at rank ceil(q*n), at least 1, in ascending order: an exact value, never an
    interpolation.

    Cases: null keys form a key of their own; null values count as rows only, and a key without values has null
    results; ties take as many ranks as they have rows; rows with the same ``ident`` count once (rows without one all
    count); an empty table gives no row. Values are integers or decimals of up to 18 digits.

    Plan: totals per key are added up in each task first. Keys with more than COLD_ROWS rows and more than one in
    MOST_HOT of all rows are hot; their ranks are resolved by ``resolve_ranks``. The other keys' few rows are ranked where
    they lie after a shuffle by key.
    """
    kind = df.schema[value].dataType
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        scale = kind.scale
    elif isinstance(kind, T.IntegralType):
        scale = 0
    else:
        raise TypeError("exact selection takes integers and decimals of up to 18 digits")
    code = (F.col(value) * F.lit(10**scale)).cast("bigint") if scale else F.col(value).cast("bigint")
    rows = df.select(*([F.col(ident).alias("ident")] if ident else []), F.col(key).alias("key"), code.alias("v"))
    if ident:
        rows = once_per_id(rows, "ident").drop("ident")
    ensure_checkpoint_dir(df.sparkSession)
    rows = rows.checkpoint()
    per_key = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.count("v").alias("values"), F.sum(F.col("v").cast("decimal(38,0)")).alias("total"), F.min("v").alias("least"), F.max("v").alias("most")).checkpoint()
    n = per_key.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = per_key.where(F.col("values") > max(COLD_ROWS, n // MOST_HOT))
    qs = F.array(*[F.lit(float(q)) for q in quantiles])
    state = hot.select("key", F.posexplode(F.transform(qs, lambda q: _rank(q, F.col("values")))).alias("q", "rank"), F.col("least").alias("lo"), F.col("most").alias("hi"))
    values = rows.where("v is not null")
    resolved = resolve_ranks(values, state)
    names = [f"q{100 * q:g}".replace(".", "_") for q in quantiles]
    picked = resolved.groupBy("key").agg(*[F.max(F.when(F.col("q") == i, F.col("lo"))).alias(c) for i, c in enumerate(names)])
    cold = values.join(F.broadcast(hot.select(F.col("key").alias("k"))), F.col("key").eqNullSafe(F.col("k")), "left_anti")
    cold = cold.withColumns({"at": F.row_number().over(Window.partitionBy("key").orderBy("v")), "of": F.count(F.lit(1)).over(Window.partitionBy("key"))})
    picked = picked.unionAll(cold.groupBy("key").agg(*[F.max(F.when(F.col("at") == _rank(F.lit(float(q)), F.col("of")), F.col("v"))).alias(c) for q, c in zip(quantiles, names)]))
    out = per_key.withColumn("share", F.col("rows") / n).join(picked.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k")), "left")
    back = (lambda c: (F.col(c).cast("decimal(38,0)") / F.lit(10**scale).cast(f"decimal({scale + 1},0)")).cast(f"decimal(38,{scale})")) if scale else (lambda c: F.col(c).cast("decimal(38,0)") if c == "total" else F.col(c))
    return out.select("key", "rows", "values", *[back(c).alias(c) for c in ("total", "least", "most", *names)], "share", (F.col("share") > heavy_share).alias("heavy"))
