"""Helpers shared by the operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows gathered from Arrow batches before a vectorised step runs on them.
CHUNK_ROWS = 131_072
_TEMPORARY: list[str] = []


def normalised(c: Column | str) -> Column:
    """Lower case without surrounding spaces and tabs; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.btrim(c, F.lit(" \t")))


def once_per_id(df: DataFrame, ident: str) -> DataFrame:
    """One row per ``ident``: deliveries of a record that repeat its id count once.

    Each other column takes the largest non-null value delivered, so the result does not depend on the order of
    arrival. Rows without an id are no known repetition of each other and are all kept. Only fixed-width columns keep
    the aggregation hash based, so callers select the columns they need first.
    """
    rest = [c for c in df.columns if c != ident]
    keys = [ident]
    if df.schema[ident].nullable:  # a number of its own for each row without id: no second pass over the rows
        df = df.withColumn("_row", F.when(F.col(ident).isNull(), F.monotonically_increasing_id()))
        keys.append("_row")
    once = df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in rest]) if rest else df.select(*keys).distinct()
    return once.select(ident, *rest)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, named by ``spark.checkpoint.dir``. A temporary one of this machine serves only
    where all tasks run in this process; elsewhere executors could not see it, so it is an error to name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[.*\])?\Z", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
    if not _TEMPORARY:
        _TEMPORARY.append(tempfile.mkdtemp(prefix="shardloom-"))
        atexit.register(shutil.rmtree, _TEMPORARY[0], ignore_errors=True)
    return _TEMPORARY[0]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder the cluster names; set one of our own only where none is named (tests, local runs)."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def _shuffles(plan) -> bool:
    """Whether a physical plan has an exchange among its nodes."""
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return _shuffles(plan.inputPlan())
    if "Exchange" in plan.getClass().getSimpleName():
        return True
    children = plan.children().iterator()
    while children.hasNext():
        if _shuffles(children.next()):
            return True
    return False


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df``, shuffled by ``key`` if it is read in fewer partitions than the cluster has cores.

    For costly work on rows of small inputs (a file with one row group is one task otherwise). Large inputs have more
    partitions than cores and pass unchanged, as do plans that have a shuffle of their own.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    execution = df._jdf.queryExecution()
    if _shuffles(execution.executedPlan()) or execution.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """``df`` with the place of each row in an order, from 0: rows are sorted in ranges, and a range begins at the number
    of rows in the ranges before it, so no task sees more than its range. Rows that tie are numbered in any order."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_at", 33)
    counts = [tuple(r) for r in rows.groupBy(part.alias("p")).count().orderBy("p").collect()]  # a row per partition
    starts, n = [], 0
    for p, c in counts:
        starts.append((p, n))
        n += c
    begin = F.broadcast(df.sparkSession.createDataFrame(starts, "_p bigint, _begin bigint"))
    out = rows.join(begin, part == F.col("_p")).withColumn(name, F.col("_begin") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.select(*[c for c in df.columns if c != name], name)


def gathered(batches: Iterable[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """Arrow batches joined to tables of about ``rows`` rows, in order."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    """A column as one Arrow array."""
    c = table.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def starts_of_runs(*cols: pa.Array):
    """Boolean numpy array: the row differs from the row before it in one of the columns (none holds nulls)."""
    import numpy as np
    import pyarrow.compute as pc

    n = len(cols[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
        for c in cols:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return new
