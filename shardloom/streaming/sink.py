"""A streaming sink that places each micro-batch in the shards of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..engine import Engine


def sharded_sink(engine: Engine, table: str, name: str) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: rows go to their shards, and a batch that is delivered again after a restart is
    written once. A marker per batch lies below the default root; ``name`` tells streams apart. A batch that failed
    between its write and its marker is written again, so consumers that cannot bear that keep an id and drop repeats."""
    marks = f"{engine.catalog.default_root}/_batches/{name}"

    def write(batch: DataFrame, batch_id: int) -> None:
        mark = f"{marks}/{batch_id}"
        if engine._exists(mark):
            return
        engine.write(batch.withColumns({}), table)
        engine._fs(mark).create(engine._path(mark), True).close()

    return write


def sessions_of_stream(events: DataFrame, entity: str, at: str, gap: str, lateness: str) -> DataFrame:
    """Sessions of a stream by Spark's session windows: ``entity``, ``start_at``, ``end_at``, ``events``. A session comes
    out once the watermark (``lateness`` behind the latest event) has passed its end; later rows are dropped. A gap of
    exactly ``gap`` starts a new session here, as session windows are open at their end; rows without time are left out."""
    seen = events.where(F.col(at).isNotNull() & F.col(entity).isNotNull()).withWatermark(at, lateness)
    out = seen.groupBy(F.session_window(at, gap).alias("w"), F.col(entity).alias("entity")).agg(F.max(at).alias("end_at"), F.count(F.lit(1)).alias("events"))
    return out.select("entity", F.col("w.start").alias("start_at"), "end_at", "events")
