"""Watching a project: changed paths in, incremental builds out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trellis.operators.build import language_of
from trellis.sources.project import excluded


def watch(changes: DataFrame, build: Callable[[list[str]], None], checkpoint: str, excludes: list[str] | None = None, every: str = "500 milliseconds", once: bool = False) -> StreamingQuery:
    """Calls ``build`` with the distinct readable paths of each micro-batch of ``changes (path)``.

    The paths of one batch are what a person changed within the trigger interval; they are handed over in parts of 10,000.
    """

    def run(batch: DataFrame, _: int) -> None:
        paths = batch.select("path").filter(F.col("path").isNotNull() & language_of("path").isNotNull() & ~excluded("path", excludes)).distinct()
        part: list[str] = []
        for row in paths.toLocalIterator():
            part.append(row.path)
            if len(part) == 10_000:
                build(sorted(part))
                part = []
        if part:
            build(sorted(part))

    writer = changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
