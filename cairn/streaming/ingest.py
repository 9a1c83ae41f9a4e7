"""Listings that arrive as files, folded into a table; running totals; progress."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.reconcile import union_listings
from ..operators.rollup import class_totals
from ..schema import LISTING, OBJECTS
from ..sources.listings import normalised
from ..sources.table import InventoryTable


def listing_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Objects of JSON-lines files as they appear; a trigger takes a bounded number of files."""
    raw = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", files_per_trigger).option("mode", "FAILFAST").json(folder)
    return normalised(raw)


def merge_into(table: InventoryTable, start_from: str | None = None) -> Callable[[DataFrame, int], None]:
    """A writer for foreachBatch. Without start_from a batch is united with the table (a scan's pages); else it replaces its range of keys.

    Files whose keys a batch does not touch stay as they are, and the roll-up follows by signed sums. A batch that is
    written twice, after a restart, changes nothing the second time.
    """

    def write(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        rows = union_listings(batch)
        if table.current() is None:
            table.save(rows)
        elif start_from is None:
            table.unite(rows)
        else:
            table.replace(rows, start_from)

    return write


def ingest(spark: SparkSession, folder: str, table: InventoryTable, checkpoint: str, start_from: str | None = None, files_per_trigger: int = 64) -> StreamingQuery:
    """Fold all files that are there into the table and stop."""
    stream = listing_stream(spark, folder, files_per_trigger)
    return stream.writeStream.foreachBatch(merge_into(table, start_from)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_class_totals(stream: DataFrame, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Objects and bytes by class of a stream of objects, kept in a table of that name in memory: a row a class."""
    writer = class_totals(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def objects_stream(spark: SparkSession, folder: str, files: str = "*") -> DataFrame:
    """Objects of Parquet files as they appear."""
    return spark.readStream.schema(OBJECTS).option("pathGlobFilter", files).parquet(folder)


class ProgressLog(StreamingQueryListener):
    """Keeps what each trigger reports: rows, rows a second, duration."""

    def __init__(self):
        self.rows: list[dict] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append({"batch": p.batchId, "rows": p.numInputRows, "rate": p.processedRowsPerSecond, "ms": p.batchDuration})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
