"""Captured pages as a stream that goes on behind the last one it has read."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema

SLICE = 2000


class Span(InputPartition):
    """Pages of numbers in (after, until], in a batch that began behind ``begun``."""

    def __init__(self, after: int, until: int, begun: int):
        self.after, self.until, self.begun = after, until, begun


class CapturedPages(DataSource):
    """``spark.readStream.format("captured_pages").option("path", folder)``: Parquet files of pages with a column ``seq`` above 0 that only grows.

    The offset is the last number read, kept in the query's checkpoint: a restarted query goes on behind it and never walks from
    the root again.  ``traversal_from_root`` is true in the first batch alone.  The numbers available are read from the files'
    footers; a batch is read in slices of ``slice`` numbers, each a task.  A page that comes with a number already passed is not read.
    """

    @classmethod
    def name(cls):
        return "captured_pages"

    def schema(self):
        return from_arrow_schema(ds.dataset(self.options["path"], format="parquet").schema.append(pa.field("traversal_from_root", pa.bool_())))

    def streamReader(self, schema):
        return CapturedReader(self.options["path"], int(self.options.get("slice", SLICE)), schema.names)


class CapturedReader(DataSourceStreamReader):
    def __init__(self, path: str, size: int, columns: list[str]):
        self.path, self.size, self.columns = path, size, columns
        self.known: dict[str, int] = {}

    def initialOffset(self):
        return {"seq": 0}

    def latestOffset(self):
        for file in ds.dataset(self.path, format="parquet").get_fragments():
            if file.path not in self.known:
                tops = [g.statistics["seq"]["max"] for g in file.row_groups if g.statistics.get("seq")]
                self.known[file.path] = max(tops, default=0)
        return {"seq": max(self.known.values(), default=0)}

    def partitions(self, start, end):
        lo, hi = start["seq"], end["seq"]
        return [Span(a, min(a + self.size, hi), lo) for a in range(lo, hi, self.size)]

    def read(self, partition):
        pages = ds.dataset(self.path, format="parquet")
        own = [c for c in self.columns if c != "traversal_from_root"]
        wanted = (ds.field("seq") > partition.after) & (ds.field("seq") <= partition.until)
        for batch in pages.to_batches(columns=own, filter=wanted):
            if batch.num_rows:
                root = pa.array([partition.begun == 0] * batch.num_rows, pa.bool_())
                yield pa.RecordBatch.from_arrays([*batch.columns, root], names=[*own, "traversal_from_root"])
