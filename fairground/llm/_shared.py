"""What the operators share: tables, lineage cuts, and Arrow helpers."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared checkpoint folder, with no lineage behind them.

    The folder is the cluster's ``spark.checkpoint.dir``.  Only where that is unset and all of Spark is in this one
    process (tests) a new temporary folder is taken; on a cluster that is an error, for executors share no such folder.
    Long sessions should set ``spark.cleaner.referenceTracking.cleanCheckpoints``, so that what is no longer used goes.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def frugal(scan):
    """``scan``, from batches to batches, that gives freed memory back to the system when its partition ends.

    Python workers are used again by later stages, and what the allocators keep would otherwise add up in them.
    """

    @functools.wraps(scan)
    def run(batches):
        try:
            yield from scan(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def some_labels(labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, label) of at most ``most`` rows with a known id and a label of 0 or 1, taken by hash of the id."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    order = F.xxhash64("doc_id")
    rows = known.count()
    if rows > most:  # a first cut without a sort; the limit then holds exactly
        known = known.where(F.pmod(order, F.lit(1 << 40)) / float(1 << 40) < 1.2 * most / rows).orderBy(F.pmod(order, F.lit(1 << 40)), "doc_id", "label").limit(most)
    return known


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: int, text: str = "text") -> DataFrame:
    """(text, label) of the rows of ``docs`` under those labels, which are broadcast: ``most`` rows of 12 bytes bound them."""
    return docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(some_labels(labels, label, most)), "doc_id").select("text", "label")


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


def column(rows: pa.RecordBatch, name: str) -> pa.Array:
    c = rows.column(rows.schema.get_field_index(name))
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c


def wider(df: DataFrame, **added: str) -> T.StructType:
    """The schema of ``df`` with more columns, given as DDL types."""
    return T.StructType([*df.schema.fields, *(f for n, k in added.items() for f in T._parse_datatype_string(f"{n} {k}").fields)])
