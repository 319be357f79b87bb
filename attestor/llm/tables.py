"""Reading inputs and settling intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of narrow tables that are broadcast at most; larger ones are joined by shuffle.
SMALL = 200_000
BATCH = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_small_batches(docs: DataFrame) -> DataFrame:
    """docs, whose rows from now on go to Python in batches of at most BATCH bytes (or single rows), as all tables of this
    session do: the default of 64 MB, in the executor and in each of its workers, is much for long texts."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return docs


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, which only local mode may use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="attestor-shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def settle(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: lineage ends there, so a lost
    executor costs no recomputation, and columns such as a partition's number keep their values. The files
    go when the application ends, or before that by discard().

    narrow is for a few short columns that come out of a shuffle: they are dealt out anew, so that files hold as much
    as the session asks for, few where there is little and many where there is much."""
    spark = df.sparkSession
    if narrow:
        df = df.hint("rebalance")
    path = f"{shared_dir(spark).rstrip('/')}/attestor/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.option("compression", "zstd").parquet(path)  # Snappy's readers hold direct buffers until the heap is collected
    settled = spark.read.schema(df.schema).parquet(path)
    settled._settled_at = path
    return settled


def discard(*tables: DataFrame) -> None:
    """Deletes settled tables that no result will read again."""
    for df in tables:
        path = df.__dict__.get("_settled_at")
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def fitting(df: DataFrame, most: int = SMALL) -> DataFrame:
    """A settled narrow table with the hint that its counted size allows: broadcast, or a join by shuffle."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one, that no column of df has in any case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def content(text: Column) -> Column:
    """What tells the texts of one id apart."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def keep_rows(docs: DataFrame, verdicts: DataFrame, id_col: str, text_col: str, small: int = SMALL) -> DataFrame:
    """The rows of docs that verdicts (doc_id, content, kept) keeps, all columns as they are.

    verdicts has one row for each row of docs. Rows that agree in id and content are one document: of those kept
    one row stays. Only decisions are moved while they are few; the rows of docs are shuffled beyond `small`.
    """
    a, b, c, d, stays = (unused(docs, name) for name in ("key_id", "key_content", "of_id", "of_content", "stays"))
    by_key = settle(verdicts.groupBy("doc_id", "content").agg(F.max("kept").alias(stays), F.count("*").alias("n")).where(f"NOT {stays} OR n > 1").select(F.col("doc_id").alias(c), F.col("content").alias(d), stays), "verdicts", narrow=True)
    keyed = docs.withColumns({a: F.col(id_col).cast("long"), b: content(F.col(text_col))})
    alike = F.col(a).eqNullSafe(F.col(c)) & (F.col(b) == F.col(d))
    left = keyed.join(fitting(by_key.where(f"NOT {stays}"), small), alike, "left_anti")
    again = by_key.where(stays)
    if not again.isEmpty():
        again = fitting(again, small)
        left = left.join(again, alike, "left_anti").unionByName(left.join(again, alike, "left_semi").dropDuplicates([a, b]))
    return left.drop(a, b)


def loaded(parts: list) -> Iterator:
    """The values of broadcast variables, one after another; of several a worker holds only the one in use."""
    for p in parts:
        yield p.value
        if len(parts) > 1:
            p.__dict__.pop("_value", None)  # a broadcast variable keeps what it has read


def by_size(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose binary or string column has at most `most` bytes, or which are single rows."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right"))
            last = max(last, first + 1)
            yield batch.slice(first, last - first)
            first = last
    give_back()


def give_back() -> None:
    """A worker that is used again returns the memory of its task."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
