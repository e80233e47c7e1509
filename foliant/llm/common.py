"""Shared helpers: table access, the shared scratch folder, Arrow row batches."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where ``spark.checkpoint.dir`` is unset, as in tests.
OWN_CHECKPOINT_DIR = "file:///tmp/foliant-checkpoints"
#: Bytes of a row group of the tables that operators and stages write.
ROW_GROUP = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a path without a scheme is taken as Spark takes it."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|\Z)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = OWN_CHECKPOINT_DIR
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Parquet tables in the shared folder, removed when the block ends. Lost executors don't lose them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/foliant-{uuid.uuid4().hex}"
        self.n = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, self.root)

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/t{self.n}"

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.path()
        write(df, path)
        return self.spark.read.schema(df.schema).parquet(path)


def write(df: DataFrame, path: str) -> None:
    """Parquet in small row groups: a writer holds its group in memory, and texts may be long."""
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


HELD: dict = {}


def held(key: object, build: Callable[[], object] | None = None) -> object:
    """One large object a worker process, the one that was asked for last: workers go on from one operator to the next, and must not keep what the one before built.
    Without a builder nothing is kept."""
    if build is None:
        HELD.clear()
        return None
    if key not in HELD:
        HELD.clear()
        HELD[key] = build()
    return HELD[key]


def map_rows(df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """fn is called once for a task and gives the function that turns one Arrow batch into another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = fn()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """Whole texts; null is empty."""
    for x in batch.column(name):
        yield x.as_py() or ""


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """Whole texts as UTF-8; null is empty."""
    return raw(batch.column(name))


def raw(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def portions(batch: pa.RecordBatch, size: int, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch's rows in turn, so many at once that their texts have at most ``size`` bytes, and one at least."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, end - at)
        at = end


def doc_rows(docs: DataFrame) -> DataFrame:
    """Only the two columns that are read; others, whatever their names, stay out of the way."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 3. Null ids have no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(fold_of(doc_id) == 1, F.lit(False))


def py_fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 3


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents that aren't held out. The bound is on the
    labels: the ``rows`` ids that come first by hash, so the same ones at every run; where the
    rare class would be thin, half the bound is kept for either class."""
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y is not null").filter(fold_of(F.col("doc_id")) != 1).withColumn("_o", F.xxhash64("doc_id"))
    halves = [one.filter(F.col("y") == v).orderBy("_o", "doc_id").limit(rows // 2) for v in (0, 1)]
    ids = halves[0].unionByName(halves[1]).groupBy("doc_id").agg(F.max("y").alias("y"))
    return doc_rows(docs).join(F.broadcast(ids), "doc_id")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))
