"""What the operators share: tables in the shared folder, prefix sums, text helpers."""

from __future__ import annotations

import ctypes
import functools
import gc
import itertools
import tempfile
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes that separate words: blank, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) is one made up: on
    a cluster each executor would write to its own disk.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: later jobs start from
    the files, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    reader = spark.read if partition_by else spark.read.schema(df.schema)
    return reader.parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch holds, as texts may be very long.  These two settings of
    the session stay set, as plans that were returned read them when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def tidy(run):
    """A function over batches that gives memory back when its task ends: Python workers
    are used again, and what they keep counts against their executor."""

    @functools.wraps(run)
    def tidied(batches):
        yield from run(batches)
        release()

    return tidied


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it has no such call
        pass


def add_up(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of arrays of size doubles, one in each row of part, over two levels of tasks
    that hold one sum each."""

    import pandas

    def run(batches):
        out = np.zeros(size)
        for pdf in batches:
            for x in pdf["part"]:
                out += np.frombuffer(x)
        yield pandas.DataFrame({"part": [out.tobytes()]})

    some = max(1, int(np.sqrt(parts.rdd.getNumPartitions())))
    rows = parts.repartition(some).mapInPandas(run, "part binary").repartition(1).mapInPandas(run, "part binary").collect()  # one
    return np.frombuffer(rows[0]["part"]) if rows else np.zeros(size)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ranked(rows: DataFrame, part: str, bucket: str, order: list[Column], out: str, fan: int = 1024) -> DataFrame:
    """Add out, the 0-based rank within part by (bucket, order), with no task holding a part.

    Rows are numbered within (part, bucket) cells; offsets of cells are prefix sums taken
    in two levels of at most fan neighbouring cells.  bucket must be a long that cuts a
    part into small cells whose order is the order wanted.
    """
    cell = Window.partitionBy(part, bucket)
    numbered = rows.withColumn("__rn", F.row_number().over(cell.orderBy(*order)) - F.lit(1))
    cells = rows.groupBy(part, bucket).agg(F.count(F.lit(1)).alias("__n"))
    cells = cells.withColumn("__block", F.floor(F.col(bucket) / F.lit(fan)))
    blocks = cells.groupBy(part, "__block").agg(F.sum("__n").alias("__m"))
    before = Window.partitionBy(part).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(part, "__block", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(part, "__block").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    cells = cells.join(blocks, [part, "__block"]).select(part, bucket, (F.col("__base") + F.col("__in")).alias("__from"))
    return numbered.join(cells, [part, bucket]).withColumn(out, F.col("__from") + F.col("__rn")).drop("__from", "__rn")


def words(text) -> list[bytes]:
    """Words of a text with A-Z in lower case; bytes.lower and bytes.split know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def whole_ids(df: DataFrame, column: str = "doc_id") -> DataFrame:
    """df with a null id as 0 and marked in no_id: pandas would turn a column of whole
    numbers with nulls into floats, which hold no large ids."""
    return df.withColumn("no_id", F.col(column).isNull()).withColumn(column, F.coalesce(F.col(column), F.lit(0)))


def null_ids(df: DataFrame, column: str = "doc_id") -> DataFrame:
    """The reverse of whole_ids."""
    return df.withColumn(column, F.when(~F.col("no_id"), F.col(column))).drop("no_id")


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """df with columns of the given names (in any case) renamed, and the names to give back."""
    taken = {n.lower() for n in names}
    moved = {c: f"__own{i}__{c}" for i, c in enumerate(df.columns) if c.lower() in taken}
    return df.withColumnsRenamed(moved), {v: k for k, v in moved.items()}


class Vocabulary:
    """Numbers distinct words in the order they come, within one task.

    number() returns the words' numbers and the words not met before; past limit words
    it starts anew (fresh is then True and all words count as new), so memory is bounded.
    """

    def __init__(self, limit: int = 300_000):
        self.limit, self.seen = limit, defaultdict(itertools.count().__next__)

    def number(self, tokens: list) -> tuple[np.ndarray, list, bool]:
        fresh = len(self.seen) > self.limit
        if fresh:
            self.seen = defaultdict(itertools.count().__next__)
        before = len(self.seen)
        ids = np.fromiter(map(self.seen.__getitem__, tokens), np.int64, len(tokens))
        return ids, list(itertools.islice(self.seen, before, None)), fresh


def chunks(pdf, column: str = "text", size: int = 1 << 20):
    """Cut a batch into row ranges of about size characters each."""
    lengths = np.array([len(t) if t else 0 for t in pdf[column]], np.int64)
    at, start = 0, 0
    for i, n in enumerate(lengths):
        at += n
        if at >= size:
            yield start, i + 1
            at, start = 0, i + 1
    if start < len(lengths):
        yield start, len(lengths)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, .. of every run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - ends + lengths, lengths)
