"""What the operators share: reading tables, shared scratch tables, word bytes.

Scratch tables cut lineage.  They are Parquet under the folder the cluster
names in ``spark.checkpoint.dir`` (shared by driver and executors), so a lost
executor costs a task retry and never the data.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text a Python stage holds at a time; larger inputs go through in blocks.
BLOCK_BYTES = 24 << 20
#: The white space that separates words in the operators' contracts (20, 09-0D).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


@functools.cache
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="strataline-")


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder; an own one only where none is named and all runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or _own_folder()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/strataline/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the scratch files that ``df`` reads; call only when nothing reads them any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = scratch_root(spark).split("://")[-1].rstrip("/")
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if f"{root}/strataline/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables; only when no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark).rstrip('/')}/strataline")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions_of(df: DataFrame) -> int:
    """How many partitions Spark plans for ``df``: the size-driven unit for bucket counts."""
    return max(1, df.rdd.getNumPartitions())


def slices(df: DataFrame) -> int:
    """Partitions for a shuffle of whole texts: the input's own size decides, not the core count."""
    spark = df.sparkSession
    return max(partitions_of(df), int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_blocks(batches: Iterable, column: int = 1, limit: int = BLOCK_BYTES) -> Iterator[list]:
    """Regroup Arrow batches into lists of their rows (as tuples), of about ``limit`` text characters."""
    rows, held = [], 0
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for row in zip(*cols, strict=True):
            rows.append(row)
            held += len(row[column] or "") + 64
            if held >= limit:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def release() -> None:
    """Hand memory that is free, but held by the allocators, back to the system.

    Workers are kept for later tasks; what one stage held would else stay beside the next one's.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function of batches that releases memory when its task ends."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A function of one group that releases memory after each group of over 4 MB."""

    def tidied(rows):
        found = run(rows)
        if rows.nbytes > 4 << 20:
            release()
        return found

    return tidied


def words_column(text: str):
    """Number of words of a text column; null and empty texts have none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
