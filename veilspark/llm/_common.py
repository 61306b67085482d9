"""Shared plumbing of the operators: stage tables, size-checked broadcasts, global ranks."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: White space of the word contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"

#: A table is broadcast only when its measured size is at most this; a shuffled join is used beyond it.
BROADCAST_BYTES = 64 << 20

#: Java pattern of one word.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session, whose driver is its one
    executor, gets a folder of its own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and returns the table read back: a cut of the lineage that
    survives lost executors, compressed and column-pruned, unlike serialised checkpoint blocks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veilspark-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def from_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's. Rows given as they are would pass through Python workers, for which each executor
    starts a second daemon and keeps it; an Arrow table does not."""
    kind = to_arrow_schema(StructType.fromDDL(schema))
    columns = list(zip(*rows, strict=True)) or [()] * len(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], schema=kind))


#: The one model that this Python worker holds.
_HELD: dict = {}


def in_worker(key, make: Callable):
    """What ``make()`` gives, kept by the worker process under ``key``. A worker holds one such object: what an earlier
    stage of a job left behind goes."""
    if key not in _HELD:
        forget()
        _HELD[key] = make()
    return _HELD[key]


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Batches to Python workers of about ``size`` bytes, unless the session asks for smaller ones than by default."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int("".join(filter(str.isdigit, spark.conf.get(name))) or 0) >= 64 << 20:  # the default, or more
        spark.conf.set(name, str(size))


def forget() -> None:
    """Empties what this worker holds, and gives free memory back. Workers outlive the stage that they were started for."""
    _HELD.clear()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A function over the batches of a task, after which the worker gives back what memory it can."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            forget()

    return whole


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_or_shuffled(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if its counted rows at ``row_bytes`` each stay under BROADCAST_BYTES; otherwise
    unmarked, so that Spark shuffles both sides (and splits skewed partitions)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def by_content(df: DataFrame, text_col: str) -> list[Column]:
    """An order of rows by what they hold, for rows whose ids are equal: by text, then by all else that can be hashed."""
    plain = [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    return [F.sha2(F.col(text_col).cast("binary"), 256), F.xxhash64(*[F.col(f"`{c}`") for c in plain])]


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def without_blanks(c: Column) -> Column:
    """Deletes every BLANKS character, by byte search instead of a regular expression."""
    for b in BLANKS:
        c = F.replace(c, F.lit(b), F.lit(""))
    return c


def word_count(c: str) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(c), F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(c: str, n: int) -> Column:
    """crc32 of a column's decimal text (null: of the empty text), modulo n."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % n


def ranked(df: DataFrame, order: list[Column], name: str = "ranked", parts: int | None = None) -> tuple[DataFrame, int]:
    """``df`` with ``rank``: the row's position from 0 in the total order ``order``, and the number of rows.

    Range-partitions, sorts inside partitions and adds each partition's start, so that no task sees more than its
    range and the driver sees one number per partition. The sorted table is staged: bounds are drawn once.
    """
    spark = df.sparkSession
    n = parts or shuffle_partitions(spark)
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = stage(placed, name)
    part = F.shiftright(F.col("_at"), 33)
    counts = {r[0]: r[1] for r in kept.groupBy(part.alias("p")).count().collect()}
    starts, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(p, 0)
    if not starts:
        return kept.withColumn("rank", F.lit(0).cast("long")).drop("_at"), 0
    offsets = from_rows(spark, [(i, s) for i, s in enumerate(starts)], "_p long, _start long")
    out = (
        kept.withColumn("_p", part)
        .join(F.broadcast(offsets), "_p")
        .withColumn("rank", F.col("_start") + (F.col("_at") - F.shiftleft(F.col("_p"), 33)))
        .drop("_p", "_start", "_at")
    )
    return out, total
