"""Ranks over whole tables without a task that sees a whole group."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into the folder that driver and executors share, and read back."""
    spark = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="veilspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = f"{found.rstrip('/')}/veilspark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ordinal(df: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """``out``: a row's place from 0 among the rows of its ``key``, by ``order``.

    Rows are range-partitioned by (key, order) and sorted inside partitions; the driver gets one count per partition
    and one per key, of which there are few (labels of a configuration).
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = staged(df.repartitionByRange(parts, key, order).sortWithinPartitions(key, order).withColumn("_at", F.monotonically_increasing_id()), "ordinal")
    part = F.shiftright("_at", 33)
    in_part = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    in_key = sorted(((r["k"], r["n"]) for r in placed.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).collect()), key=lambda kn: kn[0].encode())
    starts, at = [], 0
    for p, n in in_part:
        starts.append((p, at))
        at += n
    begin, at = F.lit(0), 0
    for k, n in in_key:
        begin, at = F.when(F.col(key) == k, F.lit(at)).otherwise(begin), at + n
    offsets = df.sparkSession.createDataFrame(starts, "_p long, _start long")
    ranked = placed.withColumn("_p", part).join(F.broadcast(offsets), "_p")  # a row per partition
    return ranked.withColumn(out, F.col("_start") + F.col("_at") - F.shiftleft("_p", 33) - begin).drop("_p", "_start", "_at")
