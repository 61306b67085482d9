"""Tables of string cells: column classification, and redaction of the columns that hold personal data.

A table is a DataFrame with a row number column; every other column is a cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..engine import Engine
from ..functions.text import is_blank
from ..schema import EngineError
from . import redaction as R
from .faker import dictionary

SAMPLE_SIZE = 50
MODES = ("redact", "synth", "drop_column")


def resolve_headers(width: int, first_row: Sequence[str] | None, headers: Sequence[str] | None, header_row: bool) -> list[str | None]:
    """Names of the columns: ``headers``, else the first row if it is one, else none."""
    if headers is not None:
        if len(headers) != width:
            raise EngineError(f"{len(headers)} headers for {width} columns")
        return list(headers)
    return list(first_row) if header_row and first_row is not None else [None] * width


def rectangular(rows: DataFrame, width: int, cells: str = "cells", row: str = "row_idx") -> DataFrame:
    """Ragged rows (an array column) as ``width`` columns c0.. : missing cells are empty, more are cut."""
    return rows.select(row, *[F.coalesce(F.get(F.col(cells), k), F.lit("")).alias(f"c{k}") for k in range(width)])


def cells_of(df: DataFrame, row: str) -> DataFrame:
    names = [c for c in df.columns if c != row]
    return df.select(row, F.posexplode(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names])).alias("col", "cell"))


def classify_columns(df: DataFrame, engine: Engine, row: str = "row_idx", sample_size: int = SAMPLE_SIZE, headers: Sequence[str] | None = None) -> DataFrame:
    """``index, header, label, confidence, samples, label_counts`` per column.

    Of the first ``sample_size`` non-blank cells of a column, each label counts once per cell; the most frequent
    label wins, among equals the one seen first. Columns without samples or findings have no label.
    """
    names = list(headers) if headers is not None else [c for c in df.columns if c != row]
    width = len([c for c in df.columns if c != row])
    if len(names) != width:
        raise EngineError(f"{len(names)} headers for {width} columns")
    top = F.row_number().over(W.partitionBy("col").orderBy(row))
    sample = cells_of(df, row).where(~is_blank(F.col("cell"))).withColumn("rn", top).where(F.col("rn") <= sample_size)
    found = engine.with_spans(sample, "cell")
    labels = found.select("col", "rn", F.posexplode(F.array_distinct(F.transform("spans", lambda s: s["label"]))).alias("pos", "label"))
    counts = labels.groupBy("col", "label").agg(F.count("*").alias("n"), F.min(F.struct("rn", "pos")).alias("seen"))
    best = counts.groupBy("col").agg(
        F.min(F.struct((-F.col("n")).alias("a"), F.col("seen").alias("b"), F.col("label").alias("label"))).alias("best"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_counts"),
    )
    samples = sample.groupBy("col").agg(F.count("*").alias("samples"))
    columns = df.sparkSession.createDataFrame(list(enumerate(names)), "col int, header string")
    joined = columns.join(samples, "col", "left").join(best, "col", "left")
    n = F.coalesce("samples", F.lit(0)).cast("long")
    return joined.select(
        F.col("col").alias("index"),
        "header",
        F.col("best.label").alias("label"),
        F.when(F.col("best.label").isNull(), 0.0).otherwise(-F.col("best.a") / n).alias("confidence"),
        n.alias("samples"),
        F.coalesce("label_counts", F.expr("cast(map() as map<string,bigint>)")).alias("label_counts"),
    )


def redact_table(
    df: DataFrame, engine: Engine, mode: str = "redact", row: str = "row_idx", sample_size: int = SAMPLE_SIZE, markers: R.Markers | None = None, classifications: Sequence[str | None] | None = None
) -> DataFrame:
    """The table with the columns that hold personal data redacted, faked consistently, or left out.

    ``classifications`` (a label or None per column) skips the sampling pass; that pass sends one row per column to
    the driver. Fakes are numbered in row-major order and shared by all columns.
    """
    if mode not in MODES:
        raise EngineError(f"unknown mode {mode}; known: {', '.join(MODES)}")
    names = [c for c in df.columns if c != row]
    if classifications is None:
        classifications = [r["label"] for r in classify_columns(df, engine, row, sample_size).orderBy("index").collect()]
    held = [c for c, label in zip(names, classifications, strict=True) if label is not None]
    if mode == "drop_column":
        return df.drop(*held)
    filled = df.select(row, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in names])
    if mode == "redact":
        for c in held:
            spans = R.with_markers(F.col("_spans"), engine.markers if markers is None else markers, engine.enabled)
            cell = F.col(f"`{c}`")
            filled = engine.with_spans(filled, f"`{c}`", "_spans").withColumn(c, F.when(is_blank(cell), cell).otherwise(R.splice(cell, spans))).drop("_spans")
        return filled
    if not held:
        return filled
    cells = engine.with_spans(filled.select(row, F.posexplode(F.array(*[F.col(f"`{c}`") for c in held])).alias("col", "cell")), "cell")
    flat = cells.select(row, "col", F.posexplode("spans").alias("pos", "s")).select(row, "col", "pos", F.col("s.label").alias("label"), F.col("s.text").alias("text"))
    fakes = dictionary(flat, [row, "col", "pos"])
    marked = flat.join(fakes, ["label", "text"]).groupBy(row, "col").agg(F.array_sort(F.collect_list(F.struct("pos", "fake"))).alias("f"))
    done = cells.join(marked, [row, "col"], "left").withColumn(
        "cell", F.when(F.col("f").isNull(), F.col("cell")).otherwise(R.splice(F.col("cell"), F.zip_with("spans", "f", lambda s, f: s.withField("marker", f["fake"]))))
    )
    wide = done.groupBy(row).agg(*[F.max(F.when(F.col("col") == k, F.col("cell"))).alias(f"_{k}") for k in range(len(held))])
    joined = filled.join(wide, row)
    return joined.select(row, *[F.col(f"_{held.index(c)}").alias(c) if c in held else F.col(f"`{c}`") for c in names])
