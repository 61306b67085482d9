"""Files in and out: whole texts, CSV tables, gating of a scan, JSON, JSON lines and SARIF findings."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fingerprint, line_col, preview, sarif_level

MAX_BYTES = 1_000_000
# Extensions that are not scanned (some are suffixes of two parts).
SKIP_SUFFIXES = (
    ".lock .lockfile .min.js .min.css .min.html .wasm .node .dylib .so .dll .a .lib .o .onnx .safetensors .gguf .pt .pth .bin .pkl .png .jpg .jpeg .gif .webp .ico .svg .mp3 .mp4 .webm .mov "
    ".avi .wav .flac .ogg .pdf .zip .tar .gz .7z .rar .woff .woff2 .ttf .otf .eot .class .jar .war"
).split()
SKIP_NAMES = ("package-lock.json", "pnpm-lock.yaml")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``uri, text`` of whole files, decoded as UTF-8."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("text"))


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path, length, content`` below a folder; the columns that are not asked for are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def skip_reason(path: Column, length: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Why a file is not scanned: ``extension``, ``empty``, ``size``; null if it is."""
    name = F.lower(F.substring_index(path, "/", -1))
    ext = name.isin(*SKIP_NAMES)
    for s in SKIP_SUFFIXES:
        ext = ext | name.endswith(s)
    return F.when(ext, "extension").when(length == 0, "empty").when(length > max_bytes, "size")


def scannable(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``uri, text`` of the files that are scanned; sizes and names are tested before any content is read."""
    return files.where(skip_reason(F.col("path"), F.col("length"), max_bytes).isNull()).select(F.col("path").alias("uri"), F.decode("content", "UTF-8").alias("text"))


def parse_csv(text: str) -> list[list[str]]:
    """RFC 4180 rows: quoted cells may hold commas, quotes (doubled) and line ends; a carriage return outside quotes
    is dropped; an empty line is a row of one empty cell."""
    rows, row, cell, quoted, i, n = [], [], [], False, 0, len(text)
    while i < n:
        c = text[i]
        if quoted:
            if c != '"':
                cell.append(c)
            elif text[i + 1 : i + 2] == '"':
                cell.append('"')
                i += 1
            else:
                quoted = False
        elif c == '"':
            quoted = True
        elif c in ",\n":
            row.append("".join(cell))
            cell = []
            if c == "\n":
                rows.append(row)
                row = []
        elif c != "\r":
            cell.append(c)
        i += 1
    if cell or row:
        rows.append([*row, "".join(cell)])
    return rows


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """``uri, row_idx, cells`` of every row of each file, in the exact dialect above."""

    @F.pandas_udf("array<array<string>>")
    def rows(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: parse_csv(t or ""))

    return read_texts(spark, path).select("uri", F.posexplode(rows("text")).alias("row_idx", "cells"))


def csv_line(cells: Sequence[Column]) -> Column:
    """A row in CSV: cells with commas, quotes or line ends are quoted."""
    one = lambda c: F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.concat_ws(",", *[one(F.coalesce(c.cast("string"), F.lit(""))) for c in cells])


def span_lines(found: DataFrame) -> DataFrame:
    """One JSON object per span (``value``), for ``write.text``."""
    return found.select(F.explode("spans").alias("s")).select(F.to_json("s").alias("value"))


def result_json(found: DataFrame) -> DataFrame:
    """One JSON object per text: containsPii, spans, summary."""
    return found.select(F.to_json(F.struct(F.col("contains_pii").alias("containsPii"), "spans", "summary")).alias("value"))


# Names and descriptions of the model's rules in findings.
MODEL_RULES = {
    "private_email": ("PrivateEmail", "Email address"),
    "private_phone": ("PrivatePhone", "Phone number"),
    "private_person": ("PrivatePerson", "Personal name"),
    "private_address": ("PrivateAddress", "Postal address"),
    "private_url": ("PrivateUrl", "Personal / sensitive URL (account recovery, session-id, etc.)"),
    "private_date": ("PrivateDate", "Date tied to a person (birth date, signup date, etc.)"),
    "account_number": ("AccountNumber", "Account / card / SSN / customer ID"),
    "secret": ("Secret", "Password / API key / JWT / recovery code"),
}


def sarif_results(found: DataFrame, model_level: str | None = None, uri: str = "uri", text: str = "text", spans: str = "spans") -> DataFrame:
    """One row per span: ``uri, pos, rule_id, level, message, start_line, start_column, end_line, end_column,
    fingerprint``."""
    flat = found.select(F.col(uri).alias("uri"), F.col(text).alias("text"), F.posexplode(spans).alias("pos", "s"))
    line, col = line_col(F.col("text"), F.col("s.start"))
    end_line, end_col = line_col(F.col("text"), F.col("s.end"))
    return flat.select(
        "uri",
        "pos",
        F.col("s.label").alias("rule_id"),
        F.col("s.source").alias("source"),
        sarif_level(F.col("s.source"), F.col("s.severity"), model_level).alias("level"),
        F.concat(F.lit("Found "), F.col("s.label"), F.lit(': "'), preview(F.col("s.text")), F.lit('"')).alias("message"),
        line.alias("start_line"),
        col.alias("start_column"),
        end_line.alias("end_line"),
        end_col.alias("end_column"),
        fingerprint(F.col("uri"), line, F.col("s.label"), F.col("s.text")).alias("fingerprint"),
    )


def sarif_rules(results: DataFrame) -> DataFrame:
    """``rule_id, first``: each rule with its first use."""
    return results.groupBy("rule_id").agg(F.min(F.struct("uri", "pos")).alias("first"))


def rule_definition(rule_id: str) -> dict:
    name, description = MODEL_RULES.get(rule_id, (rule_id, f"Custom rule: {rule_id}"))
    return {"id": rule_id, "name": name, "shortDescription": {"text": description}, "defaultConfiguration": {"level": "error"}}


def result_object() -> Column:
    """A SARIF result as a struct of the columns of ``sarif_results``."""
    region = F.struct(F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn"), F.col("end_line").alias("endLine"), F.col("end_column").alias("endColumn"))
    place = F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return F.struct(
        F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("primaryLocationLineHash")).alias("partialFingerprints")
    )


def to_sarif(found: DataFrame, model_level: str | None = None, **names: str) -> str:
    """The SARIF 2.1.0 document of a scan, in file and span order. The findings of one scan report go to the driver;
    for more than a report can hold, write ``sarif_results`` instead."""
    results = sarif_results(found, model_level, **names)
    rows = results.orderBy("uri", "pos").select("rule_id", F.to_json(result_object()).alias("r")).toLocalIterator()
    rules, out = {}, []
    for r in rows:
        rules.setdefault(r["rule_id"], rule_definition(r["rule_id"]))
        out.append(json.loads(r["r"]))
    driver = {"name": "veilspark", "version": "0.1.0", "rules": list(rules.values())}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": out}]})


def annotations(results: DataFrame) -> DataFrame:
    """CI annotation lines of findings."""
    from ..functions.text import annotation_text

    return results.select(F.format_string("::error file=%s,line=%d,col=%d,title=%s::%s", "uri", "start_line", "start_column", "rule_id", annotation_text(F.col("message"))).alias("value"))

