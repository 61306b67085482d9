"""``python -m veilspark``: redact, detect, table, classify, scan, cache."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .classifier import cache
from .engine import Engine
from .functions.text import is_blocking
from .operators import tables
from .schema import EngineError
from .sources import files


def _session() -> SparkSession:
    return SparkSession.builder.appName("veilspark").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilspark", description="Find and redact personal data and secrets.")
    p.add_argument("--version", action="version", version="veilspark 0.1.0")
    sub = p.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--secrets", action="store_true", help="add the secrets preset")
    shared.add_argument("--backend", default="auto")
    shared.add_argument("--min-confidence", type=float, default=0.0)
    shared.add_argument("--categories", help="comma-separated model labels")
    for name in ("redact", "detect"):
        c = sub.add_parser(name, parents=[shared])
        c.add_argument("path", nargs="?", default="-")
        if name == "redact":
            c.add_argument("--in-place", action="store_true")
        else:
            c.add_argument("--jsonl", action="store_true")
            c.add_argument("--sarif", action="store_true")
    for name in ("table", "classify"):
        c = sub.add_parser(name, parents=[shared])
        c.add_argument("path", nargs="?", default="-")
        c.add_argument("--header", action="store_true")
        c.add_argument("--sample-size", type=int, default=tables.SAMPLE_SIZE)
        if name == "table":
            c.add_argument("--mode", choices=tables.MODES, default="redact")
    c = sub.add_parser("scan", parents=[shared], help="gate files: exit 1 on blocking findings")
    c.add_argument("paths", nargs="+")
    c.add_argument("--severity", choices=("all", "warn", "block"), default="block")
    c.add_argument("--max-bytes", type=int, default=files.MAX_BYTES)
    c.add_argument("--warn-only", action="store_true")
    c.add_argument("--allow-list", action="store_true", help="only tell which files would be scanned")
    c.add_argument("--annotations", action="store_true")
    c.add_argument("--sarif", metavar="FILE")
    c = sub.add_parser("cache")
    c.add_argument("action", choices=("info", "clear"))
    return p


def _engine(a: argparse.Namespace) -> Engine:
    return Engine(presets=["secrets"] if a.secrets or a.command == "scan" else [], backend=a.backend, min_confidence=a.min_confidence, enabled=a.categories.split(",") if a.categories else None)


def _text(path: str) -> str:
    if path == "-":
        return sys.stdin.read()
    with open(path, encoding="utf-8", newline="") as f:
        return f.read()


def _table(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, list[str | None]]:
    rows = files.parse_csv(_text(a.path))
    width = len(rows[0]) if rows else 0
    names = tables.resolve_headers(width, rows[0] if rows else None, None, a.header)
    body = rows[1:] if a.header else rows
    df = spark.createDataFrame(list(enumerate(body)), "row_idx long, cells array<string>")
    return tables.rectangular(df, width), names


def _csv(rows: list[list[str]]) -> str:
    quote = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c
    return "".join(",".join(map(quote, r)) + "\n" for r in rows)


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    try:
        return _run(a)
    except EngineError as e:
        print(f"veilspark: {e}", file=sys.stderr)
        return 2


def _run(a: argparse.Namespace) -> int:
    if a.command == "cache":
        if a.action == "clear":
            print(f"{cache.clear()} bytes removed")
        else:
            print(json.dumps([f.__dict__ for f in cache.info()], indent=2))
        return 0
    spark, engine = _session(), _engine(a)
    if a.command in ("redact", "detect"):
        df = spark.createDataFrame([(a.path, _text(a.path))], "uri string, text string")
        if a.command == "redact":
            out = engine.redact(df).first()["redacted_text"]
            if a.in_place and a.path != "-":
                with open(a.path, "w", encoding="utf-8", newline="") as f:
                    f.write(out)
            else:
                sys.stdout.write(out)
            return 0
        found = engine.detect(df)
        if a.sarif:
            print(files.to_sarif(found))
        elif a.jsonl:
            for r in files.span_lines(found).collect():
                print(r["value"])
        else:
            print(json.dumps(json.loads(files.result_json(found).first()["value"]), indent=2, ensure_ascii=False))
        return 0
    if a.command in ("table", "classify"):
        df, names = _table(spark, a)
        found = [r.asDict(recursive=True) for r in tables.classify_columns(df, engine, sample_size=a.sample_size, headers=[n or "" for n in names]).orderBy("index").collect()]
        if a.command == "classify":
            print(json.dumps(found, indent=2, ensure_ascii=False))
            return 0
        out = tables.redact_table(df, engine, a.mode, classifications=[f["label"] for f in found])
        kept = [c for c in out.columns if c != "row_idx"]
        rows = [[r[c] for c in kept] for r in out.orderBy("row_idx").collect()]
        head = [[names[int(c[1:])] or "" for c in kept]] if a.header else []
        sys.stdout.write(_csv(head + rows))
        return 0
    listed = spark.read.format("binaryFile").load(a.paths)
    reason = files.skip_reason(F.col("path"), F.col("length"), a.max_bytes)
    if a.allow_list:
        for r in listed.select("path", reason.alias("r")).orderBy("path").collect():
            print(f"SCAN {r['path']}" if r["r"] is None else f"SKIP {r['path']} ({r['r']})")
        return 0
    found = engine.detect(files.scannable(listed, a.max_bytes))
    blocking = found.withColumn("spans", F.filter("spans", lambda s: is_blocking(s["source"], s["severity"], a.severity)))
    results = files.sarif_results(blocking, "warning" if a.warn_only else None).orderBy("uri", "pos").collect()
    for r in results:
        print(f"{r['rule_id']}  {r['uri']}:{r['start_line']}:{r['start_column']}  {r['message']}")
    if a.annotations:
        for r in files.annotations(files.sarif_results(blocking)).collect():
            print(r["value"])
    if a.sarif:
        with open(a.sarif, "w", encoding="utf-8") as f:
            f.write(files.to_sarif(blocking, "warning" if a.warn_only else None))
    return 1 if results and not a.warn_only else 0
