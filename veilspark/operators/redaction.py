"""From spans to redacted text: merging, enablement, markers, splicing, summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SPANS_SQL

#: A marker per label; None keeps the text, a missing label has its default. Or a function of (span, index) that
#: counts enabled spans only.
Markers = Mapping[str, str | None] | Callable[[dict, int], str]


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def by_start(spans: Column) -> Column:
    """Stable sort by start."""
    keyed = F.transform(spans, lambda x, i: F.struct(x["start"].alias("s"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def merge(model: Column, rules: Column) -> Column:
    """Rule spans, and the model spans that overlap none of them, sorted by start."""
    free = F.filter(model, lambda m: ~F.exists(rules, lambda r: overlaps(m, r)))
    return by_start(F.concat(free, rules))


def confident(spans: Column, least: float) -> Column:
    return F.filter(spans, lambda s: s["confidence"] >= least) if least > 0 else spans


def is_enabled(span: Column, enabled: Sequence[str] | None) -> Column:
    """Rule spans always; model spans if their label is among the enabled ones (None: all)."""
    return F.lit(True) if enabled is None else (span["source"] == "rule") | span["label"].isin(list(enabled))


def with_markers(spans: Column, markers: Markers | None = None, enabled: Sequence[str] | None = None) -> Column:
    """Spans with the marker that stands for each; disabled spans and null markers keep the text."""
    if callable(markers):
        return _marked_by_function(spans, markers, enabled)
    table = dict(markers or {})

    def marker(s: Column) -> Column:
        out = s["marker"]
        for label, m in table.items():
            out = F.when(s["label"] == label, s["text"] if m is None else F.lit(m)).otherwise(out)
        return F.when(is_enabled(s, enabled), out).otherwise(s["text"])

    return F.transform(spans, lambda s: s.withField("marker", marker(s)))


def _marked_by_function(spans: Column, fn: Callable[[dict, int], str], enabled: Sequence[str] | None) -> Column:
    allowed = None if enabled is None else set(enabled)

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series) -> pd.Series:
        def one(row):
            out, k = [], 0
            for s in row if row is not None else []:
                s = dict(s)
                if s["source"] == "rule" or allowed is None or s["label"] in allowed:
                    out.append(fn(s, k))
                    k += 1
                else:
                    out.append(s["text"])
            return out

        return rows.map(one)

    return F.zip_with(spans, run(spans), lambda s, m: s.withField("marker", F.coalesce(m, s["text"])))


def splice(text: Column, spans: Column) -> Column:
    """Replaces each span by its marker, from the last to the first."""
    return F.aggregate(
        F.reverse(spans),
        F.coalesce(text, F.lit("")),
        lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["start"]), s["marker"], F.substring(acc, s["end"] + 1, F.length(acc))),
    )


def without_overlaps(spans: Column) -> Column:
    """Of spans sorted by start, those that begin at or after the end of the last one kept."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("to"), F.expr(f"cast(array() as {SPANS_SQL})").alias("out")),
        lambda acc, s: F.when(s["start"] >= acc["to"], F.struct(s["end"].alias("to"), F.array_append(acc["out"], s).alias("out"))).otherwise(acc),
        lambda acc: acc["out"],
    )


def summary(spans: Column) -> Column:
    """How many spans each label has; labels without any are absent."""
    labels = F.transform(spans, lambda s: s["label"])
    return F.map_from_entries(F.transform(F.array_distinct(labels), lambda x: F.struct(x, F.size(F.filter(labels, lambda y: y == x)).cast("bigint"))))


def contains_pii(spans: Column) -> Column:
    return F.size(spans) > 0
