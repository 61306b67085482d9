"""Scalar helpers as native columns: places in a text, fingerprints, previews, levels, blank tests."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space at a span's edges that is not part of it.
EDGE_BLANKS = "[\\x20\\t\\n\\x0b\\f\\r\\u00a0]"
_ANY_BLANK = "[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
PREVIEW_CHARS = 80


def line_col(text: Column, offset: Column) -> tuple[Column, Column]:
    """Line and column, from 1, of a code-point offset; columns start again after each line feed."""
    prefix = F.substring(text, F.lit(1), offset)
    line = F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"), F.lit(""))) + 1
    return line.cast("int"), (F.length(F.substring_index(prefix, "\n", -1)) + 1).cast("int")


def fingerprint(uri: Column, line: Column, label: Column, text: Column) -> Column:
    """16 hexadecimal digits that identify a finding."""
    return F.substring(F.sha2(F.concat_ws("|", uri, line.cast("string"), label, text), 256), 1, 16)


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def preview(text: Column) -> Column:
    return F.when(F.length(text) > PREVIEW_CHARS, F.concat(F.substring(text, 1, PREVIEW_CHARS - 3), F.lit("..."))).otherwise(text)


def sarif_level(source: Column, severity: Column, model_level: str | None = None) -> Column:
    rule = F.when(severity == "block", "error").when(severity == "warn", "warning").otherwise("note")
    return F.when(source == "rule", rule).otherwise(F.lit(model_level or "error"))


def is_blank(c: Column) -> Column:
    """Whether a cell has nothing but white space (null counts as blank)."""
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), _ANY_BLANK, "")) == 0


def is_blocking(source: Column, severity: Column, threshold: str) -> Column:
    """``all``: every span; ``warn`` and ``block``: rules of severity block, with ``block`` also the model's spans."""
    if threshold == "all":
        return F.lit(True)
    block = F.coalesce(severity == "block", F.lit(False))
    return block if threshold == "warn" else (source == "model") | block


def annotation_text(c: Column) -> Column:
    """For a one-line CI annotation: line ends and percent signs become blanks."""
    return F.regexp_replace(c, r"[\r\n%]", " ")


def utf16_offset(text: Column, offset: Column) -> Column:
    """A code-point offset in UTF-16 units: characters beyond the basic plane count twice."""
    prefix = F.substring(text, F.lit(1), offset)
    return (offset + F.regexp_count(prefix, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("int")


def env_flag(name: str) -> bool:
    """Whether an environment variable is set to anything but an empty string, 0 or false."""
    return os.environ.get(name, "").strip().lower() not in ("", "0", "false")
