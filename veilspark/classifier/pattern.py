"""The default classifier: fixed patterns for the model's labels, as one native scan.

It stands in for a neural token classifier where no weights are at hand: deterministic, without downloads, and with
another recall than a network has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column

from ..operators.rules import Rule, rule_spans

_GIVEN = "Alice|Bob|Carol|David|Eve|Frank|Grace|Hank|John|Jane"
_STREET = "St|Street|Ave|Avenue|Rd|Road|Blvd|Lane|Ln|Drive|Dr|Way|Court|Ct"
_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"
#: In order of precedence at one place.
PATTERNS = (
    Rule("private_email", r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    Rule("private_url", r"\bhttps?://[A-Za-z0-9./?=&%_~:#-]*[A-Za-z0-9/]"),
    Rule("private_date", rf"\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b\d{{1,2}} (?:{_MONTH}) \d{{4}}\b"),
    Rule("private_address", rf"\b\d{{1,5}} [A-Z][a-z]+ (?:{_STREET})\b(?:,? [A-Z][a-z]+,? [A-Z]{{2}} \d{{5}})?"),
    Rule("account_number", r"\b(?:\d{4}[ -]){3}\d{4}\b|\b\d{3}-\d{2}-\d{4}\b|\b\d{16}\b"),
    Rule("private_phone", r"\+?\d[\d\s().-]{8,}\d"),
    Rule("private_person", rf"\b(?:{_GIVEN})(?:\s[A-Z][a-z]+)?\b"),
    Rule("secret", r"\b[a-f0-9]{40}\b"),
)


def pattern_spans(text: Column, patterns: Sequence[Rule] = PATTERNS) -> Column:
    """Spans with source ``model``, mutually disjoint, sorted by start."""
    return rule_spans(text, patterns, source="model")
