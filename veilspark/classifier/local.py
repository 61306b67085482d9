"""The engine's detection on plain strings, for SQL functions and stateful streams: same rules, merge and splice."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import functions as F

from ..operators.rules import Rule
from ..schema import SPANS_SQL
from .pattern import PATTERNS

if TYPE_CHECKING:
    from ..engine import Engine

_WS = "\\t-\\r \\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


@lru_cache(maxsize=256)
def _compiled(rules: tuple[Rule, ...]) -> re.Pattern:
    """One alternation in this dialect: ASCII words and digits, Unicode white space."""

    def dialect(p: str) -> str:
        p = re.sub(r"\((?!\?)", "(?:", re.sub(r"\\.", lambda m: m[0].replace("(", "\0"), p)).replace("\0", "(")
        out, in_class, i = [], False, 0
        while i < len(p):
            if p[i] == "\\":
                out.append((_WS if in_class else f"[{_WS}]") if p[i + 1] == "s" else p[i : i + 2])
                i += 2
                continue
            in_class = (in_class or p[i] == "[") and p[i] != "]"
            out.append(p[i])
            i += 1
        return "".join(out)

    flags = re.ASCII
    for c in "".join(r.flags for r in rules):
        flags |= {"i": re.I, "m": re.M, "s": re.S}[c]
    return re.compile("|".join(f"({dialect(r.pattern)})" for r in rules), flags)


def find(text: str, rules: Sequence[Rule], source: str = "rule") -> list[dict]:
    """Spans of the rules, sorted by start, united rules first at equal starts."""
    united = tuple(r for r in rules if r.pattern is not None and not r.flags)
    scans = [united] if united else []
    scans += [(r,) for r in rules if r.pattern is None or r.flags]
    out = []
    for scan in scans:
        if scan[0].pattern is None:
            found = [(s, e, scan[0]) for s, e in scan[0].match(text) if 0 <= s < e <= len(text)]
        else:
            found = [(m.start(), m.end(), scan[m.lastindex - 1]) for m in _compiled(scan).finditer(text) if m.end() > m.start()]
        for s, e, r in found:
            out.append({"label": r.label, "source": source, "severity": r.severity if source == "rule" else None, "start": s, "end": e, "text": text[s:e], "marker": r.shown, "confidence": 1.0})
    return sorted(out, key=lambda x: x["start"])


def merged(model: list[dict], rules: list[dict]) -> list[dict]:
    free = [m for m in model if not any(m["start"] < r["end"] and r["start"] < m["end"] for r in rules)]
    return sorted(free + rules, key=lambda x: x["start"])


def detect(text: str, rules: Sequence[Rule], patterns: Sequence[Rule] = PATTERNS) -> list[dict]:
    return merged(find(text, patterns, "model"), find(text, rules))


def splice(text: str, spans: list[dict], base: int = 0) -> str:
    for s in reversed(spans):
        text = text[: s["start"] - base] + s["marker"] + text[s["end"] - base :]
    return text


def _settled(engine: Engine):
    """Detection with the engine's rules, backend, categories, markers and least confidence."""
    from ..engine import backend_named
    from ..schema import EngineError, ErrorCode

    patterns = {backend_named("pattern"): PATTERNS, backend_named("none"): ()}.get(engine.backend)
    if patterns is None:
        raise EngineError("SQL functions know the backends pattern and none", ErrorCode.BACKEND_UNAVAILABLE)
    rules, enabled, markers, least = tuple(engine.rules), engine.enabled, engine.markers, engine.min_confidence

    def run(text: str | None, marked: bool) -> list[dict]:
        spans, k = [s for s in detect(text or "", rules, patterns) if s["confidence"] >= least], 0
        for s in spans if marked else ():
            if s["source"] != "rule" and enabled is not None and s["label"] not in enabled:
                s["marker"] = s["text"]
            elif callable(markers):
                s["marker"], k = markers(dict(s), k), k + 1
                s["marker"] = s["text"] if s["marker"] is None else s["marker"]
            elif s["label"] in (markers or {}):
                s["marker"] = s["text"] if markers[s["label"]] is None else markers[s["label"]]
        return spans

    return run


def local_spans(engine: Engine):
    run_one = _settled(engine)

    @F.pandas_udf(SPANS_SQL)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: run_one(t, False))

    return run


def local_redact(engine: Engine):
    run_one = _settled(engine)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: splice(t or "", run_one(t, True)))

    return run
