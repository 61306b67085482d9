"""Detection and redaction of text streams with stable emission.

A stream arrives as rows (stream_id, seq, chunk, eos). Fragments are taken in the order of ``seq``; one that comes
early waits in the state until the gap before it closes. A span is emitted once it ends at least a safety margin before
the end of what has arrived. Redacted text is emitted up to that edge, but never into a span that is detected and not
yet stable, so that no part of it leaves unredacted. At the end of the stream everything is detected once more and the
rest goes out. The state keeps the text from the window's start on, not the whole stream.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..classifier.local import detect, splice
from ..classifier.pattern import PATTERNS
from ..operators.rules import Rule
from ..schema import LABELS, EngineError

CHARS_PER_TOKEN = 4
OUTPUT = "stream_id string, kind string, pos long, label string, source string, severity string, start long, end long, text string, marker string"
STATE = "state string"
_COLUMNS = ["stream_id", "kind", "pos", "label", "source", "severity", "start", "end", "text", "marker"]


@dataclass(frozen=True)
class StreamOptions:
    """``window_tokens`` of context, of which the last ``margin_tokens`` are not yet stable (4 characters a token)."""

    window_tokens: int = 1024
    margin_tokens: int = 256

    def __post_init__(self) -> None:
        if self.window_tokens <= 0 or self.margin_tokens < 0 or self.margin_tokens >= self.window_tokens:
            raise EngineError("the window is positive and the margin lies between 0 and the window")

    @property
    def margin(self) -> int:
        return CHARS_PER_TOKEN * self.margin_tokens

    @property
    def context(self) -> int:
        return CHARS_PER_TOKEN * self.window_tokens


@dataclass
class StreamState:
    """What is known of one stream. Offsets count from the stream's start; ``base`` is where ``buffer`` begins."""

    base: int = 0
    buffer: str = ""
    cursor: int = 0
    next_seq: int = 0
    emitted: int = 0
    done: bool = False
    early: dict[int, tuple[str, bool]] = field(default_factory=dict)
    seen: set[tuple[str, int, int]] = field(default_factory=set)
    stable: list[dict] = field(default_factory=list)

    def dump(self) -> str:
        d = self.__dict__ | {"early": [[k, *v] for k, v in sorted(self.early.items())], "seen": sorted(self.seen)}
        return json.dumps(d)

    @classmethod
    def load(cls, text: str) -> StreamState:
        d = json.loads(text)
        d["early"] = {int(k): (c, e) for k, c, e in d["early"]}
        d["seen"] = {tuple(x) for x in d["seen"]}
        return cls(**d)


class Redactor:
    """The per-stream processor, free of Spark: feed fragments, get output rows."""

    def __init__(self, rules: Sequence[Rule] = (), options: StreamOptions | None = None, patterns: Sequence[Rule] = PATTERNS, enabled: Sequence[str] | None = None, markers: dict[str, str | None] | None = None) -> None:
        self.rules, self.patterns, self.options = tuple(rules), tuple(patterns), options or StreamOptions()
        self.enabled, self.markers = set(LABELS if enabled is None else enabled), dict(markers or {})

    def _spans(self, st: StreamState) -> list[dict]:
        out = []
        for s in detect(st.buffer, self.rules, self.patterns):
            if s["source"] == "model" and s["label"] not in self.enabled:
                continue
            m = self.markers.get(s["label"], s["marker"])
            out.append(s | {"start": s["start"] + st.base, "end": s["end"] + st.base, "marker": s["text"] if m is None else m})
        return out

    def feed(self, st: StreamState, seq: int, chunk: str, eos: bool) -> Iterator[dict]:
        """Takes one fragment; yields rows for every fragment that is now in order. Repeats are ignored."""
        if st.done or seq < st.next_seq:
            return
        st.early[seq] = (chunk, eos)
        while not st.done and st.next_seq in st.early:
            text, last = st.early.pop(st.next_seq)
            st.next_seq += 1
            st.buffer += text
            yield from self._advance(st, last)

    def _advance(self, st: StreamState, last: bool) -> Iterator[dict]:
        end = st.base + len(st.buffer)
        edge = end if last else max(st.cursor, end - self.options.margin)
        if not last and edge == st.cursor and not st.buffer:
            return
        spans = self._spans(st)
        for s in spans:
            key = (s["label"], s["start"], s["end"])
            if s["end"] <= edge and key not in st.seen and s["start"] >= st.cursor:
                st.seen.add(key)
                st.stable.append(s)
                yield {"kind": "span", "pos": s["start"], **{k: s[k] for k in ("label", "source", "severity", "start", "end", "text", "marker")}}
        cap = edge
        for s in sorted([*spans, *st.stable], key=lambda s: -s["start"]):  # an unstable span holds the text back
            if s["end"] > cap and st.cursor <= s["start"] < cap:
                cap = s["start"]
        if cap > st.cursor:
            ready = sorted((s for s in st.stable if st.cursor <= s["start"] and s["end"] <= cap), key=lambda s: s["start"])
            raw = st.buffer[st.cursor - st.base : cap - st.base]
            yield {"kind": "text", "pos": st.cursor, "start": st.cursor, "end": cap, "text": splice(raw, ready, st.cursor)}
            st.cursor = cap
        st.emitted = len(st.seen)
        if last:
            st.done = True
            yield {"kind": "result", "pos": end, "start": 0, "end": end, "text": str(len(st.seen))}
            st.buffer, st.base, st.stable, st.seen, st.early = "", end, [], set(), {}
            return
        keep = max(st.base, min(st.cursor, end - self.options.context))
        # Cut only outside of spans, so that what is detected again begins as it did before.
        for s in spans:
            if s["start"] < keep < s["end"]:
                keep = s["start"]
        st.buffer, st.base = st.buffer[keep - st.base :], keep
        st.stable = [s for s in st.stable if s["end"] > st.cursor]
        st.seen = {k for k in st.seen if k[2] > keep}


def run_batch(redactor: Redactor, rows: Sequence[tuple[int, str, bool]]) -> list[dict]:
    """All output rows of one whole stream."""
    st, out = StreamState(), []
    for seq, chunk, eos in rows:
        out += redactor.feed(st, seq, chunk or "", bool(eos))
    return out


def _frame(key: str, rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([{"stream_id": key} | r for r in rows], columns=_COLUMNS, dtype=object)


def redact_stream(df: DataFrame, redactor: Redactor, idle: str | None = None) -> DataFrame:
    """Output rows (kind ``span``, ``text`` or ``result``) of a streaming DataFrame (stream_id string, seq long from 0,
    chunk string, eos boolean).

    Streams are dealt out by ``stream_id``; each one's state is on one task and its size is bounded by the window and
    by fragments that came too early. With ``idle`` (such as "1 hour") a stream without news for so long is flushed
    as if it had ended.
    """
    limit = None if idle is None else _milliseconds(idle)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        st = StreamState.load(state.get[0]) if state.exists else StreamState()
        out: list[dict] = []
        if state.hasTimedOut:
            if not st.done:
                st.early.pop(st.next_seq, None)
                out += redactor.feed(st, st.next_seq, "", True)
            state.remove()
        else:
            rows = sorted(r for f in frames for r in zip(f["seq"].tolist(), f["chunk"].fillna("").tolist(), f["eos"].fillna(False).tolist(), strict=True))
            for seq, chunk, eos in rows:
                out += redactor.feed(st, int(seq), chunk, bool(eos))
            state.update((st.dump(),))
            if limit is not None:
                state.setTimeoutDuration(limit)
        yield _frame(key[0], out)

    timeout = GroupStateTimeout.NoTimeout if limit is None else GroupStateTimeout.ProcessingTimeTimeout
    typed = df.select(F.col("stream_id").cast("string"), F.col("seq").cast("long"), F.col("chunk").cast("string"), F.col("eos").cast("boolean"))
    return typed.groupBy("stream_id").applyInPandasWithState(step, OUTPUT, STATE, "append", timeout)


def _milliseconds(span: str) -> int:
    n, unit = span.split()
    return int(float(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1000)


def redact_replay(df: DataFrame, redactor: Redactor) -> DataFrame:
    """The same rows for streams that are complete in a batch DataFrame."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        return _frame(key[0], run_batch(redactor, list(zip(pdf["seq"].tolist(), pdf["chunk"].fillna("").tolist(), pdf["eos"].tolist(), strict=True))))

    typed = df.select(F.col("stream_id").cast("string"), F.col("seq").cast("long"), F.col("chunk").cast("string"), F.col("eos").cast("boolean"))
    return typed.groupBy("stream_id").applyInPandas(one, OUTPUT)


def split_sinks(rows: DataFrame, spans: Callable[[DataFrame], None], texts: Callable[[DataFrame], None]):
    """A foreachBatch function that sends span rows and text rows to their own sinks, computing the batch once."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        spans(batch.where("kind = 'span'").drop("kind"))
        texts(batch.where("kind = 'text'").select("stream_id", "pos", "text"))
        batch.unpersist()

    return rows.writeStream.foreachBatch(write)
