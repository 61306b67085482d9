"""From class scores per token to character spans: Viterbi over BIOES tags, runs, trimming; chunk handling."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LABELS, EngineError, ErrorCode

CLASSES = 1 + 4 * len(LABELS)
_NO = np.float32(-1e30)
# The biases of a calibration file.
BIASES = (
    "transition_bias_background_stay", "transition_bias_background_to_start", "transition_bias_inside_to_continue",
    "transition_bias_inside_to_end", "transition_bias_end_to_background", "transition_bias_end_to_start",
)
#: Characters that are trimmed from a span's ends.
_TRIM = "\x20\x09\x0a\x0b\x0c\x0d\xa0"


def zero_calibration() -> dict[str, float]:
    return dict.fromkeys(BIASES, 0.0)


def load_calibration(text: str) -> dict[str, float]:
    """The six biases of a calibration document."""
    try:
        found = json.loads(text)["operating_points"]["default"]["biases"]
        values = {k: float(found[k]) for k in BIASES if not isinstance(found[k], bool)}
    except (KeyError, TypeError, ValueError) as e:
        raise EngineError(f"calibration: {e}", ErrorCode.CALIBRATION_INVALID) from e
    if len(values) != len(BIASES) or not all(np.isfinite(list(values.values()))):
        raise EngineError("calibration: the six biases are numbers", ErrorCode.CALIBRATION_INVALID)
    return values


def transitions(biases: dict[str, float] | None = None, labels: int = len(LABELS)) -> np.ndarray:
    """(from, to) scores: legal moves carry their bias, all others are out of reach."""
    b = list((biases or zero_calibration())[k] for k in BIASES)
    n = 1 + 4 * labels
    out = np.full((n, n), _NO, dtype=np.float32)
    begin, inside, end, single = (np.arange(k, n, 4) for k in (1, 2, 3, 4))
    starts = np.concatenate((begin, single))
    out[0, 0] = b[0]
    out[0, starts] = b[1]
    for group in (begin, inside):
        out[group, inside] = b[2]
        out[group, end] = b[3]
    for group in (end, single):
        out[group, 0] = b[4]
        out[group[:, None], starts[None, :]] = b[5]
    return out


def viterbi(logits: np.ndarray, biases: dict[str, float] | None = None) -> np.ndarray:
    """Best legal tag path; ties go to the lowest tag. A path may end anywhere but starts outside or at a start."""
    logits = np.asarray(logits, dtype=np.float32)
    if logits.ndim != 2 or (len(logits) and (logits.shape[1] - 1) % 4):
        raise EngineError(f"logits of shape {logits.shape}")
    if not len(logits):
        return np.zeros(0, dtype=np.uint8)
    n = logits.shape[1]
    move = transitions(biases, (n - 1) // 4)
    first = np.full(n, _NO, dtype=np.float32)
    first[0] = first[1::4] = first[4::4] = 0
    score = first + logits[0]
    back = np.zeros((len(logits), n), dtype=np.int64)
    for t in range(1, len(logits)):
        reach = score[:, None] + move
        back[t] = reach.argmax(axis=0)
        score = reach[back[t], np.arange(n)] + logits[t]
    path = np.zeros(len(logits), dtype=np.uint8)
    path[-1] = score.argmax()
    for t in range(len(logits) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def describe(tag: int) -> tuple[str, int]:
    """(prefix, label index) of a tag id: O is 0, then B, I, E, S of each label."""
    return ("O", -1) if tag == 0 else ("BIES"[(tag - 1) % 4], (tag - 1) // 4)


def tag_id(name: str, labels: Sequence[str] = LABELS) -> int:
    """The id of a tag written as ``O`` or ``B-label``."""
    return 0 if name == "O" else 1 + 4 * labels.index(name[2:]) + "BIES".index(name[0])


def runs(tags: Iterable[int]) -> list[tuple[int, int, int]]:
    """(label, first token, last token) of each run. A lone E is a run of one token, an I without a beginning begins a
    run, and a run still open at the end is closed there."""
    out: list[tuple[int, int, int]] = []
    label, since, t = -1, 0, -1

    def close(at: int) -> None:
        nonlocal label
        if label >= 0:
            out.append((label, since, at))
        label = -1

    for t, tag in enumerate(tags):
        prefix, k = describe(int(tag))
        if prefix == "E" and k == label:
            close(t)
            continue
        if prefix == "I" and k == label:
            continue
        close(t - 1)
        if prefix in "SE":
            out.append((k, t, t))
        elif prefix in "BI":
            label, since = k, t
    close(t)
    return out


def spans_of(tags: Iterable[int], offsets: Sequence[int], text: str, labels: Sequence[str] = LABELS, base: int = 0) -> list[dict]:
    """Trimmed character spans of a tag sequence; ``offsets`` has one more entry than tokens."""
    out = []
    for k, s, e in runs(tags):
        start, end = offsets[s], offsets[e + 1]
        inner = text[start:end]
        start += len(inner) - len(inner.lstrip(_TRIM))
        end -= len(inner) - len(inner.rstrip(_TRIM))
        if start < end:
            out.append({"label": labels[k], "source": "model", "severity": None, "start": base + start, "end": base + end, "text": text[start:end], "marker": f"[{labels[k]}]", "confidence": 1.0})
    return out


def chunk_starts(n: int, most: int = 2048, overlap: int = 128) -> list[tuple[int, int]]:
    """(from, to) token ranges: one if everything fits, else steps of ``most - overlap`` up to the one that reaches
    the end."""
    if most <= overlap or overlap < 0:
        raise EngineError("a chunk is longer than its overlap")
    if n <= most:
        return [(0, n)]
    out = []
    for s in range(0, n, most - overlap):
        out.append((s, min(n, s + most)))
        if s + most >= n:
            break
    return out


def chunked(df: DataFrame, tokens: str, most: int = 2048, overlap: int = 128) -> DataFrame:
    """One row per chunk: ``chunk_no, first_token`` and the chunk's slice in ``tokens``, natively."""
    if most <= overlap or overlap < 0:
        raise EngineError("a chunk is longer than its overlap")
    step = most - overlap
    n = F.size(tokens)
    count = F.when(n <= most, 1).otherwise(F.ceil((n - most) / step) + 1).cast("int")
    rows = df.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), count - 1))).withColumn("first_token", F.col("chunk_no") * step)
    return rows.withColumn(tokens, F.slice(F.col(tokens), F.col("first_token") + 1, F.lit(most)))


def merge_chunks(spans: Column) -> Column:
    """Spans of all chunks in chunk order, without repeats of (start, end, label), sorted by start."""
    key = lambda s: F.struct(s["start"], s["end"], s["label"])
    keys = F.transform(spans, key)
    first = F.filter(spans, lambda s, i: F.array_position(keys, key(s)) == (i + 1).cast("long"))
    keyed = F.transform(first, lambda x, i: F.struct(x["start"].alias("s"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def decode_logits(df: DataFrame, logits: str, offsets: str, text: str, out: str = "spans", biases: dict[str, float] | None = None, labels: Sequence[str] = LABELS) -> DataFrame:
    """Spans from columns of class scores (array of arrays) and token offsets: for any model run elsewhere."""
    from ..schema import SPANS_SQL

    @F.pandas_udf(SPANS_SQL)
    def run(x: pd.Series, off: pd.Series, texts: pd.Series) -> pd.Series:
        def one(rows, o, t):
            if rows is None or t is None or not len(rows):
                return []
            return spans_of(viterbi(np.stack([np.asarray(r, dtype=np.float32) for r in rows]), biases), [int(i) for i in o], t, labels)

        return pd.Series([one(*z) for z in zip(x, off, texts, strict=True)])

    return df.withColumn(out, run(logits, offsets, text))


def bioes_runs_sql(df: DataFrame, key: str, tags: str) -> DataFrame:
    """Runs of legal tag sequences as gaps and islands, natively: ``key, label, first_token, last_token``."""
    from pyspark.sql import Window as W

    t = df.select(key, F.posexplode(tags).alias("t", "tag"))
    w = W.partitionBy(key).orderBy("t")
    begins = F.col("tag").rlike("^[BS]-").cast("int")
    island = t.withColumn("run", F.sum(begins).over(w.rowsBetween(W.unboundedPreceding, 0))).where("tag <> 'O'")
    return island.groupBy(key, "run").agg(F.min("t").alias("first_token"), F.max("t").alias("last_token"), F.first(F.substring("tag", 3, 100)).alias("label")).drop("run")
