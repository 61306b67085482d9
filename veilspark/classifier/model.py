"""A sparse mixture-of-experts token classifier in NumPy: kernels, blocks, forward pass, and how it runs in Spark.

Arrays are kept in 32-bit floats where a mixed-precision engine would round to 16 bits in between.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LABELS, SPANS_SQL, EngineError, ErrorCode
from .sequence import chunk_starts, spans_of, viterbi
from .tokenizer import Tokenizer


@dataclass(frozen=True)
class Config:
    # The published dimensions.
    hidden: int = 640
    layers: int = 8
    heads: int = 14
    kv_heads: int = 2
    head_dim: int = 64
    window: int = 128
    ff: int = 640
    experts: int = 128
    top_k: int = 4
    classes: int = 33
    eps: float = 1e-5
    theta: float = 150_000.0
    rope_factor: float = 32.0
    rope_original: int = 4096
    beta_fast: float = 32.0
    beta_slow: float = 1.0
    swiglu_limit: float = 7.0
    swiglu_alpha: float = 1.702
    block: int = 32


class Backend(Protocol):
    """What runs a model: ``forward(ids, mask)`` gives (tokens, classes) scores."""

    def warmup(self) -> None: ...

    def forward(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray: ...

    def dispose(self) -> None: ...


def rms_norm(x: np.ndarray, gamma: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return x * gamma / np.sqrt((x * x).mean(axis=-1, keepdims=True) + eps)


def add_rms_norm(a: np.ndarray, b: np.ndarray, gamma: np.ndarray, eps: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    return s, rms_norm(s, gamma, eps)


def top_k(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the k greatest per row, falling; among equals the lower index first."""
    at = np.argsort(-x, axis=-1, kind="stable")[..., :k]
    return at, np.take_along_axis(x, at, axis=-1)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    total = e.sum(axis=-1, keepdims=True)
    return np.where(total > 0, e / np.where(total > 0, total, 1), 1.0 / x.shape[-1])


def router_top_k(logits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Chosen experts and their weights, which add up to 1 / k."""
    at, values = top_k(logits, k)
    return at, softmax(values) / k


def swiglu(gate_up: np.ndarray, limit: float = 7.0, alpha: float = 1.702) -> np.ndarray:
    """Gate and up interleaved on the last axis."""
    gate, up = np.minimum(gate_up[..., 0::2], limit), np.clip(gate_up[..., 1::2], -limit, limit)
    return (up + 1) * gate / (1 + np.exp(-alpha * gate))


def unpack_int4(packed: np.ndarray) -> np.ndarray:
    """Two values a byte, low half first."""
    return np.stack((packed & 15, packed >> 4), axis=-1).reshape(*packed.shape[:-1], -1)


def dequantise(packed: np.ndarray, scales: np.ndarray, zero: np.ndarray, block: int = 32) -> np.ndarray:
    """Rows of 4-bit blocks: (q - zero) * scale per block; ``zero`` is packed like the values."""
    q = unpack_int4(packed).astype(np.float32)
    z = unpack_int4(zero)[..., : scales.shape[-1]].astype(np.float32)
    return (q - np.repeat(z, block, axis=-1)[..., : q.shape[-1]]) * np.repeat(scales.astype(np.float32), block, axis=-1)[..., : q.shape[-1]]


@dataclass
class Linear:
    """A 4-bit weight of (out, in) with its bias; dequantised when it is used."""

    packed: np.ndarray
    scales: np.ndarray
    zero: np.ndarray
    bias: np.ndarray | None = None
    block: int = 32

    def __call__(self, x: np.ndarray) -> np.ndarray:
        y = x @ dequantise(self.packed, self.scales, self.zero, self.block).T
        return y if self.bias is None else y + self.bias.astype(np.float32)

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """Embedding lookup; ids out of range give zeros."""
        ok = (ids >= 0) & (ids < len(self.packed))
        at = np.where(ok, ids, 0)
        return dequantise(self.packed[at], self.scales[at], self.zero[at], self.block) * ok[:, None]


def rope_tables(n: int, c: Config) -> tuple[np.ndarray, np.ndarray]:
    """Cosines and sines of (position, pair), frequencies stretched by the YARN ramp, with its attention scaling."""
    half = c.head_dim // 2
    freq = c.theta ** (-np.arange(half, dtype=np.float64) / half)
    edge = lambda turns: half * math.log(c.rope_original / (turns * 2 * math.pi)) / math.log(c.theta)
    low, high = max(edge(c.beta_fast), 0), min(edge(c.beta_slow), half - 1)
    ramp = np.clip((np.arange(half) - low) / max(high - low, 1e-3), 0, 1)
    freq = freq / c.rope_factor * ramp + freq * (1 - ramp)
    scale = 0.1 * math.log(c.rope_factor) + 1 if c.rope_factor > 1 else 1.0
    angle = np.arange(n)[:, None] * freq[None, :]
    return (np.cos(angle) * scale).astype(np.float32), (np.sin(angle) * scale).astype(np.float32)


def rope(x: np.ndarray, cos: np.ndarray, sin: np.ndarray) -> np.ndarray:
    """Rotates interleaved pairs of (tokens, heads, dim)."""
    a, b = x[..., 0::2], x[..., 1::2]
    out = np.empty_like(x)
    out[..., 0::2] = a * cos[:, None] - b * sin[:, None]
    out[..., 1::2] = b * cos[:, None] + a * sin[:, None]
    return out


def banded_attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, sinks: np.ndarray, mask: np.ndarray, window: int) -> np.ndarray:
    """Grouped-query attention within ``window`` tokens on either side, with a sink column per head; O(T * window)."""
    t, heads, dim = q.shape
    group = heads // k.shape[1]
    out = np.zeros_like(q)
    for i in range(t):
        lo, hi = max(0, i - window), min(t, i + window + 1)
        keys, values = np.repeat(k[lo:hi], group, axis=1), np.repeat(v[lo:hi], group, axis=1)
        s = np.einsum("hd,jhd->hj", q[i], keys)
        s = np.where(mask[lo:hi][None, :] != 0, s, -np.inf)
        top = np.maximum(s.max(axis=1), sinks)
        e = np.exp(s - top[:, None])
        out[i] = np.einsum("hj,jhd->hd", e / (e.sum(axis=1) + np.exp(sinks - top))[:, None], values)
    return out


def mixture(x: np.ndarray, chosen: np.ndarray, weights: np.ndarray, gate_up: list[Linear], down: list[Linear], c: Config) -> np.ndarray:
    """Each token's experts, computed expert by expert and added up by weight."""
    out = np.zeros((len(x), c.hidden), dtype=np.float32)
    for e in np.unique(chosen):
        token, slot = np.nonzero(chosen == e)
        y = down[e](swiglu(gate_up[e](x[token]), c.swiglu_limit, c.swiglu_alpha))
        np.add.at(out, token, y * weights[token, slot][:, None])
    return out * c.top_k


@dataclass
class Block:
    norm1: np.ndarray
    q: Linear
    k: Linear
    v: Linear
    o: Linear
    sinks: np.ndarray
    norm2: np.ndarray
    router: np.ndarray
    router_bias: np.ndarray
    gate_up: list[Linear]
    down: list[Linear]

    def __call__(self, x: np.ndarray, cos: np.ndarray, sin: np.ndarray, mask: np.ndarray, c: Config) -> np.ndarray:
        h = rms_norm(x, self.norm1, c.eps)
        q = rope(self.q(h).reshape(len(x), c.heads, c.head_dim), cos, sin)
        k = rope(self.k(h).reshape(len(x), c.kv_heads, c.head_dim), cos, sin)
        v = self.v(h).reshape(len(x), c.kv_heads, c.head_dim)
        a = self.o(banded_attention(q, k, v, self.sinks, mask, c.window).reshape(len(x), -1))
        x, h = add_rms_norm(x, a, self.norm2, c.eps)
        chosen, weights = router_top_k(h @ self.router.T + self.router_bias, c.top_k)
        return x + mixture(h, chosen, weights, self.gate_up, self.down, c)


class NumpyBackend:
    """The whole classifier."""

    def __init__(self, embed: Linear, blocks: list[Block], norm: np.ndarray, classifier: np.ndarray, bias: np.ndarray, config: Config) -> None:
        self.embed, self.blocks, self.norm, self.classifier, self.bias, self.config = embed, blocks, norm, classifier, bias, config

    def warmup(self) -> None:
        self.forward(np.zeros(16, dtype=np.int64), np.ones(16, dtype=np.uint8))

    def forward(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        x = self.embed.rows(np.asarray(ids))
        cos, sin = rope_tables(len(x), self.config)
        for b in self.blocks:
            x = b(x, cos, sin, mask, self.config)
        return rms_norm(x, self.norm, self.config.eps) @ self.classifier.T + self.bias

    def dispose(self) -> None:
        self.blocks = []


class OnnxBackend:
    """A model file run by onnxruntime."""

    def __init__(self, path: str) -> None:
        try:
            import onnxruntime
        except ImportError as e:
            raise EngineError("onnxruntime is not installed", ErrorCode.BACKEND_UNAVAILABLE) from e
        self.session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        self.inputs = [i.name for i in self.session.get_inputs()]

    def warmup(self) -> None:
        self.forward(np.zeros(16, dtype=np.int64), np.ones(16, dtype=np.int64))

    def forward(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        feed = dict(zip(self.inputs, (np.asarray(ids, dtype=np.int64)[None], np.asarray(mask, dtype=np.int64)[None]), strict=False))
        return self.session.run(None, feed)[0][0]

    def dispose(self) -> None:
        self.session = None


_LOADED: dict[str, Backend] = {}


def classify(df: DataFrame, name: str, load: Callable[[], Backend], tokenizer: Tokenizer, text_col: str = "text", out_col: str = "spans", labels: tuple[str, ...] = LABELS, biases: dict[str, float] | None = None, most: int = 2048, overlap: int = 128) -> DataFrame:
    """``df`` with a model's spans. ``load`` runs once per Python worker and is remembered there under ``name``."""

    @F.pandas_udf(SPANS_SQL)
    def run(texts: pd.Series) -> pd.Series:
        if name not in _LOADED:
            _LOADED[name] = load()
            _LOADED[name].warmup()

        def one(text: str | None) -> list[dict]:
            ids, offsets = tokenizer.encode(text or "")
            seen, out = set(), []
            for s, e in chunk_starts(len(ids), most, overlap):
                if s == e:
                    continue
                tags = viterbi(_LOADED[name].forward(np.array(ids[s:e]), np.ones(e - s, dtype=np.uint8)), biases)
                for x in spans_of(tags, offsets[s : e + 1], text, labels):
                    if (key := (x["start"], x["end"], x["label"])) not in seen:
                        seen.add(key)
                        out.append(x)
            return sorted(out, key=lambda x: x["start"])

        return texts.map(one)

    return df.withColumn(out_col, run(text_col))
