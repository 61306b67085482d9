"""Array kernels of a token classifier as native columns over ``array<double>`` and as relational steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def rms_norm(x: Column, gamma: Column | None = None, eps: float = 1e-5) -> Column:
    """x * gamma / sqrt(mean of squares + eps)."""
    root = F.sqrt(total(F.transform(x, lambda v: v * v)) / F.size(x) + eps)
    out = F.transform(x, lambda v: v / root)
    return out if gamma is None else F.zip_with(out, gamma, lambda a, g: a * g)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def add_rms_norm(a: Column, b: Column, gamma: Column | None = None, eps: float = 1e-5) -> Column:
    return rms_norm(add(a, b), gamma, eps)


def softmax(x: Column) -> Column:
    """With the greatest value taken off; all alike if nothing remains."""
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    s = total(e)
    return F.transform(e, lambda v: F.when(s > 0, v / s).otherwise(1.0 / F.size(x)))


def top_k(x: Column, k: int) -> Column:
    """(index, value) of the k greatest, falling; among equals the lower index first."""
    keyed = F.transform(x, lambda v, i: F.struct((-v).alias("a"), i.alias("index"), v.alias("value")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda y: F.struct(y["index"].alias("index"), y["value"].alias("value")))


def router_top_k(x: Column, k: int) -> Column:
    """(index, weight): softmax over the chosen values, over k."""
    chosen = top_k(x, k)
    weights = softmax(F.transform(chosen, lambda c: c["value"]))
    return F.zip_with(chosen, weights, lambda c, w: F.struct(c["index"].alias("index"), (w / k).alias("weight")))


def swiglu(gate_up: Column, limit: float = 7.0, alpha: float = 1.702) -> Column:
    """Gate and up interleaved."""
    pairs = F.sequence(F.lit(0), (F.size(gate_up) / 2).cast("int") - 1)

    def one(i: Column) -> Column:
        g = F.least(F.get(gate_up, i * 2), F.lit(limit))
        u = F.greatest(F.least(F.get(gate_up, i * 2 + 1), F.lit(limit)), F.lit(-limit))
        return (u + 1) * g / (1 + F.exp(-alpha * g))

    return F.transform(pairs, one)


def rope(x: Column, position: Column, theta: float = 150_000.0) -> Column:
    """Interleaved pairs rotated by position * theta ** (-2 p / dim)."""
    half = F.size(x) / 2

    def one(v: Column, i: Column) -> Column:
        p = F.floor(i / 2)
        angle = position * F.pow(F.lit(theta), -p / half)
        other = F.get(x, F.when(i % 2 == 0, i + 1).otherwise(i - 1))
        return v * F.cos(angle) + F.when(i % 2 == 0, -other).otherwise(other) * F.sin(angle)

    return F.transform(x, one)


def zeros(n: Column | int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def gather(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Lookup by key; keys that the table lacks give null. Spark picks the join by the table's size."""
    return rows.join(table.select(key, value), key, "left")


def scatter_add(rows: DataFrame, target: str, value: str, weight: str, out: str = "value") -> DataFrame:
    """Sum of weight * value per target."""
    return rows.groupBy(target).agg(F.sum(F.col(weight) * F.col(value)).alias(out))


def matmul(x: DataFrame, w: DataFrame, row: str, inner: str, col: str, a: str, b: str, out: str = "value") -> DataFrame:
    """Sparse product of (row, inner, a) and (inner, col, b)."""
    return x.join(w, inner).groupBy(row, col).agg(F.sum(F.col(a) * F.col(b)).alias(out))


def banded_scores(rows: DataFrame, seq: str, pos: str, vector: str, window: int) -> DataFrame:
    """``seq, q, k, score`` of all pairs at most ``window`` apart: an equi-join on buckets of the window's width, so
    that a sequence's work grows with its length times the window."""
    b = F.floor(F.col(pos) / window)
    left = rows.select(F.col(seq).alias("seq"), F.col(pos).alias("q"), F.col(vector).alias("qv"), F.explode(F.array(b - 1, b, b + 1)).alias("b"))
    right = rows.select(F.col(seq).alias("seq"), F.col(pos).alias("k"), F.col(vector).alias("kv"), b.alias("b"))
    near = left.join(right, ["seq", "b"]).where(F.abs(F.col("q") - F.col("k")) <= window)
    return near.select("seq", "q", "k", total(F.zip_with("qv", "kv", lambda x, y: x * y)).alias("score"))


def banded_attention(rows: DataFrame, seq: str, pos: str, vector: str, value: str, window: int, sink: float = 0.0) -> DataFrame:
    """``seq, q, value``: attention over scalars within the band, with a sink that takes its share of the weight."""
    scores = banded_scores(rows, seq, pos, vector, window)
    w = W.partitionBy("seq", "q")
    top = F.greatest(F.max("score").over(w), F.lit(sink))
    joined = scores.withColumn("top", top).join(rows.select(F.col(seq).alias("seq"), F.col(pos).alias("k"), F.col(value).alias("v")), ["seq", "k"])
    e = F.exp(F.col("score") - F.col("top"))
    return joined.groupBy("seq", "q").agg((F.sum(e * F.col("v")) / (F.sum(e) + F.exp(F.lit(sink) - F.first("top")))).alias("value"))


def expert_histogram(routed: DataFrame, chosen: str = "chosen") -> DataFrame:
    """``expert, picks, share`` of router choices (an array of structs with ``index``)."""
    picks = routed.select(F.explode(chosen).alias("c")).groupBy(F.col("c.index").alias("expert")).agg(F.count("*").alias("picks"))
    return picks.select("expert", "picks", (F.col("picks") / F.sum("picks").over(W.partitionBy())).alias("share"))  # a row per expert


def cosine_similarities(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``a, b, cosine`` of all pairs a < b of a small table of vectors (one per expert): joined by component, so that
    only products are aggregated."""
    flat = vectors.select(F.col(key).alias("k"), F.posexplode(vector).alias("i", "v"))
    norm = flat.groupBy("k").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    unit = flat.join(norm, "k").select("k", "i", (F.col("v") / F.col("norm")).alias("v"))
    left, right = unit.select(F.col("k").alias("a"), "i", F.col("v").alias("x")), unit.select(F.col("k").alias("b"), "i", F.col("v").alias("y"))
    return left.join(right, "i").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))
