"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Document rates minimise the relative entropy to "each document once" under one token constraint per source and a
bound on copies. The convex dual has one multiplier per source and the solution is an exponential tilt,
``rate = min(cap, exp(multiplier * size / mean size))``. All multipliers are found together by Newton steps, each
a distributed aggregation over the table of (source, size) classes: rates depend on nothing else. Rates become
whole copies by cumulative rounding in size order, whose error is below one largest document per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ._common import by_content, free_name, ranked, small_or_shuffled, stage, word_count

TOLERANCE = 1e-6


def source_targets(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Adds ``weight`` and ``target`` to one row per ``source`` with ``source_size``.

    Sources in code point order (null last) weigh ``cycle`` repeating. A source stops at ``cap`` times its size; the
    excess is shared again by weight until none is above. Each sharing is an aggregation over the sources, which are
    ranked by ranges, so that their number is not bounded by one task.
    """
    placed, _ = ranked(sources, [F.col("source").isNull(), F.col("source")], "mix-sources")
    w = F.element_at(F.array(*[F.lit(c) for c in cycle]), (F.col("rank") % len(cycle) + 1).cast("int"))
    placed = placed.withColumn("weight", w).drop("rank")
    level, stopped = 0.0, -1
    while True:
        stops = F.col("weight") * F.lit(level) > F.col("source_size") * float(cap)
        whole, full, open_, n = placed.agg(
            F.sum("source_size"), F.sum(F.when(stops, F.col("source_size"))), F.sum(F.when(~stops, F.col("weight"))), F.sum(stops.cast("long"))
        ).first()
        if n in (None, stopped) or not open_:
            break
        stopped = n if level else -1
        level = (whole - (full or 0) * float(cap)) / open_
    return placed.withColumn("target", F.least(F.col("source_size") * float(cap), F.col("weight") * F.lit(level)).cast("double"))


def _rate(lam: Column, z: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(lam * z, F.lit(50.0))))


def balance(classes: DataFrame, targets: DataFrame, cap: float = 3.0) -> DataFrame:
    """Newton on the dual: ``source, lam, mean`` for each source with words; ``classes`` is (source, size, n)."""
    n_sources = targets.count()
    small = lambda df: small_or_shuffled(df, 64, n_sources)  # noqa: E731  one row per source
    base = classes.join(small(targets.select("source_key", "source_size", "target", "n_docs")), "source_key").where("source_size > 0")
    base = base.withColumn("z", F.col("size") * F.col("n_docs") / F.col("source_size"))
    base = stage(base, "mix-classes")
    state = stage(
        targets.where("source_size > 0").select(
            "source_key", "target", "source_size", F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(False).alias("done")
        ),
        "mix-state",
    )
    step = 0
    while True:  # at the latest every third step halves a bracket
        step += 1
        r = _rate(F.col("lam"), F.col("z"), cap)
        sums = (
            base.select("source_key", "size", "n", "z")
            .join(small(state.where("not done").select("source_key", "lam")), "source_key")
            .groupBy("source_key")
            .agg(
                F.sum(F.col("n") * F.col("size") * r).alias("f"),
                F.sum(F.when(r < cap, F.col("n") * F.col("size") * F.col("z") * r).otherwise(0.0)).alias("slope"),
            )
        )
        gap = F.col("f") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        # A Newton step, or while it leaves the bracket a doubling of the multiplier or the bracket's middle.
        newton = F.col("lam") - gap / F.when(F.col("slope") > 0, F.col("slope"))
        wide = (hi - lo) > 1e5
        other = F.when(wide, F.when(gap < 0, F.greatest(F.col("lam") * 2, F.lit(0.5))).otherwise(F.least(F.col("lam") * 2, F.lit(-0.5)))).otherwise((lo + hi) / 2)
        fits = F.lit(step % 3 > 0) & (F.col("slope") > 0) & (newton > lo) & (newton < hi) & (F.abs(newton - F.col("lam")) <= F.greatest(F.abs(F.col("lam")), F.lit(4.0)))
        done = F.col("done") | (F.abs(gap) <= F.col("target") * TOLERANCE) | ((hi - lo) <= 1e-12 * F.greatest(F.lit(1.0), F.abs("lam"))) | (F.col("lam") > 1e4)
        state = stage(
            state.join(small(sums), "source_key", "left").select(
                "source_key",
                "target",
                "source_size",
                F.when(done, F.col("lam")).when(fits, newton).otherwise(other).alias("lam"),
                F.coalesce(lo, "lo").alias("lo"),
                F.coalesce(hi, "hi").alias("hi"),
                F.coalesce(done, F.lit(True)).alias("done"),
            ),
            "mix-state",
        )
        if state.where("not done").isEmpty():
            break
    return base.join(small(state.select("source_key", "lam")), "source_key").select(
        "source_key", "size", "n", F.when(F.col("target") >= F.col("source_size") * cap, F.lit(float(cap))).otherwise(_rate(F.col("lam"), F.col("z"), cap)).alias("rate")
    ).withColumn("rate", F.round("rate", 9))  # sums of doubles differ in their last bits from run to run


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """One row per input row: ``<id_col>, source, size, source_size, target, rate, copies, taken``.

    ``size`` is the text's words (null: 0), ``taken`` = copies * size with at most ``cap`` copies. A null source is a
    source of its own. Rows without words get rate 1 and take nothing. Equal rows are interchangeable; ids may repeat
    or be null. Ranks inside a class come from hashed sub-buckets, about the root of the class's count, so a class of
    a third of all rows is spread too. Texts of any length count whole; an empty table gives no rows; extra columns are
    ignored. Results depend on the rows alone, not on their partitioning. The table of sources is broadcast when its
    counted rows are few, else joined by shuffle.
    """
    key = F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source_col)))
    light = stage(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("source_key"), word_count(text_col).alias("size")), "mix")
    classes = stage(light.groupBy("source_key", "source", "size").agg(F.count("*").alias("n")), "mix-counts")
    sources = classes.groupBy("source_key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    targets = stage(source_targets(sources, cycle, float(cap)), "mix-targets")
    rates = balance(classes.drop("source"), targets, float(cap))
    in_order = W.partitionBy("source_key").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    plan = rates.withColumn("f0", F.coalesce(F.sum(F.col("rate").cast("decimal(12,9)") * F.col("n")).over(in_order), F.lit(0)).cast("double"))
    plan = stage(plan.withColumn("nb", F.ceil(F.sqrt("n")).cast("long")), "mix-plan")
    joined = light.join(plan, ["source_key", "size"], "left")
    h = F.xxhash64("id", F.lit(17))
    placed = joined.withColumns({"_h": h, "bucket": F.pmod(h, F.coalesce("nb", F.lit(1)))})
    own = W.partitionBy("source_key", "size", "bucket").orderBy("_h", "id")
    counts = placed.groupBy("source_key", "size", "bucket").agg(F.count("*").alias("m"))
    earlier = W.partitionBy("source_key", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("off", F.coalesce(F.sum("m").over(earlier), F.lit(0))).drop("m")
    i = F.col("off") + F.row_number().over(own) - 1
    f = lambda k: F.floor(F.col("f0") + k * F.col("rate") + 1e-9)
    ranked = placed.join(offsets, ["source_key", "size", "bucket"]).withColumn("_i", i)
    copies = F.when(F.col("rate").isNull(), F.lit(1)).otherwise(F.least(F.lit(cap), f(F.col("_i") + 1) - f(F.col("_i")))).cast("int")
    return (
        ranked.withColumn("copies", copies)
        .join(small_or_shuffled(targets.select("source_key", "source_size", "target"), 64), "source_key")
        .select(
            F.col("id").alias(id_col), "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken")
        )
    )


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cycle: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it (rows without words: once), with its columns.

    Copies are found by id, source and size: by a broadcast of the counted plan when it is small, else by a shuffle.
    Where that key repeats, the rows that share it are numbered, by content on the one side and by copies on the other,
    so that reruns agree.
    """
    words, place, copy = (free_name(df, c) for c in ("_words", "_k", "_copy"))
    plan = stage(mix(df, id_col, text_col, source_col, cycle, cap).select(F.col(id_col).alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("copies").alias("_copies")), "mix-copies")
    rows = plan.count()
    keyed = df.withColumn(words, word_count(text_col))
    if plan.groupBy("_id", "_source", "_size").count().where("count > 1").isEmpty():
        other = small_or_shuffled(plan, 64, rows)
        numbered = F.lit(True)
    else:
        keyed = keyed.withColumn(place, F.row_number().over(W.partitionBy(id_col, source_col, words).orderBy(*by_content(df, text_col))))
        other = plan.withColumn("_k2", F.row_number().over(W.partitionBy("_id", "_source", "_size").orderBy("_copies")))
        numbered = keyed[place] == other["_k2"]
    match = keyed[id_col].eqNullSafe(other["_id"]) & keyed[source_col].eqNullSafe(other["_source"]) & (keyed[words] == other["_size"])
    taken = keyed.join(other, match & numbered).where(other["_copies"] > 0)
    return taken.select(*[keyed[c] for c in df.columns], F.explode(F.sequence(F.lit(1), other["_copies"])).alias(copy)).select(*df.columns)
