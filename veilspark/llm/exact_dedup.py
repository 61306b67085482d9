"""Exact deduplication by progressive refinement, in DataFrame functions only.

Texts are equal when identical after deleting blanks. Rows are separated by length, then by a hash of the first
characters, and only rows that still share a group are compared by the hash of their full content; a group's count
decides each step, so no group is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import by_content, free_name, small_or_shuffled, stage, text_or_empty, without_blanks

PREFIX_CHARS = 64


def refine(light: DataFrame) -> DataFrame:
    """Of rows with ``n_bytes`` and ``prefix_hash``, those whose (length, prefix) group has another row."""
    shared_length = light.groupBy("n_bytes").count().where("count > 1").select("n_bytes")
    # A length is a number up to the longest text: the table is counted before it is broadcast.
    at_length = light.join(small_or_shuffled(shared_length, 16), "n_bytes", "left_semi")
    shared_prefix = at_length.groupBy("n_bytes", "prefix_hash").count().where("count > 1").select("n_bytes", "prefix_hash")
    # Staged, so that this side is dealt out by an exchange of its own and Spark can split a hot group of the other.
    shared_prefix = stage(shared_prefix, "exact-prefixes")
    return light.join(shared_prefix, ["n_bytes", "prefix_hash"], "left_semi")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``<id_col>, n_chars, text_sha256, keep_id, group_size, kept``.

    The longest original text stays (code points), then the smallest id; a null id comes last, and of wholly equal
    rows exactly one is kept. Null text counts as empty. Extra columns are ignored; an empty table gives none.
    The texts are read in one scan that leaves a narrow table; every later step moves only that.
    """
    norm = without_blanks(text_or_empty(text_col))
    light = stage(
        df.select(
            F.col(id_col).alias("id"),
            F.length(text_or_empty(text_col)).cast("long").alias("n_chars"),
            norm.alias("_norm"),
        ).select(
            "id",
            "n_chars",
            F.octet_length("_norm").alias("n_bytes"),
            F.xxhash64(F.substring("_norm", 1, PREFIX_CHARS)).alias("prefix_hash"),
            F.sha2("_norm", 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row_at"),
        ),
        "exact",
    )
    best = F.struct((-F.col("n_chars")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("c"), F.col("row_at").alias("d"))
    groups = (
        refine(light)
        .groupBy("text_sha256")
        .agg(F.count("*").alias("size"), F.min(best).alias("best"))
        .where("size > 1")
    )
    joined = light.join(stage(groups, "exact-groups"), "text_sha256", "left")
    return joined.select(
        F.col("id").alias(id_col),
        "n_chars",
        "text_sha256",
        F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("best.c")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.col("best.d") == F.col("row_at"))).alias("kept"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all of its columns.

    Rows are matched through (id, length) of the dropped ones, counted: where ids repeat, as many rows of an id and
    normal form stay as the operator keeps, the first by content. Columns of any name are left as they are.
    """
    sha_col, chars_col, place = (free_name(df, c) for c in ("_sha", "_chars2", "_rn"))
    out = exact_duplicates(df, id_col, text_col)
    dropped = out.where(~F.col("kept")).groupBy(id_col, "text_sha256", F.col("n_chars").alias("_chars")).agg(F.count("*").alias("_gone"))
    sha = F.sha2(without_blanks(text_or_empty(text_col)), 256)
    keyed = df.withColumns({sha_col: sha, chars_col: F.length(text_or_empty(text_col)).cast("long")})
    gone = dropped.select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_s"), F.col("_chars"), "_gone")
    n = gone.count()
    cond = keyed[id_col].eqNullSafe(gone["_id"]) & (keyed[sha_col] == gone["_s"]) & (keyed[chars_col] == gone["_chars"])
    kept = out.where("kept").groupBy(id_col, "text_sha256", F.col("n_chars").alias("_chars")).agg(F.count("*").alias("_stay"))
    mixed = gone.join(kept, (gone["_id"].eqNullSafe(kept[id_col])) & (gone["_s"] == kept["text_sha256"]) & (gone["_chars"] == kept["_chars"]), "left_semi")
    if mixed.isEmpty():
        return keyed.join(small_or_shuffled(gone, 128, n), cond, "left_anti").select(*[keyed[c] for c in df.columns])
    # Equal rows (same id, same text) of which one stays: keep the first of each by a rank inside the equal rows.
    from pyspark.sql import Window as W

    w = W.partitionBy(id_col, sha_col, chars_col).orderBy(*by_content(df, text_col))
    stay = kept.select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_s"), "_chars", "_stay")
    ranked = keyed.withColumn(place, F.row_number().over(w))
    cond = ranked[id_col].eqNullSafe(stay["_id"]) & (ranked[sha_col] == stay["_s"]) & (ranked[chars_col] == stay["_chars"])
    return ranked.join(stay, cond).where(ranked[place] <= stay["_stay"]).select(*[ranked[c] for c in df.columns])
