"""Consistent fake values: one per (label, text), numbered per label by first appearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import ordinal

# The person pool, in order.
PERSONS = (
    "Alice Anderson", "Maria Rodriguez", "James Chen", "Olivia Patel", "Liam Nakamura", "Sophia Williams",
    "Noah Becker", "Emma Dubois", "Lucas Kowalski", "Mia Johansson", "Ethan Tanaka", "Ava Hernandez",
)


def _date_text(d: Column) -> Column:
    """A date as SQL engines other than Spark write it: a year beyond 9999 has no plus sign, one before 1 is BC."""
    before = F.concat(F.lpad((1 - F.year(d)).cast("string"), F.greatest(F.length((1 - F.year(d)).cast("string")), F.lit(4)), F.lit("0")), F.date_format(d, "-MM-dd"), F.lit(" (BC)"))
    return F.when(F.year(d) < 1, before).otherwise(F.ltrim(d.cast("string"), F.lit("+")))


def fake_value(label: Column, i: Column) -> Column:
    """The fake for the ``i``-th distinct text (from 0) of a label."""
    person = F.get(F.array(*[F.lit(p) for p in PERSONS]), (i % len(PERSONS)).cast("int"))
    n = i.cast("long")
    return (
        F.when(label == "private_person", person)
        .when(label == "private_email", F.concat(F.regexp_replace(F.lower(person), "[^a-z]+", "."), F.lit("@example.com")))
        .when(label == "private_phone", F.concat(F.lit("+1-555-01"), F.lpad((n % 100).cast("string"), 2, "0")))
        .when(label == "private_address", F.concat((n + 100).cast("string"), F.lit(" Main St, Springfield, IL "), F.lpad((n + 60000).cast("string"), F.greatest(F.length((n + 60000).cast("string")), F.lit(5)), F.lit("0"))))
        .when(label == "private_url", F.concat(F.lit("https://example.com/path/"), n.cast("string")))
        .when(label == "private_date", _date_text(F.date_add(F.lit("2026-01-01").cast("date"), (n * 7).cast("int"))))
        .when(label == "account_number", F.concat(F.lit("4111-1111-1111-"), F.lpad((n % 10000).cast("string"), 4, "0")))
        .when(label == "secret", F.lit("[secret]"))
        .otherwise(F.concat(F.lit("["), label, F.lit("]")))
    )


def dictionary(found: DataFrame, order: list[str]) -> DataFrame:
    """``label, text, fake`` of the distinct texts in ``found`` (columns label, text and ``order``).

    The numbering is global per label, as consistent fakes need. Occurrences are aggregated to their first place, and
    the distinct texts are numbered by ranges, so that no task holds all of a label.
    """
    first = found.groupBy("label", "text").agg(F.min(F.struct(*order)).alias("first"))
    return ordinal(first, "label", "first", "i").select("label", "text", fake_value(F.col("label"), F.col("i")).alias("fake"))


def faked(df: DataFrame, key: list[str], order: list[str], text_col: str, spans_col: str, out_col: str) -> DataFrame:
    """``df`` with ``out_col``: each text with its spans replaced by fakes that are consistent over the whole table.

    ``key`` identifies rows; ``order`` is their order of appearance (spans follow inside a row).
    """
    exploded = df.select(*dict.fromkeys([*key, *order]), F.posexplode(spans_col).alias("span_pos", "span"))
    named = exploded.select(*dict.fromkeys([*key, *order]), "span_pos", F.col("span.label").alias("label"), F.col("span.text").alias("text"))
    fakes = dictionary(named, [*order, "span_pos"])
    back = named.join(fakes, ["label", "text"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("span_pos", "fake"))).alias("_fakes"))
    from .redaction import splice

    joined = df.join(back, key, "left")
    spans = F.zip_with(F.col(spans_col), F.col("_fakes"), lambda s, f: s.withField("marker", f["fake"]))
    return joined.withColumn(out_col, F.when(F.col("_fakes").isNull(), F.col(text_col)).otherwise(splice(F.col(text_col), spans))).drop("_fakes")
