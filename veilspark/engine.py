"""The facade: detection and redaction of text columns, tables and streams with one configuration."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .classifier.pattern import pattern_spans
from .operators import redaction as R
from .operators.rules import Rule, call_column, no_spans, resolve, rule_spans
from .schema import LABELS, EngineError, ErrorCode

#: A backend turns a text column into model spans, sorted by start and mutually disjoint.
Backend = Callable[[Column], Column]
_BACKENDS: dict[str, Backend] = {"pattern": pattern_spans, "none": lambda text: no_spans()}


def register_backend(name: str, backend: Backend) -> None:
    """Makes a classifier available by name, for example one over a NumPy or ONNX model."""
    _BACKENDS[name] = backend


def backend_named(name: str) -> Backend:
    name = "pattern" if name == "auto" else name
    if name not in _BACKENDS:
        raise EngineError(f"unknown backend {name}; known: {', '.join(_BACKENDS)}", ErrorCode.BACKEND_UNAVAILABLE)
    return _BACKENDS[name]


class Engine:
    """Rules, presets, backend and markers that calls share; a call may replace its rules, markers or categories."""

    def __init__(
        self,
        rules: Sequence[Rule] | None = None,
        presets: Sequence[str] = (),
        backend: str = "auto",
        enabled: Sequence[str] | None = None,
        markers: R.Markers | None = None,
        min_confidence: float = 0.0,
    ) -> None:
        if not 0 <= min_confidence <= 1:
            raise EngineError("min_confidence lies between 0 and 1")
        if enabled is not None and set(enabled) - set(LABELS):
            raise EngineError(f"unknown categories: {sorted(set(enabled) - set(LABELS))}")
        self.rules, self.backend = resolve(rules, presets), backend_named(backend)
        self.enabled, self.markers, self.min_confidence = enabled, markers, min_confidence

    def spans(self, text: Column, rules: Sequence[Rule] | None = None, calls: Sequence[Column] = ()) -> Column:
        """All spans of a text as one column: the model's, the rules', merged; ``rules`` replace the session's."""
        used = self.rules if rules is None else list(rules)
        model = self.backend(F.coalesce(text, F.lit("")))
        found = R.merge(model, rule_spans(text, used, calls=calls)) if used else model
        return R.confident(found, self.min_confidence)

    def with_spans(self, df: DataFrame, text_col: str = "text", out_col: str = "spans", rules: Sequence[Rule] | None = None) -> DataFrame:
        """``df`` with the spans of a column. Function rules run first, as columns of their own."""
        calls = [r for r in (self.rules if rules is None else rules) if r.match is not None]
        names = [f"_call_{k}" for k in range(len(calls))]
        ready = df.withColumns({n: call_column(F.col(text_col), r) for n, r in zip(names, calls, strict=True)}) if calls else df
        return ready.withColumn(out_col, self.spans(F.col(text_col), rules, [F.col(n) for n in names])).drop(*names)

    def detect(self, df: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
        """``df`` with ``spans, summary, contains_pii``."""
        out = self.with_spans(df, text_col, "spans", rules)
        return out.withColumns({"summary": R.summary(F.col("spans")), "contains_pii": R.contains_pii(F.col("spans"))})

    def redact(
        self, df: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None, markers: R.Markers | None = None, enabled: Sequence[str] | None = None, resolve_overlaps: bool = False
    ) -> DataFrame:
        """``detect`` with the markers filled in, and ``redacted_text``."""
        enabled = self.enabled if enabled is None else enabled
        out = self.with_spans(df, text_col, "spans", rules)
        if resolve_overlaps:
            out = out.withColumn("spans", R.without_overlaps(F.col("spans")))
        out = out.withColumn("spans", R.with_markers(F.col("spans"), self.markers if markers is None else markers, enabled))
        return out.withColumns(
            {"redacted_text": R.splice(F.col(text_col), F.col("spans")), "summary": R.summary(F.col("spans")), "contains_pii": R.contains_pii(F.col("spans"))}
        )

    def redact_batch(self, spark: SparkSession, texts: Sequence[str], **options) -> list[dict]:
        """Results for a list of texts, in order."""
        df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
        return [r.asDict(recursive=True) for r in self.redact(df, **options).orderBy("i").drop("i").collect()]

    def register(self, spark: SparkSession, prefix: str = "pii") -> None:
        """SQL functions ``<prefix>_spans(text)``, ``<prefix>_redact(text)``: temporary functions over the native
        expressions are not possible from Python, so these run as Arrow batches of regular expressions."""
        from .classifier.local import local_redact, local_spans

        spark.udf.register(f"{prefix}_spans", local_spans(self))
        spark.udf.register(f"{prefix}_redact", local_redact(self))


def faked(df: DataFrame, engine: Engine, key: Sequence[str], order: Sequence[str], text_col: str = "text", out_col: str = "redacted_text") -> DataFrame:
    """Whole-column redaction by consistent fakes."""
    from .operators.faker import faked as run

    return run(engine.with_spans(df, text_col), list(key), list(order), text_col, "spans", out_col)

