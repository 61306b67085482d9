"""Types, labels and errors shared by the engine."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T

# The closed set of model labels.
LABELS = ("account_number", "private_address", "private_email", "private_person", "private_phone", "private_url", "private_date", "secret")
# Severities of rules.
SEVERITIES = ("block", "warn", "track")

#: Offsets are code points, ``end`` exclusive.
SPAN = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("marker", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)
SPANS = T.ArrayType(SPAN)
SPANS_SQL = "array<struct<label:string,source:string,severity:string,start:int,end:int,text:string,marker:string,confidence:double>>"


class ErrorCode(str, Enum):
    # The public error codes.
    MODEL_DOWNLOAD_FAILED = "MODEL_DOWNLOAD_FAILED"
    BACKEND_UNAVAILABLE = "BACKEND_UNAVAILABLE"
    CALIBRATION_INVALID = "CALIBRATION_INVALID"
    INPUT_TOO_LARGE = "INPUT_TOO_LARGE"
    ABORTED = "ABORTED"
    INTERNAL = "INTERNAL"


class EngineError(Exception):
    """Raised for invalid options and unusable models; ``code`` tells which."""

    def __init__(self, message: str, code: ErrorCode = ErrorCode.INTERNAL) -> None:
        super().__init__(message)
        self.code = code
