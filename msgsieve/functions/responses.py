"""Second-opinion requests and responses as data."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from msgsieve import fixed_values as fixed
from msgsieve.functions.evaluation import bind
from msgsieve.functions.labels import clamp01
from msgsieve.functions.text import strip

# --- fixed values -------------------------------------------------------------
JSON_OBJECT = r"(?s)(\{[^{}]*\})"
JSON_FIELDS = "label string, confidence string, reason string, _broken string"
# Numbers as Python's float() reads them from text; underscores group digits.
FLOAT_TEXT = r"(?i)^[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+)?|inf|infinity|nan)$"
JSON_BOOLEAN_CONFIDENCE = r'(?<!\\)"confidence"\s*:\s*(true|false)'


def request_prompt(text: Column) -> Column:
    """User prompt that asks for a second opinion on ``text``."""
    return F.concat(F.lit('ข้อความ: "'), text, F.lit('"'))


def parse_response(raw: Column) -> Column:
    """``struct<parse_ok, label, confidence, reason>`` of a model's answer.

    The first brace pair without inner braces must be valid JSON with a known
    label and a numeric confidence; a missing confidence counts as 0.5.  A bad
    answer gives ``parse_ok = false`` and nulls, it never fails the job.
    """
    found = F.nullif(F.regexp_extract(F.coalesce(raw, F.lit("")), JSON_OBJECT, 1), F.lit(""))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "allowSingleQuotes": "false"}
    return bind(
        found,
        lambda json: bind(F.from_json(json, JSON_FIELDS, options), lambda fields: _checked(json, fields)),
    )


def _checked(json: Column, fields: Column) -> Column:
    """Fields of a JSON object under the rules of ``parse_response``."""
    label = F.lower(strip(fields["label"]))
    keys = F.json_object_keys(json)
    boolean = F.nullif(F.regexp_extract(json, JSON_BOOLEAN_CONFIDENCE, 1), F.lit(""))
    number = strip(fields["confidence"])
    confidence = (
        F.when(~F.array_contains(keys, "confidence"), F.lit(0.5))
        .when(boolean.isNotNull(), (boolean == "true").cast("double"))
        .when(number.rlike(FLOAT_TEXT), F.replace(number, F.lit("_"), F.lit("")).try_cast("double"))
    )
    # A null reason is rendered as text, as the string conversion of null is.
    reason = F.when(
        F.array_contains(keys, "reason"), strip(F.coalesce(fields["reason"], F.lit("None")))
    ).otherwise(F.lit(""))
    valid = json.isNotNull() & fields["_broken"].isNull() & label.isin(fixed.LABELS) & confidence.isNotNull()
    return bind(
        F.coalesce(valid, F.lit(False)),
        lambda ok: F.struct(
            ok.alias("parse_ok"),
            F.when(ok, label).alias("label"),
            F.when(ok, clamp01(confidence)).alias("confidence"),
            F.when(ok, reason).alias("reason"),
        ),
    )
