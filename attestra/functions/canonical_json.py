"""Canonical JSON: sorted keys, no blanks, shortest numbers.

Fixed-schema objects are assembled from native columns, because their key order is known when the
plan is built. Free-form JSON goes through one Arrow-batched helper.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _utf16_order(key: str) -> bytes:
    return key.encode("utf-16-be", "surrogatepass")


def json_string(value: Column) -> Column:
    """JSON text of a string column, ``null`` for null. Wrap finished text in ``lower_escapes``."""
    wrapped = F.to_json(F.array(value))
    text = F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)
    return F.coalesce(F.when(value.isNotNull(), text), F.lit("null"))


def lower_escapes(text: Column) -> Column:
    """Give control-character escapes lower-case hex digits.

    The writer prints them in upper case. An even run of backslashes in front means the backslash
    is data, not an escape. Applied once to finished text, not per member.
    """
    fixed = text
    for code in ("000B", "000E", "000F", "001A", "001B", "001C", "001D", "001E", "001F"):
        fixed = F.regexp_replace(
            fixed, rf"(?<!\\)((?:\\\\)*)\\u{code}", rf"$1\\u{code.lower()}"
        )
    return F.when(text.rlike(r"\\u00[01][A-F]"), fixed).otherwise(text)


def json_integer(value: Column) -> Column:
    return F.coalesce(value.cast("bigint").cast("string"), F.lit("null"))


def json_boolean(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def json_fixed6(value: Column) -> Column:
    """A number that carries at most six decimals, printed without trailing zeros."""
    text = F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", "")
    plain = F.when(text.isin("-0", ""), F.lit("0")).otherwise(text)
    whole = F.when(value == F.round(value, 0), value.cast("bigint").cast("string")).otherwise(plain)
    return F.when(value.isNull(), F.lit("null")).otherwise(whole)


def json_array(items: Column, element) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, element), ","), F.lit("]"))


def json_object(fields: dict[str, Column]) -> Column:
    """Object text from already encoded members; keys are ordered when the plan is built."""
    parts: list[Column] = []
    for i, key in enumerate(sorted(fields, key=_utf16_order)):
        lead = "{" if i == 0 else ","
        parts += [F.lit(f"{lead}{json.dumps(key, ensure_ascii=False)}:"), fields[key]]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")


def _number_text(value: float | int) -> str:
    if isinstance(value, int):
        if abs(value) < 10**21:
            # Integers beyond 2**53 are rounded to the nearest double by the reader.
            return str(value) if abs(value) <= 2**53 else _number_text(float(value))
        value = float(value)
    if not math.isfinite(value):
        raise ValueError("Canonical JSON rejects non-finite numbers")
    if value == 0:
        return "0"
    sign = "-" if value < 0 else ""
    mantissa, exponent = repr(abs(value)), 0
    if "e" in mantissa:
        mantissa, power = mantissa.split("e")
        exponent = int(power)
    whole, _, fraction = mantissa.partition(".")
    digits = (whole + fraction).lstrip("0")
    point = len(whole) + exponent - (len(whole + fraction) - len(digits))
    digits = digits.rstrip("0") or "0"
    if len(digits) <= point <= 21:
        return sign + digits + "0" * (point - len(digits))
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    power = point - 1
    head = digits if len(digits) == 1 else f"{digits[0]}.{digits[1:]}"
    return f"{sign}{head}e{'+' if power > 0 else '-'}{abs(power)}"


def _string_text(value: str) -> str:
    text = json.dumps(value, ensure_ascii=False)
    return "".join(f"\\u{ord(c):04x}" if 0xD800 <= ord(c) <= 0xDFFF else c for c in text)


def _key_order(key: str) -> tuple:
    # Array-index keys enumerate first, in numeric order, whatever order they were inserted in.
    if key.isascii() and key.isdigit() and str(int(key)) == key and int(key) < 2**32 - 1:
        return (0, int(key), b"")
    return (1, 0, _utf16_order(key))


def canonical_text(value: object) -> str:
    """Canonical JSON of one parsed value."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return _string_text(value)
    if isinstance(value, (int, float)):
        return _number_text(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical_text(v) for v in value) + "]"
    if isinstance(value, dict):
        members = sorted(value.items(), key=lambda item: _key_order(item[0]))
        return "{" + ",".join(f"{_string_text(k)}:{canonical_text(v)}" for k, v in members) + "}"
    raise TypeError(f"Canonical JSON rejects {type(value).__name__}")


def _reject_constant(name: str) -> float:
    raise ValueError(f"Canonical JSON rejects {name}")


@F.pandas_udf(StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    """Canonical form of free-form JSON text."""
    return raw.map(
        lambda t: canonical_text(json.loads(t, parse_constant=_reject_constant)),
        na_action="ignore",
    )
