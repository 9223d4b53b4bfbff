"""Text and number coercions of rule predicates.

Rules compare bytes; only A-Z fold. Numbers are prefixes: what follows the
digits is ignored, overflow saturates, and a text without digits is no number.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(UPPER, LOWER)
I64_MIN, I64_MAX = -(1 << 63), (1 << 63) - 1


def fold(v: Column) -> Column:
    """A-Z in lower case; every other character as it is. A text of ASCII alone
    takes the quick way, on which both rules are the same."""
    return F.when(F.octet_length(v) == F.length(v), F.lower(v)).otherwise(F.translate(v, UPPER, LOWER))


def fold_literal(text: str) -> str:
    return text.translate(_FOLD)


def to_i64(v: Column) -> Column:
    """The integer at the text's start, saturated to 64 bits; null without one."""
    digits = F.regexp_extract(v, r"^[+-]?([0-9]+)", 1)
    significant = F.regexp_extract(v, r"^[+-]?0*([0-9]*)", 1)
    negative = F.startswith(v, F.lit("-"))
    limit = F.when(negative, F.lit(I64_MIN)).otherwise(F.lit(I64_MAX))
    padded = F.when(significant == "", F.lit("0")).otherwise(significant)
    number = F.when(F.length(significant) <= 19, padded).otherwise(F.lit("0")).cast("decimal(38,0)")
    signed = F.when(negative, -number).otherwise(number)
    fits = (F.length(significant) <= 19) & signed.between(F.lit(I64_MIN), F.lit(I64_MAX))
    value = F.when(fits, F.when(fits, signed).otherwise(F.lit(0)).cast("bigint")).otherwise(limit)
    return F.when(v.isNotNull() & (digits != ""), value)


def literal_to_i64(text: str) -> int | None:
    m = re.match(r"[+-]?[0-9]+", text)
    return None if not m else max(I64_MIN, min(I64_MAX, int(m[0])))


_BLANK = r"^[ \t\n\x0B\f\r]*"
_DECIMAL = r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
_HEX = r"([+-]?)0[xX](?=\.?[0-9a-fA-F])([0-9a-fA-F]*)\.?([0-9a-fA-F]*)(?:[pP]([+-]?[0-9]+))?"


def to_f64(v: Column) -> Column:
    """The floating-point number at the text's start (after blanks), decimal or
    hexadecimal; null without one or if it isn't finite."""
    decimal = F.expr("try_cast(null as double)")
    found = F.regexp_extract(v, _BLANK + _DECIMAL, 1)
    decimal = F.when(found != "", found.try_cast("double"))
    sign, whole, part, power = (F.regexp_extract(v, _BLANK + _HEX, i) for i in (1, 2, 3, 4))
    digits = F.concat(whole, part)
    # 13 hexadecimal digits are exact in a double; further ones only scale.
    short = F.substring(F.concat(F.lit("0"), digits), 1, 14)
    dropped = F.greatest(F.length(digits) - 13, F.lit(0)) * 4
    shift = F.coalesce(power.try_cast("int"), F.lit(0)) - 4 * F.length(part) + dropped
    hexadecimal = F.conv(short, 16, 10).cast("double") * F.pow(F.lit(2.0), shift.cast("double"))
    hexadecimal = F.when(sign == "-", -hexadecimal).otherwise(hexadecimal)
    value = F.when(digits != "", hexadecimal).otherwise(decimal)
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def literal_to_f64(text: str) -> float | None:
    m = re.match(r"[ \t\n\x0b\f\r]*([+-]?0[xX](?=\.?[0-9a-fA-F])[0-9a-fA-F]*\.?[0-9a-fA-F]*(?:[pP][+-]?[0-9]+)?)", text)
    if m:
        value = float.fromhex(m[1])
    else:
        m = re.match(r"[ \t\n\x0b\f\r]*" + _DECIMAL, text)
        value = float(m[1]) if m else math.nan
    return value if math.isfinite(value) else None
