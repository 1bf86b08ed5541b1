"""Closeness of numbers and of claims as written, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The confirm tolerance.
RTOL, ATOL = 1e-6, 1e-9
LOOSE_RTOL = 5e-4
_NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def close(a: Column, b: Column, rtol: float = RTOL, atol: float = ATOL) -> Column:
    """Symmetric closeness; a missing value or NaN is close to nothing, an infinity to itself."""
    known = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    near = F.abs(a - b) <= atol + rtol * F.greatest(F.abs(a), F.abs(b))
    return F.coalesce(known & F.when(finite(a) & finite(b), near).otherwise(a == b), F.lit(False))


def parse_claim(raw: Column) -> Column:
    """Struct (value, decimals, kind) of a number as written.

    A per cent sign divides by 100 and adds two decimals, a trailing x marks a
    factor; thousands separators are ignored; decimals are null in scientific
    notation.
    """
    text = F.trim(raw.cast("string"))
    kind = F.when(text.endswith("%"), "percent").when(F.lower(F.right(text, F.lit(1))) == "x", "factor").otherwise("plain")
    token = F.regexp_extract(F.replace(text, F.lit(","), F.lit("")), _NUMBER, 0)
    value = F.when(token != "", token.try_cast("double"))
    plain = F.when(F.contains(token, F.lit(".")), F.length(token) - F.instr(token, ".")).otherwise(0)
    decimals = F.when(token.rlike("[eE]") | (token == ""), F.lit(None)).otherwise(plain)
    percent = kind == "percent"
    return F.struct(
        F.when(percent, value / 100).otherwise(value).alias("value"),
        F.when(percent, decimals + 2).otherwise(decimals).cast("int").alias("decimals"),
        kind.alias("kind"),
    )


def claim_close(claim: Column, produced: Column) -> Column:
    """Whether a produced value rounds to the claim as parsed by ``parse_claim``."""
    v, d = claim["value"], claim["decimals"]
    loose = close(v, produced, LOOSE_RTOL, ATOL)
    half = F.abs(v - produced) <= 0.5 * F.pow(F.lit(10.0), -d) + 1e-9 + 1e-9 * F.abs(v)
    rounded = F.when((d == 0) & (F.abs(v) <= 1), loose).when(d.isNotNull(), half).otherwise(loose)
    return F.coalesce(v.isNotNull() & produced.isNotNull() & ~F.isnan(produced) & rounded, F.lit(False))


def claim_pad(claim: Column) -> Column:
    """Half the width of a claim's rounding band."""
    v, d = claim["value"], claim["decimals"]
    loose = LOOSE_RTOL * F.greatest(F.abs(v), F.lit(1.0))
    return F.when((d == 0) & (F.abs(v) <= 1), loose).when(d.isNotNull(), 0.5 * F.pow(F.lit(10.0), -d) + 1e-9).otherwise(loose)
