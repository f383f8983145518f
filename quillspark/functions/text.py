"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without Unicode white space, and the separators U+001C to U+001F, at either end."""
    return F.regexp_replace(c, r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", "")


def clock(seconds: Column) -> Column:
    """HH:MM:SS, cut to whole seconds; hours do not wrap."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def number(c: Column) -> Column:
    """A string as a double if it is a plain decimal number, NaN or infinity, else null."""
    plain = F.regexp_replace(strip(c), "_(?=[0-9])", "")
    return F.when(plain.rlike(r"(?i)^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$|^[+-]?(nan|inf|infinity)$"), plain.try_cast("double"))


def word_count(c: Column, ascii_only: bool = False) -> Column:
    """Runs of word characters, apostrophes and hyphens at a word boundary: those with a word
    character in them. A boundary is Unicode's own, so the ASCII form does without."""
    pattern = r"[A-Za-z0-9_'-]*[A-Za-z0-9_][A-Za-z0-9_'-]*" if ascii_only else r"(?U)\b[\w'-]+\b"
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), 0))


def redact(c: Column, secret: Column, limit: int = 1200) -> Column:
    """c with the secret blacked out, cut to limit characters."""
    return F.left(F.when(F.length(secret) > 0, F.replace(c, secret, F.lit("[REDACTED]"))).otherwise(c), F.lit(limit))


def python_json(value: Column) -> Column:
    """A string as a JSON string literal, other characters than ASCII left as they are."""
    short = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
    plain = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    shown = plain
    for k in map(chr, range(32)):
        shown = F.replace(shown, F.lit(k), F.lit(short.get(k, f"\\u{ord(k):04x}")))
    return F.concat(F.lit('"'), F.when(plain.rlike(r"[\x00-\x1f]"), shown).otherwise(plain), F.lit('"'))


def python_float(value: Column) -> Column:
    """A finite double as plain decimal digits with a point, from 0.0001 on without an exponent."""
    plain = value.cast("string")
    spread = F.regexp_replace(F.regexp_replace(plain.cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    size = F.abs(value)
    return F.when(plain.contains("E") & (size >= 1e-4) & (size < 1e16), spread).otherwise(plain)


def two_decimals(p: Column) -> Column:
    """0 to 1 with two decimals, rounded by the exact value of the double, ties to even. Below
    2**-8 it is 0.00; from there on p * 2**61 is a whole number."""
    one = 1 << 61
    whole = ((p * F.lit(float(one))).cast("long").cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)")).cast("decimal(30,0)")
    unit = F.lit(one).cast("decimal(20,0)")
    parts = F.transform(F.array(whole), lambda q: F.struct(q.alias("q"), F.floor(q / unit).cast("long").alias("n")))
    # the quotient may be rounded: n is put right by what is left
    fixed = F.transform(parts, lambda x: F.struct(x["q"].alias("q"), (x["n"] - F.when(x["n"] * unit > x["q"], 1).otherwise(0)).alias("n")))
    twice = F.transform(fixed, lambda x: F.struct(x["n"].alias("n"), ((x["q"] - x["n"] * unit) * 2).cast("decimal(38,0)").alias("r")))
    hundredths = F.get(F.transform(twice, lambda x: x["n"] + F.when((x["r"] > unit) | ((x["r"] == unit) & (x["n"] % 2 == 1)), 1).otherwise(0)), F.lit(0))
    return F.format_string("%d.%02d", F.floor(hundredths / 100), hundredths % 100)
