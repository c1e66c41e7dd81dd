"""Money and identifier functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that mean "no identifier" (fixed list), compared in lower case.
PLACEHOLDERS = ("", "unknown", "null", "none", "nil", "na", "n/a", "undefined", "default", "test", "not available", "not_available", "-", "?")


def rupees(amount: Column) -> Column:
    """Whole rupees with Indian grouping: 70654321 -> ₹7,06,54,321; the sign stands before the symbol."""
    digits = F.abs(F.round(amount, 0)).cast("decimal(30,0)").cast("string")
    grouped = F.transform(F.array(digits), lambda d: F.when(F.length(d) <= 3, d).otherwise(
        F.concat(F.reverse(F.regexp_replace(F.reverse(d.substr(F.lit(1), F.length(d) - 3)), r"(\d{2})(?=\d)", "$1,")), F.lit(","), d.substr(F.length(d) - 2, F.lit(3)))))[0]
    return F.concat(F.when(F.round(amount, 0) < 0, "-").otherwise(""), F.lit("₹"), grouped)


def percent(p: Column) -> Column:
    """0 -> 0%, below 0.1 % -> <0.1% (a fixed text), else one decimal; null outside [0, 1]."""
    return F.when((p < 0) | (p > 1), F.lit(None)).when(p == 0, "0%").when(p < 0.001, "<0.1%").otherwise(F.concat(F.format_number(p * 100, 1), F.lit("%")))


def normalised(value: Column | str) -> Column:
    """Trimmed, runs of white space as one space; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))


def is_placeholder(value: Column) -> Column:
    """True for values that identify nobody: the list, only zeros, or only f's, whatever the punctuation."""
    v = F.lower(normalised(value))
    bare = F.regexp_replace(v, r"[\s:\-_.]", "")
    return v.isin(*PLACEHOLDERS) | (bare == "") | F.coalesce(bare.rlike("^(0+|f+)$"), F.lit(False))


def hmac_sha256(secret: str, message: Column) -> Column:
    """Hex HMAC-SHA-256 of a text column with a fixed secret, from two SHA-256 calls."""
    key = secret.encode()
    if len(key) > 64:
        import hashlib

        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ pad for b in key).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def quantised(value: Column) -> Column:
    """Two decimals, halves away from zero."""
    return F.round(value.cast("decimal(28,10)"), 2)


def composed(value: Column) -> Column:
    """Unicode NFKC, which Spark has no function for; ASCII texts don't leave the JVM's path."""
    import pandas as pd

    @F.pandas_udf("string")
    def nfkc(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFKC")

    return F.when(value.rlike(r"^\p{ASCII}*$"), value).otherwise(nfkc(value))


def identifier_id(secret: str, kind: Column, value: Column) -> Column:
    """The id of an identifier's value: 32 hex digits of an HMAC of `kind:value`; null for values that identify nobody."""
    return F.when(~is_placeholder(value), F.substring(hmac_sha256(secret, F.concat_ws(":", kind, normalised(value))), 1, 32))


def keyed_id(secret: str, prefix: str, value: Column, digits: int) -> Column:
    """An opaque account or order id: the prefix and upper-case hex digits."""
    return F.concat(F.lit(f"{prefix}-"), F.upper(F.substring(hmac_sha256(secret, F.concat(F.lit(f"{prefix}:"), value)), 1, digits)))


def masked(kind: Column, ident: Column) -> Column:
    """The kind and the last four characters, for display."""
    return F.concat(F.initcap(F.replace(F.lower(kind), F.lit("_"), F.lit(" "))), F.lit(" ••"), F.right(ident, F.lit(4)))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5) of a text column, from one SHA-1."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def logit(p: Column, edge: float = 1e-6) -> Column:
    """log(p / (1 - p)), with p kept `edge` away from 0 and 1."""
    s = F.least(F.greatest(p, F.lit(edge)), F.lit(1 - edge))
    return F.log(s / (1 - s))
