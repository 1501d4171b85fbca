"""Redaction of personal data, and URL predicates for pages that are never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfield.functions.text import _col

# Patterns and placeholders of personal data (the last group of an account number may be short).
PATTERNS = {
    "email": (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[E-MAIL ENTFERNT]"),
    "iban": (r"\b[A-Z]{2}\d{2}(?:\s?[0-9A-Z]{4}){3,7}(?:\s?[0-9A-Z]{1,3})?\b", "[IBAN ENTFERNT]"),
    "svn": (r"\b\d{2}[\s\-.]?(?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])\d{2}[\s\-.]?[A-Z][\s\-.]?\d{3}\b", "[SVN ENTFERNT]"),
    "phone": (r"(?:(?:\+49|0049|0)[\s\-.]?)?(?:\(?\d{2,5}\)?[\s\-.]?)?\d{3,}[\s\-.]?\d{3,}(?:[\s\-.]?\d{1,4})?", "[TEL ENTFERNT]"),
}
#: Specific patterns before the phone pattern, or in the other order, which takes IBANs for phone numbers.
ORDERS = {"specific": ["email", "iban", "svn", "phone"], "phone_first": ["email", "phone", "iban", "svn"]}
# Paths of sensitive and of legal pages, metadata keys.
SENSITIVE = "/login|/auth|/signin|/signup|/register|/account|/profil|/admin|/datenschutz|/privacy|/cookie|/tracking|/bewerbung|/formular|/antrag"
LEGAL = "/impressum|/legal|/kontakt|/imprint|/ueber-uns|/about"
METADATA_MARK = "[ENTFERNT – DSGVO Art. 5]"
SENSITIVE_KEYS = ["author", "creator", "producer", "email", "phone", "user", "username", "ip", "geolocation", "location"]


def redact(text: Column | str, order: str = "specific") -> tuple[Column, dict[str, Column]]:
    """the text with placeholders, and per kind the hits found when its turn came; null stays null."""
    text, counts = _col(text), {}
    for kind in ORDERS[order]:
        pattern, mark = PATTERNS[kind]
        counts[kind] = F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, mark)
    return text, counts


def redaction_totals(df: DataFrame, text: str, by: list[str], order: str = "specific") -> DataFrame:
    """Per group the hits of every kind, and in all."""
    _, counts = redact(text, order)
    rows = df.select(*by, *[F.coalesce(c, F.lit(0)).alias(k) for k, c in counts.items()])
    sums = rows.groupBy(*by).agg(*[F.sum(k).alias(k) for k in PATTERNS])
    return sums.withColumn("total", sum((F.col(k) for k in PATTERNS), F.lit(0)))


def sanitize_metadata(data: Column | str) -> Column:
    """values of sensitive keys, in any case, are replaced."""
    return F.transform_values(_col(data), lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_KEYS), F.lit(METADATA_MARK)).otherwise(v))


def is_sensitive_url(url: Column | str) -> Column:
    """P10."""
    return F.lower(_col(url)).rlike(SENSITIVE)


def is_legal_url(url: Column | str) -> Column:
    """P11."""
    return F.lower(_col(url)).rlike(LEGAL)
