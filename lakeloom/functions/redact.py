"""Removing secrets from text and attribute maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that must not leave the system, matched without regard to case.
SECRET_PATTERNS = [
    r"password\s*=\s*['\"][^'\"]+['\"]",
    r"secret\s*=\s*['\"][^'\"]+['\"]",
    r"token\s*=\s*['\"][^'\"]+['\"]",
    r"api_key\s*=\s*['\"][^'\"]+['\"]",
    r"authorization:\s*bearer\s+\S+",
    r"WHERE\s+\w+\s*=\s*'[^']+'",
]

# An attribute whose name contains one of these is dropped.
FORBIDDEN_ATTRIBUTES = [
    "filter_value",
    "filter_values",
    "jwt",
    "token",
    "password",
    "secret",
    "credential",
    "authorization",
    "cookie",
    "session",
    "api_key",
    "user_email",
    "user_name",
    "pii",
    "ssn",
    "credit_card",
    "row_data",
    "query_result",
    "result_data",
]

# Fixed value: letters of the longest error that a run record holds.
MAX_MESSAGE = 500


def redact(text: Column | str) -> Column:
    """A whole text with its secrets replaced."""
    text = F.col(text) if isinstance(text, str) else text
    for pattern in SECRET_PATTERNS:
        text = F.regexp_replace(text, f"(?i){pattern}", "[REDACTED]")
    return text


def redact_message(message: Column | str, longest: int = MAX_MESSAGE) -> Column:
    """The error of a run record: secrets replaced, then cut to what a record holds."""
    text = redact(message)
    short = F.concat(F.substring(text, 1, longest - 3), F.lit("..."))
    return F.when(F.length(text) > longest, short).otherwise(text)


def safe_attributes(attributes: Column | str) -> Column:
    forbidden = "|".join(FORBIDDEN_ATTRIBUTES)
    return F.map_filter(attributes, lambda key, _: ~F.lower(key).rlike(forbidden))
