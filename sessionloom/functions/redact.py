"""Masking of secrets, addresses and deep paths, and code-point truncation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import NOT_WS, WS, WS_CHARS, strip_ws

# What is masked, in this order, and what replaces it.
REDACTIONS = [
    (r"sk-[A-Za-z0-9_-]{12,}", "sk-REDACTED"),
    (r"ghp_[A-Za-z0-9]{12,}", "ghp_REDACTED"),
    (r"xox[baprs]-[A-Za-z0-9-]{10,}", "xox-REDACTED"),
    (r"AKIA[0-9A-Z]{12,}", "AKIA-REDACTED"),
    (
        rf"(?i)(api[_-]?key|token|secret|password|authorization){WS}*[:=]{WS}*"
        rf"{NOT_WS}+",
        "$1=REDACTED",
    ),
    (r"[\w.+-]+@[\w-]+\.[\w.-]+", "<email>"),
    (r"(?<!\w)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w)", "<ip>"),
]
TRUNCATION_MARK = " …[truncated]"


def mask(text: Column, home: str | None = None) -> Column:
    """Mask secrets and addresses and fold deep absolute paths to their last part."""
    out = F.replace(text, F.lit(home), F.lit("~")) if home else text
    for pattern, replacement in REDACTIONS:
        masked = F.regexp_replace(out, pattern, replacement)
        # The address pattern is slow on long words, so texts without the sign skip it.
        out = F.when(F.contains(text, F.lit("@")), masked).otherwise(out) if "@" in pattern else masked
    # Three or more path parts: keep only the last one.
    return F.regexp_replace(out, r"(?:/[\w.\-]+){2,}/([\w.\-]+)", "/…/$1")


def truncate(text: Column, limit: int) -> Column:
    cut = F.concat(F.rtrim(F.substring(text, 1, limit), F.lit(WS_CHARS)), F.lit(TRUNCATION_MARK))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def redact(text: Column, limit: int, home: str | None = None) -> Column:
    return truncate(strip_ws(mask(text, home)), limit)
