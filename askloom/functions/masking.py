"""Personal-data patterns for answers, and their redaction."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

# Kind and pattern, applied in this order (the order is part of the result:
# twelve or thirteen plain digits become PHONE before CREDIT_CARD can see them).
ANSWER_PATTERNS = [
    ("EMAIL", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("PHONE", r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("CREDIT_CARD", r"\b(?:\d[ -]*?){13,16}\b"),
    ("API_KEY", r"\b(?:sk-[a-zA-Z0-9]{32,}|AKIA[0-9A-Z]{16})\b"),
    ("SSN_AADHAAR", r"\b\d{3}-\d{2}-\d{4}\b|\b\d{4}\s?\d{4}\s?\d{4}\b"),
]


# What a text must hold for a kind to be possible at all. Testing this first is far cheaper than
# running the pattern, and redaction adds none of it.
_SIGNS = {"EMAIL": ["@"], "API_KEY": ["sk-", "AKIA"]}
_DIGIT = r"(?U)\d"


def mask_pii(c, patterns=ANSWER_PATTERNS) -> Column:
    """Redact each pattern in turn. ``(?U)`` makes digits and word edges Unicode-aware."""
    text = F.col(c) if isinstance(c, str) else c

    def redact(x, kind, pattern):
        return F.regexp_replace(x, "(?U)" + pattern, f"[REDACTED_{kind}]")

    def chain(with_digits):
        out = text
        for kind, pattern in patterns:
            signs = _SIGNS.get(kind)
            if signs is not None:
                possible = reduce(or_, [F.contains(text, F.lit(s)) for s in signs])
                out = F.when(possible, redact(out, kind, pattern)).otherwise(out)
            elif with_digits:
                out = redact(out, kind, pattern)
        return out

    return F.when(text.rlike(_DIGIT), chain(True)).otherwise(chain(False))
