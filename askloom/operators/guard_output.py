"""Checks on answers: empty, leaked instructions, lack of grounding, personal data."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from askloom.functions.masking import mask_pii
from askloom.functions.text import distinct_words4, let, strip_ws

# Leak signatures, texts put in place of a blocked answer, thresholds.
LEAK_SIGNATURES = [
    "as an ai language model",
    "as an ai",
    "my system instructions",
    "ignore previous instructions",
]
EMPTY_TEXT = "Unable to generate a valid response from the knowledge base."
LEAK_TEXT = "Response blocked due to meta-prompting leak or system violation."
UNGROUNDED_TEXT = (
    "The system generated a response that could not be confidently verified "
    "against the retrieved source documents."
)
DEFAULT_THRESHOLD = 0.25
PIPELINE_THRESHOLD = 0.10


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_empty_answer(answer) -> Column:
    return F.coalesce(strip_ws(answer), F.lit("")) == ""


def has_leak(answer, signatures=LEAK_SIGNATURES) -> Column:
    """Plain substring search on the lower-cased answer."""
    low = F.lower(_col(answer))
    found = F.lit(False)
    for s in signatures:
        found = found | F.contains(low, F.lit(s))
    return found


def _word_sets(answer, context) -> Column:
    context = F.coalesce(_col(context), F.array().cast("array<string>"))
    return F.struct(
        F.size(context).alias("chunks"), distinct_words4(answer).alias("a"),
        distinct_words4(F.array_join(context, " ")).alias("c"))


def overlap_ratio(answer, context) -> Column:
    """Shared distinct words over distinct answer words; ``context`` is an array of texts."""
    return let(_word_sets(answer, context), lambda w: F.when(
        F.size(w["a"]) > 0, F.size(F.array_intersect(w["a"], w["c"])) / F.size(w["a"])))


def is_grounded(answer, context, threshold: float = DEFAULT_THRESHOLD) -> Column:
    return let(_word_sets(answer, context), lambda w: (
        F.when((w["chunks"] == 0) | (F.size(w["c"]) == 0), False)
        .when(F.size(w["a"]) == 0, True)
        .otherwise(F.size(F.array_intersect(w["a"], w["c"])) / F.size(w["a"]) >= F.lit(threshold))))


def validate_output(answer, context, threshold: float = PIPELINE_THRESHOLD) -> Column:
    """First failing check wins: ``struct<text, valid, reason>``."""

    def verdict(text, valid, reason):
        return F.struct(text.alias("text"), F.lit(valid).alias("valid"), F.lit(reason).alias("reason"))

    return (
        F.when(is_empty_answer(answer), verdict(F.lit(EMPTY_TEXT), False, "EMPTY_RESPONSE"))
        .when(has_leak(answer), verdict(F.lit(LEAK_TEXT), False, "META_LEAK_BLOCKED"))
        .when(~is_grounded(answer, context, threshold),
              verdict(F.lit(UNGROUNDED_TEXT), False, "HALLUCINATION_RISK"))
        .otherwise(verdict(mask_pii(answer), True, "PASSED"))
    )
