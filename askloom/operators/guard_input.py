"""Checks on questions: toxicity verdict and removal of personal data.

The recogniser patterns and scores are parameters of this library.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, functions as F

from askloom.functions.text import let

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@dataclass(frozen=True)
class Recognizer:
    entity: str
    pattern: str
    score: float
    sign: str = "[0-9]"     # a text without this cannot match; tested first because it is cheap
    luhn: bool = False


# Applied in this order, so a card number is not taken for a phone number.
RECOGNIZERS = [
    Recognizer("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 1.0, sign="@"),
    Recognizer("CREDIT_CARD", r"\b(?:[0-9][ -]?){12,18}[0-9]\b", 1.0, luhn=True),
    Recognizer("IP_ADDRESS", rf"\b{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\b", 0.6),
    Recognizer("US_SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.85),
    Recognizer("PHONE_NUMBER", r"(?:\+[0-9]{1,3}[ .-]?)?\(?\b[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}\b", 0.75),
]
SCORE_THRESHOLD = 0.6
TOXICITY_THRESHOLD = 0.5

# Reasons in the verdict.
REASON_CLEAN = "Clean prompt."
REASON_PII = "PII detected and redacted."
REASON_TOXIC = "Content flagged for toxicity (Confidence: %.2f)."


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _passes_luhn(value: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(value, "[ -]", ""))


def _hits(text: Column, r: Recognizer) -> Column:
    values = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))
    if r.luhn:
        values = F.filter(values, _passes_luhn)
    return F.when(text.rlike(r.sign), F.transform(values, lambda v: F.struct(
        F.lit(r.entity).alias("entity"), v.alias("value"), F.lit(r.score).alias("score")))
    ).otherwise(F.array().cast("array<struct<entity:string,value:string,score:double>>"))


def _replace_checked(text: Column, r: Recognizer) -> Column:
    """Replace the matches that pass the check: what lies between matches, and the matches, in turn."""
    between = F.split(text, r.pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))
    return F.array_join(F.zip_with(between, matches, lambda part, match: F.concat(part, F.when(
        match.isNull(), "").when(_passes_luhn(match), f"<{r.entity}>").otherwise(match))), "")


def detect_pii(df: DataFrame, text: str = "text", recognizers=None,
               threshold: float = SCORE_THRESHOLD) -> DataFrame:
    """One row per match: the columns of ``df`` but the text, then entity, value, score."""
    found = [_hits(F.col(text), r) for r in recognizers or RECOGNIZERS if r.score >= threshold]
    keep = [c for c in df.columns if c != text]
    # the outer form: for the inner one the optimizer adds a filter that searches once more
    return df.select(*keep, F.inline_outer(F.concat(*found))).filter(F.col("entity").isNotNull())


def anonymize_pii(text, recognizers=None, threshold: float = SCORE_THRESHOLD) -> Column:
    """Put ``<ENTITY>`` in place of each kept match, one recogniser after the other."""
    raw = _col(text)
    kept = [r for r in recognizers or RECOGNIZERS if r.score >= threshold]
    out = raw
    # Neighbours with the same sign share one test. A placeholder adds no sign to the text.
    for sign, group in groupby(kept, key=lambda r: r.sign):
        done = out
        for r in group:
            done = (_replace_checked(done, r) if r.luhn
                    else F.regexp_replace(done, r.pattern, f"<{r.entity}>"))
        out = F.when(raw.rlike(sign), done).otherwise(out)
    return out


def is_toxic(toxic_score, toxic=None, threshold: float = TOXICITY_THRESHOLD) -> Column:
    """Score from the threshold up, and the predicted label if given. Unknown means no."""
    flagged = _col(toxic_score) >= F.lit(threshold)
    if toxic is not None:
        flagged = _col(toxic) & flagged
    return F.coalesce(flagged, F.lit(False))


def validate_input(text, toxic_score, toxic=None, threshold: float = TOXICITY_THRESHOLD,
                   recognizers=None) -> Column:
    """``struct<status, reason, sanitized>``; personal data is looked for only when not toxic."""
    raw = _col(text)
    return (
        F.when(is_toxic(toxic_score, toxic, threshold), F.struct(
            F.lit("REJECTED").alias("status"),
            F.format_string(REASON_TOXIC, _col(toxic_score)).alias("reason"),
            F.lit(None).cast("string").alias("sanitized")))
        .otherwise(let(anonymize_pii(raw, recognizers), lambda clean: F.struct(
            F.lit("ACCEPTED").alias("status"),
            F.when(clean.eqNullSafe(raw), REASON_CLEAN).otherwise(REASON_PII).alias("reason"),
            clean.alias("sanitized"))))
    )
