"""Personal data, instructions inside documents, quotations and date claims."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

#: Patterns of personal data; digits are those of all scripts.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
CARD = r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)"
SSN = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
PHONE = r"(?<!\d)(?:\+1[\s.-]?)?(?:\(\d{3}\)|\d{3})[\s.-]\d{3}[\s.-]\d{4}(?!\d)"
#: Signals of instructions inside a document, in their order.
INJECTIONS = {
    "instruction_override": r"\b(ignore|disregard) (all |the )?(prior|previous)\b",
    "prompt_extraction": r"\b(system prompt|developer message|hidden instructions)\b",
    "secret_exfiltration": r"\b(reveal|print|return).{0,30}\b(secret|api key|token)\b",
    "role_impersonation": r"\b(you are now|act as|pretend to be)\b",
}
#: Dates and durations.
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
DATE = rf"(?:\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}|(?:{MONTHS})\s+\d{{1,2}}(?:,\s*|\s+)\d{{4}})"
DURATION = r"\d+(?:\.\d+)?\s+(?:(?:business|calendar|working)\s+)?(?:minute|hour|day|week|month|year)s?"
CLAIMS = [re.compile(p, re.I) for p in (rf"\b(?:within|after|before|for|by|on|until|no later than)\s+(?:{DATE}|{DURATION})\b", rf"\b{DATE}\b", rf"\b{DURATION}\b")]


def redacted_simple(text: Column) -> Column:
    """Text with e-mail addresses, social-security and telephone numbers replaced (no cards, which need a check sum)."""
    for pattern, mark in ((EMAIL, "[e]"), (SSN, "[s]"), (PHONE, "[p]")):
        text = F.regexp_replace(text, "(?U)" + pattern if mark != "[e]" else pattern, mark)
    return text


def is_card(digits: str) -> bool:
    """Luhn's test on 13 to 19 digits."""
    values = [int(d) for d in digits][::-1]
    return 13 <= len(values) <= 19 and (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def redact(text: str) -> tuple[str, int]:
    """Text with markers for personal data, and how many; addresses first, then cards, then the other numbers."""
    text, addresses = re.subn(EMAIL, "[e]", text)
    cards = [m.span() for m in re.finditer(CARD, text) if is_card("".join(filter(str.isdigit, m[0])))]
    edges = [0, *(at for span in cards for at in span), len(text)]
    text = "[c]".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
    text, people = re.subn(SSN, "[s]", text)
    text, lines = re.subn(PHONE, "[p]", text)
    return text, addresses + len(cards) + people + lines


@F.pandas_udf(StructType().add("text", StringType()).add("count", IntegerType()))
def redacted(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([redact(t) if t is not None else (None, 0) for t in text], columns=["text", "count"])


def injection_signals(text: Column) -> Column:
    """Names of the signals that a text shows, in their order."""
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?i){p}"), F.lit(name)) for name, p in INJECTIONS.items())))


def claims_of(text: str) -> list[str]:
    """Date and duration claims that don't overlap, longer patterns first, by place."""
    text, found = " ".join(text.split()), []
    for pattern in CLAIMS:
        for m in pattern.finditer(text):
            if all(m.end() <= a or m.start() >= b for a, b, _ in found):
                found.append((m.start(), m.end(), m[0]))
    return [c for _, _, c in sorted(found)]


@F.pandas_udf(ArrayType(StringType()))
def temporal_claims(text: pd.Series) -> pd.Series:
    return text.map(lambda t: claims_of(t) if t is not None else None)


def holds_quote(text: Column, quote: Column) -> Column:
    """Whether the text holds the quote with no word character on either side."""
    literal = F.concat(F.lit(r"(?U)(?<!\w)\Q"), F.replace(quote, F.lit(r"\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?!\w)"))
    return F.regexp_like(text, literal)
