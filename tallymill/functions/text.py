"""Number tokens, text clean-up and text for speech."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number, first as written, then with grouped thousands.
NUMBER = r"\$?\d+(?:\.\d+)?"
GROUPED_NUMBER = r"\$?\d+(?:,\d{3})*(?:\.\d+)?"

# Patterns rewritten for speech.
DOLLARS = r"\$(\d+(?:,\d{3})*(?:\.\d+)?)"
ISO_DATE = r"(?U)\b\d{4}-\d{2}-\d{2}\b"
EMAIL = r"(?U)\b([A-Za-z0-9._%+-]+)@([A-Za-z0-9.-]+\.[A-Za-z]{2,})\b"

# Rewrites of the second rule set, in order.
SPACE = r"[\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
WEB_REWRITES = (
    ("₹", "rupees "),
    (r"\$", "dollars "),
    ("€", "euros "),
    ("£", "pounds "),
    ("%", " percent "),
    (r"(\d+)\.(\d+)", "$1 point $2"),
    (r"\n+", ". "),
    (rf"([.!?]){SPACE}+", "$1 "),
    (rf"^{SPACE}+|{SPACE}+$", ""),
)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def find_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def number_tokens(text: Column, mode: str = "exact") -> Column:
    """Distinct number tokens of a text.

    "exact" keeps tokens as written, so ``$12`` and ``12`` differ and a thousands
    separator splits a number. "normalized" reads ``$1,200.50`` as ``1200.5``.
    """
    if mode == "exact":
        return F.array_distinct(find_all(text, NUMBER))
    if mode == "normalized":
        return F.array_distinct(_plain_numbers(F.array_distinct(find_all(text, GROUPED_NUMBER))))
    raise ValueError(f"unknown mode {mode!r}")


def _plain_numbers(tokens: Column) -> Column:
    """Numbers without signs, separators and zeros that say nothing.

    Most tokens have no such zeros, and patterns are run only on those that may.
    """

    def without_zeros_before(digits: Column) -> Column:
        return F.when(digits.startswith("0"), F.regexp_replace(digits, r"^0+(?=\d)", "")).otherwise(digits)

    def without_zeros_after(digits: Column) -> Column:
        short = F.regexp_replace(F.regexp_replace(digits, r"(\.\d*?)0+$", "$1"), r"\.$", "")
        return F.when(F.contains(digits, F.lit(".")), short).otherwise(digits)

    plain = F.transform(tokens, lambda token: F.translate(token, "$,", ""))
    return F.transform(F.transform(plain, without_zeros_before), without_zeros_after)


def _spoken_date(date: Column) -> Column:
    day = F.try_to_date(date, "yyyy-MM-dd")
    known = day >= F.lit("0001-01-01").cast("date")
    return F.when(known, F.date_format(day, "MMMM d, yyyy")).otherwise(date)


def _replace_dates(text: Column) -> Column:
    between = F.split(text, ISO_DATE, -1)
    spoken = F.transform(find_all(text, ISO_DATE), _spoken_date)
    pieces = F.zip_with(
        between, spoken, lambda piece, date: F.concat(piece, F.coalesce(date, F.lit("")))
    )
    return F.array_join(pieces, "")


def speech_text(text: Column, rules: str = "voice") -> Column:
    """Rewrite a text so that it reads well aloud.

    "voice" spells out dollar amounts, ISO dates and the @ of e-mail addresses.
    "web" replaces currency signs, percent signs, decimal points and line breaks.
    """
    if rules == "voice":
        text = F.regexp_replace(text, DOLLARS, "$1 dollars")
        text = _replace_dates(text)
        return F.regexp_replace(text, EMAIL, "$1 at $2")
    if rules == "web":
        for pattern, replacement in WEB_REWRITES:
            text = F.regexp_replace(text, pattern, replacement)
        return F.when(F.length(text) > 0, F.concat(text, F.lit(" ."))).otherwise(text)
    raise ValueError(f"unknown rules {rules!r}")


def pseudonym(secret: Column) -> Column:
    return F.sha2(secret, 256)
