"""Text expressions: tokens, normal form, profile ratios. All run in the JVM.

A NULL text is read as an empty text everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What separates two tokens, and what counts as a symbol.
TOKEN_GAP = r"[^\p{L}\p{N}]+"
SYMBOL = r"[^\p{L}\p{N}\s]"


def body(text: Column | str) -> Column:
    """The text, or '' where it is NULL."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(col, F.lit(""))


def tokens(text: Column | str) -> Column:
    """Lower-case word tokens in reading order."""
    return F.filter(F.split(F.lower(body(text)), TOKEN_GAP), lambda t: t != "")


def normalised(text: Column | str) -> Column:
    """Tokens joined and surrounded by one blank, so containment is token-aligned."""
    words = F.trim(F.lower(F.regexp_replace(body(text), TOKEN_GAP, " ")))
    return F.concat(F.lit(" "), words, F.lit(" "))


def symbol_ratio(text: Column | str) -> Column:
    """Share of characters that are neither letter, digit nor white space; NULL if empty."""
    whole = F.length(body(text))
    # Runs of symbols go at once: the same characters, fewer matches.
    kept = F.length(F.regexp_replace(body(text), SYMBOL + "+", ""))
    return F.round(F.try_divide((whole - kept).cast("double"), whole.cast("double")), 6)


def lines(text: Column | str) -> Column:
    return F.split(body(text), "\n")
