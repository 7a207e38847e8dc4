"""Expressions that find and mask sensitive spans inside one text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import body

# The pattern of each kind, in masking order.
SECRET = r'(?i)(token|secret|password|api_key) = "[0-9a-f]{40}"'
CARD = r"\b[0-9]{16}\b"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9]{1,3} \([0-9]{3}\) [0-9]{3}-[0-9]{4}"
IP = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
PATTERNS = {"secret": SECRET, "card": CARD, "email": EMAIL, "phone": PHONE, "ip": IP}

# The level a kind brings.
HIGH = ("secret", "card")
MEDIUM = ("email", "phone", "ip")

# What the JVM runs in place of the patterns above, with the same matches:
# * \b is spelled out, because its meaning for non-ASCII letters changed between JDKs;
# * an e-mail's local part may only start where a run of its characters starts (or where the
#   last match ended), else a run of n such characters without an @ costs n*n steps.
_EDGE_L, _EDGE_R = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
_JVM = {
    **PATTERNS,
    "card": CARD.replace(r"\b", _EDGE_L, 1).replace(r"\b", _EDGE_R, 1),
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))" + EMAIL,
    "ip": IP.replace(r"\b", _EDGE_L, 1).replace(r"\b", _EDGE_R, 1),
}
# A literal every match contains: a cheap test before the pattern runs.
_NEEDLE = {"secret": ' = "', "email": "@", "phone": " (", "ip": ".", "card": None}


def passes_luhn(digits: Column) -> Column:
    """Luhn check of a 16-digit string: double every other digit from the left."""

    def worth(ch: Column, i: Column) -> Column:
        digit = ch.cast("int")
        twice = digit * 2
        return F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(F.split(digits, ""), worth), F.lit(0), lambda acc, x: acc + x)
    return total % 10 == 0


def found(text: Column | str, kind: str) -> Column:
    """Array of the spans of one kind, in reading order."""
    spans = F.regexp_extract_all(body(text), F.lit(_JVM[kind]), F.lit(0))
    if kind == "card":
        spans = F.filter(spans, passes_luhn)
    if _NEEDLE[kind] is None:
        return spans
    return F.when(F.contains(body(text), F.lit(_NEEDLE[kind])), spans).otherwise(
        F.array().cast("array<string>")
    )


def all_found(text: Column | str) -> Column:
    """Struct with one array of spans per kind."""
    return F.struct(*[found(text, kind).alias(kind) for kind in PATTERNS])


def masked_value(value: Column) -> Column:
    """First two characters, then one star for each other character."""
    return F.concat(F.substring(value, 1, 2), F.repeat(F.lit("*"), F.length(value) - 2))


def masked_text(text: Column | str) -> Column:
    """The text with every span replaced by its kind in brackets."""
    col = F.regexp_replace(body(text), _JVM["secret"], "[SECRET]")
    # Only Luhn-valid runs go, so cut at the runs and put each back masked or as it was.
    runs = F.transform(
        F.regexp_extract_all(col, F.lit(_JVM["card"]), F.lit(0)),
        lambda run: F.when(passes_luhn(run), F.lit("[CARD]")).otherwise(run),
    )
    glued = F.array_join(
        F.zip_with(
            F.split(col, _JVM["card"]),
            runs,
            lambda piece, run: F.concat(piece, F.coalesce(run, F.lit(""))),
        ),
        "",
    )
    col = F.when(F.rlike(col, F.lit(_JVM["card"])), glued).otherwise(col)
    for kind in MEDIUM:
        col = F.regexp_replace(col, _JVM[kind], f"[{kind.upper()}]")
    return F.when((F.col(text) if isinstance(text, str) else text).isNotNull(), col)
