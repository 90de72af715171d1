"""Text column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ledgerloom.fixed_values import CODE_FENCE, PUBLISHER_SEPARATOR, SENTENCE_BREAK, UNAVAILABLE
from ledgerloom.functions.numbers import Col, col


# White space as Python's str.split and re see it: ASCII plus the Unicode separators.
SPACE = r"[\s\x{85}\p{Z}\x{1c}-\x{1f}]"


def blank_to_null(c: Col) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def squeezed(c: Col) -> Column:
    """Runs of white space as one blank, ends trimmed; NULL stays NULL."""
    return F.trim(F.regexp_replace(col(c), SPACE + "+", " "))


def without_publisher(title: Col, publisher: Col) -> Column:
    """The title without its trailing " - Publisher", only when the source tag names that publisher."""
    suffix = F.concat(F.lit(PUBLISHER_SEPARATOR), col(publisher))
    cut = F.length(col(title)) - F.length(suffix)
    return F.when(
        F.endswith(col(title), suffix), F.substring(col(title), F.lit(1), cut)
    ).otherwise(col(title))


def rfc822_utc(c: Col) -> Column:
    """An RSS date such as 'Mon, 05 Oct 2026 12:00:00 GMT' as a UTC timestamp; NULL if unreadable.

    No zone, or ``-0000``, means UTC. Needs a UTC session time zone.
    """
    text = F.regexp_replace(squeezed(c), r"^[A-Za-z]{3,9},\s*", "")
    text = F.regexp_replace(text, r"\s+(GMT|UTC|UT|Z)$", " +0000")
    zones = {"EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
             "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}
    for name, offset in zones.items():
        text = F.regexp_replace(text, rf"\s+{name}$", f" {offset}")
    text = F.regexp_replace(text, r"(:\d\d)$", "$1 +0000")
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(text, F.lit("d MMM yyyy HH:mm Z")),
    )


def sentence_count(c: Col) -> Column:
    parts = F.split(F.trim(col(c)), SENTENCE_BREAK)
    return F.size(F.filter(parts, lambda p: p != ""))


def word_tokens(c: Col) -> Column:
    """Words and single punctuation marks. Counts differ from any model tokenizer's."""
    return F.regexp_extract_all(col(c), F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), F.lit(1))


def unwrapped(c: Col) -> Column:
    """A model answer without code fences and one pair of triple quotes."""
    text = F.regexp_replace(F.regexp_replace(col(c), CODE_FENCE, ""), r"^\s+|\s+$", "")
    for quote in ('"""', "'''"):
        text = F.regexp_replace(text, f"^{quote}", "")
        text = F.regexp_replace(text, f"{quote}$", "")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def markdown_escaped(c: Col) -> Column:
    """Outside text made inert in Markdown."""
    return F.replace(F.regexp_replace(col(c), r"([\\`*_\[\]])", r"\\$1"), F.lit("<"), F.lit("&lt;"))


def _as_printed(c: Column, digits: int) -> Column:
    """The double with ``digits`` decimals nearest to the exact binary value, ties to even.

    Java rounds a double's shortest decimal form half up, so 114.55, which is stored a little below that, becomes 114.6;
    printf of C and SQL prints 114.5. The rounding error of the scaled value tells on which side of a tie the exact one is. Numbers without a binary fraction at that scale stay as they are.
    """
    scale = 10.0**digits

    def nearest(x: Column) -> Column:
        a = F.abs(x)
        split = a * 134217729.0  # halves of 26 bits, whose products with the scale are exact
        high = split - (split - a)
        scaled = a * scale
        error = (high * scale - scaled) + (a - high) * scale
        whole = F.floor(scaled).cast("double")
        part = scaled - whole
        up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
        fixed = (whole + F.when(up, 1.0).otherwise(0.0)) / scale
        return F.when(a < 2.0**52 / scale, F.when(x < 0, -fixed).otherwise(fixed)).otherwise(x)

    # a one-element array binds the value once
    return F.transform(F.array(c.cast("double")), nearest)[0]


def printf(spec: str, *values: Col) -> Column:
    """``format_string`` whose %.nf prints the exact binary value, as printf of C and SQL does."""
    kinds = re.findall(r"%[-+0-9]*(?:\.(\d+))?([a-zA-Z])", spec.replace("%%", ""))
    given = [_as_printed(col(v), int(digits or 6)) if kind == "f" else col(v) for v, (digits, kind) in zip(values, kinds, strict=True)]
    return F.format_string(spec, *given)


def number_text(c: Col, spec: str, missing: str = UNAVAILABLE) -> Column:
    """``spec`` is a printf format such as ``%+.1f%%``."""
    return F.when(col(c).isNotNull(), printf(spec, c)).otherwise(F.lit(missing))


def significant4(c: Col) -> Column:
    """Four significant digits, plain or scientific the way ``%.4g`` prints them."""

    def trimmed(text: Column) -> Column:
        return F.regexp_replace(text, r"\.?0+$", "")

    def from_scientific(text: Column) -> Column:
        mantissa, power = F.substring_index(text, "e", 1), F.substring_index(text, "e", -1)
        digits = F.when(F.contains(mantissa, F.lit(".")), trimmed(mantissa)).otherwise(mantissa)
        plain = trimmed(text.cast("decimal(20,8)").cast("string"))
        return F.when(power.cast("int").between(-4, 3), plain).otherwise(F.concat(digits, F.lit("e"), power))

    # A one-element array binds the formatted text once instead of repeating it in every branch.
    return F.transform(F.array(F.format_string("%.3e", col(c).cast("double"))), from_scientific)[0]


def bullets(lines: Col) -> Column:
    return F.array_join(F.transform(col(lines), lambda line: F.concat(F.lit("- "), line)), "\n")
