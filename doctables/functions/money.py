"""Amount parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doctables.functions.text import WS, let

# Fixed value: a decimal amount with two places that no digit or dot follows.
MONEY = r"(\d[\d,]*(?:\.\d{2}|,\d{2}))(?![\d.])"


def money_tokens(line: Column) -> Column:
    """All money-like tokens of a line, as text."""
    return F.regexp_extract_all(line, F.lit(MONEY), F.lit(1))


def parse_amount(c: Column) -> Column:
    """Locale-aware value of the first number in a text.

    The later of ``,`` and ``.`` is the decimal sign; a lone comma is one when at most two digits
    follow; four or more bare digits carry two implied decimals.
    """
    raw = F.regexp_extract(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("**"), F.lit("")),
                           r"\d[\d.,]*", 0)

    def value(r: Column) -> Column:
        comma, dot = F.instr(F.reverse(r), ","), F.instr(F.reverse(r), ".")
        no_comma = F.replace(r, F.lit(","), F.lit(""))

        def as_point(x: Column) -> Column:
            return F.regexp_replace(x, "^([^,]*),", "$1.")

        text = (
            F.when((comma > 0) & (dot > 0) & (comma < dot), as_point(F.replace(r, F.lit("."), F.lit(""))))
            .when((comma > 0) & (dot > 0), no_comma)
            .when((comma > 0) & (comma <= 3), as_point(r))
            .when(comma > 0, no_comma)
            .when(dot > 0, r)
            .when(F.length(r) >= 4, F.regexp_replace(r, r"^(\d+)(\d\d)$", "$1.$2"))
            .otherwise(r)
        )
        return F.regexp_extract(text, r"^\d*\.?\d*", 0).try_cast("double")

    # one number with one decimal sign, as most amounts are written, needs none of that
    plain = c.cast("string")
    return (F.when(plain.rlike(r"^\d+\.\d+\z"), plain.try_cast("double"))
            .when(plain.rlike(r"^\d+,\d{1,2}\z"), F.replace(plain, F.lit(","), F.lit(".")).try_cast("double")).otherwise(let(raw, value)))


def to_num(c: Column) -> Column:
    """Numeric prefix of a text after dropping thousands commas, blanks and currency signs."""
    text = F.regexp_replace(c.cast("string"), f"[,{WS[1:-1]}$€£]", "")
    prefix = r"^[+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
    return F.regexp_extract(text, prefix, 0).try_cast("double")
