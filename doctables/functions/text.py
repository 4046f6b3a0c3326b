"""String-valued Column functions for document text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the white-space characters that trimming removes.
BLANKS = (
    " \t\n\r\f\u000b\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


# the same characters inside a regular expression; few ranges, since a character is compared with one after the other
WS = r"[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.transform(F.array(value), body).getItem(0)


def trim_all(c: Column) -> Column:
    """Trim every white-space character, not only spaces."""
    return F.btrim(c, F.lit(BLANKS))


# a character that is no white space, unless all there is is the word null; the first alternative tells of almost every value
PRESENT = rf"^(?:[!-MO-mo-~]|{WS}*+(?!(?i:null){WS}*\z)[^{WS[1:-1]}])"


def is_present(c: Column) -> Column:
    """Not null, not blank, and not the literal word ``null``."""
    # one pattern, since many columns are tested in one expression, which must stay small enough to be compiled
    return F.coalesce(c.cast("string").rlike(PRESENT), F.lit(False))


def clean_markdown(c: Column) -> Column:
    """Unwrap a fenced markdown block up to three times, drop image links, shorten separator runs."""
    text = trim_all(F.coalesce(c, F.lit("")))
    fence = r"(?s)\A```markdown\n(.*)\n```\z"
    for _ in range(3):
        text = let(text, lambda x: F.when(
            x.startswith("```markdown") & x.endswith("```"), trim_all(F.regexp_replace(x, fence, "$1"))).otherwise(x))
    text = F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)" + WS + "*", "")
    text = F.regexp_replace(text, "_{10,}", "---")
    return F.regexp_replace(text, "[-=~*.]{200,}", "---")


def normalize_markdown(c: Column) -> Column:
    """Line-break tags become spaces and bold markers go away."""
    return F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)<br\s*/?>", " "), F.lit("**"), F.lit(""))


# Rewrites from markdown to plain text, applied in this order before cells and dashes. The marks behind each tell which texts
# it can change; without marks it is a plain character.
PLAIN_TEXT_REWRITES = (
    (r"(\*\*|__)(.*?)\1", "$2", ("**", "__")),
    (r"(\*|_)(.*?)\1", "$2", ("*", "_")),
    ("#+" + WS, "", ("#",)),
    (r"\[(.*?)\]\(.*?\)", "$1", ("](",)),
    (r"!\[(.*?)\]\(.*?\)", "$1", ("![",)),
    (r"```.*?\n(?s:.*?)\n```|`.*?`", "", ("`",)),
    (">", "", None),
    (r"\n{2,}", "\n", ("\n\n",)),
)


def _unwrap_cells(c: Column) -> Column:
    """``|cell|`` becomes the trimmed cell, from left to right; a last bar without a partner stays."""
    def piece(p: Column, i: Column, n: Column) -> Column:
        return F.when(i % 2 == 0, p).when(i < n - 1, trim_all(p)).otherwise(F.concat(F.lit("|"), p))

    return let(F.split(c, r"\|"), lambda ps: F.array_join(F.transform(ps, lambda p, i: piece(p, i, F.size(ps))), ""))


def markdown_to_text(c: Column) -> Column:
    """Plain text of a markdown string. A text without a rewrite's marks is not searched for its pattern."""
    for pattern, replacement, marks in PLAIN_TEXT_REWRITES:
        if marks is None:  # a plain character
            c = F.replace(c, F.lit(pattern), F.lit(replacement))
        else:
            c = let(c, lambda x: F.when(reduce(or_, [x.contains(m) for m in marks]), F.regexp_replace(x, pattern, replacement)).otherwise(x))
    c = let(c, lambda x: F.when(x.contains("|"), _unwrap_cells(x)).otherwise(x))
    return trim_all(F.replace(c, F.lit("-"), F.lit("")))


def table_cells(line: Column) -> Column:
    """Non-empty trimmed cells of a pipe-table line; null for any other line."""
    text = trim_all(line)
    inner = F.substring(text, 2, F.greatest(F.length(text) - 2, F.lit(0)))
    cells = F.filter(F.transform(F.split(inner, r"\|"), trim_all), lambda x: x != "")
    return F.when(is_table_line(line), cells)


def is_table_line(line: Column) -> Column:
    text = trim_all(line)
    # most lines have no blanks around
    return (line.startswith("|") & line.endswith("|")) | (text.startswith("|") & text.endswith("|"))


def clean_charge_name(c: Column) -> Column:
    """Drop a leading one-character code and leading three-letter codes."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), f"^{WS}*[A-Z0-9]{WS}+", "")
    text = trim_all(F.regexp_replace(text, f"^{WS}*(?:[A-Z]{{3}}{WS}+)+", ""))
    # most names begin with a word that is no code
    return F.when(c.rlike("^[A-Z][a-z]"), trim_all(c)).otherwise(text)


def norm_key(c: Column) -> Column:
    """Lower-case identifier without anything but letters and digits."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def norm_text(c: Column) -> Column:
    """Lower-case text with dashes and underscores as single spaces."""
    return F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "[-–—_]+", " ")


def cap_words(c: Column, n: int = 20) -> Column:
    """First ``n`` words; an ellipsis marks what was cut."""
    words = F.split(trim_all(F.regexp_replace(c, WS + "+", " ")), " ")
    return F.concat(F.array_join(F.slice(words, 1, n), " "),
                    F.when(F.size(words) > n, F.lit("…")).otherwise(F.lit("")))


def file_stem(c: Column) -> Column:
    """Normalised stem of the last path segment, at most 255 characters."""
    base = F.element_at(F.split(c, "/"), -1)
    stem = F.regexp_extract(base, r"^([^.]*)", 1)
    stem = F.regexp_replace(stem, r"[^\w\s]", "")
    return F.substring(F.lower(F.regexp_replace(stem, r"\s+", "_")), 1, 255)


def safe_name(c: Column) -> Column:
    """Last path segment with characters unsafe for storage replaced by ``_``."""
    return F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"[^\w.\- ]+", "_")


def display_name(first: Column, last: Column, email: Column, default: Column | None = None) -> Column:
    """First and last name, else e-mail, else the default."""
    name = F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(last, F.lit("")))
    parts = [F.nullif(name, F.lit("")), F.nullif(email, F.lit(""))]
    return F.coalesce(*parts, *([default] if default is not None else []))
