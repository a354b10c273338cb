"""String helpers with Python-like Unicode whitespace semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One character class that both Java regex and RE2 read the same way: every
# character Python's str.isspace() accepts (Java's (?U)\s misses \x1c-\x1f,
# RE2's \s misses most of the rest).
WS_CLASS = (r"[\t\n\x0b\x0c\r \x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")

# Tokens that mean "no value" for the enrichment predicate.
BLANK_TOKENS = ("unknown", "n/a", "none")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same set as plain characters (space excluded), for translate / btrim,
# which are much cheaper per row than a regex.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


# What most strings are: no whitespace but single spaces, no whitespace at the ends. One
# cheap test spares them the work per character of translate and btrim.
NOT_PLAIN = "[^ -~]"


def ws_trim(c) -> Column:
    """Strip leading / trailing Unicode whitespace (Python ``str.strip``)."""
    c = _col(c)
    trimmed = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(trimmed, c).otherwise(F.btrim(c, F.lit(" " + WS_CHARS)))


def spaced(c) -> Column:
    """Every whitespace character -> a space."""
    return F.when(c.rlike(NOT_PLAIN), F.translate(c, WS_CHARS, " " * len(WS_CHARS))).otherwise(c)


def clean_str(c) -> Column:
    """null / "" -> ""; strip; every whitespace run -> one space.

    Only strings that then hold a double space pay for the regex."""
    s = spaced(F.coalesce(_col(c).cast("string"), F.lit("")))
    return F.trim(F.when(s.contains("  "), F.regexp_replace(s, " {2,}", " ")).otherwise(s))


def is_blank_token(c, trim: bool = True) -> Column:
    """True when the value is null, blank or one of the 'unknown' tokens."""
    v = F.lower(F.coalesce(_col(c), F.lit("")))
    if trim:
        v = ws_trim(v)
    return (v == "") | v.isin(*BLANK_TOKENS)


def needs_enrichment(make="compatible_make", ptype="part_type") -> Column:
    return is_blank_token(make) | is_blank_token(ptype)


def needs_make(make="compatible_make") -> Column:
    """Narrower predicate of the repair pass: make only, lower-cased, not trimmed."""
    return is_blank_token(make, trim=False)


def word_count(c) -> Column:
    """Number of whitespace-separated words (Python ``len(str.split())``)."""
    return F.regexp_count(spaced(F.coalesce(_col(c), F.lit(""))), F.lit("[^ ]+"))


def name_tokens(c) -> Column:
    """Lower-cased words of two or more word characters."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"(?U)\w\w+"), 0)


def strip_fence(c) -> Column:
    """Trim, then drop a leading ```json fence and a trailing ``` fence."""
    t = ws_trim(_col(c))
    stripped = F.regexp_replace(
        F.regexp_replace(t, r"^```(?:json)?" + WS_CLASS + "*", ""), WS_CLASS + r"*```$", "")
    return F.when(t.startswith("```"), stripped).otherwise(t)


def truthy(c, dtype: str) -> Column:
    """Python truthiness by Spark type: "" / 0 / false / null / [] are false."""
    c = _col(c)
    if dtype == "string":
        t = c.isNotNull() & (c != "")
    elif dtype == "boolean":
        t = F.coalesce(c, F.lit(False))
    elif dtype.startswith("array"):
        t = c.isNotNull() & (F.size(c) > 0)
    else:  # numeric; NaN is truthy in Python
        t = c.isNotNull() & ((c != 0) | F.isnan(c.cast("double")))
    return F.coalesce(t, F.lit(False))


def na_to_null(c, tokens) -> Column:
    """Null out blank strings and the CSV missing-value tokens (quirk Q9)."""
    c = _col(c)
    return F.when(c.isin(*tokens) | (c == ""), F.lit(None).cast("string")).otherwise(c)
