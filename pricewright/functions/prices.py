"""Price parsing. ``compat=True`` reproduces the literal digit-filter rule
(quirk Q1); the default reads the first number after a currency mark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewright.functions.text import _col, ws_trim

NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
CURRENCY = r"(?:rs\.?|pkr|₨)"
# A plain decimal literal, what Python float() accepts minus inf/nan/"_"
FLOAT_LITERAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
# Digits with at most one point, few enough for exact cents.
PLAIN_AMOUNT = r"^[0-9]{1,13}(?:\.[0-9]{1,20})?\z"
# A number on both sides of the separator, the right one not a percentage.
RANGE_PATTERN = (r"(?i)[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:through|–|-)\s*(?:" + CURRENCY
                 + r"\s*)?[0-9][0-9,]*(?:\.[0-9]+)?(?:[^%0-9.,]|$)")
COMPAT_RANGE_PATTERN = r"(?i)through|–|-"


def round2(c) -> Column:
    """Round a double to cents as round(x*100)/100, half away from zero, in
    plain double arithmetic (no BigDecimal per row): the same arithmetic as
    DuckDB's round(double, 2), and Python's result except where x*100 lands
    exactly on .5 in binary (2.675 -> 2.68, Python 2.67; quirk Q2). Spark's
    own round(x, 2) rounds the shortest decimal text, which disagrees more
    often (4876.525 -> 4876.53)."""
    x = _col(c)
    return F.signum(x) * F.floor(F.abs(x) * 100 + 0.5) / 100


def round_n(c, n: int = 4) -> Column:
    """round(x * 10^n) / 10^n, half away from zero, in double arithmetic."""
    x, m = _col(c), float(10 ** n)
    return F.signum(x) * F.floor(F.abs(x) * m + 0.5) / m


def _to_money(s: Column) -> Column:
    """Guarded string -> double rounded to 2; anything unparsable -> null.

    Spark's string cast accepts a few forms Python's float() does not
    ("1d", "2f", hex "0x1p3"); those are rejected with cheap string tests
    instead of a per-row regex. NaN and infinities are not prices."""
    v = s.try_cast("double")
    tail = F.lower(F.substring(s, -1, 1))
    ok = v.isNotNull() & (F.abs(v) < float("inf")) & ~tail.isin("d", "f") & ~F.lower(s).contains("x")
    return F.when(ok, round2(v))


def finite_positive(c) -> Column:
    """price > 0 and finite; NaN sorts above +inf in Spark, so one upper bound
    excludes both (quirk Q5)."""
    c = _col(c)
    return F.coalesce((c > 0) & (c < float("inf")), F.lit(False))


def clean_price(c, dtype: str | None = None) -> Column:
    """Drop commas, strip, parse, round 2; failure -> 0.0. The literal guard
    rejects what Python float() rejects and also "nan"/"inf" (quirk Q5).

    A plain decimal is parsed at once: this expression is copied into filters, where
    each use of a part evaluates it again. A double (``dtype``) needs no text."""
    if dtype == "double":
        v = _col(c)
        return F.coalesce(F.when(F.abs(v) < float("inf"), round2(v)), F.lit(0.0))
    text = _col(c).cast("string")
    amount = F.floor(text.try_cast("double") * 100 + 0.5) / 100
    rest = _to_money(ws_trim(F.translate(text, ",", "")))
    return F.coalesce(F.when(text.rlike(PLAIN_AMOUNT), amount).otherwise(rest), F.lit(0.0))


def parse_price(c, compat: bool = False) -> Column:
    """Price text -> double, 0.0 when nothing usable."""
    c = _col(c)
    if compat:
        digits = F.regexp_replace(F.regexp_replace(c, ",", ""), r"[^0-9.]", "")
        v = _to_money(digits)
    else:
        after_mark = F.regexp_extract(c, r"(?i)" + CURRENCY + r"\s*(" + NUMBER + ")", 1)
        first = F.regexp_extract(c, "(" + NUMBER + ")", 1)
        num = F.when(after_mark != "", after_mark).otherwise(first)
        v = _to_money(F.regexp_replace(num, ",", ""))
    return F.coalesce(v, F.lit(0.0))


def parse_price_range(c) -> Column:
    """struct(low, high) over every number in the text; one -> both; none -> 0."""
    nums = F.regexp_extract_all(F.regexp_replace(_col(c), ",", ""), F.lit(r"[0-9]+(?:\.[0-9]+)?"), 0)
    vals = F.transform(nums, lambda x: round2(x.try_cast("double")))
    empty = F.size(vals) == 0
    return F.struct(
        F.when(empty, F.lit(0.0)).otherwise(F.array_min(vals)).alias("low"),
        F.when(empty, F.lit(0.0)).otherwise(F.array_max(vals)).alias("high"))


def price_text_rule(text, del_text=None, ins_text=None, compat: bool = False) -> Column:
    """Card price rule: range text -> (min, max); sale pair -> (ins, del);
    else the single price. ``original`` is 0 when equal to ``price``."""
    text = F.coalesce(_col(text), F.lit(""))
    is_range = text.rlike(COMPAT_RANGE_PATTERN if compat else RANGE_PATTERN)
    rng = parse_price_range(text)
    single = parse_price(text, compat)
    low = F.when(is_range, rng["low"])
    high = F.when(is_range, rng["high"])
    if del_text is not None and ins_text is not None:
        d, i = _col(del_text), _col(ins_text)
        has_pair = d.isNotNull() & i.isNotNull()
        low = low.when(has_pair, parse_price(i, compat))
        high = high.when(has_pair, parse_price(d, compat))
    low = low.otherwise(single)
    high = high.otherwise(single)
    return F.struct(low.alias("price"),
                    F.when(high != low, high).otherwise(F.lit(0.0)).alias("original"))


def currency_search(c) -> Column:
    """First positive amount written after 'Rs' / 'Rs.' / '₨' in the text."""
    found = F.regexp_extract_all(_col(c), F.lit(r"(?:Rs\.?\s*|₨\s*)([0-9,]+(?:\.[0-9]+)?)"), 1)
    vals = F.transform(found, lambda x: parse_price(x, compat=True))
    return F.coalesce(F.get(F.filter(vals, lambda v: v > 0), 0), F.lit(0.0))


def log_target(c) -> Column:
    return F.log1p(_col(c))


def inverse_target(c) -> Column:
    """expm1 back to the price scale, negative predictions clipped to 0."""
    return F.greatest(F.expm1(_col(c)), F.lit(0.0))


def price_band(pred, median_ae, width: float = 1.5) -> Column:
    """price -/+ width x median abs error, low clipped at 0, half-even to 0 dp."""
    p, m = _col(pred), _col(median_ae)
    return F.struct(
        F.bround(p, 0).alias("predicted_price_pkr"),
        F.bround(F.greatest(p - width * m, F.lit(0.0)), 0).alias("confidence_range_low"),
        F.bround(p + width * m, 0).alias("confidence_range_high"))


