"""Report text: currency, counts, percentages, deltas and deviations.

Rounding is decided on the exact binary value of the double: halves go up for counts (``round_count``) and away from zero
for fixed digits (``fixed``), whatever the shortest decimal spelling of the number would suggest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = "\u00a0"

# En-US currency symbols; any other well-formed code is written out.
CURRENCY_SYMBOLS = {
    "USD": "$", "EUR": "€", "GBP": "£", "INR": "₹", "JPY": "¥", "CNY": "CN¥", "KRW": "₩", "CAD": "CA$", "AUD": "A$",
    "NZD": "NZ$", "HKD": "HK$", "TWD": "NT$", "MXN": "MX$", "BRL": "R$", "ILS": "₪", "VND": "₫", "PHP": "₱",
    "XAF": "FCFA", "XCD": "EC$", "XOF": f"F{NBSP}CFA", "XPF": "CFPF", "XXX": "¤",
}


def _grouped(n: Column) -> Column:
    """Whole number with thousands commas; the decimal keeps large values out of exponent form."""
    return F.format_number(n.cast("decimal(38,0)"), 0)


def round_count(v: Column) -> Column:
    """Nearest whole number, halves towards positive infinity."""
    whole = F.floor(v)
    return whole + F.when(v - whole >= 0.5, 1).otherwise(0)


def format_number(v: Column) -> Column:
    v = v.cast("double")
    text = _grouped(round_count(v))
    return F.when((v < 0) & (v >= -0.5), F.concat(F.lit("-"), text)).otherwise(text)


def format_currency(v: Column, code: Column) -> Column:
    """Whole currency amount. Unknown three-letter codes are spelled out; anything else is a plain labelled number."""
    v = v.cast("double")
    size = F.abs(v)
    whole = F.floor(size)
    digits = _grouped(whole + F.when(size - whole >= 0.5, 1).otherwise(0))
    symbols = F.create_map(*[F.lit(x) for pair in CURRENCY_SYMBOLS.items() for x in pair])
    upper = F.upper(code)
    symbol = F.coalesce(F.try_element_at(symbols, upper), F.concat(upper, F.lit(NBSP)))
    sign = F.when(v < 0, "-").otherwise("")
    # letters-only symbols stand apart from the digits
    gap = F.when(symbol.rlike("[A-Za-z]$"), NBSP).otherwise("")
    return (
        F.when(code.rlike("^[A-Za-z]{3}$"), F.concat(sign, symbol, gap, digits))
        .otherwise(F.concat(code, F.lit(" "), format_number(v)))
    )


def fixed(v: Column, digits: int) -> Column:
    """``v`` with 0 or 1 decimals. The product by ten is corrected by its own rounding error before halves are judged."""
    size = F.abs(v)
    if digits == 0:
        scaled, error = size, F.lit(0.0)
    else:
        scaled = size * 10
        error = (size * 8 - scaled) + size * 2
    whole = F.floor(scaled)
    frac = scaled - whole
    n = whole + F.when((frac > 0.5) | ((frac == 0.5) & (error >= 0)), 1).otherwise(0)
    sign = F.when(v < 0, "-").otherwise("")
    if digits == 0:
        return F.concat(sign, n.cast("string"))
    return F.concat(sign, F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def format_percent(v: Column, digits: int = 1) -> Column:
    return F.concat(fixed(v.cast("double") * 100, digits), F.lit("%"))


def format_kpi(v: Column, fmt: Column, code: Column) -> Column:
    return (
        F.when(v.isNull(), "—")
        .when(fmt == "currency", format_currency(v, code))
        .when(fmt == "percent", format_percent(v))
        .otherwise(format_number(v))
    )


def format_delta(v: Column) -> Column:
    return F.when(v.isNull(), "N/A").otherwise(F.concat(F.when(v > 0, "+").otherwise(""), format_percent(v)))


def format_deviation(method: Column, deviation: Column) -> Column:
    return (
        F.when(method == "zscore", F.concat(F.lit("z = "), fixed(deviation, 1)))
        .when(method == "iqr", F.concat(fixed(deviation, 1), F.lit("x IQR")))
        .otherwise(F.concat(F.when(deviation > 0, "+").otherwise(""), fixed(deviation * 100, 0),
                            F.lit("% vs. trailing avg")))
    )


def plain_number(v: Column) -> Column:
    """Shortest spelling of a number: no trailing ``.0``, no exponent below 1e21."""
    v = v.cast("double")
    text = F.regexp_replace(v.try_cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    whole = (v == F.floor(v)) & (F.abs(v) < 1e18)
    return F.when(whole, v.cast("bigint").cast("string")).otherwise(F.coalesce(text, v.cast("string")))


def format_method(method: Column, threshold: Column) -> Column:
    return (
        F.when(method == "zscore", F.concat(F.lit("z-score method, threshold "), plain_number(threshold)))
        .when(method == "iqr", F.concat(F.lit("IQR method, multiplier "), plain_number(threshold)))
        .otherwise(F.concat(F.lit("rolling 3-month baseline, threshold "), format_percent(threshold, 0)))
    )


def delta_polarity(delta: Column, higher_is_better: Column) -> Column:
    return (
        F.when(delta.isNull() | (delta == 0), "neutral")
        .when((delta > 0) == higher_is_better, "good")
        .otherwise("bad")
    )
