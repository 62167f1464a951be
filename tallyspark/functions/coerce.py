"""Turning raw text cells into numbers, money and days without ever throwing.

Text rules: cells are trimmed of every Unicode blank. Numbers may carry ``$`` and thousands commas; what is left must be
a plain or exponent decimal. Days are read from a closed list of spellings, month before day where a slash date is
ambiguous, and an impossible day is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The blank characters trimmed from cells (ASCII blanks, NBSP, Unicode spaces, line separators, BOM).
BLANK_CHARS = (
    "\t\n\u000b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_PLAIN_NUMBER = NUMBER_PATTERN.replace("$", r"\z")  # a line break at the end is left to the trimming

_TIME = r"(?:[T ]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:\s*[AaPp][Mm])?)?"
_YMD_FIXED = rf"^\d{{4}}[-/]\d{{2}}[-/]\d{{2}}{_TIME}$"
_MDY_FIXED = rf"^\d{{2}}[-/]\d{{2}}[-/]\d{{4}}{_TIME}$"
_YMD = rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}}){_TIME}$"
_MDY = rf"^(\d{{1,2}})[-/](\d{{1,2}})[-/](\d{{4}}|\d{{2}}){_TIME}$"
_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)$"
_YEAR_MONTH = r"^(\d{4})(?:-(\d{1,2}))?$"
_MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
_WEEKDAY = r"(?:[A-Za-z]{3,9},?\s+)?"
_UTC = r"(?:\s*(?:GMT|UTC|Z|[+-]00:?00))?"
_MONTH_FIRST = rf"(?i)^{_WEEKDAY}({_MONTHS})[a-z]*\.?\s+(\d{{1,2}}),?\s+(\d{{4}}){_TIME}{_UTC}$"
_DAY_FIRST = rf"(?i)^{_WEEKDAY}(\d{{1,2}})[\s-]+({_MONTHS})[a-z]*\.?,?[\s-]+(\d{{4}}|\d{{2}}){_TIME}{_UTC}$"
_MONTH_YEAR = rf"(?i)^({_MONTHS})[a-z]*\.?,?[\s-]+(\d{{4}})$"
_MONTH_DAY = rf"(?i)^({_MONTHS})[a-z]*\.?[\s-]+(\d{{1,2}})$"
_DOTTED = rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}){_TIME}$"
# a time of day, then a zone by name or offset, then a remark in brackets
_ZONE_TAIL = (r"^(.*\d:\d{2}(?::\d{2}(?:\.\d+)?)?(?:\s*[AaPp][Mm])?)\s*"
              r"(Z|(?:GMT|UTC)?\s*[+-]\d{2}:?(?:\d{2})?|GMT|UTC|UT|[ECMP][SD]T)(?:\s*\([^)]*\))?$")
# Minutes that the named zones are ahead of UTC, and the year of a month and day without one.
ZONES = {"EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420}
YEARLESS = "2001"


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda cell: use(cell)), F.lit(0))


def _within(c: Column, low: str, high: str) -> Column:
    return c.between(F.lit(low), F.lit(high))


def trim_blanks(c: Column) -> Column:
    """Most cells begin and end in visible ASCII and need no search for blanks."""
    bare = _within(F.substring(c, 1, 1), "!", "~") & _within(F.substring(c, -1, 1), "!", "~")
    return F.when(bare, c).otherwise(F.btrim(c, F.lit(BLANK_CHARS)))


def number_text(c: Column) -> Column:
    """The digits of a cell: currency sign and commas removed, ``0`` when nothing else was there, null when no number."""
    def stripped(bare: Column) -> Column:
        return F.when(bare == "", F.lit("0")).when(bare.rlike(NUMBER_PATTERN), bare)

    return F.when(c.rlike(_PLAIN_NUMBER), c).otherwise(named(trim_blanks(F.translate(c, "$,", "")), stripped))


def parse_number(c: Column) -> Column:
    return number_text(c).try_cast("double")


def parse_money(c: Column, dtype: str = "decimal(38,10)") -> Column:
    return number_text(c).try_cast(dtype)


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")


def _year(y: Column) -> Column:
    """Two-digit years below 50 are in this century."""
    return F.when(F.length(y) == 4, y).when(y < "50", F.concat(F.lit("20"), y)).otherwise(F.concat(F.lit("19"), y))


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group)


def _month_number(name: Column) -> Column:
    at = F.instr(F.lit(_MONTHS.replace("|", "")), F.lower(name))
    return F.floor((at + 2) / 3).cast("string")


def parse_day(c: Column) -> Column:
    """Day of a date cell. The two fixed-width spellings come first and are cut by position, which is most of any feed.

    Zoned instants, with an offset or one of the ``ZONES``, are read as their UTC day; so is any spelling below with a zone
    behind its time. A month and day without a year is in ``YEARLESS``, as browsers have it. Eight digits without a separator are no day.
    """
    def moved(found: Column) -> Column:
        return _utc_day(_unzoned_day(found["core"]), found["core"], found["zone"])

    tail = F.struct(_part(c, _ZONE_TAIL, 1).alias("core"), _part(c, _ZONE_TAIL, 2).alias("zone"))
    zoned = F.contains(c, F.lit(":")) & c.rlike(_ZONE_TAIL)
    return F.coalesce(_unzoned_day(c), F.when(zoned, named(tail, moved)))


def _utc_day(day: Column, core: Column, zone: Column) -> Column:
    """``day`` moved by what its time of day and zone make of it in UTC."""
    clock = r"(\d{1,2}):(\d{2})(?::\d{2}(?:\.\d+)?)?\s*([AaPp])?[Mm]?$"
    hour, half = _part(core, clock, 1).try_cast("int"), F.lower(_part(core, clock, 3))
    hour = F.when(half == "p", hour % 12 + 12).when(half == "a", hour % 12).otherwise(hour)
    named = F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])
    offset = r"([+-])(\d{2}):?(\d{2})?$"
    away = _part(zone, offset, 2).try_cast("int") * 60 + F.coalesce(_part(zone, offset, 3).try_cast("int"), F.lit(0))
    ahead = F.when(zone.rlike(offset), F.when(_part(zone, offset, 1) == "-", -away).otherwise(away)).otherwise(
        F.coalesce(F.try_element_at(named, zone), F.lit(0)))
    minutes = hour * 60 + _part(core, clock, 2).try_cast("int") - ahead
    return F.date_add(day, F.floor(minutes / 1440).cast("int"))


def _unzoned_day(c: Column) -> Column:
    zoned = F.when(c.rlike(r"[+-]\d{2}$"), F.concat(c, F.lit(":00"))).otherwise(c)
    utc_day = F.to_utc_timestamp(zoned.try_cast("timestamp"), F.current_timezone()).cast("date")
    mdy_fixed = F.concat(F.substring(c, 7, 4), F.lit("-"), F.substring(c, 1, 2), F.lit("-"), F.substring(c, 4, 2))
    month = F.coalesce(F.nullif(_part(c, _YEAR_MONTH, 2), F.lit("")), F.lit("1"))
    day_first = F.when(c.rlike(_DAY_FIRST), _ymd(_year(_part(c, _DAY_FIRST, 3)), _month_number(_part(c, _DAY_FIRST, 2)),
                                                 _part(c, _DAY_FIRST, 1)))
    digits = (
        F.when(c.rlike(_YMD_FIXED), F.translate(F.substring(c, 1, 10), "/", "-").try_cast("date"))
        .when(c.rlike(_MDY_FIXED), mdy_fixed.try_cast("date"))
        .when(c.rlike(_ZONED), utc_day)
        .when(c.rlike(_YMD), _ymd(_part(c, _YMD, 1), _part(c, _YMD, 2), _part(c, _YMD, 3)))
        .when(c.rlike(_MDY), _ymd(_year(_part(c, _MDY, 3)), _part(c, _MDY, 1), _part(c, _MDY, 2)))
        .when(c.rlike(_YEAR_MONTH), _ymd(_part(c, _YEAR_MONTH, 1), month, F.lit("1")))
        .when(c.rlike(_DOTTED), _ymd(_part(c, _DOTTED, 3), _part(c, _DOTTED, 1), _part(c, _DOTTED, 2)))
        .otherwise(day_first)
    )
    letters = (
        F.when(c.rlike(_MONTH_FIRST), _ymd(_part(c, _MONTH_FIRST, 3), _month_number(_part(c, _MONTH_FIRST, 1)),
                                           _part(c, _MONTH_FIRST, 2)))
        .when(c.rlike(_MONTH_YEAR), _ymd(_part(c, _MONTH_YEAR, 2), _month_number(_part(c, _MONTH_YEAR, 1)), F.lit("1")))
        .when(c.rlike(_MONTH_DAY), _ymd(F.lit(YEARLESS), _month_number(_part(c, _MONTH_DAY, 1)), _part(c, _MONTH_DAY, 2)))
        .otherwise(day_first)
    )
    # every spelling begins with a digit or a letter, and no text is tried against those of the other kind
    first = F.substring(c, 1, 1)
    return F.when(_within(first, "0", "9"), digits).when(_within(first, "A", "z"), letters)


def number_or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("double"))


def text_or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))
