"""Coercion of raw cells. All of it is built-in expressions, so it stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character that counts as white space around a cell.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_UNITS = {"d": 86_400_000_000, "h": 3_600_000_000, "min": 60_000_000, "s": 1_000_000}
_NAMES = {"d": "days?|d", "h": "hours?|hrs?|h", "min": "minutes?|mins?|m", "s": "seconds?|secs?|s"}


def trimmed(c: Column) -> Column:
    """Text without white space around it, that of Unicode included."""
    return F.btrim(c.cast("string"), F.lit(WHITE))


def text(c: Column, upper: bool = False) -> Column:
    """Trimmed text, null where blank."""
    t = F.nullif(trimmed(c), F.lit(""))
    return F.upper(t) if upper else t


def number(c: Column, kind: T.DataType | None = None) -> Column:
    """Number in a cell, null where there is none. NaN counts as missing; ``1d`` and ``1f`` aren't numbers.

    ``kind``: the column's type where it is known; numbers then needn't be read from text.
    """
    if isinstance(kind, T.NumericType):
        n = c.cast("double")
        return F.when(~F.isnan(n), n) if isinstance(kind, (T.FloatType, T.DoubleType)) else n
    t = trimmed(c)
    n = F.when(~t.rlike(r"(?i)(?:d|(?<!in)f)$"), t.try_cast("double"))
    return F.nanvl(n, F.lit(None).cast("double"))  # names the number once: Spark computes an expression as often as it is named


def named(c: Column, use) -> Column:
    """``use(c)``, for which a row's ``c`` is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def fractional(n: Column) -> Column:
    """Whether a number isn't whole; infinity counts as such."""
    return (n != F.floor(n).cast("double")) | (F.abs(n) == float("inf"))


def whole(c: Column, kind: T.DataType | None = None) -> Column:
    """Whole number in a cell, null where it has none. Check ``fractional`` first: fractions are null here.

    Integers keep all their digits, in columns of integers as in texts.
    """
    if isinstance(kind, T.IntegralType):
        return c.cast("long")
    n = number(c, kind)
    through = F.when(~fractional(n), n.try_cast("long"))
    if isinstance(kind, T.NumericType):
        return through
    t = trimmed(c)
    return F.coalesce(F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("long")), through)


def lap_micros(c: Column, kind: T.DataType) -> Column:
    """Microseconds of a lap time. Numbers are nanoseconds; texts are clock times, amounts with units, or ISO durations."""
    if isinstance(kind, T.DayTimeIntervalType):
        return _interval_micros(c)
    if isinstance(kind, T.NumericType):
        return F.floor(c.cast("decimal(30,3)") / 1000).cast("long")
    return named(F.regexp_replace(trimmed(c), r"\s+", " "), _text_micros)


def _text_micros(t: Column) -> Column:
    """Microseconds of a lap time's text, which has single spaces."""
    clock = r"^([+-]?)(?:(\d{1,9}) days?,? ?)?([+-]?)(\d{1,9}):(\d{1,9}):(\d{1,9})(?:\.(\d+))?$"

    def told(groups: Column) -> Column:
        group = lambda k: F.get(groups, F.lit(k - 1))
        part = lambda k: F.when(group(k) == "", F.lit(0).cast("long")).otherwise(group(k).cast("long"))  # noqa: E731  # a cast that fails costs more than all else
        sign = lambda k: F.when(group(k) == "-", -1).otherwise(1)
        of_day = ((part(4) * 60 + part(5)) * 60 + part(6)) * 1_000_000 + F.rpad(group(7), 6, "0").try_cast("long")
        return sign(1) * (part(2) * _UNITS["d"] + sign(3) * of_day)

    groups = F.split(F.regexp_replace(t, clock, ";".join(f"${k}" for k in range(1, 8))), ";", -1)  # none of them holds a semicolon
    clocked = F.when(t.rlike(clock), named(groups, told))
    amount = r"(\d+(?:\.\d*)?|\.\d+)"
    spoken = "^([+-]?) ?" + "".join(rf"(?:{amount} ?(?:{n}) ?)?" for n in _NAMES.values()) + "$"
    iso = r"^([+-]?)P(?:(\d+)D)?T?(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d*)?)S)?$"

    def summed(pattern: str) -> Column:
        total = sum((F.coalesce(F.nullif(F.regexp_extract(t, pattern, k), F.lit("")).try_cast("decimal(18,9)"), F.lit(0).cast("decimal(18,9)")) * u for k, u in enumerate(_UNITS.values(), 2)), F.lit(0).cast("decimal(18,9)"))
        return F.when(t.rlike(pattern) & t.rlike(r"\d"), F.when(F.regexp_extract(t, pattern, 1) == "-", -1).otherwise(1) * F.floor(total).cast("long"))

    bare = t.rlike(r"^[+-]?[\d.]*$")
    return F.coalesce(clocked, F.when(~bare, F.coalesce(summed("(?i)" + spoken), summed(iso))))


def _interval_micros(c: Column) -> Column:
    return F.unix_micros(F.timestamp_micros(F.lit(0)) + c)


def interval(micros: Column) -> Column:
    """Day-time interval of so many microseconds."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(18,6)"))


def seconds(micros: Column) -> Column:
    return micros / 1e6


def slug(c: Column, empty: str = "unknown_event") -> Column:
    """Letters and digits in lower case, anything else one underscore; ``empty`` where nothing is left."""
    s = F.lower(F.btrim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", "_"), F.lit("_")))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(empty))


def race_id(season: Column, round_number: Column, event: Column) -> Column:
    return F.format_string("%d_%02d_%s", season, round_number, slug(event))


def positive_whole(c: Column) -> Column:
    """Whole number of at least 1, else null."""
    n = whole(c)
    return F.when(n >= 1, n.cast("int"))
