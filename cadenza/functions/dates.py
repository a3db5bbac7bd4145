"""Dates and times from text, tolerances between dates, and date labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.text import fold

#: Month names as they are written in listings (fixed values).
MONTHS = {
    "pt": ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"),
    "es": ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
    "en": ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"),
    "fr": ("janvier", "fevrier", "mars", "avril", "mai", "juin", "juillet", "aout", "septembre", "octobre", "novembre", "decembre"),
    "de": ("januar", "februar", "marz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"),
}


def month_number(name: Column) -> Column:
    """1..12 of a month's name in any of the languages, or its first three letters."""
    table = {}
    for names in MONTHS.values():
        for i, n in enumerate(names, 1):
            table.setdefault(n, i)
            table.setdefault(n[:3], i)
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), fold(name))


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.format_string("%s-%s-%s", y, F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def _parts(found: Column) -> Column:
    """What stands between the signs of a date that has been found; articles are left out."""
    return F.split(F.regexp_replace(found, r"(?i)[ºª.,/-]|\bde\b|(?<=\d)(?:st|nd|rd|th)\b", " "), r"\s+")


def _ordered(parts: Column, y: int, m: int, d: int, named: bool = False) -> Column:
    month = F.get(parts, m)
    return _ymd(F.get(parts, y), month_number(month) if named else month, F.get(parts, d))


# Each is matched once; what it has found is cut into its parts.
_ISO = r"\d{4}-\d{2}-\d{2}"
_NUMBERS = r"\d{1,2}[/.-]\d{1,2}[/.-]\d{4}"
_DAY_FIRST = r"\d{1,2}[ºª.]?\s+(?:de\s+)?\p{L}{3,}\.?\s+(?:de\s+)?\d{4}"
_MONTH_FIRST = r"\p{L}{3,}\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4}"


def parse_date(c: Column | str) -> Column:
    """ISO, day-first numbers, 'day (de) month (de) year' or 'month day, year'; null if there is no such date."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    iso = F.try_to_date(F.regexp_extract(c, rf"^({_ISO})(?:[T ].*)?$", 1), "yyyy-MM-dd")
    ways = ((_NUMBERS, 2, 1, 0, False), (_DAY_FIRST, 2, 1, 0, True), (_MONTH_FIRST, 2, 0, 1, True))
    return F.coalesce(iso, *(_ordered(_parts(F.regexp_extract(c, p, 0)), y, m, d, named) for p, y, m, d, named in ways))


def parse_time(c: Column | str) -> Column:
    """'7h30', '7:30', '7h' as 'HH:MM'."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    full, hour = r"(\d{1,2})[h:](\d{2})", r"(\d{1,2})[hH]"
    found = F.when(F.regexp_extract(c, full, 1) != "", F.concat(F.lpad(F.regexp_extract(c, full, 1), 2, "0"), F.lit(":"), F.regexp_extract(c, full, 2)))
    return found.when(F.regexp_extract(c, hour, 1) != "", F.concat(F.lpad(F.regexp_extract(c, hour, 1), 2, "0"), F.lit(":00")))


def parse_time_12h(c: Column) -> Column:
    """'7:30 AM' and the like as 'HH:MM'."""
    p = r"(?i)(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m"
    hour = F.regexp_extract(c, p, 1).try_cast("int") % 12 + F.when(F.lower(F.regexp_extract(c, p, 3)) == "p", 12).otherwise(0)
    minute = F.when(F.regexp_extract(c, p, 2) == "", "00").otherwise(F.regexp_extract(c, p, 2))
    return F.when(F.regexp_extract(c, p, 3) != "", F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), minute))


def plausible_time(c: Column, first: int = 4, last: int = 23) -> Column:
    """The time if its hour may be a start, else null."""
    return F.when(F.substring(c, 1, 2).try_cast("int").between(first, last), c)


def dates_compatible(a: Column, b: Column, days: int) -> Column:
    """Within so many days of each other, or one of them unknown."""
    return F.coalesce(F.abs(F.datediff(a, b)) <= days, F.lit(True))


def date_candidates(text: Column, first_year: int = 2025, last_year: int = 2030) -> Column:
    """All dates that a page's text has, without repeats, in ISO order."""
    every = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    # The parts are a lambda's argument, so they are made once a date.
    parts = lambda p, y, m, d, named: F.transform(F.transform(every(p), _parts), lambda x: _ordered(x, y, m, d, named))
    dates = F.concat(
        F.transform(every(_ISO), lambda x: F.try_to_date(x, "yyyy-MM-dd")),
        parts(r"\d{1,2}[/.]\d{1,2}[/.]\d{4}", 2, 1, 0, False),
        parts(r"\d{1,2}\s+(?:de\s+)?\p{L}{3,}\s+(?:de\s+)?\d{4}", 2, 1, 0, True),
        parts(r"\p{L}{3,}\s+\d{1,2},?\s+\d{4}", 2, 0, 1, True),
    )
    return F.array_sort(F.array_distinct(F.filter(dates, lambda d: d.isNotNull() & F.year(d).between(first_year, last_year))))


def next_date(dates: Column, as_of: Column) -> Column:
    """The earliest date not before as_of, else the latest of all."""
    return F.coalesce(F.array_min(F.filter(dates, lambda d: d >= as_of)), F.array_max(dates))


def infer_year(month: Column, day: Column, as_of: Column) -> Column:
    """The next date of this month and day."""
    this = _ymd(F.year(as_of).cast("string"), month, day)
    return F.when(this >= as_of, this).otherwise(_ymd((F.year(as_of) + 1).cast("string"), month, day))


#: How a date is written in full, by language: what stands around day, month name and year (fixed values).
_LONG = {
    "en": "MMMM d, yyyy",
    "pt pt-pt es": "d 'de' MMMM 'de' yyyy",
    "de da nb fi cs sk sl hr": "d. MMMM yyyy",
    "hu": "yyyy. MMMM d.",
    "ru": "d MMMM yyyy 'г.'",
    "he": "d 'ב'MMMM yyyy",
    "fr it nl pl el sv th id ms": "d MMMM yyyy",
    "ja zh-cn zh-tw": "yyyy年M月d日",
    "ko": "yyyy년 M월 d일",
}
LANGUAGES = tuple(x for k in _LONG for x in k.split())


def long_date(d: Column, language: str = "en") -> Column:
    """day, month name and year in a language; month names are those of the language's locale, other languages are written as English."""
    language = language if language in LANGUAGES else "en"
    pattern = next(v for k, v in _LONG.items() if language in k.split())
    # The row writer takes a locale, which date_format does not; one field without separator or quotes is the text itself.
    return F.nullif(F.to_csv(F.struct(d.cast("date").alias("d")), {"dateFormat": pattern, "locale": language, "sep": "\x01", "quote": "\x02", "nullValue": ""}), F.lit(""))


def earliest_of(text: Column) -> Column:
    """the earliest of a text's day-first dates."""
    found = F.regexp_extract_all(text, F.lit(r"\d{1,2}/\d{1,2}/\d{4}"), F.lit(0))
    return F.array_min(F.array_compact(F.transform(found, parse_date)))


def first_found(text: Column, *patterns: str) -> Column:
    """the first group of the first pattern, in the order given, that the text has."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns))


def time_required(date: Column, as_of: Column, months: int = 0) -> Column:
    """Whether an event must have a start time: those of the next `months` months, by default none."""
    return F.coalesce(date.between(as_of, F.add_months(as_of, months)), F.lit(False)) if months else F.lit(False)
