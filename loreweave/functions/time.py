"""Time columns: tolerant parsing, time windows named in a query, dates in a text, weights by age."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The numerals, names and formats that are recognised.
NUMERALS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "十一": 11, "十二": 12}
MONTH = r"([一二三四五六七八九十]{1,2}|\d{1,2})\s*月"
FULL_DATE = r"(20\d{2})[-/年](\d{1,2})[-/月](\d{1,2})[日号]?"
MONTH_DAY = MONTH + r"\s*([一二三四五六七八九十]{1,2}|\d{1,2})\s*[日号]"
MONTH_PART = MONTH + r"\s*(初|中旬|底|末)"
MONTH_ONLY = MONTH + r"(?!\d|日|号|初|中|底|末)"
LAST_MONTH = r"上(?:个)?月"
RECENT = r"最近|最新|刚刚|近|这(?:一?周|几天|个月)"
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
TEXT_DATE = r"(?:20\d{2}|19\d{2})\s*年\s*(?:\d{1,2}\s*月)?(?:\d{1,2}\s*[日号])?"
RANGE_SIGN = r"至|到|—|–|~|～|→|->|－"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_time(text: Column | str) -> Column:
    """A timestamp in UTC from ISO text or one of FORMATS, null if it can't be read."""
    return F.coalesce(F.try_to_timestamp(_col(text)), *[F.try_to_timestamp(_col(text), F.lit(f)) for f in FORMATS])


def numeral(text: Column) -> Column:
    """An Arabic or Chinese number up to nineteen, else null."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in NUMERALS.items() for x in kv]), F.nullif(text, F.lit("")))
    teen = F.when((F.length(text) == 2) & text.startswith("十"), 10 + F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NUMERALS.items() for x in kv]), F.substring(text, 2, 1)), F.lit(0)))
    return F.coalesce(F.when(text.rlike(r"^\d+$"), text.try_cast("int")), teen, known)


def _once(value: Column, use) -> Column:
    """use(value) with the value worked out once, however often use names it: long conditions stay small enough to be compiled."""
    return F.transform(F.array(value), use)[0]


def _date(y: Column, m: Column, d: Column) -> Column:
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(y.isNotNull() & m.isNotNull() & d.isNotNull(), text.try_cast("date"))


def query_window(query: Column | str, now: Column) -> Column:
    """struct(start, end) of days that a query names, or null.

    In order: a full date, a month and day, a part of a month, a month, last month, the last 30 days. A
    month without a year is this year's, or last year's if it is still to come; an impossible date passes
    to the next form. A day in Chinese numerals isn't read: the whole month is.
    """
    q = F.coalesce(_col(query), F.lit(""))
    part = lambda pattern, k: F.regexp_extract(q, pattern, k)
    number = lambda pattern, k: part(pattern, k).try_cast("int")
    year_of = lambda m: F.when(m <= F.month(now), F.year(now)).otherwise(F.year(now) - 1)
    both = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("start"), b.alias("end")))
    of_day = lambda d: _once(d, lambda x: both(x, x))
    whole = lambda m: _once(_date(year_of(m), m, F.lit(1)), lambda x: both(x, F.last_day(x)))
    day = _date(number(FULL_DATE, 1), number(FULL_DATE, 2), number(FULL_DATE, 3))
    month = lambda pattern: _once(part(pattern, 1), numeral)
    month_day = _once(month(MONTH_DAY), lambda m: _date(year_of(m), m, number(MONTH_DAY, 2)))
    piece = part(MONTH_PART, 2)
    first = F.when(piece == "初", 1).when(piece == "中旬", 10).otherwise(21)
    last = lambda m: F.when(piece == "初", 10).when(piece == "中旬", 20).otherwise(F.dayofmonth(F.last_day(_date(year_of(m), m, F.lit(1)))))
    month_part = _once(month(MONTH_PART), lambda m: both(_date(year_of(m), m, first), _date(year_of(m), m, last(m))))
    previous = F.add_months(F.trunc(now, "month"), -1)
    return F.coalesce(
        of_day(day), of_day(month_day), month_part, _once(month(MONTH_ONLY), whole),
        F.when(q.rlike(LAST_MONTH), F.struct(previous.alias("start"), F.last_day(previous).alias("end"))),
        F.when(q.rlike(RECENT), F.struct(F.date_sub(F.to_date(now), 30).alias("start"), F.to_date(now).alias("end"))),
    )


def dates_in_text(text: Column | str) -> Column:
    """struct(start, end): the first Chinese date of a text, and the second of the first two joined by a range sign."""
    t = F.coalesce(_col(text), F.lit(""))
    found = F.regexp_extract_all(t, F.lit(f"({TEXT_DATE})"), 1)
    # what follows a range sign directly after a date, the sign anywhere between the two
    joined = F.regexp_extract(t, f"(?s)(?:{TEXT_DATE})(?:(?!(?:20|19)\\d{{2}}\\s*年).)*?(?:{RANGE_SIGN})(?:(?!(?:20|19)\\d{{2}}\\s*年).)*?({TEXT_DATE})", 1)

    def to_date(x: Column) -> Column:
        month, day = F.regexp_extract(x, r"年\s*(\d{1,2})\s*月", 1), F.regexp_extract(x, r"(\d{1,2})\s*[日号]", 1)
        return _date(F.regexp_extract(x, r"^(\d{4})", 1).try_cast("int"), F.coalesce(month.try_cast("int"), F.lit(1)), F.coalesce(day.try_cast("int"), F.lit(1)))

    return F.struct(to_date(F.get(found, F.lit(0))).alias("start"), to_date(F.nullif(joined, F.lit(""))).alias("end"))


def recency_factor(at: Column | str, now: Column, half_life_days: float = 60.0) -> Column:
    """1 for new, down to 0.5; 1 without a time."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(_col(at).cast("timestamp"))) / 86_400e6)
    return F.coalesce(0.5 + 0.5 * F.pow(F.lit(0.5), age / half_life_days), F.lit(1.0))


def time_factor(at: Column | str, window: Column, boost: float = 1.5) -> Column:
    return F.when(F.to_date(_col(at)).between(window["start"], window["end"]), F.lit(boost)).otherwise(F.lit(1.0))
