"""Absolute and relative dates in text, as Columns. Times are double epoch seconds in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names and their numbers, day names from Monday, number words.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
MONTH_OF = {m: i for i, m in enumerate(MONTHS, 1)} | {m[:3]: i for i, m in enumerate(MONTHS, 1)} | {"sept": 9}
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
NUMBERS = {
    "a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8,
    "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "couple of": 2, "few": 3, "several": 3,
}
MONTH = "|".join(sorted(MONTH_OF, key=len, reverse=True))
COUNT = "[0-9]+|" + "|".join(sorted(NUMBERS, key=len, reverse=True))
PLAIN_COUNT = "[0-9]+|" + "|".join(sorted((x for x in NUMBERS if x not in ("couple of", "few", "several")), key=len, reverse=True))

#: Fixed patterns of absolute dates, in the order in which they are tried.
ISO = r"(?<![0-9])([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})(?:[T\s]+(?:\([A-Za-z]{3}\)\s*)?([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}))?)?"
MDY = rf"(?i)\b({MONTH})\.?[-\s]+([0-9]{{1,2}})(?:st|nd|rd|th)?,?[-\s]+([0-9]{{4}})\b"
DMY = rf"(?i)\b([0-9]{{1,2}})(?:st|nd|rd|th)?\s+({MONTH})\.?,?\s+([0-9]{{4}})\b"
MY = rf"(?i)\b({MONTH})\.?,?\s+([0-9]{{4}})\b"


def lookup(values: dict[str, int], key: Column) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def _int(text: Column) -> Column:
    return F.when(text != "", text).try_cast("int")


def utc(year: Column, month: Column, day: Column, hour=None, minute=None, second=None) -> Column:
    """Epoch seconds, null for an impossible date or time."""
    zero = F.lit(0)
    parts = [F.coalesce(x, zero) if x is not None else zero for x in (hour, minute, second)]
    made = F.try_make_timestamp(year, month, day, *parts)
    return F.when(year.between(1, 9999), F.unix_timestamp(made)).cast("double")


def parse_absolute(text: Column) -> Column:
    """struct<epoch, label> of the first date: ISO, month d y, d month y, month y; null without."""
    g = lambda p, k: F.regexp_extract(text, p, k)
    n = lambda p, k: _int(g(p, k))
    month = lambda p, k: lookup(MONTH_OF, F.lower(g(p, k)))
    tries = [
        (utc(n(ISO, 1), n(ISO, 2), n(ISO, 3), n(ISO, 4), n(ISO, 5), n(ISO, 6)), F.trim(g(ISO, 0))),
        (utc(n(MDY, 3), month(MDY, 1), n(MDY, 2)), g(MDY, 0)),
        (utc(n(DMY, 3), month(DMY, 2), n(DMY, 1)), g(DMY, 0)),
        (utc(n(MY, 2), month(MY, 1), F.lit(1)), g(MY, 0)),
    ]
    return F.coalesce(*[F.when(e.isNotNull(), F.struct(e.alias("epoch"), label.alias("label"))) for e, label in tries])


def moment(epoch: Column) -> Column:
    return F.timestamp_seconds(epoch)


def shift(epoch: Column, months: Column) -> Column:
    """``months`` earlier: the day is clamped to the month's end, the time of day stays."""
    earlier = F.add_months(moment(epoch), -months)
    return (F.unix_timestamp(earlier.cast("timestamp")) + F.pmod(epoch, F.lit(86400))).cast("double")


def _unit_back(epoch: Column, n: Column, unit: Column) -> Column:
    return (
        F.when(unit == "day", epoch - n * 86400)
        .when(unit == "week", epoch - n * 604800)
        .when(unit == "month", shift(epoch, n))
        .otherwise(shift(epoch, n * 12))
    )


def weekday(epoch: Column) -> Column:
    return F.weekday(moment(epoch))


#: Fixed patterns of relative dates, in the order in which they are tried.
AGO = rf"(?i)\b({COUNT})\s+(day|week|month|year)s?\s+ago\b"
SINCE = (
    r"(?i)\b(?:been|being)\b[^.?!]{0,80}?\bfor\s+(?:about |around |almost |nearly |over |roughly )?"
    rf"({PLAIN_COUNT})\s+(day|week|month|year)s?\b"
)
LAST_DAY = rf"(?i)\b(last|previous)\s+({'|'.join(DAYS)})\b"
LAST_WEEKEND = r"(?i)\blast\s+weekend\b"
LAST_UNIT = r"(?i)\b(last|past|previous)\s+(week|month|year)\b"
SIMPLE = r"(?i)\b(yesterday|today|tonight|tomorrow|last night)\b"
MONTH_DAY = (
    rf"(?i)\b(?:(early|mid|late)[- ]?({MONTH})|({MONTH})\.?\s+([0-9]{{1,2}})(?:st|nd|rd|th)?|\bin\s+({MONTH}))\b(?!,?\s*[0-9]{{4}})"
)


#: What every text that ``parse_relative`` finds something in has.
RELATIVE = "(?i)" + "|".join(p.removeprefix("(?i)") for p in (AGO, SINCE, LAST_DAY, LAST_WEEKEND, LAST_UNIT, SIMPLE, MONTH_DAY))


def number(word: Column) -> Column:
    low = F.lower(word)
    return F.coalesce(_int(F.regexp_extract(low, "^[0-9]+$", 0)), lookup(NUMBERS, low), F.lit(1))


def month_day(text: Column, anchor: Column) -> Column:
    """struct<epoch, label>: a month, with a day or part but no year, in the anchor's year, or in
    the one before if that lies more than a day ahead. The first usable phrase counts."""

    def one(phrase: Column) -> Column:
        g = lambda k: F.regexp_extract(phrase, MONTH_DAY, k)
        part, day = F.lower(g(1)), _int(g(4))
        name = F.lower(F.coalesce(*[F.when(g(k) != "", g(k)) for k in (2, 3, 5)]))
        month = lookup(MONTH_OF, name)
        wanted = F.coalesce(day, lookup({"early": 5, "mid": 15, "late": 25}, part), F.lit(15))

        def at(year: Column) -> Column:
            first = F.make_date(year, month, F.lit(1))
            e = utc(year, month, F.least(wanted, F.dayofmonth(F.last_day(first))))
            return F.when(e <= anchor + 86400, e)

        year = F.year(moment(anchor))
        usable = ~((name == "may") & day.isNull() & (part == ""))
        epoch = F.when(usable, F.coalesce(at(year), at(year - 1)))
        return F.struct(epoch.alias("epoch"), F.trim(phrase).alias("label"))

    found = F.transform(F.regexp_extract_all(text, F.lit(MONTH_DAY), F.lit(0)), one)
    return F.try_element_at(F.filter(found, lambda x: x["epoch"].isNotNull()), F.lit(1))


def parse_relative(text: Column, anchor: Column) -> Column:
    """struct<epoch, label> of the first kind of relative phrase that ``text`` has."""
    anchor = anchor.cast("double")
    g = lambda p, k: F.regexp_extract(text, p, k)
    back = lambda target: F.pmod(weekday(anchor) - target, F.lit(7))
    days = lambda target: F.when(back(target) == 0, 7).otherwise(back(target))
    order = {d: i for i, d in enumerate(DAYS)}
    word = F.lower(g(SIMPLE, 1))
    step = F.when(word.isin("yesterday", "last night"), -1).when(word == "tomorrow", 1).otherwise(0)
    tries = [
        (AGO, _unit_back(anchor, number(g(AGO, 1)), F.lower(g(AGO, 2)))),
        (SINCE, _unit_back(anchor, number(g(SINCE, 1)), F.lower(g(SINCE, 2)))),
        (LAST_DAY, anchor - days(lookup(order, F.lower(g(LAST_DAY, 2)))) * 86400),
        (LAST_WEEKEND, anchor - days(F.lit(5)) * 86400),
        (LAST_UNIT, _unit_back(anchor, F.lit(1), F.lower(g(LAST_UNIT, 2)))),
        (SIMPLE, anchor + step * 86400),
    ]
    found = [F.when(text.rlike(p), F.struct(e.cast("double").alias("epoch"), g(p, 0).alias("label"))) for p, e in tries]
    return F.coalesce(month_day(text, anchor), *found)


#: Fixed patterns of a label and of a turn number.
LABEL = r"(?i)(?:(?<![\w.])@|\bdate[=:])\s*([^\s\]]+(?:\s+\([A-Za-z]{3}\)\s*[0-9]{1,2}:[0-9]{2})?)"
TURN = r"(?i)\bturn[=:]([^\s]+)"


def extract_time(text: Column, anchor: Column) -> Column:
    """struct<epoch, label, kind>: a label, else an absolute date, else a relative one, else the turn."""
    label = F.regexp_replace(F.trim(F.regexp_extract(text, LABEL, 1)), "[,;:]+$", "")
    turn = F.regexp_replace(F.regexp_extract(text, TURN, 1), "[,;:]+$", "")
    s = lambda e, name, kind: F.struct(e.cast("double").alias("epoch"), name.cast("string").alias("label"), F.lit(kind).alias("kind"))
    none, named, free = F.lit(None), parse_absolute(label), parse_absolute(text)
    relative = F.when(anchor.isNotNull(), parse_relative(text, anchor))
    whole = turn.rlike("^[0-9]+$")
    return (
        F.when(text.rlike(LABEL), F.when(named.isNotNull(), s(named["epoch"], label, "absolute")).otherwise(s(none, label, "malformed")))
        .when(free.isNotNull(), s(free["epoch"], free["label"], "absolute"))
        .when(relative.isNotNull(), s(relative["epoch"], relative["label"], "relative"))
        .when(
            text.rlike(TURN),
            F.when(whole, s(turn.try_cast("double"), F.concat(F.lit("turn="), turn), "ordinal")).otherwise(
                s(none, F.concat(F.lit("turn="), turn), "malformed")
            ),
        )
        .otherwise(s(none, none, "none"))
    )


#: Fixed pattern of the phrases that are resolved in place.
PHRASE = (
    rf"(?i)(?<![\w-])(?:((?:{PLAIN_COUNT})\s+(?:day|week|month|year)s?\s+ago)|(yesterday|tomorrow|last\s+night)"
    rf"|(last\s+(?:{'|'.join(DAYS)}))|(last\s+weekend)|((?:last|this|next)\s+(?:week|month|year)))(?![\w-])"
)


def _day(epoch: Column) -> Column:
    return F.date_format(moment(epoch), "d MMMM yyyy")


def _phrases(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PHRASE), F.lit(0))


def _word(phrase: Column, k: int) -> Column:
    return F.element_at(F.split(F.lower(phrase), r"\s+"), k)


def _phrase_day(phrase: Column, said: Column) -> Column:
    """The epoch that a phrase names if it names one day; weeks, months and spans give null."""
    order = {d: i for i, d in enumerate(DAYS)}
    last = _word(phrase, -1)
    back = F.pmod(weekday(said) - lookup(order, last), F.lit(7))
    return (
        F.when((last == "ago") & _word(phrase, 2).isin("day", "days"), said - number(_word(phrase, 1)) * 86400)
        .when(last == "tomorrow", said + 86400)
        .when(last.isin("yesterday", "night"), said - 86400)
        .when(last.isin(*DAYS), said - F.when(back == 0, 7).otherwise(back) * 86400)
    ).cast("double")


def resolve_phrases(text: Column, said: Column) -> Column:
    """array of "phrase = what it means", the first use of each phrase, in order; empty if undated."""
    said = said.cast("double")

    def meaning(p: Column) -> Column:
        first, last, unit = _word(p, 1), _word(p, -1), F.regexp_replace(_word(p, 2), "s$", "")
        back = _unit_back(said, number(first), unit)
        offset = F.when(first == "last", -1).when(first == "next", 1).otherwise(0)
        moved = F.add_months(F.trunc(moment(said), "month"), offset)
        return (
            F.when((last == "ago") & (unit == "day"), _day(back))
            .when((last == "ago") & (unit == "week"), F.concat(F.lit("around "), _day(back)))
            .when((last == "ago") & (unit == "month"), F.concat(F.lit("around "), F.date_format(moment(back), "MMMM yyyy")))
            .when(last == "ago", F.concat(F.lit("around "), F.year(moment(back)).cast("string")))
            .when(last == "weekend", F.concat(F.lit("the weekend before "), _day(said)))
            .when(last == "week", F.concat(F.when(offset == -1, "the week before ").when(offset == 1, "the week after ").otherwise("the week of "), _day(said)))
            .when(last == "month", F.date_format(moved, "MMMM yyyy"))
            .when(last == "year", (F.year(moment(said)) + offset).cast("string"))
            .otherwise(_day(_phrase_day(p, said)))
        )

    key = lambda p: F.regexp_replace(F.lower(p), r"\s+", " ")
    found = _phrases(text)
    first = F.filter(found, lambda p, i: F.array_position(F.transform(found, key), key(p)) == i + 1)
    notes = F.transform(first, lambda p: F.concat(p, F.lit(" = "), meaning(p)))
    return F.when(said.isNull(), F.array().cast("array<string>")).otherwise(notes)


def day_phrases(text: Column, said: Column) -> Column:
    """array<struct<phrase, epoch>> of the phrases that name one day, at its midnight."""
    midnight = (F.floor(said / 86400) * 86400).cast("double")
    made = F.transform(_phrases(text), lambda p: F.struct(p.alias("phrase"), _phrase_day(p, midnight).alias("epoch")))
    return F.filter(made, lambda x: x["epoch"].isNotNull())


#: Fixed patterns of dates with or without a year.
ISO_DAY = r"(?<![0-9])([0-9]{4})-([0-9]{2})-([0-9]{2})(?![0-9])"
MONTH_FIRST = rf"(?i)\b({MONTH})\.?\s+([0-9]{{1,2}})(?:st|nd|rd|th)?(?:,?\s+([0-9]{{4}}))?\b"
DAY_FIRST = rf"(?i)\b([0-9]{{1,2}})(?:st|nd|rd|th)?\s+({MONTH})\.?(?:,?\s+([0-9]{{4}}))?\b"


def explicit_dates(clause: Column, said: Column) -> Column:
    """Epochs of the dates that a clause names; without a year, in the year nearest ``said``."""

    def nearest(month: Column, day: Column) -> Column:
        year = F.year(moment(said))
        options = F.array(*[utc(year + k, month, day) for k in (-1, 0, 1)])
        options = F.filter(options, lambda e: e.isNotNull())
        ranked = F.array_sort(F.transform(F.sequence(F.lit(1), F.size(options)), lambda i: F.struct(F.abs(F.element_at(options, i) - said).alias("d"), i.alias("i"), F.element_at(options, i).alias("e"))))
        return F.when(F.size(options) > 0, F.element_at(ranked, 1)["e"])

    def dated(pattern: str, m: int, d: int):
        def one(p: Column) -> Column:
            g = lambda k: F.regexp_extract(p, pattern, k)
            month, day, year = lookup(MONTH_OF, F.lower(g(m))), _int(g(d)), _int(g(3))
            made = F.when(year.isNotNull(), utc(year, month, day)).otherwise(nearest(month, day))
            return F.when(g(m) != "may", made) if m == 1 else made  # "may 5" may be the verb

        return F.transform(F.regexp_extract_all(clause, F.lit(pattern), F.lit(0)), one)

    iso = F.transform(
        F.regexp_extract_all(clause, F.lit(ISO_DAY), F.lit(0)),
        lambda p: utc(*[_int(F.regexp_extract(p, ISO_DAY, k)) for k in (1, 2, 3)]),
    )
    return F.filter(F.concat(iso, dated(MONTH_FIRST, 1, 2), dated(DAY_FIRST, 2, 1)), lambda e: e.isNotNull())


def day_diff(earlier: Column, later: Column) -> Column:
    return F.datediff(moment(later), moment(earlier)).cast("long")


def months_between(earlier: Column, later: Column) -> Column:
    """struct<months, days>: whole calendar months, the anchor day clamped, and the days left."""
    a, b = F.to_date(moment(earlier)), F.to_date(moment(later))
    whole = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    whole = whole - (F.dayofmonth(b) < F.least(F.dayofmonth(a), F.dayofmonth(F.last_day(b)))).cast("int")
    return F.struct(F.greatest(F.lit(0), whole).alias("months"), F.greatest(F.lit(0), F.datediff(b, F.add_months(a, whole))).alias("days"))


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n != 1, "s").otherwise(""))


def describe_gap(earlier: Column, later: Column) -> Column:
    """ "40 days; 5 weeks 5 days; 1 month 9 days"."""
    days, m = day_diff(earlier, later), months_between(earlier, later)
    weeks, rest = F.floor(days / 7), days % 7
    week = F.when(weeks > 0, F.concat(_plural(weeks, "week"), F.when(rest > 0, F.concat(F.lit(" "), _plural(rest, "day"))).otherwise("")))
    months = F.concat(_plural(m["months"], "month"), F.lit(" "), _plural(m["days"], "day"))
    return F.concat_ws("; ", F.concat(days.cast("string"), F.lit(" days")), week, months)


def span(earlier: Column, later: Column) -> Column:
    """ "40 days (about 5 weeks)": months by another rule than ``months_between``, without a clamp."""
    days = day_diff(earlier, later)
    a, b = F.to_date(moment(earlier)), F.to_date(moment(later))
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) - (F.dayofmonth(b) < F.dayofmonth(a)).cast("int")
    weeks = F.floor(days / 7).cast("string")
    parts = F.concat_ws(
        ", ",
        F.when(days >= 14, F.concat(F.when(days % 7 == 0, "").otherwise("about "), weeks, F.lit(" weeks"))),
        F.when(months >= 2, F.concat(months.cast("string"), F.lit(" months"))),
        F.when(months >= 12, F.concat(F.floor(months / 12).cast("string"), F.lit(" year"), F.when(months >= 24, "s").otherwise(""))),
    )
    return F.concat(_plural(days, "day"), F.when(parts != "", F.concat(F.lit(" ("), parts, F.lit(")"))).otherwise(""))
