"""Time expressions: overlap, proximity, decay, relative dates."""

from __future__ import annotations

import re
import unicodedata
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.vector import clamp


def micros(c: Column) -> Column:
    """Microseconds since the epoch; times without a zone count as UTC."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), c.cast("timestamp_ntz"))


def hours_between(a: Column, b: Column) -> Column:
    return F.abs(micros(a) - micros(b)) / 3.6e9


def overlaps(start: Column, end: Column, mentioned: Column, low: Column, high: Column) -> Column:
    """The interval meets [low, high], or any of the three times lies in it (bounds included)."""
    parts = [start.isNotNull() & end.isNotNull() & (start <= high) & (end >= low), *[c.between(low, high) for c in (mentioned, start, end)]]
    out = F.lit(False)
    for p in parts:
        out = out | F.coalesce(p, F.lit(False))
    return out


def best_micros(start: Column, end: Column, mentioned: Column) -> Column:
    """The middle of the interval, else its start, its end, or when it was mentioned."""
    return F.coalesce((micros(start) + micros(end)) / 2, micros(start).cast("double"), micros(end).cast("double"), micros(mentioned).cast("double"))


def proximity(best: Column, low: Column, high: Column, without: float = 0.5) -> Column:
    """1 in the middle of the window, 0 at half its length from it; a window without length gives 1."""
    total = (micros(high) - micros(low)) / 8.64e10
    middle = (micros(high) + micros(low)) / 2
    near = 1 - F.least(F.abs(best - middle) / 8.64e10 / (total / 2), F.lit(1.0))
    return F.when(best.isNull(), F.lit(without)).when(total <= 0, F.lit(1.0)).otherwise(near)


def link_weight(hours: Column) -> Column:
    """Temporal link weight: linear over a day, never below 0.3."""
    return F.greatest(F.lit(0.3), 1 - hours / 24)


def decay_weight(seconds: Column, sigma: float = 86_400.0) -> Column:
    return F.exp(-seconds / F.lit(sigma))


def recency(when: Column, now: Column, days: float = 365.0) -> Column:
    age = (micros(now) - micros(when)) / 8.64e10
    return F.coalesce(clamp(1 - age / days, 0.1, 1.0), F.lit(0.5))


#: Phrases of a text and how many days from its date they point to; the first match wins.
RELATIVE_DAYS = {
    r"\blast night\b": -1,
    r"\byesterday\b": -1,
    r"\btoday\b": 0,
    r"\bthis morning\b": 0,
    r"\bthis afternoon\b": 0,
    r"\bthis evening\b": 0,
    r"\btonigh?t\b": 0,
    r"\btomorrow\b": 1,
    r"\blast week\b": -7,
    r"\bthis week\b": 0,
    r"\bnext week\b": 7,
    r"\blast month\b": -30,
    r"\bthis month\b": 0,
    r"\bnext month\b": 30,
}


def relative_day(text: Column, on: Column) -> Column:
    """The date that a phrase of the text points to, null without one."""
    out = F.lit(None).cast("date")
    for pattern, days in reversed(RELATIVE_DAYS.items()):
        out = F.when(F.lower(text).rlike(pattern), F.date_add(on.cast("date"), days)).otherwise(out)
    return out


#: What a phrase names, as calendar units from the present one (first, last), in English, Spanish,
#: Italian, French and German, without accents. The first line that matches counts.
PERIODS = [
    ("day", -1, -1, r"yesterday|ayer|ieri|hier|gestern"),
    ("day", 0, 0, r"today|hoy|oggi|aujourd'?hui|heute"),
    ("day", -3, -1, r"couple (of )?days? ago"),
    ("day", -5, -2, r"few days? ago"),
    ("day", -21, -7, r"couple (of )?weeks? ago"),
    ("day", -35, -14, r"few weeks? ago"),
    ("day", -90, -30, r"couple (of )?months? ago"),
    ("day", -150, -60, r"few months? ago"),
    ("week", -1, -1, r"last week|la semana pasada|la settimana scorsa|la semaine derniere|letzte woche"),
    ("month", -1, -1, r"last month|el mes pasado|il mese scorso|le mois dernier|letzten? monat"),
    ("year", -1, -1, r"last year|el ano pasado|l'anno scorso|l'annee derniere|letztes? jahr"),
    ("weekend", -1, -1, r"last weekend|el fin de semana pasado|lo scorso fine settimana|le week-?end dernier|letztes? wochenende"),
]
#: Names of the months in the same languages.
MONTHS = [
    "january enero gennaio janvier januar",
    "february febrero febbraio fevrier februar",
    "march marzo mars marz",
    "april abril aprile avril",
    "may mayo maggio mai",
    "june junio giugno juin juni",
    "july julio luglio juillet juli",
    "august agosto aout",
    "september septiembre settembre septembre",
    "october octubre ottobre octobre oktober",
    "november noviembre novembre",
    "december diciembre dicembre decembre dezember",
]
_MONTH_OF = {name: k for k, names in enumerate(MONTHS) for name in names.split()}
_PHRASES = [(unit, first, last, re.compile(r"\b(" + words.replace(" ", r"\s+") + r")\b")) for unit, first, last, words in PERIODS]
_MONTH_YEAR = re.compile(r"\b(" + "|".join(sorted(_MONTH_OF, key=len, reverse=True)) + r")\s+(\d{4})\b")


def _unit_start(unit: str, day: date, shift: int) -> date:
    """Where the unit that is `shift` after that of a day begins. Of weekends, the last before the day is number -1."""
    if unit == "day":
        return day + timedelta(shift)
    if unit == "week":
        return day + timedelta(7 * shift - day.weekday())
    if unit == "weekend":
        return day + timedelta(7 * shift + 7 - ((day.weekday() - 6) % 7 + 1))
    year, month = divmod(12 * day.year + (day.month - 1 if unit == "month" else 0) + shift * (1 if unit == "month" else 12), 12)
    return date(year, month + 1, 1)


def period(query: str, now: datetime) -> tuple[datetime, datetime] | None:
    """The time window that a question names (yesterday, la semana pasada, Juni 2023), on the driver; accents
    and case do not count."""
    folded = "".join(c for c in unicodedata.normalize("NFD", query.lower()) if not unicodedata.combining(c))
    for unit, first, last, phrase in _PHRASES:
        if phrase.search(folded):
            low = _unit_start(unit, now.date(), first)
            high = low + timedelta(2) if unit == "weekend" else _unit_start(unit, now.date(), last + 1)
            break
    else:
        named = _MONTH_YEAR.search(folded)
        if not named or not int(named[2]):
            return None
        low = date(int(named[2]), _MONTH_OF[named[1]] + 1, 1)
        high = _unit_start("month", low, 1)
    return datetime.combine(low, time.min), datetime.combine(high, time.min) - timedelta(microseconds=1)
