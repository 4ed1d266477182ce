"""One printed date or time to a day or an unambiguous instant; exhaustive, no locale, no guessing of zones."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# Month names in English, French and German, with their usual abbreviations.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10, "nov": 11, "dec": 12,
    "janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12,
    "janv": 1, "fevr": 2, "fev": 2, "avr": 4, "juil": 7,
    "januar": 1, "jaenner": 1, "janner": 1, "februar": 2, "marz": 3, "maerz": 3, "juni": 6, "juli": 7, "oktober": 10, "dezember": 12,
    "mrz": 3, "okt": 10, "dez": 12,
}

# Zone letters and their offsets from UTC in minutes.
ZONE_LETTERS = {"AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780, "CST": -360, "CDT": -300, "UTC": 0, "GMT": 0, "Z": 0}

_ACCENTS = str.maketrans("áàâäãéèêëíìîïóòôöõúùûüç", "aaaaaeeeeiiiiooooouuuuc")
_WEEKDAY = r"(?:(?:mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun)(?:day|nesday|rsday|urday|sday)?|lundi|mardi|mercredi|jeudi|vendredi|samedi|dimanche|lun|mer|jeu|ven|sam|dim|montag|dienstag|mittwoch|donnerstag|freitag|samstag|sonntag|mo|di|mi|do|fr|sa|so)"
_MONTH = "(?P<mon>" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")\.?"
_CLOCK = r"(?P<h>\d{1,2})(?::(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?|h(?P<mih>\d{2}))(?:\s*(?P<ap>[ap])\.?m\.?)?|(?P<h12>\d{1,2})\s*(?P<ap12>[ap])\.?m\.?"
_ZONE = r"(?P<zone>z|utc|gmt|aest|aedt|acst|acdt|awst|nzst|nzdt|cst|cdt)?\s*(?P<off>\(?(?:utc|gmt)?\s*[+-]\d{1,2}(?::?\d{2})?\)?)?"

_DATES = [
    r"(?P<y>\d{4})(?P<sep>[-/.])(?P<m>\d{1,2})(?P=sep)(?P<d>\d{1,2})",
    r"(?P<a>\d{1,2})(?P<sep>[-/.])(?P<b>\d{1,2})(?P=sep)(?P<y>\d{4}|\d{2})",
    rf"(?P<d>\d{{1,2}})(?:st|nd|rd|th|er|\.)?[\s-]*{_MONTH}[\s,-]*(?P<y>\d{{4}}|\d{{2}})",
    rf"{_MONTH}[\s-]*(?P<d>\d{{1,2}})(?:st|nd|rd|th)?(?:\s*,\s*|[\s-]+)(?P<y>\d{{4}}|\d{{2}})",
    rf"(?P<y>\d{{4}})[\s-]*{_MONTH}[\s-]*(?P<d>\d{{1,2}})",
]
_AFTER = rf"(?:(?:\s*t\s*|\s*,\s*|\s+at\s+|\s+um\s+|\s+a\s+|\s+)(?:{_CLOCK})(?:\s*uhr)?\s*{_ZONE})?"
_FORMS = [re.compile(rf"(?:{_WEEKDAY}\.?,?\s+)?{d}{_AFTER}") for d in _DATES]
_FORMS += [re.compile(rf"(?:{_CLOCK})\s*{_ZONE}?\s*,?\s+(?:{_WEEKDAY}\.?,?\s+)?{d}(?:\s+(?P<zone2>{'|'.join(z.lower() for z in ZONE_LETTERS)}))?(?:\s*(?P<off2>\(?(?:utc|gmt)?\s*[+-]\d{{1,2}}(?::?\d{{2}})?\)?))?") for d in _DATES]
_BASIC = re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})t(?P<h>\d{2}):?(?P<mi>\d{2})(?::?(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?\s*" + _ZONE)
_SPREADSHEET = re.compile(r"(\d{5})(?:[.,](\d+))?")
_EPOCH = datetime(1970, 1, 1)


@lru_cache(maxsize=1024)
def zone_of(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


def _utc_text(t: datetime) -> str:
    return t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond:06d}Z" if t.year >= 1000 else f"{t.year:04d}" + t.strftime("-%m-%dT%H:%M:%S.") + f"{t.microsecond:06d}Z"


def _local_to_utc(t: datetime, zone: str | None) -> datetime | None:
    """None where the zone is unknown or the local time occurs twice or never."""
    z = zone_of(zone) if zone else None
    if z is None:
        return None
    a, b = t.replace(tzinfo=z, fold=0).utcoffset(), t.replace(tzinfo=z, fold=1).utcoffset()
    return t - a if a == b else None


def _day(y: int, m: int, d: int) -> date | None:
    try:
        return date(y, m, d)
    except ValueError:
        return None


def _year(text: str) -> int:
    return int(text) + 2000 if len(text) == 2 else int(text)


def _offset(text: str) -> timedelta | None:
    sign = -1 if "-" in text else 1
    digits = re.sub(r"[^0-9]", "", text)
    h, m = (int(digits[:-2]), int(digits[-2:])) if len(digits) > 2 else (int(digits), 0)
    return timedelta(minutes=sign * (60 * h + m)) if h <= 18 and m < 60 else None


def _settle(day: date, g: dict, zone: str | None) -> str | None:
    h = g.get("h") or g.get("h12")
    if h is None:
        return day.isoformat()
    hour, minute, second = int(h), int(g.get("mi") or g.get("mih") or 0), int(g.get("s") or 0)
    micro = int(((g.get("f") or "") + "000000")[:6])
    half = g.get("ap") or g.get("ap12")
    if half:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if half == "p" else 0)
    if hour > 23 or minute > 59 or second > 59:
        return None
    t = datetime(day.year, day.month, day.day, hour, minute, second, micro)
    off, letters = g.get("off") or g.get("off2"), g.get("zone") or g.get("zone2")
    try:
        if off:
            shift = _offset(off)
            return None if shift is None else _utc_text(t - shift)
        if letters:
            return _utc_text(t - timedelta(minutes=ZONE_LETTERS[letters.upper()]))
        utc = _local_to_utc(t, zone)
        return None if utc is None else _utc_text(utc)
    except OverflowError:
        return None


def _bare(text: str, zone: str | None) -> str | None:
    n = len(text)
    try:
        if n == 8:
            day = _day(int(text[:4]), int(text[4:6]), int(text[6:]))
            return day.isoformat() if day else None
        if n == 14:
            day = _day(int(text[:4]), int(text[4:6]), int(text[6:8]))
            return _settle(day, {"h": text[8:10], "mi": text[10:12], "s": text[12:]}, zone) if day else None
        if n == 10:
            return _utc_text(_EPOCH + timedelta(seconds=int(text)))
        if n == 13:
            return _utc_text(_EPOCH + timedelta(milliseconds=int(text)))
    except (ValueError, OverflowError):
        pass
    return None


def normal_form(text: str | None, zone: str | None) -> str | None:
    """``yyyy-MM-dd`` for a day, ``yyyy-MM-ddTHH:mm:ss.SSSSSSZ`` for an instant, None where the text settles neither.

    Digit-only day/month dates with the year last are month first for zones in America/, day first elsewhere, and the
    other way round where that is no real day. A clock time without zone is local to ``zone``.
    """
    if not isinstance(text, str):
        return None
    s = re.sub(r"[\s   ]+", " ", text).strip().lower().translate(_ACCENTS)
    if not s or not any(c.isdigit() for c in s) or not s.isascii():
        return None
    if s.isdigit() and len(s) != 5:
        return _bare(s, zone)
    if m := _SPREADSHEET.fullmatch(s):
        days, frac = int(m[1]), m[2]
        base = datetime(1899, 12, 30) + timedelta(days=days)
        if frac is None:
            return base.date().isoformat()
        seconds = (int(frac) * 86400 * 2 + 10 ** len(frac)) // (2 * 10 ** len(frac))
        utc = _local_to_utc(base + timedelta(seconds=seconds), zone)
        return None if utc is None else _utc_text(utc)
    if m := _BASIC.fullmatch(s):
        g = m.groupdict()
        day = _day(int(g["y"]), int(g["m"]), int(g["d"]))
        return _settle(day, g, zone) if day else None
    for form in _FORMS:
        if m := form.fullmatch(s):
            g = m.groupdict()
            if g.get("a"):
                a, b, y = int(g["a"]), int(g["b"]), _year(g["y"])
                month_first = bool(zone) and zone.startswith("America/")
                day = (_day(y, a, b) or _day(y, b, a)) if month_first else (_day(y, b, a) or _day(y, a, b))
            else:
                day = _day(_year(g["y"]), MONTHS[g["mon"]] if g.get("mon") else int(g["m"]), int(g["d"]))
            return _settle(day, g, zone) if day else None
    return None


UTC = timezone.utc
