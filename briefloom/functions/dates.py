"""Date functions. The session time zone is expected to be UTC; ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from briefloom.functions.text import let, trim_ws

# Thai month names, short and long, with their numbers.
THAI_MONTHS = {
    "ม.ค.": 1, "มกราคม": 1,
    "ก.พ.": 2, "กุมภาพันธ์": 2,
    "มี.ค.": 3, "มีนาคม": 3,
    "เม.ย.": 4, "เมษายน": 4,
    "พ.ค.": 5, "พฤษภาคม": 5,
    "มิ.ย.": 6, "มิถุนายน": 6,
    "ก.ค.": 7, "กรกฎาคม": 7,
    "ส.ค.": 8, "สิงหาคม": 8,
    "ก.ย.": 9, "กันยายน": 9,
    "ต.ค.": 10, "ตุลาคม": 10,
    "พ.ย.": 11, "พฤศจิกายน": 11,
    "ธ.ค.": 12, "ธันวาคม": 12,
}
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"

# RFC 822 month names and zone names.
ENGLISH_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZONE_HOURS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0,
    "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7,
}

BUDDHIST_OFFSET = 543
BANGKOK = "Asia/Bangkok"

_RFC822 = (
    "^(?:[A-Za-z]{3,9}\\.?,?\\s*)?(\\d{1,2})[\\s-]+([A-Za-z]{3})[A-Za-z]*\\.?,?[\\s-]+(\\d{4})"
    "(?:,?\\s+(\\d{1,2}):(\\d{2})(?::(\\d{2})(?:\\.\\d+)?)?)?\\s*([+-]\\d{2}:?\\d{2}|[A-Za-z]{1,4})?(?:\\s*\\(.*\\))?$"
)
_ISO = (
    "^(\\d{4})-(\\d{2})-(\\d{2})"
    "(?:[Tt ](\\d{2}):(\\d{2})(?::(\\d{2})(?:[.,](\\d{1,6})\\d*)?)?)?\\s*([+-]\\d{2}:?\\d{2}|[Zz])?$"
)
_THAI = "^.*?(\\d{1,2})\\s*([ก-๙.]+)\\s*(\\d{4})(?:\\s+(\\d{1,2}):(\\d{2}))?.*$"
_NUMERIC = "^(\\d{1,2})[/-](\\d{1,2})[/-](\\d{4})$"


# Each notation is rewritten to: year|month|day|hour|minute|second|fraction|zone.
_BANGKOK_ZONE = "+07:00"
_TO_FIELDS_ISO = "$1|$2|$3|$4|$5|$6|$7|$8"
_TO_FIELDS_RFC822 = "$3|$2|$1|$4|$5|$6||$7"
_TO_FIELDS_THAI = f"$3|$2|$1|$4|$5|||{_BANGKOK_ZONE}"
_TO_FIELDS_NUMERIC = f"$3|$2|$1|||||{_BANGKOK_ZONE}"


def _lookup(entries: dict[str, int], key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])
    return F.element_at(table, key)


def _months() -> dict[str, int]:
    digits = {str(i): i for i in range(1, 13)} | {f"{i:02d}": i for i in range(1, 10)}
    return digits | {name: i + 1 for i, name in enumerate(ENGLISH_MONTHS)} | THAI_MONTHS


def _int(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")).cast("int"), F.lit(0))


def _zone_seconds(zone: Column) -> Column:
    """Seconds east of UTC; no zone means UTC; unknown names give null."""
    digits = F.regexp_replace(zone, "[^0-9]", "")
    size = _int(F.substring(digits, 1, 2)) * 3600 + _int(F.substring(digits, 3, 2)) * 60
    return (
        F.when(zone == "", F.lit(0))
        .when(zone.startswith("-"), -size)
        .when(zone.startswith("+"), size)
        .otherwise(_lookup(ZONE_HOURS, F.lower(zone)) * 3600)
    )


def _instant(fields: Column) -> Column:
    """Instant from the eight fields; days past the end of a month roll over."""

    def at(i: int) -> Column:
        return F.get(fields, F.lit(i))

    def build(number: Column) -> Column:
        year, month, day, hour, minute, second = (F.get(number, F.lit(i)) for i in range(6))
        valid = (
            month.isNotNull() & day.between(1, 31) & year.between(1, 9999)
            & (hour <= 24) & (minute < 60) & (second < 60)
        )
        first = F.make_date(F.when(valid, year), month, F.lit(1))
        days = F.unix_date(F.date_add(first, day - 1)).cast("bigint")
        seconds = days * 86400 + hour * 3600 + minute * 60 + second - _zone_seconds(at(7))
        return F.timestamp_micros(seconds * 1_000_000 + F.rpad(at(6), 6, "0").cast("bigint"))

    year = _int(at(0))
    christian = F.when(year > 2400, year - BUDDHIST_OFFSET).otherwise(year)
    numbers = F.array(christian, _lookup(_months(), F.lower(at(1))), _int(at(2)), _int(at(3)), _int(at(4)), _int(at(5)))
    return let(numbers, build)


def parse_date(c: Column, now: Column | None = None) -> Column:
    """Publish time of a feed entry as a timestamp, null when it cannot be read.

    Reads ISO 8601, RFC 822, Thai text dates (Thai digits, Buddhist years, Bangkok midnight) and
    day-first numeric dates. Times without a zone are UTC. With ``now``, absurd times are null.
    """
    notations = (
        (_ISO, _TO_FIELDS_ISO),
        (_NUMERIC, _TO_FIELDS_NUMERIC),
        (_THAI, _TO_FIELDS_THAI),
        (_RFC822, _TO_FIELDS_RFC822),
    )

    def fields(raw: Column) -> Column:
        out = F
        for pattern, target in notations:
            out = out.when(raw.rlike(pattern), F.regexp_replace(raw, pattern, target))
        return F.split(out, "\\|", -1)

    arabic = F.translate(trim_ws(c), THAI_DIGITS, "0123456789")
    ts = let(let(arabic, fields), _instant)
    return ts if now is None else clamp_date(ts, now)


def clamp_date(ts: Column, now: Column) -> Column:
    """Null before the year 2000 and more than two days after ``now``."""
    low = F.lit("2000-01-01T00:00:00Z").cast("timestamp")
    return F.when(ts.between(low, now + F.expr("INTERVAL 2 DAYS")), ts)


def parse_epoch_or_date(c: Column, now: Column | None = None) -> Column:
    """9 to 11 digits are epoch seconds, everything else is read as a date (C14)."""
    raw = trim_ws(c.cast("string"))
    is_epoch = raw.rlike("^\\d{9,11}$")
    return F.when(is_epoch, F.timestamp_seconds(F.when(is_epoch, raw).cast("bigint"))).otherwise(parse_date(raw, now))


def is_within_lookback(ts: Column, hours: float, now: Column) -> Column:
    """Not older than the window and not more than six hours ahead."""
    age = F.unix_micros(now) - F.unix_micros(ts)
    ahead = F.lit(-6 * 3600 * 1_000_000)
    return F.coalesce((age <= F.lit(int(hours * 3600 * 1_000_000))) & (age >= ahead), F.lit(False))


def date_key(ts: Column, tz: str = BANGKOK) -> Column:
    """Calendar day in a time zone."""
    return F.to_date(F.from_utc_timestamp(ts, tz))


def format_local(ts: Column, tz: str = BANGKOK, pattern: str | None = None) -> Column:
    """Local display text, empty when there is no time (C17).

    The default is the Thai medium form: day, short month name, Buddhist year, time.
    """
    local = F.from_utc_timestamp(ts, tz)
    if pattern is not None:
        return F.coalesce(F.date_format(local, pattern), F.lit(""))
    short = [name for name, i in sorted(THAI_MONTHS.items(), key=lambda kv: kv[1]) if "." in name]
    months = F.array(*[F.lit(m) for m in short])
    text = F.concat_ws(
        " ",
        F.dayofmonth(local).cast("string"),
        F.element_at(months, F.month(local)),
        (F.year(local) + BUDDHIST_OFFSET).cast("string"),
        F.date_format(local, "HH:mm"),
    )
    return F.when(ts.isNull(), F.lit("")).otherwise(text)
