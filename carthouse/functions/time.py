"""F1 / F2: ISO-8601 event times with an offset, and their local calendar fields.

All are Column expressions (JVM side, inside whole-stage codegen).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the ISO offset form without seconds, which the default parser
# does not accept but the ISO-8601 offset format allows.
_NO_SECONDS = "yyyy-MM-dd'T'HH:mmXXX"
# Fixed value: the shape of an ISO offset date-time (seconds and fraction
# optional, offset required).
_ISO_OFFSET_RE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_event_time(text) -> Column:
    """ISO-8601 text with offset -> TIMESTAMP instant (micros; nanos truncate).

    NULL when the text is not a valid ISO offset date-time; the strict policy
    turns that NULL into a failure (see operators.projections).
    """
    t = _c(text)
    return F.when(t.rlike(_ISO_OFFSET_RE),
                  F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(t, F.lit(_NO_SECONDS))))


def local_date(text) -> Column:
    """Calendar date in the event's *own* offset: the date part of the text.

    Deliberately not ``to_date(to_timestamp(t))``, which would shift the day
    into the session zone.
    """
    d = F.substring(_c(text), 1, 10)
    # A date of this shape is cast, which takes a third of the time of a formatter.
    shaped = (F.length(d) == 10) & (F.substring(d, 5, 1) == "-") & (F.substring(d, 8, 1) == "-") & F.substring(d, 10, 1).between("0", "9")
    return F.coalesce(F.when(shaped, d.try_cast("date")), F.try_to_date(d, "yyyy-MM-dd"))


def calendar_fields(text, names=("year", "month", "day")) -> list[Column]:
    d = local_date(text)
    cols = [F.year(d), F.month(d), F.dayofmonth(d)]
    return [c.alias(n) for c, n in zip(cols, names)][: len(names)]


def offset_text(offset_minutes) -> Column:
    """Minutes east of UTC -> 'Z' or '+HH:MM' / '-HH:MM'."""
    m = _c(offset_minutes).cast("int")
    a = F.abs(m)
    hhmm = F.concat(F.lpad((a / 60).cast("int").cast("string"), 2, "0"), F.lit(":"),
                    F.lpad((a % 60).cast("string"), 2, "0"))
    return F.when(m == 0, F.lit("Z")).otherwise(
        F.concat(F.when(m < 0, F.lit("-")).otherwise(F.lit("+")), hhmm))


def _micros_of_second(ts: Column) -> Column:
    """0..999999 from a wall time, without any zone conversion."""
    return F.pmod((F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long"), F.lit(1_000_000))


def _iso_text(date_text: Column, h: Column, m: Column, sec: Column, micros: Column, offset_minutes) -> Column:
    def two(c):
        return F.lpad(c.cast("string"), 2, "0")

    frac = F.when(micros == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.regexp_replace(F.lpad(micros.cast("string"), 6, "0"), "0+$", "")))
    return F.concat(date_text, F.lit("T"), two(h), F.lit(":"), two(m), F.lit(":"), two(sec), frac,
                    offset_text(offset_minutes))


def format_local_time(local_ntz, offset_minutes) -> Column:
    """Local wall time (TIMESTAMP_NTZ) at a given offset -> ISO offset text.

    Same shape as the ISO offset formatter: seconds always, the fraction only
    when non-zero and without trailing zeros, 'Z' for a zero offset. Built
    from zone-free parts (``date_format`` would pass through the session
    zone and move wall times that fall in its daylight-saving gaps).
    """
    ts = _c(local_ntz)
    return _iso_text(F.to_date(ts).cast("string"), F.hour(ts), F.minute(ts), F.second(ts),
                     _micros_of_second(ts), offset_minutes)


def format_event_time(instant, offset_minutes) -> Column:
    """Instant (TIMESTAMP) shown at an offset -> ISO offset text, by epoch
    arithmetic (no session zone involved)."""
    day_us = 86_400_000_000
    local_us = F.unix_micros(_c(instant)) + _c(offset_minutes).cast("long") * 60_000_000
    days = F.floor(local_us / F.lit(day_us)).cast("int")
    sod = local_us - days.cast("long") * day_us
    return _iso_text(F.date_from_unix_date(days).cast("string"), (sod / 3_600_000_000).cast("long"),
                     F.pmod((sod / 60_000_000).cast("long"), F.lit(60)),
                     F.pmod((sod / 1_000_000).cast("long"), F.lit(60)), F.pmod(sod, F.lit(1_000_000)),
                     offset_minutes)


# The shape the ISO offset formatter prints (micros).
_CANONICAL_RE = (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{0,5}[1-9])?(Z|[+-](?!00:00)\d{2}:\d{2})$")
# date+hh:mm, :ss, (unused), fraction digits, offset
_PARTS_RE = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2})(:\d{2})?(\.(\d{1,9}))?(Z|[+-]\d{2}:\d{2})$"
_LOCAL_RE = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?)(Z|[+-]\d{2}:\d{2})$"


def text_offset_minutes(text) -> Column:
    """Minutes east of UTC written in ISO offset text ('Z' = 0)."""
    off = F.regexp_extract(_c(text), _LOCAL_RE, 4)
    mins = F.substring(off, 2, 2).cast("int") * 60 + F.substring(off, 5, 2).cast("int")
    return F.when(off == "Z", F.lit(0)).when(off == "", F.lit(None).cast("int")) \
        .otherwise(F.when(F.substring(off, 1, 1) == "-", -mins).otherwise(mins))


def normalize_event_time(text, checked: bool = False) -> Column:
    """Re-render ISO offset text the way the ISO offset formatter prints the
    parsed value: seconds always, the fraction cut to micros and only when
    non-zero, 'Z' for a zero offset.

    Pure string work on the matched parts. ``checked=True`` when the caller
    already failed on unparseable text (the strict projections); otherwise
    text that does not parse gives NULL.
    """
    t = _c(text)

    def part(i):
        return F.regexp_extract(t, _PARTS_RE, i)

    frac = F.regexp_replace(F.substring(part(4), 1, 6), "0+$", "")
    off = part(5)
    out = F.concat(part(1), F.when(part(2) == "", F.lit(":00")).otherwise(part(2)),
                   F.when(frac == "", F.lit("")).otherwise(F.concat(F.lit("."), frac)),
                   F.when(off.isin("Z", "+00:00", "-00:00"), F.lit("Z")).otherwise(off))
    ok = t.rlike(_ISO_OFFSET_RE) if checked else parse_event_time(t).isNotNull()
    # Text that already has the printed shape (nearly all) is kept after one match.
    return F.when(t.rlike(_CANONICAL_RE) if checked else t.rlike(_CANONICAL_RE) & ok, t).when(ok, out)


def ntz_epoch_micros(local_ntz) -> Column:
    """Micros since 1970-01-01T00:00 of a wall time, independent of the session zone."""
    ts = _c(local_ntz)
    secs = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return (F.unix_date(F.to_date(ts)).cast("long") * 86_400_000_000 + secs.cast("long") * 1_000_000
            + _micros_of_second(ts))
