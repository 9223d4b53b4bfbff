"""Event times: five textual layouts to epoch seconds, as column expressions.

Blanks around the text don't count; it has 1 to 63 characters. Days are
counted in the proleptic Gregorian calendar without a check against the month
(31 February rolls over), seconds go up to 60.999, years from 1970 to 2100. An
absent zone is UTC. The layouts are told apart by where - / and letters stand,
so a text has one layout at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import to_f64

# The fields that may hold an event's time, in order.
TIME_FIELDS = ("@timestamp", "time", "timestamp", "event.created")
DATE_FIELD, CLOCK_FIELD = "event.date", "event.time"
ALL_FIELDS = (*TIME_FIELDS, DATE_FIELD, CLOCK_FIELD)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

#: A clock: hours, minutes, and seconds as any number's prefix.
_CLOCK = r"([0-9]{2}):([0-9]{2})(:[ \t]*[+]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?))?"
#: What follows it: nothing, Z and anything, or an offset and anything.
_ZONE = r" *(?:$|[Zz].*|([+-])([0-9]{2}):?([0-9]{2})?.*)"
_ISO = r"(?s)^([0-9].{3})-(..)-(..)(?:$|[Tt ]" + _CLOCK + _ZONE + r")"
_SLASH = r"(?s)^([0-9].{3})/(..)/(..) *" + _CLOCK + _ZONE
_CLF = r"(?s)^([0-9]{1,2})/([A-Za-z]{3})/([0-9]..[0-9]):" + _CLOCK + _ZONE
_SYSLOG = r"(?s)^([A-Za-z]{3}) *([0-9]{1,2}) *" + _CLOCK + _ZONE


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01; the day may lie beyond its month's end."""
    y = F.when(m <= 2, y - 1).otherwise(y).cast("long")
    era = F.floor(y / 400)
    of_era = y - era * 400
    shifted = F.when(m > 2, m - 3).otherwise(m + 9)
    of_year = F.floor((153 * shifted + 2) / 5) + d - 1
    return era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468


def _bind(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def civil_to_epoch(
    y: Column, mo: Column, d: Column, h: Column, mi: Column, se: Column, offset_min: Column
) -> Column:
    """Epoch seconds, or null where a part is out of range."""
    parts = F.struct(
        y.alias("y"), mo.alias("mo"), d.alias("d"), h.alias("h"), mi.alias("mi"), se.alias("se"), offset_min.alias("o")
    )
    return _bind(parts, _epoch_of)


def _epoch_of(p: Column) -> Column:
    days = days_from_civil(p["y"], p["mo"], p["d"]).cast("double")
    good = p["y"].between(1970, 2100) & p["mo"].between(1, 12) & p["d"].between(1, 31) & _clock_ok(p)
    return F.when(good, days * 86400.0 + p["h"] * 3600.0 + p["mi"] * 60.0 + p["se"] - p["o"] * 60.0)


def _clock_ok(p: Column) -> Column:
    return p["h"].between(0, 23) & p["mi"].between(0, 59) & (p["se"] >= 0) & (p["se"] < 61)


def _int(v: Column) -> Column:
    return F.when(v.rlike("^[0-9]+$"), v).try_cast("int")


def _groups(b: Column, pattern: str, n: int) -> Column:
    """The pattern's groups as an array, in one pass; null if it doesn't match."""
    joined = F.regexp_replace(b, pattern, "\u0001".join(f"${i + 1}" for i in range(n)))
    return F.when(b.rlike(pattern), F.split(joined, "\u0001", -1))


def _clock(h: Column, mi: Column, se: Column) -> tuple[Column, Column, Column]:
    seconds = F.when(se == "", F.lit(0.0)).otherwise(F.regexp_replace(se, r"^:[ \t]*[+]?", "").try_cast("double"))
    return F.coalesce(_int(h), F.lit(0)), F.coalesce(_int(mi), F.lit(0)), seconds


def _offset(sign: Column, hours: Column, minutes: Column) -> Column:
    """Minutes east of UTC; null where they are out of range."""
    h, m = F.coalesce(_int(hours), F.lit(0)), F.coalesce(_int(minutes), F.lit(0))
    return F.when((h <= 14) & (m <= 59), (h * 60 + m) * F.when(sign == "-", -1).otherwise(1))


def _civil(b: Column, pattern: str, year: int, month: int, day: int, named: bool = False) -> Column:
    """The time of a layout whose pattern gives year, month and day in these
    places, then a clock and a zone."""

    def made(p: Column) -> Column:
        at = lambda i: F.get(p, F.lit(i))
        mo = _month(at(month)) if named else _int(at(month))
        clock = _clock(at(3), at(4), at(5))
        return civil_to_epoch(_int(at(year)), mo, _int(at(day)), *clock, _offset(at(6), at(7), at(8)))

    return _bind(_groups(b, pattern, 9), made)


def trimmed(v: Column) -> Column:
    b = F.regexp_replace(v, r"^[ \t]+|[ \t]+$", "")
    return F.when(F.length(v).between(1, 63) & (b != ""), b)


def _at(b: Column, i: int) -> Column:
    return F.substring(b, i + 1, 1)


def time_epoch(b: Column) -> Column:
    """A number of 9 to 18 characters above 1e8; what follows a blank is ignored."""
    shape = b.rlike(r"(?s)^[0-9]") & F.length(b).between(9, 18)
    shape &= ~_at(b, 4).isin("-", "/") & (_at(b, 2) != "/")
    number = F.regexp_extract(b, r"(?s)^((?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|0[xX][0-9a-fA-F.pP+-]+))(?: .*)?$", 1)
    value = _bind(F.when(shape & (number != ""), number), to_f64)
    return _bind(value, lambda x: F.when(x > 100000000.0, x))


def time_iso(b: Column) -> Column:
    """YYYY-MM-DD, optionally with T or a blank, a clock and a zone."""
    return _civil(b, _ISO, 0, 1, 2)


def time_slash(b: Column) -> Column:
    """YYYY/MM/DD HH:MM:SS, of 19 characters at least."""
    return F.when(F.length(b) >= 19, _civil(b, _SLASH, 0, 1, 2))


def _month(name: Column) -> Column:
    at = F.array_position(F.lit(list(MONTHS)), F.lower(name))
    return F.when(at > 0, at).cast("int")


def time_clf(b: Column) -> Column:
    """D/Mon/YYYY:HH:MM:SS, of 20 characters at least, optionally with a zone."""
    return F.when(F.length(b) >= 20, _civil(b, _CLF, 2, 1, 0, named=True))


def time_rfc3164(b: Column, ref_wall: float | Column = 0) -> Column:
    """Mon D HH:MM:SS; the year is the reference clock's, or the next or last
    one where the months are more than six apart."""
    wall = ref_wall if isinstance(ref_wall, Column) else F.lit(float(ref_wall))
    ref = F.timestamp_seconds(F.greatest(wall, F.lit(0.0)))

    def made(p: Column) -> Column:
        at = lambda i: F.get(p, F.lit(i))
        h, mi, se = _clock(at(2), at(3), at(4))
        parts = F.struct(
            _month(at(0)).alias("mo"), _int(at(1)).alias("d"), h.alias("h"), mi.alias("mi"), se.alias("se"),
            _offset(at(5), at(6), at(7)).alias("o"),
        )
        return _bind(parts, dated)

    def dated(p: Column) -> Column:
        apart = p["mo"] - F.month(ref)
        year = F.year(ref) + F.when(apart > 6, -1).when(apart < -6, 1).otherwise(0)
        days = days_from_civil(year, p["mo"], p["d"]).cast("double")
        value = days * 86400.0 + p["h"] * 3600.0 + p["mi"] * 60.0 + p["se"] - p["o"] * 60.0
        return F.when(p["d"].between(1, 31) & _clock_ok(p), value)

    return _bind(_groups(b, _SYSLOG, 8), made)


def parse_time(v: Column, ref_wall: float | Column = 0) -> Column:
    """Epoch seconds of a text in any layout, or null."""
    return _bind(trimmed(v), lambda b: _any_layout(b, ref_wall))


def _any_layout(b: Column, ref_wall: float | Column) -> Column:
    is_iso = b.rlike(r"(?s)^[0-9]...-..-")
    is_slash = b.rlike(r"(?s)^[0-9].../../") & (F.length(b) >= 19)
    is_clf = (F.length(b) >= 20) & ((_at(b, 1) == "/") | (_at(b, 2) == "/"))
    dated = (
        F.when(is_iso, time_iso(b))
        .when(is_slash, time_slash(b))
        .when(is_clf, time_clf(b))
        .otherwise(time_rfc3164(b, ref_wall))
    )
    return F.coalesce(time_epoch(b), dated)


def own_time(field, ref_wall: float | Column = 0) -> Column:
    """The first time that an event's fields give, or null. field(name) is a column."""
    tries = [parse_time(field(name), ref_wall) for name in TIME_FIELDS]
    date, clock = field(DATE_FIELD), field(CLOCK_FIELD)
    both = (F.length(date) > 0) & (F.length(clock) > 0) & (F.length(date) + F.length(clock) + 2 < 64)
    tries.append(F.when(both, parse_time(F.concat(date, F.lit(" "), clock), ref_wall)))
    return F.coalesce(*tries)


#: Rows of a range that one task sorts, about, and ranges at most (a number for each is in the plan).
RANGE_ROWS, MAX_RANGES = 1_000_000, 50_000


def dealt(df: DataFrame, order: str, range_rows: int = RANGE_ROWS, max_ranges: int = MAX_RANGES) -> tuple[Column, int]:
    """The range of the order that a row of df is in, of about range_rows, and the last range's number."""
    rows = df.count()
    ranges = max(1, min(max_ranges, rows // range_rows))
    cuts: list = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        bounds = df.agg(F.percentile_approx(F.col(order), F.lit(shares), F.lit(max(10_000, 4 * ranges)))).first()[0]
        cuts = sorted(set(bounds or []))
    n = len(cuts)
    if not n:
        return F.lit(0), 0
    steps = F.lit([1 << i for i in range(n.bit_length())][::-1])
    held = F.lit(cuts)
    bucket = F.aggregate(  # how many cuts are below the row's place, by halving
        steps,
        F.lit(0),
        lambda at, s: F.when(
            (at + s <= n) & (F.element_at(held, F.least(at + s, F.lit(n))) < F.col(order)), at + s
        ).otherwise(at),
    )
    return bucket, n


def event_clock(
    df: DataFrame, own: str, order: str, out: str = "ts", range_rows: int = RANGE_ROWS, max_ranges: int = MAX_RANGES
) -> DataFrame:
    """df with the clock `out`: an event's own time, or its last timed predecessor's
    in arrival order (0 before any), and `untimed`.

    The carry goes over all rows. Rows are dealt to ranges of the order, as many as
    their number asks for; each range's last own time (a row for each range) is
    carried on to the next, and within a range a window does it. Input of one range
    takes one pass; else the order is read once more, and own times are.
    """
    bucket, n = dealt(df, order, range_rows, max_ranges)
    table = [0.0]
    if n:
        timed = df.select(bucket.alias("b"), F.col(order).alias("o"), F.col(own).alias("t")).where("t is not null")
        last = {r["b"]: r["t"] for r in timed.groupBy("b").agg(F.max_by("t", "o").alias("t")).collect()}
        for b in range(n):
            table.append(last.get(b, table[-1]))
    rows = df.withColumn("__bucket", bucket)
    w = Window.partitionBy("__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = F.element_at(F.lit([float(x) for x in table]), F.col("__bucket") + 1)
    clock = F.coalesce(F.last(own, ignorenulls=True).over(w), before)
    return rows.withColumn(out, clock).withColumn("untimed", F.col(own).isNull()).drop("__bucket")
