"""Time parsing, grid steps, and the year ranges that values are stored under."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the grid steps and their lengths in seconds.
STEP_SECONDS = {"PT1M": 60, "PT1H": 3600, "P1D": 86400}

# Years that start a storage range; the last one ends the covered time.
BUCKET_YEARS = [1950, 2000, 2010, *range(2015, 2031)]

# Years take four digits (more after a plus sign), the other fields one or two; blanks may precede a
# field. The groups are possessive, so a field never gives digits back to the next one.
_YEAR, _TWO = r"(\+[0-9]++|[0-9]{1,4}+)", r"([0-9]{1,2}+)"
_COMPACT_GAPS = [r"\s*+"] * 6
_DASHED_GAPS = [r"\s*+", r"-\s*+", r"-\s*+", r"\s*+", r":\s*+", r":\s*+"]


def _pattern(gaps):
    return "^" + "".join(gap + field for gap, field in zip(gaps, [_YEAR] + [_TWO] * 5))


def _prefix_pattern(gaps):
    """Matches a text that ends before all fields have been read."""
    pattern = ""
    for gap, field in reversed(list(zip(gaps, [_YEAR] + [_TWO] * 5))):
        pattern = f"({gap}({field}{pattern})?)?" if pattern else f"({gap})?"
    return f"^{pattern}$"


def _parse(text: Column, full: str, spark_format: str, gaps) -> Column:
    pattern = _pattern(gaps) + "$"

    def field(i):
        return F.regexp_extract(text, pattern, i).try_cast("int")

    plain = F.when(text.rlike(full), F.try_to_timestamp(text, F.lit(spark_format)))
    # Second 60 is the first of the next minute; the plain parser refuses it.
    loose = F.when(
        text.rlike(pattern),
        F.try_make_timestamp(field(1), field(2), field(3), field(4), field(5), field(6).cast("decimal(16,6)")),
    )
    return F.coalesce(plain, loose)


def compact_time(text: Column) -> Column:
    """`yyyyMMddHHmmss` in UTC; NULL when malformed or no such time."""
    return _parse(text, r"^[0-9]{14}$", "yyyyMMddHHmmss", _COMPACT_GAPS)


def dashed_time(text: Column) -> Column:
    """`yyyy-MM-dd HH:mm:ss` in UTC; NULL when malformed or no such time."""
    full = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"
    return _parse(text, full, "yyyy-MM-dd HH:mm:ss", _DASHED_GAPS)


# Every text that matches is read by `dashed_time`; others may be too, such as the last days of a month.
_PLAIN = r"^(?!0000)[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|1[0-9]|2[0-8]) ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]\z"


def is_plain_time(text: Column) -> Column:
    """Whether `dashed_time` surely reads a text, without reading it."""
    return F.coalesce(text.rlike(_PLAIN), F.lit(False))


def compact_time_fault(text: Column) -> Column:
    """Why `compact_time` gave NULL, in the fixed wording of the receipts."""
    return (
        F.when(text.rlike(_pattern(_COMPACT_GAPS) + "$"), "input is out of range")
        .when(text.rlike(_pattern(_COMPACT_GAPS)), "trailing input")
        .when(text.rlike(_prefix_pattern(_COMPACT_GAPS)), "premature end of input")
        .otherwise("input contains invalid characters")
    )


def step_seconds(resolution: str, strict: bool = True) -> int:
    """Length of a grid step; with ``strict=False`` an unknown name means one minute."""
    if strict and resolution not in STEP_SECONDS:
        raise ValueError(f"unknown time resolution {resolution!r}, use one of {sorted(STEP_SECONDS)}")
    return STEP_SECONDS.get(resolution, STEP_SECONDS["PT1M"])


def range_start(value: Column, starts: list, bounds: list[Column] | None = None) -> Column:
    """The largest of the sorted ``starts`` that is not above ``value``, by binary search; NULL below the first.

    ``bounds`` are what the value is compared with in their place, if that is cheaper.
    """
    bounds = bounds or [F.lit(start) for start in starts]

    def among(low: int, high: int) -> Column:
        if high - low == 1:
            return F.lit(starts[low])
        middle = (low + high) // 2
        return F.when(value < bounds[middle], among(low, middle)).otherwise(among(middle, high))

    return F.when(value >= bounds[0], among(0, len(starts))) if len(starts) else F.lit(None).cast("int")


# Boundaries that go into one expression; it is searched in as many steps as their number has binary digits.
MOST_RANGES = 1000


def range_years(boundaries: DataFrame, column: str = "year") -> list[int]:
    """The first years of storage ranges from a table, sorted; the last one is the end of the covered time."""
    years = [r[0] for r in boundaries.where(F.col(column).isNotNull()).select(column).distinct().limit(MOST_RANGES + 1).collect()]
    if not 2 <= len(years) <= MOST_RANGES:
        raise ValueError(f"storage ranges need from 2 to {MOST_RANGES} boundaries")
    return sorted(map(int, years))


def _new_year(year: int) -> Column:
    """The first day of a year, which a time is compared with as it is: no calendar is asked for it."""
    return F.make_date(F.lit(year), F.lit(1), F.lit(1))


def obs_bucket(obstime: Column, ranges: list[int] = BUCKET_YEARS) -> Column:
    """First year of the storage range of a time, NULL outside the covered time."""
    return F.when(obstime < _new_year(ranges[-1]), range_start(obstime, ranges[:-1], [_new_year(year) for year in ranges[:-1]]))


def obs_month(obstime: Column, ranges: list[int] = BUCKET_YEARS) -> Column:
    """Year and month of a time as one number, `yyyymm`; NULL outside the covered time."""
    inside, date = (obstime >= _new_year(ranges[0])) & (obstime < _new_year(ranges[-1])), utc_date(obstime)
    return F.when(inside, F.year(date) * 100 + F.month(date))


def month_filter(start=None, end=None, column: str = "obs_month") -> Column:
    """Predicate on the month column implied by a closed time range, for partition pruning."""
    test = F.lit(True)
    if start is not None:
        test = test & (F.col(column) >= start.year * 100 + start.month)
    if end is not None:
        test = test & (F.col(column) <= end.year * 100 + end.month)
    return test


def bucket_filter(start=None, end=None, column: str = "obs_bucket", ranges: list[int] = BUCKET_YEARS) -> Column:
    """Predicate on the partition column implied by a closed time range, for partition pruning."""
    buckets = ranges[:-1]
    if start is not None:
        first = max([b for b in buckets if b <= start.year], default=buckets[0])
        buckets = [b for b in buckets if b >= first]
    if end is not None:
        buckets = [b for b in buckets if b <= end.year]
    return F.col(column).isin(buckets)


def floor_div(a: Column, b: int) -> Column:
    """Whole-number division that rounds down, also below zero."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b))


def micros(time: Column) -> Column:
    """Microseconds since 1970 in UTC, of a time with or without zone."""
    return F.unix_micros(time.cast("timestamp"))


def rfc3339(time: Column) -> Column:
    """Text of a UTC time; the fraction is left out when zero and otherwise has 3 or 6 digits."""
    time = time.cast("timestamp")
    fraction = F.pmod(F.unix_micros(time), F.lit(1_000_000))
    return (
        F.when(fraction == 0, F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(fraction % 1000 == 0, F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .otherwise(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    )


def utc_date(time: Column) -> Column:
    """Date in UTC, for plans that pass very many rows: the rules of the time zone are not asked for each of them."""
    return F.date_from_unix_date(floor_div(micros(time), 86_400 * 1_000_000).cast("int"))
