"""Calendar expressions; the present day is always an argument."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_date(ts: Column, zone: str) -> Column:
    """Calendar date of a UTC timestamp in a zone."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def next_saturday(day: Column) -> Column:
    """The first Saturday after a day, never the day itself."""
    return F.next_day(day, "SAT")


def days_since(now: Column, day: Column) -> Column:
    return F.datediff(now, day)


def relative_label(days: Column) -> Column:
    return F.when(days == 0, "today").when(days == 1, "yesterday").otherwise(F.concat(days.cast("string"), F.lit(" days ago")))


def clock(ms: Column) -> Column:
    """m:ss of a duration in milliseconds."""
    s = F.floor(ms / 1000)
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


def valid_date(text: Column) -> Column:
    """Whether a text is a real date in the form YYYY-MM-DD."""
    return F.coalesce(F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd") == text, F.lit(False))
