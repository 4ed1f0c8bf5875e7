"""Date parsing and arithmetic; nothing reads the clock, and what can't be parsed is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exposure_penalty(days: Column) -> Column:
    """Points taken off an item shown ``days`` ago; null: never shown."""
    return (
        F.when(days.isNull(), 0).when(days <= 1, 30).when(days <= 3, 25).when(days <= 6, 10).otherwise(0)
    )


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_timestamp(
        F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")
    ).cast("date")


_KOREAN = r"(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일"


def last_korean_date(text: Column) -> Column:
    found = F.try_element_at(F.regexp_extract_all(text, F.lit(_KOREAN), F.lit(0)), F.lit(-1))
    return _date(*[F.nullif(F.regexp_extract(found, _KOREAN, k), F.lit("")) for k in (1, 2, 3)])


def feed_time(c: Column) -> Column:
    """ISO, else RFC 2822 without its weekday, which the parser rejects."""
    mail = F.regexp_replace(c, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))


def dotted_time(c: Column) -> Column:
    """``yyyy.MM.dd[ HH:mm:ss]`` or ``yyyyMMdd``."""
    return F.coalesce(
        F.try_to_timestamp(c, F.lit("yyyy.MM.dd HH:mm:ss")),
        F.try_to_timestamp(c, F.lit("yyyy.MM.dd")),
        F.try_to_timestamp(c, F.lit("yyyyMMdd")),
    )


def range_end(c: Column) -> Column:
    """The date after ``~`` in ``A ~ B``, or of ``yyyyMMddHHmm``."""
    tail = F.regexp_extract(c, r"~\s*(\d{4}[.-]\d{2}[.-]\d{2})", 1)
    return F.coalesce(
        F.try_to_timestamp(F.regexp_replace(F.nullif(tail, F.lit("")), r"\.", "-"), F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(F.when(c.rlike(r"^\d{12}$"), F.substring(c, 1, 8)), F.lit("yyyyMMdd")),
    ).cast("date")


def english_date(c: Column) -> Column:
    """``August 30, 2026(Sun)``."""
    return F.try_to_timestamp(F.trim(F.regexp_replace(c, r"\(.*\)", "")), F.lit("MMMM d, yyyy")).cast("date")


def iso_day(c: Column) -> Column:
    return F.try_to_timestamp(F.substring(F.trim(c), 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def local_time(c: Column) -> Column:
    """An ISO time without its offset."""
    return F.try_to_timestamp(F.regexp_replace(c, r"([+-]\d{2}:?\d{2}|Z)$", "")).cast("timestamp_ntz")


def days_until(c: Column, ref: Column) -> Column:
    return F.datediff(iso_day(c), ref)
