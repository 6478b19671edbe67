"""Sanitizers, dates, digests and identity expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_stamp(value: Column) -> Column:
    """UTC instant of an ISO text with an explicit offset, at most 40 characters, else null."""
    pattern = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})$"
    fits = (F.length(value) <= 40) & F.rlike(value, F.lit(pattern))
    return F.when(fits, F.try_to_timestamp(value))


def clean_code(value: Column) -> Column:
    """Identifier of 1 to 80 safe characters, else null."""
    return F.when(F.rlike(value, F.lit(r"^[A-Za-z0-9_-]{1,80}$")), value)


def clean_count(value: Column) -> Column:
    """Whole number from 0 to 10,000,000, else 0. Text with a fraction is not a count."""
    number = F.when(F.rlike(value, F.lit(r"^\d{1,8}$")), value.try_cast("long"))
    return F.when(number <= 10_000_000, number).otherwise(F.lit(0).cast("long"))


def clean_number(value: Column) -> Column:
    """Number from 0 up to (not including) 1e12, else null."""
    number = value.try_cast("double")
    return F.when((number >= 0) & (number < 1e12), number)


def clean_text(value: Column, pattern: str) -> Column:
    """The value when the whole of it matches, else null."""
    return F.when(F.rlike(value, F.lit(f"^(?:{pattern})$")), value)


def closed(value: Column, allowed: Sequence[str], other: str) -> Column:
    """Closed vocabulary: anything unknown, null included, becomes ``other``."""
    return F.when(value.isin(list(allowed)), value).otherwise(F.lit(other))


def strict_date(value: Column) -> Column:
    """ISO date that round-trips, else null."""
    parsed = F.try_to_date(F.when(F.rlike(value, F.lit(r"^\d{4}-\d{2}-\d{2}$")), value))
    return F.when(parsed.cast("string") == value, parsed)


# English month abbreviations of mail dates.
MAIL_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def any_date(value: Column) -> Column:
    """Date or UTC instant, as text, from ISO dates, ISO instants, mail dates and dd/mm/yyyy."""
    iso_day = strict_date(value).cast("string")
    iso_instant = F.date_format(clean_stamp(value), "yyyy-MM-dd'T'HH:mm:ssXXX")
    mail = F.regexp_replace(value, r"^[A-Za-z]{3},\s*", "")
    mail = F.regexp_replace(mail, r"\b(?:GMT|UTC|UT)$", "+0000")
    shape = r"^\d{1,2} (?:%s) \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$" % "|".join(MAIL_MONTHS)
    mail_instant = F.date_format(
        F.try_to_timestamp(F.when(F.rlike(mail, F.lit(shape)), mail), F.lit("d MMM yyyy HH:mm:ss Z")),
        "yyyy-MM-dd'T'HH:mm:ssXXX")
    written = F.regexp_extract(value, r"(\d{2}[/-]\d{2}[/-]20\d{2})", 1)
    day = F.try_to_date(F.when(written != "", F.translate(written, "-", "/")), "dd/MM/yyyy").cast("string")
    return F.coalesce(iso_day, iso_instant, mail_instant, day)


def local_instant(local: Column, zone: str = "Europe/Madrid") -> Column:
    """UTC instant of a local clock time; null when the clock skips or repeats it."""
    instant = F.to_utc_timestamp(local, zone)
    back = F.from_utc_timestamp(instant, zone)
    hour = F.expr("INTERVAL 1 HOUR")
    repeated = (F.from_utc_timestamp(instant + hour, zone) == local) | (
        F.from_utc_timestamp(instant - hour, zone) == local)
    return F.when((back == local) & ~repeated, instant)


def row_text(columns: Sequence[Column]) -> Column:
    """Canonical one-line text of a row: values by position, null marked, separator 0x1f."""
    return F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("\u0000")) for c in columns])


def short_id(text: Column, length: int) -> Column:
    """Leading hex digits of the SHA-256 of a text."""
    return F.left(F.sha2(text, 256), F.lit(length))


def digest_parts(text: Column) -> list[Column]:
    """Aggregates of an additive multiset digest: order-free, duplicate-sensitive and
    combinable before the shuffle, so that no group is ever collected."""
    hashed = F.sha2(text, 256)
    lanes = [F.conv(F.substring(hashed, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)") for i in range(5)]
    return [F.sum(lane) for lane in lanes] + [F.count(F.lit(1))]


def membership_key(namespace: str, course: Column, roster: Column, scope: Column, block: Column,
                   number: Column) -> Column:
    """Scoped membership id: hash of the JSON array of its reviewed parts; null when a part is
    outside its format."""
    fits = (
        F.rlike(course, F.lit(r"^\d{4}-\d{4}$")) & F.rlike(scope, F.lit(r"^(?:0597|\d{4}[A-Z0-9]\d{2})$"))
        & F.rlike(block, F.lit(r"^[A-Za-z0-9_-]{1,20}$")) & F.rlike(number, F.lit(r"^\d{7,8}$"))
    )
    parts = F.to_json(F.array(F.lit(namespace), course, roster, scope, block, number))
    return F.when(fits, short_id(parts, 32))
