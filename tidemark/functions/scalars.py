"""Scalar rules as columns: units, instants, quality classes, identifiers, civil days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exact conversion factors.
FEET, CUBIC_FEET, KELVIN = 0.3048, 0.028316846592, 273.15
_TO_SI = {"ft": (FEET, 0.0, "m"), "m": (1.0, 0.0, "m"), "ft3/s": (CUBIC_FEET, 0.0, "m3/s"), "m3/s": (1.0, 0.0, "m3/s"), "degC": (1.0, KELVIN, "K"), "K": (1.0, 0.0, "K")}


def to_si(value: Column, unit: Column) -> Column:
    """Struct (value, unit) in SI; an unknown unit gives NULL, a temperature below absolute zero raises."""
    v, u = F.lit(None).cast("double"), F.lit(None).cast("string")
    for name, (factor, offset, si) in _TO_SI.items():
        v = F.when(unit == name, value * factor + offset).otherwise(v)
        u = F.when(unit == name, si).otherwise(u)
    v = F.when((u == "K") & (v < 0), F.raise_error(F.lit("temperature below absolute zero")).cast("double")).otherwise(v)
    return F.struct(v.alias("value"), u.alias("unit"))


def iso_utc(text: Column) -> Column:
    """An ISO instant as 'yyyy-MM-ddTHH:mm:ssZ'; text without an offset gives NULL."""
    offset = F.regexp_extract(text, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    stamp = F.try_to_timestamp(F.regexp_replace(text, r"(\.\d+)?(Z|[+-]\d{2}:?\d{2})$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    digits = F.regexp_replace(offset, ":", "")
    minutes = F.when(offset == "Z", F.lit(0)).otherwise((F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int")) * F.when(digits.startswith("-"), -1).otherwise(1))
    seconds = F.unix_seconds(stamp) - minutes * 60
    return F.when(offset != "", F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def quality_class(props: Column) -> Column:
    """Lenient class of a JSON record: a comma list of qualifiers may be text or an array; absent is unflagged."""
    approval, raw = F.get_json_object(props, "$.approval_status"), F.get_json_object(props, "$.qualifier")
    listed = F.from_json(raw, "array<string>")
    parts = F.when(raw.startswith("["), listed).otherwise(F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))
    approved = approval.isin("Approved", '["Approved"]')
    return F.when(~F.coalesce(approved, F.lit(False)) | raw.startswith("{"), "unusable_quality").when(F.size(parts) == 0, "approved_unflagged").when((F.size(parts) == 1) & (parts[0] == "ESTIMATED"), "estimated_flagged").otherwise("unusable_quality")


def decimal_value(text: Column) -> Column:
    """Struct (value, status): text that is no finite, nonnegative decimal is unusable, never zero."""
    value = text.try_cast("decimal(20,6)")
    return F.struct(F.when(value >= 0, value).alias("value"), F.when(text.isNull(), "missing_value").when(value.isNull() | (value < 0), "unusable_quality").otherwise("usable").alias("status"))


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").otherwise("SON")


def canonical_site(text: Column, agency: str) -> Column:
    """Site number without its agency prefix; white space or anything but digits gives NULL."""
    bare = F.regexp_replace(text, f"^{agency}-", "")
    return F.when(bare.rlike(r"^\d+$"), bare)


def civil_day(day: Column, zone: str) -> Column:
    """Struct (start, end, status) of a local date in UTC; a midnight that is ambiguous or does not exist is unresolved."""

    def midnight(d: Column) -> tuple[Column, Column]:
        wall = d.cast("timestamp_ntz").cast("timestamp")
        u = F.to_utc_timestamp(wall, zone)
        shifts = [F.from_utc_timestamp(u + F.expr(f"INTERVAL '{m}' MINUTE"), zone) == wall for m in (60, -60, 30, -30)]
        ambiguous = shifts[0] | shifts[1] | shifts[2] | shifts[3]
        return u, (F.from_utc_timestamp(u, zone) == wall) & ~ambiguous

    (a, good_a), (b, good_b) = midnight(day), midnight(F.date_add(day, 1))
    good = good_a & good_b
    return F.struct(F.when(good, a).alias("start"), F.when(good, b).alias("end"), F.when(good, "mapped").otherwise("unresolved").alias("status"))
