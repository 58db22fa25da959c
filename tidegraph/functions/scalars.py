"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 137 years in seconds bounds what a time in each unit can be.
YEARS_137 = 137 * 365 * 24 * 3600
EPSILON = 1e-5


def hash48(*parts: Column) -> Column:
    """48 bits of md5 of the parts joined by colons: the engine's reproducible randomness."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1] from hash48."""
    return (hash48(*parts) + 1) / F.lit(float((1 << 48) + 1))


def to_seconds(t: Column) -> Column:
    """A time in seconds, milliseconds or microseconds as seconds; 0 where it is none of them."""
    limit = F.lit(YEARS_137)
    return (
        F.when(t < 0, F.lit(0))
        .when(t < limit, t)
        .when(t < limit * 1000, F.floor(t / 1000))
        .when(t < limit * 1_000_000, F.floor(t / 1_000_000))
        .otherwise(F.lit(0))
        .cast("long")
    )


def path_time(path: Column, zone: str = "Asia/Shanghai") -> Column:
    """Epoch seconds of the first dt=YYYYmmdd[HHMM] in a path; bad hours or minutes count as 00, a bad date as 0."""
    found = F.regexp_extract(path, r"dt=(\d{8})(\d{0,4})", 1)
    clock = F.rpad(F.regexp_extract(path, r"dt=(\d{8})(\d{0,4})", 2), 4, "0")
    hour, minute = F.substring(clock, 1, 2), F.substring(clock, 3, 2)
    hour = F.when(hour < "24", hour).otherwise("00")
    minute = F.when(minute < "60", minute).otherwise("00")
    at = F.try_to_timestamp(F.concat(found, hour, minute), F.lit("yyyyMMddHHmm"))
    return F.coalesce(F.unix_timestamp(F.to_utc_timestamp(at, zone)), F.lit(0)).cast("long")


def time_text(t: Column, pattern: str = "'['yyyy-MM-dd HH:mm:ss']'") -> Column:
    return F.from_unixtime(t, pattern)


def range_label(value: Column, bounds: list[int]) -> Column:
    """floor-a, a-b, ..., z-upper: the half-open range of rising bounds that holds a value."""
    label = F.when(value < bounds[0], F.lit(f"floor-{bounds[0]}"))
    for low, high in zip(bounds, bounds[1:], strict=False):
        label = label.when(value < high, F.lit(f"{low}-{high}"))
    return label.otherwise(F.lit(f"{bounds[-1]}-upper"))


def fit_attrs(attrs: Column, length: int, kind: str = "long") -> Column:
    """The first `length` elements, filled up with zeros; a null array is all zeros."""
    zeros = F.array_repeat(F.lit(0).cast(kind), length)
    if not length:
        return F.array().cast(f"array<{kind}>")
    own = F.coalesce(attrs.cast(f"array<{kind}>"), F.array().cast(f"array<{kind}>"))
    return F.slice(F.concat(own, zeros), 1, length)


def attr_at(attrs: Column, index: int) -> Column:
    """One element, 0 where there is none."""
    return F.coalesce(F.get(attrs, index), F.lit(0))


def set_attr(attrs: Column, index: int, value: Column) -> Column:
    """The array with one element replaced; unchanged where the index is out of bounds."""
    return F.transform(attrs, lambda x, i: F.when(i == index, value).otherwise(x))


def used_ratio(attrs: Column) -> Column:
    """Share of elements that differ from 0."""
    return F.size(F.filter(attrs, lambda x: F.abs(x) > EPSILON)) / F.nullif(F.size(attrs), F.lit(0))


def transform_weight(value: Column, kind: str = "default", exponent: float = 1.0) -> Column:
    """default, log, log1p or power of a weight; negative weights count as 0."""
    value = F.greatest(value.cast("double"), F.lit(0.0))
    if kind == "default":
        return value
    if kind == "log":
        return F.when(value > 1, F.log(value)).otherwise(0.0)
    if kind == "log1p":
        return F.log1p(value)
    if kind == "power":
        return F.pow(value, F.lit(float(exponent)))
    raise ValueError(f"unknown weight transform {kind!r}")


def is_equal(a: Column, b: Column) -> Column:
    """Equal within EPSILON."""
    return F.abs(a - b) < EPSILON


def is_less(a: Column, b: Column) -> Column:
    """Less by more than EPSILON."""
    return a - b < -EPSILON


def expired(expire_ts: Column, now: int) -> Column:
    """A node is expired from its expiry second on; 0 never expires."""
    return (expire_ts != 0) & (expire_ts <= now)


def part_of(id_: Column, parts: int) -> Column:
    """The part of an id; parts are disjoint and cover all ids."""
    return F.pmod(hash48(id_), F.lit(parts)).cast("int")


def string_id(key: Column) -> Column:
    """A non-zero 64-bit id of a string key."""
    h = F.xxhash64(key)
    return F.when(h == 0, F.lit(1)).otherwise(h)


def query_parameters(query: Column) -> Column:
    """k=v&k=v as a map."""
    return F.str_to_map(query, F.lit("&"), F.lit("="))
