"""Small string and record helpers shared by the label and detection operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]*)$", 1))


def capture_no(capture_id: Column) -> Column:
    """Number of a ``capture_<n>`` id, null otherwise."""
    digits = F.regexp_extract(capture_id, r"^capture_(\d+)$", 1)
    return F.when(digits != "", digits.cast("long"))


def clean_label(label: Column) -> Column:
    return F.trim(F.coalesce(label, F.lit("")))


def name_list(value: Column) -> Column:
    """Comma list to trimmed, non-empty names."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda n: F.trim(n)), lambda n: n != "")


def parse_names(value: str | None) -> list[str]:
    return [n.strip() for n in (value or "").split(",") if n.strip()]


def tagged_stem(stem_col: Column, tag: str | None) -> Column:
    return stem_col if not tag else F.concat(F.lit(f"{tag}__"), stem_col)


def fixed6(value: Column) -> Column:
    """Six-digit text of a value in [0, 1], ties judged on the exact binary value.

    Twice the millionths are formed with their rounding error (a split product), so a
    value a hair above or below a tie goes the right way and true ties go to even.
    """
    scale = 2_000_000.0
    split = 134_217_729.0
    high_c = scale * split - (scale * split - scale)
    low_c = scale - high_c
    twice = value * scale
    big = value * split
    high = big - (big - value)
    low = value - high
    err = ((high * high_c - twice) + high * low_c + low * high_c) + low * low_c
    # Terms are written so that few are worked out twice, and errors only where they count.
    near = F.rint(twice / 2)
    tied = F.when(err > 0, (twice + 1) / 2).when(err < 0, (twice - 1) / 2).otherwise(near)
    n = F.when(twice % 2 == 1, tied).otherwise(near).cast("long")
    # A one before the digits keeps their zeros; formatting by pattern costs many times as much.
    digits = (n + 10_000_000).cast("string")
    return F.substring(F.overlay(digits, F.lit("."), F.lit(3), F.lit(0)), 2, 8)


def age_s(now: Column, ts: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts)) / 1e6


def stamp_from_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("long"))


def rgb01(col: Column) -> Column:
    return col.cast("double") / 255.0


def swap_rb(df, r: str = "r", b: str = "b"):
    """Exchange the red and blue channels."""
    return df.withColumns({r: F.col(b), b: F.col(r)})


def to_metres(raw: Column, depth_scale: Column | float) -> Column:
    return raw.cast("double") * depth_scale


# --- class colours ------------------------------------------------------------


def hue_of(name: Column) -> Column:
    """Stable hue in degrees for a class without a configured colour."""
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") % 360).cast("int")


def hue_rgb(hue: Column, saturation: float = 0.65) -> Column:
    """STRUCT<r,g,b> in 0..255 of a fully bright colour."""
    def channel(shift: int) -> Column:
        k = F.pmod(F.lit(float(shift)) + hue / 60.0, F.lit(6.0))
        fall = F.greatest(F.lit(0.0), F.least(k, F.lit(4.0) - k, F.lit(1.0)))
        return F.floor((F.lit(1.0) - F.lit(saturation) * fall) * 255.0).cast("int")

    return F.struct(channel(5).alias("r"), channel(3).alias("g"), channel(1).alias("b"))
