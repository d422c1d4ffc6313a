"""Colour column functions over `#rrggbb` strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SATURATION_FLOOR = 0.15
LIGHTNESS_FLOOR = 0.08
LIGHTNESS_CEILING = 0.92
CONTRAST_MINIMUM = 4.5


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def channel(hex_color: Column | str, index: int) -> Column:
    """Channel 0..255 (index 0 red, 1 green, 2 blue)."""
    return F.conv(F.substring(_col(hex_color), 2 + 2 * index, 2), 16, 10).cast("int")


def normalize_hex(literal: Column | str) -> Column:
    """`#abc` and `#AABBCC` to `#aabbcc`."""
    literal = F.lower(_col(literal))
    return F.when(F.length(literal) == 4, F.regexp_replace(literal, "([0-9a-f])", "$1$1")).otherwise(literal)


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int"))


def is_neutral(hex_color: Column | str) -> Column:
    """Near-white, near-black or grey, judged in HLS space."""
    channels = [channel(hex_color, i) / F.lit(255.0) for i in range(3)]
    top, low = F.greatest(*channels), F.least(*channels)
    light = (top + low) / 2
    spread = top - low
    saturation = F.when(spread == 0, F.lit(0.0)).when(light <= 0.5, spread / (top + low)).otherwise(spread / (2.0 - top - low))
    return (saturation < SATURATION_FLOOR) | (light < LIGHTNESS_FLOOR) | (light > LIGHTNESS_CEILING)


def luminance(hex_color: Column | str) -> Column:
    """Relative luminance after WCAG 2."""

    def linear(index: int) -> Column:
        c = channel(hex_color, index) / F.lit(255.0)
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(0) + 0.7152 * linear(1) + 0.0722 * linear(2)


def contrast_ratio(first: Column | str, second: Column | str) -> Column:
    a, b = luminance(first), luminance(second)
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)
