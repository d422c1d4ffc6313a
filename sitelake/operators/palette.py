"""Brand palettes from style text and image histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.functions import color as C
from sitelake.operators.skew import first_n_per_key

# Fixed values.
HEX_LITERAL = r"(#(?:[0-9a-fA-F]{3}){1,2}\b)"
RGB_LITERAL = r"rgba?\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\s*(?:,\s*[\d.]+\s*)?\)"
DEFAULT_COLORS = {"primary": "#333333", "secondary": "#f5f5f5", "accent": "#0066cc"}
IMAGE_COLORS = 8


def color_literals(css: Column) -> Column:
    """`(color, kind, pos)` of every colour literal: hex ones first, then rgb ones with channels up to 255."""
    hexes = F.transform(
        F.regexp_extract_all(css, F.lit(HEX_LITERAL), F.lit(1)),
        lambda h, i: F.struct(C.normalize_hex(h).alias("color"), F.lit(0).alias("kind"), i.alias("pos")),
    )
    r, g, b = (F.transform(F.regexp_extract_all(css, F.lit(RGB_LITERAL), F.lit(n)), lambda v: v.cast("int")) for n in (1, 2, 3))
    triples = F.transform(F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b")), lambda t, i: F.struct(
        F.when((t["r"] <= 255) & (t["g"] <= 255) & (t["b"] <= 255), C.rgb_to_hex(t["r"], t["g"], t["b"])).alias("color"),
        F.lit(1).alias("kind"), i.alias("pos")))
    return F.concat(hexes, F.filter(triples, lambda t: t["color"].isNotNull()))


def _roles(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranks 1..3 to primary, secondary and accent; a missing role repeats the one before it."""
    top = ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("rank") == i, F.col("color"))).alias(f"c{i}") for i in (1, 2, 3)])
    return top.select(
        *keys, F.col("c1").alias("primary"), F.coalesce("c2", "c1").alias("secondary"), F.coalesce("c3", "c2", "c1").alias("accent")
    )


def css_palettes(styles: DataFrame, keys: Sequence[str], css: str = "css_text") -> DataFrame:
    """Three most frequent vivid colours of the style text of each key; keys without any are absent.

    Counts are combined before the shuffle, so a key with a great deal of style text moves one row per colour.
    """
    seen = styles.select(*keys, F.explode(color_literals(F.col(css))).alias("c")).groupBy(*keys, F.col("c.color").alias("color")).agg(
        F.count("*").alias("n"), F.min(F.struct("c.kind", "c.pos")).alias("first")
    )
    vivid = seen.filter(~C.is_neutral("color"))
    return _roles(first_n_per_key(vivid, keys, [F.desc("n"), F.asc("first"), F.asc("color")], 3), keys)


def image_palettes(histogram: DataFrame, key: str) -> DataFrame:
    """The same from `(key, r, g, b, n)` rows: the eight most common colours, neutrals dropped, three kept."""
    colored = histogram.withColumn("color", C.rgb_to_hex(F.col("r"), F.col("g"), F.col("b"))).groupBy(key, "color").agg(F.sum("n").alias("n"))
    common = first_n_per_key(colored, [key], [F.desc("n"), F.asc("color")], IMAGE_COLORS, "_place").filter(~C.is_neutral("color"))
    return _roles(first_n_per_key(common, [key], [F.asc("_place")], 3), [key])


def with_palette(sites: DataFrame, css: DataFrame, image: DataFrame) -> DataFrame:
    """Palette of each site: style text, else logo image, else the defaults."""

    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select("site", F.struct("primary", "secondary", "accent").alias(name))

    default = F.struct(*[F.lit(v).alias(k) for k, v in DEFAULT_COLORS.items()])
    joined = sites.join(packed(css, "_css"), "site", "left").join(packed(image, "_image"), "site", "left")
    return joined.withColumn("colors", F.coalesce("_css", "_image", default)).drop("_css", "_image")


def contrast_pairs(colors: Column) -> Column:
    """`(label, first, second, ratio)` of the three checked pairs."""
    p, s, a = colors["primary"], colors["secondary"], colors["accent"]
    pairs = [("primary text on secondary background", p, s), ("accent on secondary background", a, s), ("primary on accent", p, a)]
    return F.array(*[
        F.struct(F.lit(label).alias("label"), x.alias("first"), y.alias("second"), C.contrast_ratio(x, y).alias("ratio")) for label, x, y in pairs
    ])


def contrast_warnings(colors: Column) -> Column:
    low = F.filter(contrast_pairs(colors), lambda w: w["ratio"] < C.CONTRAST_MINIMUM)
    return F.transform(low, lambda w: F.format_string(
        "%s (%s vs %s): contrast ratio %.2f:1 is below WCAG AA (4.5:1)", w["label"], w["first"], w["second"], w["ratio"]))
