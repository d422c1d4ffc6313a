"""Settings, fonts, prompt templates and message compaction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.functions import text as X
from sitelake.operators.skew import running_sums

# Fixed values.
ACCEPTED_FONTS = (
    "Fraunces", "Newsreader", "Instrument Serif", "Cormorant Garamond", "Playfair Display", "DM Serif Display",
    "Inter", "Inter Tight", "Manrope", "Plus Jakarta Sans", "Outfit", "Work Sans", "Sora", "Space Grotesk",
    "Archivo Black", "Archivo Expanded", "Bricolage Grotesque", "Big Shoulders Display",
    "Quicksand", "Baloo 2", "Nunito", "Comfortaa", "Oswald", "Archivo Narrow",
    "JetBrains Mono", "Space Mono", "IBM Plex Mono", "Caveat",
    "Open Sans", "Roboto", "Lato", "Montserrat", "Poppins", "Raleway", "Source Sans 3", "Noto Sans",
)
DEFAULT_HEADING_FONT = "Inter Tight"
DEFAULT_BODY_FONT = "Inter"
COMPACT_ABOVE = 300


def normalize_font(name: Column, fallback: Column) -> Column:
    """Canonical spelling of an accepted font, else the fallback."""
    pairs = [F.lit(x) for font in ACCEPTED_FONTS for x in (font.lower(), font)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(F.trim(name))), fallback)


def merge_meta(base: DataFrame, proposals: DataFrame, key: str) -> DataFrame:
    """Site meta: proposals over base per field; fonts must be accepted ones, falling back to base, then defaults."""
    fields = ("site_name", "tagline", "tone", "site_category")
    offered = proposals.select(key, *[F.col(f).alias(f"_p_{f}") for f in (*fields, "heading_font", "body_font")])
    joined = base.join(offered, key, "left")

    def kept(f: str) -> Column:
        return F.coalesce(F.when(F.col(f"_p_{f}") != "", F.col(f"_p_{f}")), F.col(f))

    def font(f: str, default: str) -> Column:
        return normalize_font(F.col(f"_p_{f}"), normalize_font(F.col(f), F.lit(default)))

    return joined.select(
        key, *[kept(f).alias(f) for f in fields], font("heading_font", DEFAULT_HEADING_FONT).alias("heading_font"),
        font("body_font", DEFAULT_BODY_FONT).alias("body_font"))


def setting_values(settings: DataFrame, defaults: Mapping[str, float]) -> DataFrame:
    """Every known setting with its stored value, else its default; zero is a valid stored value."""
    known = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(float(v)).alias("default")) for k, v in defaults.items()])
    stored = settings.filter(F.col("key").isin(*defaults)).groupBy("key").agg(F.max("value").alias("value"))
    spread = settings.sparkSession.range(1).select(F.inline(known))
    return spread.join(stored, "key", "left").select("key", F.coalesce("value", "default").alias("value"))


def model_or_default(override: Column, default: str, blank_is_unset: bool = False) -> Column:
    """Model choice: null falls back, and so does blank where blank means unset."""
    chosen = F.when(override != "", override) if blank_is_unset else override
    return F.coalesce(chosen, F.lit(default))


def upsert(base: DataFrame, updates: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Snapshot with one row per key, the newest write winning; partially aggregated before the shuffle."""
    both = base.unionByName(updates)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def template_catalogue(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Every file with its tracked category and state; an untracked file is active with an inferred category."""
    tracked = rows.select("filename", F.col("category").alias("_c"), F.col("is_active").alias("_a"))
    joined = files.join(tracked, "filename", "left")
    return joined.select(
        "filename", F.coalesce("_c", X.template_category("filename")).alias("category"), F.coalesce("_a", F.lit(True)).alias("is_active"))


def active_templates(files: DataFrame, rows: DataFrame) -> DataFrame:
    return files.join(rows.filter("not is_active").select("filename"), "filename", "left_anti")


def active_categories(active: DataFrame) -> DataFrame:
    return active.select(X.template_category("filename").alias("category")).distinct().orderBy("category")


def narrow_to_category(active: DataFrame, category: str | None) -> DataFrame:
    """Templates of the category; all of them when it is blank or nothing matches."""
    if not category:
        return active
    match = F.lower(X.template_category("filename")) == category.lower()
    found = active.filter(match).limit(1).agg(F.count("*")).scalar()
    return active.filter(match | (found == 0))


def choose_templates(runs: DataFrame, candidates: DataFrame, seed: str) -> DataFrame:
    """One template per run, picked by a hash of seed and run; a run's own override comes first, also where there is no template.

    The catalogue is numbered by name in slices, and each run joins the single number it drew.
    """
    names = candidates.select("filename").distinct()
    numbered = running_sums(names, [], ["filename"], {"_place": F.lit(1).cast("long")}, F.substring("filename", 1, 8))
    catalogue = numbered.select((F.col("_place") - 1).alias("draw"), "filename")
    total = names.agg(F.count("*")).scalar()
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col("run_id").cast("string"))), 1, 8), 16, 10).cast("long")
    drawn = runs.withColumn("draw", F.pmod(digest, F.greatest(F.lit(total), F.lit(1))))
    return drawn.join(catalogue, "draw", "left").filter("override is not null or filename is not null").select("run_id", F.coalesce("override", "filename").alias("template"))


def compact_messages(messages: DataFrame, role: str = "tool") -> DataFrame:
    """Long tool results before the newest turn become a short size note; everything else is unchanged."""
    newest = messages.groupBy("conv_id").agg(F.max("turn").alias("_newest"))
    joined = messages.join(newest, "conv_id")
    long = (F.col("role") == role) & (F.length("text") > COMPACT_ABOVE) & (F.col("turn") < F.col("_newest")) & ~F.startswith("text", F.lit("(compacted"))
    note = F.format_string(
        "(compacted -- %d chars previously returned here; call the tool again if you need the current content)", F.length("text"))
    return joined.withColumn("text", F.when(long, note).otherwise(F.col("text"))).drop("_newest")
