"""Text column functions: whitespace, slugs, contacts, labels and small codecs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EMAIL = r"(?U)[\w.\-]+@[\w.\-]+\.\w+"
PHONE = r"(?U)(\+?\d{1,2}\s?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}"
COPYRIGHT = r"(?i)(©|copyright)[^.]{0,80}"
VISIBLE_TEXT_LIMIT = 12_000
TRUNCATION_MARK = " ...[truncated]... "
FALLBACK_ALT = "Image"
DOWNLOAD_KEY_PREFIX = "download_spend:"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def collapse_whitespace(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"(?U)\s+", " "))


def clip_middle(text: Column | str, limit: int = VISIBLE_TEXT_LIMIT) -> Column:
    """Texts over the limit keep their head and tail halves around a marker."""
    text = _col(text)
    half = limit // 2
    return F.when(
        F.length(text) > limit, F.concat(F.left(text, F.lit(half)), F.lit(TRUNCATION_MARK), F.right(text, F.lit(half)))
    ).otherwise(text)


def slugify(text: Column | str, empty: str = "section") -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", empty).otherwise(slug)


def first_email(text: Column | str) -> Column:
    # Most texts hold no address; the substring test spares them the pattern.
    text = _col(text)
    return F.when(text.contains("@"), F.regexp_extract(text, EMAIL, 0)).otherwise("")


def first_phone(text: Column | str) -> Column:
    text = _col(text)
    return F.when(text.rlike(r"(?U)\d{3}"), F.trim(F.regexp_extract(text, PHONE, 0))).otherwise("")


def copyright_line(text: Column | str) -> Column:
    return F.trim(F.regexp_extract(_col(text), COPYRIGHT, 0))


def split_question(text: Column | str) -> Column:
    """Struct (question, answer): split at the first question mark."""
    text = _col(text)
    at = F.instr(text, "?")
    question = F.concat(F.trim(F.substring(text, F.lit(1), at - 1)), F.lit("?"))
    answer = F.trim(F.substring(text, at + 1, F.length(text)))
    return F.struct(
        F.when(at > 0, question).otherwise(text).alias("question"),
        F.when(at > 0, answer).otherwise("").alias("answer"),
    )


def title_case(text: Column | str) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(_col(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, F.lit(2), F.length(r))))), ""
    )


def fallback_alt_text(src: Column | str) -> Column:
    """Readable words from an image file name."""
    base = F.element_at(F.split(_col(src), "/"), -1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    stem = F.regexp_replace(stem, "^[0-9a-f]{6,8}-", "")
    stem = F.regexp_replace(stem, r"-\d+x\d+$", "")
    words = F.filter(F.split(stem, "[-_]+"), lambda w: (w != "") & ~w.rlike(r"^\d+$"))
    text = F.trim(F.array_join(words, " "))
    return F.when(text == "", FALLBACK_ALT).otherwise(title_case(text))


def template_name(raw: Column | str) -> Column:
    """Accepted template name without its `.txt`, or null when it is not allowed."""
    name = F.regexp_replace(F.trim(_col(raw)), r"(?i)\.txt$", "")
    return F.when(name.rlike("^[A-Za-z0-9_-]{1,64}$"), name)


def template_file_name(category: Column | str, name: Column | str) -> Column:
    return F.concat(_col(category), F.lit("_"), _col(name), F.lit("_prompt.txt"))


def template_category(file_name: Column | str) -> Column:
    """Everything before the first underscore (the whole name when there is none)."""
    return F.substring_index(_col(file_name), "_", 1)


def template_label(file_name: Column | str) -> Column:
    """Display label: no prompt suffix, words capitalised."""
    stem = F.regexp_replace(_col(file_name), "(?i)_prompt$", "")
    words = F.filter(F.split(stem, "[_-]+"), lambda w: w != "")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), " "
    )


def download_key(project_id: Column | str, tier: Column | str) -> Column:
    return F.concat(F.lit(DOWNLOAD_KEY_PREFIX), _col(project_id).cast("string"), F.lit(":"), _col(tier))


def tier_of_download_key(key: Column | str, project_id: Column | str) -> Column:
    """Tier written in a download key of this project; null for foreign keys or an empty tier."""
    key = _col(key)
    prefix = F.concat(F.lit(DOWNLOAD_KEY_PREFIX), _col(project_id).cast("string"), F.lit(":"))
    rest = F.substring(key, F.length(prefix) + 1, F.length(key))
    return F.when(F.startswith(key, prefix) & (rest != ""), rest)


def search_filter(column: Column | str, needle: str | None) -> Column:
    """Case-insensitive contains; an empty needle keeps every row."""
    needle = (needle or "").strip()
    return _col(column).ilike(f"%{needle}%") if needle else F.lit(True)
