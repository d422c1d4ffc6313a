"""Status vocabularies: project stages, fetch outcomes and failure messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STAGE_OF_STATUS = {
    "pending": "crawling",
    "crawling": "crawling",
    "crawled": "extracting",
    "extracting_blueprint": "extracting",
    "blueprint_ready": "generating",
    "generating": "generating",
    "awaiting_cost_approval": "awaiting_approval",
    "ready": "ready",
    "failed": "error",
    "rejected": "error",
}
STAGE_PERCENT = {"crawling": 33, "extracting": 67, "generating": 100, "awaiting_approval": 67, "ready": 100, "error": 0}
TERMINAL_STATUSES = ("ready", "failed", "rejected")

# Fixed values.
BLOCKED_MESSAGE = (
    "This site blocked automated access to this page. It may have bot-protection enabled that prevents crawling, "
    "even though nothing else appears to be wrong with the site."
)
MISSING_MESSAGE = "This page could not be found. Please double-check the URL and try again."
SERVER_MESSAGE = "This site's server returned an error. Please try again later."
UNEXPECTED_MESSAGE = "This site returned an unexpected error (HTTP %d)."
LOGIN_MESSAGE = "This site appears to require a login and can't be crawled."
ROBOTS_MESSAGE = "robots.txt disallows crawling this site"
LOGIN_HINTS = ("login", "signin", "sign-in", "log-in")

# Failure kinds whose own message may be shown to the user.
SHOWN_KINDS = (
    "CrawlError", "CrawlRejected", "SiteInaccessible", "GenerationError", "InsufficientCreditsError", "InsufficientDiskSpaceError",
)


def _lookup(mapping: dict, key: Column) -> Column:
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def stage_of(status: Column) -> Column:
    return F.coalesce(_lookup(STAGE_OF_STATUS, status), F.lit("crawling"))


def stage_percent(status: Column) -> Column:
    return F.coalesce(_lookup(STAGE_PERCENT, stage_of(status)), F.lit(0))


def is_terminal(status: Column) -> Column:
    return status.isin(*TERMINAL_STATUSES)


def fetch_message(status: Column) -> Column:
    """User message of a failed fetch; null when the status is no failure."""
    return (
        F.when(status.isNull() | (status < 400), F.lit(None).cast("string"))
        .when(status.isin(401, 403), BLOCKED_MESSAGE)
        .when(status == 404, MISSING_MESSAGE)
        .when((status >= 500) & (status < 600), SERVER_MESSAGE)
        .otherwise(F.format_string(UNEXPECTED_MESSAGE, status))
    )


def looks_like_login_url(final_url: Column) -> Column:
    return F.lower(final_url).rlike("|".join(LOGIN_HINTS))


def shown_message(kind: Column, message: Column, fallback: str, shown: Sequence[str] = SHOWN_KINDS) -> Column:
    """Own message for allow-listed failure kinds, a general one for everything else."""
    return F.when(kind.isin(*shown), message).otherwise(F.lit(fallback))


def broken_rules(rules: dict[str, Column]) -> Column:
    """Array of the codes of violated rules; explode it for one row per violation."""
    return F.array_compact(F.array(*[F.when(violated, F.lit(code)) for code, violated in rules.items()]))
