"""Runnable queries over the given tables."""

from __future__ import annotations

from importlib import import_module
from importlib.util import find_spec

from sitelake.plans.registry import REGISTRY, Query

MODULES = (
    "urls_and_text",
    "pages_and_links",
    "page_sections",
    "costs_and_usage",
    "jobs_and_projects",
    "users_and_packs",
    "ledger_and_wallets",
    "payments",
    "palette_and_audit",
    "proposals_and_merges",
    "templates_and_settings",
    "streams",
)


def load_all() -> dict[str, Query]:
    """Import every query module and return the registry."""
    for module in MODULES:
        if find_spec(f"sitelake.plans.{module}"):
            import_module(f"sitelake.plans.{module}")
    return REGISTRY
