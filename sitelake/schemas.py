"""Schemas of the stored tables and documents. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

PAGES = "site string, page_no int, url string, http_status int, html string"
ASSETS = "site string, original_url string, asset_type string, storage_path string, content_type string"
ROBOTS = "site string, status int, body string, agent string"
FETCH_LOG = "url string, status int, error string, final_url string, html string"
STYLE_FILES = "site string, file string, kind string, body string"
MANIFEST = (
    "project_id string, source_url string, page_count int, first_page int, pages array<struct<url:string,http_status:int,storage_path:string>>, "
    "assets array<struct<original_url:string,asset_type:string,storage_path:string,content_type:string>>, _corrupt string"
)
PROVIDER_EVENT = "event_id string, event_type string, resource string, ts timestamp"

APP_TABLES = {
    "users": "id string, email string, is_active boolean, is_admin boolean, created_at timestamp",
    "identities": "user_id string, provider string, subject string",
    "wallets": "id string, user_id string, balance int",
    "ledger": "id string, wallet_id string, amount int, reason string, related_project_id string, related_job_id string, "
              "related_purchase_id string, idempotency_key string, created_at timestamp",
    "purchases": "id string, user_id string, amount_usd_cents int, credits_granted int, status string, source string, credit_pack_id string, "
                 "paypal_order_id string, paypal_capture_id string, note string, refunded_at timestamp, resolved_at timestamp, created_at timestamp",
    "credit_packs": "id string, name string, credits int, price_usd_cents int, is_active boolean, sort_order int",
    "projects": "id string, user_id string, source_url string, status string, created_at timestamp",
    "jobs": "id string, project_id string, blueprint_id string, tier string, scope string, overall_status string, failure_reason string, "
            "created_at timestamp, finished_at timestamp",
    "outputs": "job_id string, template_used string, iterations int, prompt_tokens int, completion_tokens int, contrast_warnings array<string>",
    "usage": "id string, project_id string, user_id string, job_id string, model_name string, purpose string, prompt_tokens int, "
             "completion_tokens int, cost_estimate_usd double, created_at timestamp",
    "pricing": "model_name string, prompt_price_per_1m decimal(10,4), completion_price_per_1m decimal(10,4)",
    "tiers": "key string, label string, is_active boolean, sort_order int, download_credit_cost int, generation_model string",
    "settings": "key string, value double",
    "templates": "filename string, category string, is_active boolean",
    "queued_jobs": "id string, task_name string, payload string, status string, error string, created_at timestamp, started_at timestamp, finished_at timestamp",
    "snapshots": "id string, project_id string, page_count int, started_at timestamp, finished_at timestamp",
    "blueprints": "id string, project_id string, version int, is_current boolean, created_at timestamp",
    "submissions": "id string, url string, client string, user_agent string, accepted_terms boolean, created_at timestamp",
}


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


S, LIST = T.StringType(), T.ArrayType(T.StringType())
_LINK = _struct(label=S, href=S)
SECTIONS = _struct(
    hero=_struct(headline=S, subheadline=S, cta_text=S, cta_href=S, background_image=S),
    about=_struct(heading=S, body=S, image=S),
    services_features=T.ArrayType(_struct(title=S, description=S, icon_image=S)),
    faq=T.ArrayType(_struct(question=S, answer=S)),
    cta_section=_struct(heading=S, body=S, cta_text=S, cta_href=S),
    footer=_struct(links=T.ArrayType(_LINK), social_links=T.ArrayType(_struct(platform=S, url=S)), copyright_text=S),
    testimonials=T.ArrayType(_struct(quote=S, author=S, role=S)),
    gallery_portfolio=T.ArrayType(_struct(image=S, caption=S)),
    team=T.ArrayType(_struct(name=S, role=S, bio=S, photo=S)),
    pricing=T.ArrayType(_struct(plan=S, price=S, features=LIST)),
    stats_social_proof=T.ArrayType(_struct(number=S, label=S)),
    credentials_awards=T.ArrayType(_struct(name=S, badge_image=S)),
    contact=_struct(address=S, email=S, phone=S, hours=S, map=S),
    blog_news=T.ArrayType(_struct(title=S, excerpt=S, date=S)),
    additional_sections=T.ArrayType(_struct(key=S, title=S, body=S, items=LIST, images=LIST)),
)
PAGE_DOCUMENT = _struct(page_url=S, sections=SECTIONS, all_images=T.ArrayType(_struct(path=S, alt=S)))
META = _struct(
    site_name=S, tagline=S, logo=S, colors=_struct(primary=S, secondary=S, accent=S), fonts=_struct(heading=S, body=S), tone=S, favicon=S, site_category=S
)
BLUEPRINT = _struct(meta=META, navigation=T.ArrayType(_LINK), pages=T.ArrayType(PAGE_DOCUMENT))

# Fields that are null when absent; every other text field is empty instead.
NULLABLE_TEXT = frozenset({"background_image", "image", "icon_image", "photo", "badge_image", "logo", "favicon", "map"})
