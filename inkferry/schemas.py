"""Schemas of the history tables and of the page tables."""

PAGES = "blog_url STRING, url STRING, html STRING"
LIST_PAGES = "blog_url STRING, page_no BIGINT, html STRING"
FETCHED_PAGES = "url STRING, html STRING"
EXISTING_TERMS = "taxonomy STRING, id BIGINT, name STRING, parent BIGINT"

HISTORY = {
    "post_jobs": (
        "id BIGINT, blog_url STRING, job_type STRING, status STRING, "
        "created_at TIMESTAMP_NTZ, completed_at TIMESTAMP_NTZ, error_message STRING"
    ),
    "job_items": (
        "id BIGINT, job_id BIGINT, post_url STRING, dest_post_id BIGINT, status STRING, "
        "error_message STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
    ),
    "image_assets": (
        "id BIGINT, job_item_id BIGINT, image_url STRING, dest_media_id BIGINT, "
        "dest_media_url STRING, status STRING, error_message STRING, "
        "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
    ),
    "post_map": "id BIGINT, post_url STRING, dest_post_id BIGINT, created_at TIMESTAMP_NTZ",
    "internal_links": (
        "id BIGINT, job_item_id BIGINT, source_url STRING, target_url STRING, "
        "link_text STRING, context STRING, created_at TIMESTAMP_NTZ"
    ),
}

# The states the history accepts.
JOB_TYPES = ("full", "single", "retry")
RUN_STATES = ("running", "completed", "failed")
ASSET_STATES = ("pending", "uploaded", "failed")

# (child table, child column, parent table)
FOREIGN_KEYS = (
    ("job_items", "job_id", "post_jobs"),
    ("image_assets", "job_item_id", "job_items"),
    ("internal_links", "job_item_id", "job_items"),
)
CHECKS = (
    ("post_jobs", "job_type", JOB_TYPES),
    ("post_jobs", "status", RUN_STATES),
    ("job_items", "status", RUN_STATES),
    ("image_assets", "status", ASSET_STATES),
)
NOT_NULL = {
    "post_jobs": ("blog_url", "job_type", "status", "created_at"),
    "job_items": ("job_id", "post_url", "status", "created_at", "updated_at"),
    "image_assets": ("job_item_id", "image_url", "status", "created_at", "updated_at"),
    "post_map": ("post_url", "dest_post_id", "created_at"),
    "internal_links": ("job_item_id", "source_url", "target_url", "created_at"),
}
UNIQUE = (("post_map", "post_url"), ("post_map", "dest_post_id"))
