"""Selectors and options passed to the jobs; checked once on the driver."""

from __future__ import annotations

from dataclasses import dataclass, fields

from inkferry.operators.dom import compile_selector

FIRST_IS_PARENT = "first-is-parent"
LAST_IS_PARENT = "last-is-parent"
POST_STATUSES = ("draft", "publish", "pending", "private")
LONGEST_BOOKMARK_SELECTOR = 200


class ConfigurationError(ValueError):
    pass


@dataclass(frozen=True)
class MigrationConfig:
    # The source platform's markup and the default limits.
    title_selector: str = 'meta[name="title"]'
    publish_date_selector: str = 'meta[property="article:published_time"]'
    modified_date_selector: str = 'meta[property="article:modified_time"]'
    category_selector: str = "div.another_category h4 a"
    tag_selector: str = 'div.area_tag a[rel="tag"]'
    content_selector: str = "div.tt_article_useless_p_margin.contents_style"
    list_link_selector: str = "a.link_category"
    featured_image_selector: str = (
        "#main > div > div > div.article_header.type_article_header_cover > div"
    )
    bookmark_selector: str = 'figure[data-ke-type="opengraph"]'
    category_order: str = FIRST_IS_PARENT
    post_status: str = "pending"
    protocol_relative: bool = False
    workers: int = 1
    rate_interval_ms: int = 60_000
    rate_cap: int = 1
    max_attempts: int = 3
    initial_delay_ms: int = 500
    max_delay_ms: int = 600_000
    backoff_multiplier: float = 10

    def __post_init__(self) -> None:
        for f in fields(self):
            if f.name.endswith("_selector"):
                value = getattr(self, f.name)
                if not value:
                    raise ConfigurationError(f"{f.name} must not be empty")
                if f.name == "bookmark_selector" and len(value) > LONGEST_BOOKMARK_SELECTOR:
                    raise ConfigurationError(
                        f"{f.name} must have at most {LONGEST_BOOKMARK_SELECTOR} characters"
                    )
                compile_selector(value)
        # enumerated options are trimmed before they are checked
        for name, allowed in (
            ("category_order", (FIRST_IS_PARENT, LAST_IS_PARENT)),
            ("post_status", POST_STATUSES),
        ):
            value = getattr(self, name).strip()
            if value not in allowed:
                raise ConfigurationError(f"{name} must be one of {', '.join(allowed)}; got {value!r}")
            object.__setattr__(self, name, value)
        if not 1 <= self.workers <= 16:
            raise ConfigurationError("workers must be between 1 and 16")
        if self.rate_interval_ms <= 0 or self.rate_cap <= 0:
            raise ConfigurationError("rate_interval_ms and rate_cap must be greater than 0")
        if min(self.max_attempts, self.initial_delay_ms, self.max_delay_ms) < 0:
            raise ConfigurationError("attempts and delays must not be negative")
        if self.backoff_multiplier < 1:
            raise ConfigurationError("backoff_multiplier must be at least 1")
