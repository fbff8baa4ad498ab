"""Every query against its oracle SQL, and the skew paths against the same answers."""

import pytest

import __spark_entry__ as entry_point
from tests.compare import compare
from tests.conftest import SMALL

SKEWED = (
    "unresolved_failures failed_posts_report attempt_numbers resolve_links rollback_plan orphaned_media "
    "cascade_delete constraint_violations extend_post_map discover_urls dispatch_discovered dispatch_plan "
    "export_links post_payloads posts rewrite_images media_plan ensure_terms bookmark_cards"
).split()


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_query_matches_oracle(spark, name):
    result = compare(spark, SMALL, name)
    assert result.startswith(("ok", "rows")), result


@pytest.mark.parametrize("name", SKEWED)
def test_skewed_paths_match_oracle(spark, all_hot, name):
    result = compare(spark, SMALL, name)
    assert result.startswith("ok"), result


def test_entry_and_oracle_keys(spark):
    assert entry_point.entry(spark).columns == ["blog_url", "post_url"]
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
