"""The survey's query names are all registered (image intake is a tested library
function: Spark cannot write image files from the tables)."""

import __spark_entry__ as E
from pricelens import plans

SURVEY_QUERIES = """
scan_pages seed_products training_load training_roundtrip seed_sources analysis_parse
search_urls site_quota format_prices numeric_prices convert_currency identify_source offer_id price_comparison
clean_html page_text window_chunks containers container_text container_links extract_offers page_links page_images
page_pools product_chunks product_chunks_ebay entities entity_offers title_fallback price_fallback site_titles
site_prices site_fallback ebay_offers clean_titles valid_titles parse_prices chunk_offers quarantine drop_blob_logs
relevance rank_offers dedupe_offers dedupe_signature top_offers
union_sites single_site cheapest_offers filter_offers filter_count sort_price_asc sort_price_desc best_price
best_deal lowest_positive last_checked offer_counts
upsert_products upsert_sources upsert_prices refresh_prices
cache_key reuse_results latest_per_key evict_expired invalidate
normalize_analysis analysis_query alternative_queries confidence_band attach_analysis
annotate_offers bio_labels bio_valid align_labels split_examples training_ready training_stats decode_bio join_pieces
decode_pages stream_refresh stream_reuse
""".split()


def test_survey_queries_registered_with_oracles():
    q, o = E.queries(), E.oracle_sql()
    missing = [n for n in SURVEY_QUERIES if n not in q]
    assert missing == []
    assert [n for n in plans.QUERIES if n not in o] == []
