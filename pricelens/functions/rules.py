"""Fixed values that results depend on.

Everything in this module is data, not logic: retailer constants, keyword lists,
label maps and the regular expressions of the per-site extraction rules. They are
written out plainly, in the order they are applied, because results must equal
the behaviour they describe. Patterns are Java regex (Spark runs them in the
JVM); flags are spelled inline (``(?i)`` ignore case, ``(?m)`` multi-line).
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# Retailers, in the order the sites are visited.
# (site_ord, site_key, source name, search URL prefix, link root, host marker)
# --------------------------------------------------------------------------
SITES = [
    (0, "ebay", "eBay", "https://www.ebay.com/sch/i.html?_nkw=", "https://www.ebay.com", "ebay.com"),
    (1, "jiji", "Jiji Ghana", "https://jiji.com.gh/search?query=", "https://jiji.com.gh", "jiji.com.gh"),
    (2, "jumia", "Jumia Ghana", "https://www.jumia.com.gh/catalog/?q=", "https://www.jumia.com.gh", "jumia.com.gh"),
    (3, "tonaton", "Tonaton Ghana", "https://tonaton.com/search?query=", "https://tonaton.com", "tonaton.com"),
    (4, "aliexpress", "AliExpress", "https://www.aliexpress.com/wholesale?SearchText=", "https://www.aliexpress.com", "aliexpress.com"),
]

# Per-site container rules for the four container-based sites.
# (site_key, min container text length, word length limit, price min, price max)
SITE_LIMITS = [
    ("jiji", 30, 50, 50.0, 100000.0),
    ("jumia", 20, 50, 50.0, 100000.0),
    ("tonaton", 20, 50, 50.0, 100000.0),
    ("aliexpress", 30, 60, 1.0, 10000.0),
]

# Total results per search and the per-site share.
RESULTS_PER_SEARCH = 20
GENERIC_RESULT_CAP = 15

# Default catalogue sources (seeded only into an empty table).
# (source_id, name, url, logo, active)
SEED_SOURCES = [
    (1, "eBay", "https://www.ebay.com", "ebay", True),
    (2, "AliExpress", "https://www.aliexpress.com", "aliexpress", True),
    (3, "Jumia", "https://www.jumia.com.gh", "jumia", True),
    (4, "Alibaba", "https://www.alibaba.com", "alibaba", True),
    (5, "Jiji", "https://jiji.com.gh", "jiji", True),
    (6, "Tonaton", "https://tonaton.com", "tonaton", True),
    (7, "Kikuu", "https://www.kikuu.com.gh", "kikuu", True),
]

# Host substring -> (source, source_key), first match wins.
HOST_SOURCES = [
    ("jumia.com", "Jumia Ghana", "jumia"),
    ("ebay.com", "eBay", "ebay"),
    ("aliexpress.com", "AliExpress", "aliexpress"),
    ("jiji.com", "Jiji Ghana", "jiji"),
    ("tonaton.com", "Tonaton", "tonaton"),
]

# Site keys in the generic extractor's visiting order.
GENERIC_SITE_ORDER = ["jumia", "ebay", "aliexpress", "jiji", "tonaton"]

# Category filter keywords (substring match on the lower-cased title).
CATEGORY_KEYWORDS = {
    "electronics": ["phone", "laptop", "computer", "tablet", "camera", "tv", "electronics", "iphone", "samsung", "apple"],
    "clothing": ["shirt", "pants", "dress", "shoes", "jacket", "clothing", "fashion", "wear"],
    "home": ["furniture", "kitchen", "home", "garden", "decor", "appliance"],
    "sports": ["sport", "fitness", "exercise", "outdoor", "bike", "ball"],
    "books": ["book", "novel", "magazine", "ebook", "literature"],
    "toys": ["toy", "game", "puzzle", "doll", "action figure"],
    "automotive": ["car", "auto", "vehicle", "tire", "engine", "motorcycle"],
    "health": ["health", "beauty", "cosmetic", "skincare", "supplement"],
    "jewelry": ["jewelry", "watch", "necklace", "ring", "bracelet"],
    "office": ["office", "business", "supplies", "desk", "chair", "pen"],
}

# Currency symbols in lookup order and the default exchange rate.
CURRENCY_SYMBOLS = [("$", "USD"), ("₵", "GHS"), ("€", "EUR"), ("£", "GBP")]
USD_TO_GHS = 10.85

# Result reuse time-to-live (seconds) and the clean-up trigger size.
CACHE_TTL_SECONDS = 3600

# Image intake.
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "gif"]
IMAGE_MAX_BYTES = 20 * 1024 * 1024
# leading bytes (hex) of the accepted image formats: PNG, JPEG, GIF
IMAGE_MAGIC_PREFIXES = ["89504E47", "FFD8FF", "47494638"]

# Token label ids for training, and the label names the decoder knows.
LABEL2ID = {
    "O": 0, "B-TITLE": 1, "I-TITLE": 2, "B-PRICE": 3, "I-PRICE": 4,
    "B-URL": 5, "I-URL": 6, "B-IMG": 7, "I-IMG": 8,
}
SPECIAL_TOKENS = ["[CLS]", "[SEP]", "[PAD]"]
MAX_SEQ_LEN = 512
IGNORE_LABEL = -100
TRAIN_MIN_EXAMPLES = 10
AUTO_TRAIN_MIN_EXAMPLES = 20

# Size of the fixed text window (512 tokens x 3 chars).
WINDOW_TOKENS = 512
WINDOW_CHARS_PER_TOKEN = 3

# Page-level link and image patterns of the generic extractor (letters in either case; the flags
# of this and the following rules are given where they are used).
PAGE_LINK_PATTERNS = [
    r"""href=["']([^"']*product[^"']*)["']""",
    r"""href=["']([^"']*item[^"']*)["']""",
    r"""href=["']([^"']*p/[^"']*)["']""",
]
PAGE_IMAGE_PATTERNS = [
    r"""src=["']([^"']*\.(?:jpg|jpeg|png|gif|webp)[^"']*)["']""",
    r"""data-src=["']([^"']*\.(?:jpg|jpeg|png|gif|webp)[^"']*)["']""",
]

# eBay page pools.
EBAY_ITEM_URL = r"""https://www\.ebay\.com/itm/[^\s"'<>]+"""
EBAY_IMAGE_URL = r"""(?i)https?://i\.ebayimg\.com/[^\s"'<>]+\.(?:jpg|jpeg|png|gif|webp)"""
ANY_HTTPS_URL = r"""https://[^\s"'<>]+"""
ANY_IMAGE_URL = r"""(?i)https?://[^\s"'<>]+\.(?:jpg|jpeg|png|gif|webp)"""

# Line chunkers.
GENERIC_CHUNK_INDICATORS = ["price", "buy", "add to cart", "shop", "product", "item",
                            "₵", "$", "€", "£", "USD", "GHS", "delivery", "shipping"]
GENERIC_CHUNK_PRICE = r"[\$₵€£]\s*\d+|price.*\d+"
GENERIC_CHUNK_MAX = 500
EBAY_CHUNK_PRICE = r"\$\s*\d+|USD\s*\d+"
EBAY_CHUNK_MAX = 80

# Entity patterns of the rule-based recogniser (score per kind).
ENTITY_TITLE_PATTERNS = [
    r"^([A-Za-z0-9\s\-,\.]{10,100})(?:\s*[\$₵€£]|\s*price|\s*buy)",
    r"([A-Za-z0-9\s\-,\.]{15,80})\s*\n",
]
ENTITY_PRICE_PATTERNS = [
    r"([\$₵€£]\s*\d+(?:,\d{3})*(?:\.\d{2})?)",
    r"(price\s*:?\s*[\$₵€£]?\s*\d+(?:,\d{3})*(?:\.\d{2})?)",
    r"(\d+(?:,\d{3})*(?:\.\d{2})?\s*[\$₵€£])",
]
ENTITY_TITLE_SCORE = 0.8
ENTITY_PRICE_SCORE = 0.9
PRICE_FALLBACK_PATTERNS = [
    r"([\$₵€£]\s*\d+(?:,\d{3})*(?:\.\d{2})?)",
    r"(\d+(?:,\d{3})*(?:\.\d{2})?\s*[\$₵€£])",
]
TITLE_FALLBACK_REJECT = r"[\$₵€£]\d+|price|buy|cart|menu|home"
AMOUNT_PATTERN = r"(\d+(?:,\d{3})*(?:\.\d{2})?)"

# Relevance gate, near-duplicate threshold and rank weights.
RELEVANCE_MIN = 0.3
DUPLICATE_ABOVE = 0.8
RANK_TITLE_WEIGHT = 0.7
RANK_DESC_WEIGHT = 0.3
WORD_BOOST = 0.3

# --------------------------------------------------------------------------
# Per-site title and price rules ("pattern" mode), in order.
# --------------------------------------------------------------------------
JIJI_TITLE_PATTERNS = [
    r"([A-Za-z][A-Za-z0-9\s\-\.]{8,60})(?:\s*₵|\s*GH₵|\s*\d{3,})",
    r"(?:Verified\s+ID|Popular|Quick\s+reply|ENTERPRISE|DIAMOND)\s*[^\w]*([A-Za-z][A-Za-z0-9\s\-\.]{8,50}?)(?:\s*₵|\s*GH₵)",
    r"(?:iPhone|Samsung|Laptop|MacBook|Dell|HP|Lenovo|Acer|ASUS)\s+([A-Za-z0-9\s\-\.]{5,40})(?:\s*₵|\s*GH₵|\s*\d{3,})",
    r"^([A-Za-z][A-Za-z0-9\s\-\.]{10,50}?)(?:\s*₵|\s*GH₵|\s*\d{3,})",
    r"(?:New|Used|Fresh|Original|Brand)\s+([A-Za-z][A-Za-z0-9\s\-\.]{8,40})(?:\s*₵|\s*GH₵)",
    r"([A-Za-z][A-Za-z0-9\s]{15,}?)(?=\s*₵|\s*GH₵|\s*\d{4,})",
]
TONATON_TITLE_PATTERNS = JIJI_TITLE_PATTERNS
ALIEXPRESS_TITLE_PATTERNS = [
    r"([A-Za-z][A-Za-z0-9\s\-\.]{8,60})(?:\s*\$|\s*USD|\s*\d{1,4}\.\d{2})",
    r"(?:Free\s+shipping|Sale|Hot\s+sale|New\s+arrival)\s*[^\w]*([A-Za-z][A-Za-z0-9\s\-\.]{8,50}?)(?:\s*\$|\s*USD)",
    r"(?:iPhone|Samsung|Laptop|MacBook|Dell|HP|Lenovo|Acer|ASUS)\s+([A-Za-z0-9\s\-\.]{5,40})(?:\s*\$|\s*USD|\s*\d{1,4}\.\d{2})",
    r"^([A-Za-z][A-Za-z0-9\s\-\.]{10,50}?)(?:\s*\$|\s*USD|\s*\d{1,4}\.\d{2})",
    r"(?:New|Original|Genuine|Brand)\s+([A-Za-z][A-Za-z0-9\s\-\.]{8,40})(?:\s*\$|\s*USD)",
    r"([A-Za-z][A-Za-z0-9\s]{15,}?)(?=\s*\$|\s*USD|\s*\d{1,4}\.\d{2})",
]
JUMIA_TITLE_PATTERNS = [
    r"([A-Za-z][A-Za-z0-9\s]{15,})(?:\s*₵|\s*GH₵|\s*\d{3,})",
    r"([A-Za-z][A-Za-z0-9\s]{10,})(?:\s*₵|\s*GH₵)",
    r"Verified\s+ID[^₵]*?([A-Za-z][A-Za-z0-9\s]{10,})(?:\s*₵)",
    r"Popular[^₵]*?([A-Za-z][A-Za-z0-9\s]{10,})(?:\s*₵)",
    r"^([A-Za-z][^₵\n]{10,})(?:\s*₵)",
]
JUMIA_TITLE_PREFIX = r"^(Quick\s+reply|ENTERPRISE|DIAMOND|Verified\s+ID)"

GHS_PRICE_PATTERNS = {
    "jiji": [r"GH₵\s*(\d+(?:,\d{3})*(?:\.\d{2})?)", r"₵\s*(\d+(?:,\d{3})*(?:\.\d{2})?)"],
    "jumia": [r"GH₵\s*(\d+(?:,\d{3})*(?:\.\d{2})?)", r"₵\s*(\d+(?:,\d{3})*(?:\.\d{2})?)",
              r"(\d+(?:,\d{3})*(?:\.\d{2})?)\s*₵"],
    "tonaton": [r"GH₵\s*(\d+(?:,\d{3})*(?:\.\d{2})?)", r"₵\s*(\d+(?:,\d{3})*(?:\.\d{2})?)",
                r"(\d+(?:,\d{3})*(?:\.\d{2})?)\s*₵"],
}
ALIEXPRESS_PRICE_PATTERNS = [
    r"\$\s*(\d+(?:,\d{3})*(?:\.\d{2})?)",
    r"USD\s*(\d+(?:,\d{3})*(?:\.\d{2})?)",
    r"US\s*\$\s*(\d+(?:,\d{3})*(?:\.\d{2})?)",
    r"(\d{1,4}(?:,\d{3})*(?:\.\d{2})?)\s*\$",
    r"(\d{1,4}\.\d{2})\s*USD",
]
SITE_PRICE_PATTERNS = dict(GHS_PRICE_PATTERNS, aliexpress=ALIEXPRESS_PRICE_PATTERNS)
SITE_TITLE_PATTERNS = {
    "jiji": JIJI_TITLE_PATTERNS,
    "tonaton": TONATON_TITLE_PATTERNS,
    "aliexpress": ALIEXPRESS_TITLE_PATTERNS,
    "jumia": JUMIA_TITLE_PATTERNS,
}

# Fixed values: "fallback" mode (no model available): fewer patterns, no checks.
FALLBACK_TITLE_PATTERNS = {
    "jiji": JIJI_TITLE_PATTERNS,
    "tonaton": [
        r"([A-Za-z][A-Za-z0-9\s\-\.]{8,60})(?:\s*₵|\s*GH₵)",
        r"^([A-Za-z][A-Za-z0-9\s\-\.]{10,50}?)(?:\s*₵|\s*GH₵)",
    ],
    "jumia": [
        r"([A-Za-z][A-Za-z0-9\s]{15,})(?:\s*₵|\s*GH₵)",
        r"^([A-Za-z][^₵\n]{10,})(?:\s*₵)",
    ],
    "aliexpress": [
        r"([A-Za-z][A-Za-z0-9\s\-]{15,})(?:\s*\$|\s*USD)",
        r"^([A-Za-z][^\$\n]{10,})(?:\s*\$)",
    ],
}
FALLBACK_PRICE_PATTERNS = {
    "jiji": [r"GH₵\s*(\d+(?:,\d{3})*(?:\.\d{2})?)", r"₵\s*(\d+(?:,\d{3})*(?:\.\d{2})?)"],
    "tonaton": [r"₵\s*(\d+(?:,\d{3})*(?:\.\d{2})?)", r"GH₵\s*(\d+(?:,\d{3})*(?:\.\d{2})?)"],
    "jumia": [r"₵\s*(\d+(?:,\d{3})*(?:\.\d{2})?)", r"GH₵\s*(\d+(?:,\d{3})*(?:\.\d{2})?)"],
    "aliexpress": [r"\$\s*(\d+(?:,\d{3})*(?:\.\d{2})?)", r"USD\s*(\d+(?:,\d{3})*(?:\.\d{2})?)"],
}

# Cleaning of titles found by the site patterns.
GHS_TITLE_PREFIXES = [
    r"^(Quick\s+reply|ENTERPRISE|DIAMOND|Verified\s+ID|Popular)\s*",
    r"^(New|Used|Fresh|Original|Brand)\s+",
    r"^(For\s+sale|Selling|Available)\s*",
]
GHS_TITLE_TRAILERS = [r"\s*₵.*$", r"\s*GH₵.*$", r"\s*\d{3,}.*$"]
GHS_TITLE_SUFFIXES = [
    r"\s*(available|for\s+sale|selling|negotiable)$",
    r"\s*(call|contact|whatsapp).*$",
]
ALIEXPRESS_TITLE_PREFIXES = [
    r"^(Free\s+shipping|Sale|Hot\s+sale|New\s+arrival|Best\s+seller)\s*",
    r"^(New|Original|Genuine|Brand)\s+",
    r"^(For\s+sale|Selling|Available)\s*",
]
ALIEXPRESS_TITLE_TRAILERS = [r"\s*\$.*$", r"\s*USD.*$", r"\s*\d{1,4}\.\d{2}.*$"]
ALIEXPRESS_TITLE_SUFFIXES = [
    r"\s*(available|for\s+sale|selling|negotiable)$",
    r"\s*(contact|order\s+now|buy\s+now).*$",
]

# Title validity noise words (whole title, ignore case).
GHS_TITLE_NOISE = [
    r"^(call|contact|whatsapp|phone|number)$",
    r"^(available|selling|for\s+sale)$",
    r"^(new|used|fresh|original)$",
    r"^\d+$",
]
ALIEXPRESS_TITLE_NOISE = [
    r"^(contact|order|buy|shop|store)$",
    r"^(available|selling|for\s+sale)$",
    r"^(new|original|genuine|brand)$",
    r"^\d+$",
]

# Final title clean-up per site (applied after extraction).
FINAL_TITLE_PREFIX = {"jiji": r"^(Popular|Quick\s+reply|ENTERPRISE|DIAMOND|Verified\s+ID)"}
FINAL_TITLE_TRAILERS = {
    "jiji": [r"\s*₵.*$", r"\s*GH₵.*$"],
    "tonaton": [r"\s*₵.*$", r"\s*GH₵.*$"],
    "jumia": [r"\s*₵.*$", r"\s*GH₵.*$"],
    "aliexpress": [r"\s*\$.*$", r"\s*USD.*$"],
}

# eBay title and price rules.
EBAY_TITLE_PATTERNS = [
    r"(Apple iPhone \d+[^$\n]*?)(?:\s*\$|Opens|Pre-Owned|Very Good)",
    r"(iPhone \d+[^$\n]*?)(?:\s*\$|Opens|Pre-Owned|Very Good)",
    r"^([^$\n]+?)(?:\s*\$|Opens|Buy It Now)",
]
EBAY_PRICE_PATTERNS = [
    r"\$\s*(\d+(?:,\d{3})*(?:\.\d{2})?)",
    r"price[:\s]*\$?(\d+(?:,\d{3})*(?:\.\d{2})?)",
]
EBAY_CLEAN_MODEL = r"(Apple iPhone \d+[^$]*?)(?:\s*\$|\s*Opens|\s*Pre-Owned|\s*Very Good)"
EBAY_CLEAN_IPHONE = r"iPhone[^$\n]*"
EBAY_CLEAN_DASH = r"[–—-]+.*$"

# Generic title clean-up.
GENERIC_TITLE_PRICE_CUT = r"[\$₵€£]\s*\d+.*$"
GENERIC_TITLE_WORD_CUT = r"price.*$"

# Image analysis defaults.
ANALYSIS_DEFAULT_CONFIDENCE = 0.8
ANALYSIS_UNIDENTIFIED_CONFIDENCE = 0.3
ALTERNATIVE_QUERIES = 3
CONFIDENCE_HIGH = 80
CONFIDENCE_MEDIUM = 60

# Log lines dropped as binary blobs.
BLOB_LOG_MIN_CHARS = 1000
