"""The given ``events`` table seen as web-shop events of either tracker.

Every column is derived from the row itself, so the views grow with the table.  Visitors and
sessions are a user's calendar day; ``k`` is the integer in ``props``.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.work import WorkTables, shared_folder

GLOBAL_SHOP = "global.shop.example"

EVENT_NAMES = {
    "click": "page_viewed",
    "view": "product_viewed",
    "signup": "product_added_to_cart",
    "error": "checkout_started",
    "purchase": "checkout_completed",
}
AGENTS = (
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_4 like Mac OS X)",
    "Mozilla/5.0 (Linux; Android 14)",
    "Mozilla/5.0 (Windows NT 10.0; Win64)",
    "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15)",
    "Mozilla/5.0 (X11; Linux x86_64)",
    None,
)
SYSTEMS = ("iOS", "Android", "Windows", "Mac OS", "Linux", "Haiku")
SOURCES = ("google", "fbig", "Klaviyo", "rakuten", "tiktok", "bing", None)
MEDIUMS = ("cpc", "email", "affiliates", "referral", None)
COUNTRIES = ("United States", "United Kingdom", "Canada", "Germany", "Australia", "France", "Peru", None)


def _text(value) -> str:
    return "NULL" if value is None else f"'{value}'"


def pick(number: str, values) -> str:
    """Entry of ``values`` at ``number`` modulo their count."""
    table = ", ".join(f"CAST({_text(v)} AS STRING)" for v in values)
    return f"element_at(array({table}), CAST({number} % {len(values)} + 1 AS INT))"


EVENT_NAME = "CASE event_type " + " ".join(
    f"WHEN '{old}' THEN '{new}'" for old, new in EVENT_NAMES.items()) + " END"
AGENT = "CAST(floor(user_id / 4) AS BIGINT)"
TENANT = "concat('tenant_', user_id % 4)"

BROWSER_VIEW = {
    "event_type": "'customer_event'",
    "event_name": EVENT_NAME,
    "event_timestamp": "ts",
    "shop": f"CASE WHEN k < 50 THEN '{GLOBAL_SHOP}' ELSE 'us.shop.example' END",
    "page_url": "concat('https://shop.example/p/', k)",
    "user_agent": pick(AGENT, AGENTS),
    "session_id": "visitor",
    "client_id": TENANT,
    "event_details_id": "CAST(event_id AS STRING)",
    "event_details_clientid": "visitor",
    "processed_timestamp": """CASE k % 3 WHEN 0 THEN concat(translate(CAST(ts AS STRING), ' ', 'T'), 'Z')
        WHEN 1 THEN substring(CAST(ts AS STRING), 1, 19) ELSE concat(CAST(ts AS STRING), '+00:00') END""",
    "price_amount": "value",
    "price_currency": "'GBP'",
    "device_type": f"CASE WHEN {AGENT} % 6 < 2 THEN 'mobile' ELSE 'desktop' END",
    "browser": f"CASE WHEN {AGENT} % 6 = 0 THEN 'Safari' ELSE 'Chrome' END",
    "os": pick(AGENT, SYSTEMS),
    "utm_source": pick("k", SOURCES),
    "utm_medium": pick("k", MEDIUMS),
    "utm_campaign": "concat('campaign_', k % 3)",
}

SECOND_VIEW = {
    "client_id": TENANT,
    "session_id": "visitor",
    "event_datetime": "ts",
    "event_name": """CASE WHEN event_type = 'click' AND k % 10 = 0 THEN 'Login'
        WHEN event_type = 'click' AND k % 10 = 1 THEN 'Search'
        WHEN event_type = 'click' AND k % 10 = 2 THEN 'emailSubscribe'
        WHEN event_type = 'click' THEN 'PageView'
        WHEN event_type = 'view' THEN 'ViewContent'
        WHEN event_type = 'signup' THEN 'AddToCart'
        WHEN event_type = 'error' THEN 'InitiateCheckout' ELSE 'Purchase' END""",
    "device_platform": f"CASE WHEN {AGENT} % 6 < 2 THEN 'mobile' ELSE 'desktop' END",
    "browser_name": f"CASE WHEN {AGENT} % 6 = 0 THEN 'Safari' ELSE 'Chrome' END",
    "os_name": pick(AGENT, SYSTEMS),
    "country_name": pick("k", COUNTRIES),
    "search_utm_source": pick("k", SOURCES),
    "search_utm_medium": pick("k", MEDIUMS),
    "search_utm_content": "concat('content_', k % 2)",
    "search_utm_term": "concat('term_', k % 4)",
}


def work(spark: SparkSession) -> WorkTables:
    """Work tables of a registered query, below ``spark.checkpoint.dir``; a local master without that
    setting, as in tests, gets a folder of its own."""
    try:
        return WorkTables(spark, shared_folder(spark))
    except ValueError:
        if not spark.sparkContext.master.startswith("local["):
            raise
        return WorkTables(spark, tempfile.mkdtemp(prefix="tidemark-"))


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _view(spark: SparkSession, sf_dir: str, columns: dict[str, str], types: list[str] | None = None) -> DataFrame:
    rows = raw(spark, sf_dir)
    if types is not None:
        rows = rows.where(F.col("event_type").isin(types))
    keyed = rows.selectExpr(
        "*", "CAST(get_json_object(props, '$.k') AS INT) AS k",
        "concat(user_id, '/', CAST(ts AS DATE)) AS visitor")
    return keyed.selectExpr(*[f"{rule} AS {name}" for name, rule in columns.items()])


def browser_events(spark: SparkSession, sf_dir: str, only: str | None = None) -> DataFrame:
    """First tracker view, of one event name if asked: the raw type is then compared by the scan."""
    types = None if only is None else [old for old, new in EVENT_NAMES.items() if new == only]
    return _view(spark, sf_dir, BROWSER_VIEW, types)


def second_tracker_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second tracker view, under that tracker's own column names."""
    return _view(spark, sf_dir, SECOND_VIEW)
