"""Dimension members derived from event columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Member rules of the built-in dimensions, first match wins.
DEVICE_RULES = (
    ("iPhone|iPad|iOS", "iOS"),
    ("Android", "Android"),
    ("Windows", "Windows"),
    ("Mac OS|Macintosh", "macOS"),
)
COUNTRY_MEMBERS = {
    "United States": "US",
    "United Kingdom": "UK",
    "Canada": "Canada",
    "Germany": "Germany",
    "Australia": "Australia",
}
NO_COUNTRY = "Unknown Location"
UTM_SOURCE_RULES = (
    ("google|bing", "Search"),
    ("facebook|fbig", "Facebook"),
    ("instagram|IG", "Instagram"),
    ("tiktok|TikTok", "TikTok"),
    ("klaviyo|email|hs_email", "Email"),
    ("shopify|store-directory", "Shopify"),
    ("rakuten|awin|affiliate", "Affiliates"),
)
UTM_MEDIUM_RULES = (
    ("cpc|paid", "Paid Search"),
    ("email|sms", "Email"),
    ("social|instagram|facebook|tiktok", "Social"),
    ("affiliate|referral", "Affiliate"),
    ("youtube", "YouTube"),
)

def first_match(column: Column, rules, default) -> Column:
    """Member of the first regular expression that matches, else ``default``."""
    return when_then([(column.rlike(pattern), member) for pattern, member in rules], F.lit(default))


def when_then(branches: list[tuple[Column, str]], default: Column) -> Column:
    """Ordered branches; a null condition falls through to the next branch."""
    if not branches:
        return default
    (condition, member), *rest = branches
    out = F.when(condition, F.lit(member))
    for condition, member in rest:
        out = out.when(condition, F.lit(member))
    return out.otherwise(default)


def geo_two_way(shop: Column, global_shop: str) -> Column:
    """``Global`` for the global shop, ``US`` for every other one, unknown included."""
    return F.when(shop == F.lit(global_shop), F.lit("Global")).otherwise(F.lit("US"))


def geo_by_country(country: Column) -> Column:
    """Five named countries, ``Other`` for the rest, ``Unknown Location`` for none."""
    named = [(country == F.lit(name), member) for name, member in COUNTRY_MEMBERS.items()]
    return when_then(named + [(country.isNotNull(), "Other")], F.lit(NO_COUNTRY))


def device_from_agent(user_agent: Column) -> Column:
    return first_match(user_agent, DEVICE_RULES, "Other")


def device_from_column(os_name: Column) -> Column:
    return os_name.cast("string")


def utm_source_group(source: Column) -> Column:
    return first_match(source, UTM_SOURCE_RULES, "Other")


def utm_medium_group(medium: Column) -> Column:
    return first_match(medium, UTM_MEDIUM_RULES, "Other")


def mapped(column: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    """Mapped value; else ``default`` when given; else the value itself."""
    pairs = {k: v for k, v in mapping.items() if k != "default"}
    otherwise = column if default is None else F.lit(default)
    if not pairs:
        return otherwise
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])
    return F.coalesce(F.try_element_at(table, column), otherwise)
