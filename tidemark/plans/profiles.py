"""What a shop's pipeline measures: metrics, dimensions, members, priorities."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dimensions as D

TOTAL = "total"
TOTAL_MEMBER = "Total"
LAST_PRIORITY = 99


@dataclass(frozen=True)
class Metric:
    """One metric.

    ``event`` is the event name that counts (None: every event).  ``unique_by`` names the
    key counted once, in the hour of its earliest event; None counts every event.
    ``session_dims`` are dimensions counted over the first value of each session instead.
    ``top_level_from`` is the dimension whose members add up to the top level.  ``own_members``
    lists ``(dim, members)`` where the metric has other members than the profile.
    """

    name: str
    event: str | None
    unique_by: str | None = None
    dims: tuple[str, ...] = ("geo", "device")
    session_dims: tuple[str, ...] = ()
    top_level_from: str = "device"
    priority: int = LAST_PRIORITY
    funnel_rank: int | None = None
    modelled: bool = True
    own_members: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def analysed_dims(self) -> tuple[str, ...]:
        return self.session_dims or self.dims


@dataclass(frozen=True)
class Profile:
    """Metrics in report order, members per dimension, how members are derived, whether the baseline has a
    weekday term, rounds in which its trend may break, and the rule for the knee (``contributors.knee_eps``).
    ``values`` lists all that a derived dimension can be, where its rule makes that a closed set."""

    metrics: tuple[Metric, ...]
    members: dict[str, tuple[str, ...]]
    geo: Callable[[], Column] | None = field(default=None, compare=False)
    device: Callable[[], Column] | None = field(default=None, compare=False)
    tenant: str = "client_id"
    visitor: str = "event_details_clientid"
    session: str = "session_id"
    time: str = "event_timestamp"
    weekday: bool = True
    break_rounds: int = 0
    knee: str = "global"
    sensitivity: float = 1.0
    values: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def modelled(self) -> tuple[Metric, ...]:
        return tuple(m for m in self.metrics if m.modelled)

    def metric_rows(self) -> list[dict]:
        return [
            {"metric": m.name, "metric_ord": i, "priority": m.priority, "funnel_rank": m.funnel_rank}
            for i, m in enumerate(self.modelled)
        ]

    def member_rows(self, totals: bool = True) -> list[dict]:
        """Every modelled (metric, dim, member) in report column order."""
        rows = []
        for m in self.modelled:
            if totals:
                rows.append((m.name, TOTAL, TOTAL_MEMBER))
            for dim in m.analysed_dims:
                members = dict(m.own_members).get(dim, self.members[dim])
                rows += [(m.name, dim, member) for member in members]
        return [{"metric": a, "dim": b, "member": c, "ord": i} for i, (a, b, c) in enumerate(rows)]

    def members_of(self, metric: Column, dim: Column) -> Column:
        """Array of the registered members of a metric's dimension, null if not analysed."""
        lists: dict[str, list[str]] = {}
        for r in self.member_rows():
            lists.setdefault(f"{r['metric']}/{r['dim']}", []).append(r["member"])
        table = constant(lists, "map<string,array<string>>")
        return F.try_element_at(table, F.concat_ws("/", metric, dim))

    def places_of(self, metric: Column) -> Column:
        """Array of ``(dim, member, ord)`` below the metric's top level."""
        places: dict[str, list[dict]] = {}
        for r in self.member_rows():
            if r["dim"] != TOTAL:
                places.setdefault(r["metric"], []).append({k: r[k] for k in ("dim", "member", "ord")})
        return F.try_element_at(
            constant(places, "map<string,array<struct<dim:string,member:string,ord:int>>>"), metric)


def constant(value, schema: str) -> Column:
    """Config value as a column: nested values have no literal of their own, so they are written
    as JSON, which the optimizer folds to one."""
    return F.from_json(F.lit(json.dumps(value)), schema)


def small_table(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """Local table of config rows; the planner sees how small it is."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def each_of(rows: list[dict]) -> Column:
    """Array column with one struct per config row, to be exploded next to each data row."""
    kinds = {k: "string" if isinstance(v, str) else "int" for k, v in rows[0].items()}
    return constant(rows, f"array<struct<{','.join(f'{k}:{v}' for k, v in kinds.items())}>>")


def metric_table(spark: SparkSession, profile: Profile) -> DataFrame:
    return small_table(spark, profile.metric_rows(), pa.schema([
        ("metric", pa.string()), ("metric_ord", pa.int32()), ("priority", pa.int32()),
        ("funnel_rank", pa.int32())]))


def member_table(spark: SparkSession, profile: Profile, totals: bool = True) -> DataFrame:
    return small_table(spark, profile.member_rows(totals), pa.schema([
        ("metric", pa.string()), ("dim", pa.string()), ("member", pa.string()), ("ord", pa.int32())]))


# Metrics, priorities, funnel order and members of the first tracker.
BROWSER_METRICS = (
    Metric("landing_page_viewers", "page_viewed", "session", session_dims=("source", "medium"),
           top_level_from="source", priority=2, funnel_rank=1),
    Metric("visitors", None, "visitor", priority=1, funnel_rank=0),
    Metric("product_viewers", "product_viewed"),
    Metric("added_to_cart", "product_added_to_cart", priority=3, funnel_rank=2),
    Metric("checkout_started", "checkout_started", priority=4, funnel_rank=3),
    Metric("orders", "checkout_completed", priority=5, funnel_rank=4),
    Metric("buyers", "checkout_completed", "visitor", priority=6, funnel_rank=5),
    Metric("checkout_completed", "checkout_completed", modelled=False),
)
BROWSER_MEMBERS = {
    "geo": ("Global", "US"),
    "device": ("iOS", "Android", "Windows", "macOS", "Other"),
    "source": ("google", "fbig", "Klaviyo", "rakuten", "tiktok"),
    "medium": ("cpc", "paid_social", "email", "affiliates"),
}

# The same for the second tracker, whose orders have a device list of their own.
SECOND_ORDER_DEVICES = ("Android", "iOS", "Windows", "Mac OS", "Chromium OS", "Linux", "undefined")
SECOND_METRICS = (
    Metric("landing_page_viewers", "PageView", "session", session_dims=("source", "medium"),
           top_level_from="source", priority=1, funnel_rank=1),
    Metric("visitors", None, "session", priority=2, funnel_rank=0),
    Metric("product_viewers", "ViewContent"),
    Metric("added_to_cart", "AddToCart", priority=5, funnel_rank=2),
    Metric("checkout_started", "InitiateCheckout", priority=6, funnel_rank=3),
    Metric("orders", "Purchase", priority=7, funnel_rank=4, own_members=(("device", SECOND_ORDER_DEVICES),)),
    Metric("buyers", "Purchase", "session", priority=8, funnel_rank=5),
    Metric("login", "Login", priority=4),
    Metric("search", "Search", priority=3),
    Metric("checkout_completed", "Purchase", modelled=False),
    Metric("email_subscribe", "emailSubscribe", modelled=False),
)
SECOND_MEMBERS = {
    "geo": ("US", "UK", "Canada", "Germany", "Australia", "Other"),
    "device": ("Mac OS", "iOS", "Chromium OS", "Linux", "undefined", "Windows", "Android",
               "Chromecast", "Ubuntu"),
    "source": ("google", "Klaviyo", "tiktok"),
    "medium": ("cpc", "email"),
}

# Declared event and once-per-session flag of the second tracker's metrics.
SECOND_REGISTRY = {
    "landing_page_viewers": ("PageView", True),
    "product_viewers": ("ViewContent", True),
    "added_to_cart": ("AddToCart", False),
    "checkout_started": ("InitiateCheckout", True),
    "checkout_completed": ("Purchase", False),
    "buyers": ("Purchase", True),
    "orders": ("Purchase", False),
    "cart_recovery": ("CartRecovery_OfflineCartReminder", True),
    "search": ("Search", True),
    "login": ("Login", True),
}


def browser_profile(global_shop: str) -> Profile:
    return Profile(
        BROWSER_METRICS, BROWSER_MEMBERS, values={d: BROWSER_MEMBERS[d] for d in ("geo", "device")},
        geo=lambda: D.geo_two_way(F.col("shop"), global_shop),
        device=lambda: D.device_from_agent(F.col("user_agent")))


def second_tracker_profile() -> Profile:
    return Profile(
        SECOND_METRICS, SECOND_MEMBERS, values={"geo": (*SECOND_MEMBERS["geo"], D.NO_COUNTRY)},
        geo=lambda: D.geo_by_country(F.col("country_name")),
        device=lambda: D.device_from_column(F.col("os")))
