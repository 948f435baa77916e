"""The seven standard KPIs and their sixteen tables, as a configuration."""

from __future__ import annotations

from tidemark.functions.dimensions import UTM_MEDIUM_RULES, UTM_SOURCE_RULES

# Agent patterns of the configured device dimension and their grouping.
AGENT_RULES = (
    ("iPhone|iPad|iOS", "iOS"),
    ("Android", "Android"),
    ("Windows", "Windows"),
    ("Mac OS|Macintosh", "macOS"),
    ("Linux Mint", "Linux"),
    ("Linux", "Linux"),
    ("Tizen|Ubuntu|OpenBSD|FreeBSD|BlackBerry", "Other"),
)
DEVICE_MAPPING = {
    "iOS": "Mobile", "Android": "Mobile", "Windows": "Desktop", "macOS": "Desktop",
    "Linux": "Desktop", "Other": "Other",
}
COUNTED_KPIS = {
    "orders": "checkout_completed",
    "checkout_started": "checkout_started",
    "product_added_to_cart": "product_added_to_cart",
    "product_viewed": "product_viewed",
}


def _contains(rules, default="Other") -> list[dict]:
    return [{
        "type": "when_then",
        "conditions": [{"condition": f"str.contains('{p}')", "value": m} for p, m in rules],
        "default": default,
    }]


def _dimension(name: str, source: str, transformations: list[dict], mapping: str | None = None) -> dict:
    out = {"name": name, "source_column": source, "transformations": transformations}
    return out | {"mapping": mapping} if mapping else out


def _pivot(members: list[str]) -> dict:
    return {
        "index": ["time_truncated", "time_hour"],
        "values": "count",
        "aggregate_function": "sum",
        "rename_columns": {"time_truncated": "time"},
        "final_column_order": ["time_hour", "time", *members, "Total"],
    }


def _calculation(method: str, event: str | None, column: str) -> dict:
    condition = event and {"column": "event_name", "operator": "==", "value": event}
    return {"method": method, "filter": condition, "column": column}


def default_config(global_shop: str, input_file: str = "", output_directory: str = "output") -> dict:
    location = _dimension("location", "shop", [{
        "type": "when_then",
        "conditions": [{"condition": f"eq('{global_shop}')", "value": "Global"}],
        "default": "US",
    }])
    device = _dimension("device", "user_agent", _contains(AGENT_RULES), "device_mapping")
    two = {"location": location, "device": device}
    visitor = "event_details_clientid"
    landing = _calculation("unique_count", "page_viewed", visitor) | {"first_occurrence": {
        "group_by": "session_id",
        "aggregations": [{"column": "event_timestamp", "agg": "min", "alias": "session_start"}] + [
            {"column": c, "agg": "first"}
            for c in ("event_name", "shop", "user_agent", "utm_source", "utm_medium")],
        "drop_nulls": True,
    }}
    kpis = {
        "visitors": {"calculation": _calculation("unique_count", None, visitor), "dimensions": two},
        "buyers": {"calculation": _calculation("unique_count", "checkout_completed", visitor), "dimensions": two},
        **{name: {"calculation": _calculation("count", event, "*"), "dimensions": two}
           for name, event in COUNTED_KPIS.items()},
        "landing_page_viewers": {"calculation": landing, "dimensions": two | {
            "utm_source": _dimension("utm_source", "utm_source", _contains(UTM_SOURCE_RULES)),
            "utm_medium": _dimension("utm_medium", "utm_medium", _contains(UTM_MEDIUM_RULES)),
        }},
    }
    return {
        "data": {"input_file": input_file, "output_directory": output_directory},
        "kpis": kpis,
        "mappings": {"device_mapping": DEVICE_MAPPING},
        "pivot_configs": {
            "location": _pivot(["Global", "US"]),
            "device": _pivot([]),
            "utm_source": _pivot([m for _, m in UTM_SOURCE_RULES] + ["Other"]),
            "utm_medium": _pivot([m for _, m in UTM_MEDIUM_RULES] + ["Other"]),
        },
        "common_configs": {"time_truncate_unit": "1h"},
    }
