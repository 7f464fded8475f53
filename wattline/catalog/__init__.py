"""Every registered query with its oracle."""

from importlib import import_module

_MODULES = ("fixtures_check", "sources", "scalars", "aggregates", "contracts", "joins", "windows",
            "business_rules", "metrics", "trend_models", "neighbours", "short_term", "long_term", "statistics",
            "full_runs", "whole_years", "adaptive_trend")


def load():
    """``(queries, oracles)`` after importing the query modules."""
    from wattline.catalog import registry

    for m in _MODULES:
        import_module(f"wattline.catalog.{m}")
    return registry.QUERIES, registry.ORACLES
