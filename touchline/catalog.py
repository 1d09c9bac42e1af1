"""Imports every module that registers queries."""

from __future__ import annotations

from touchline import registry
from touchline.queries import bundles, context, events, features, fusion, graph, markets, merge, motifs, patterns, quality, router, scrape, sequences, signals, temporal, text, validation  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.ORACLES)
