"""All registered queries."""

from __future__ import annotations

from stationlake.checks import jobs, observations, places, profiles, registry, scalars  # noqa: F401


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
