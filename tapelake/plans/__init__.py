"""Registered queries: importing any of the modules registers them all in catalog.QUERIES and catalog.ORACLES."""

from tapelake.plans import catalog, market, records  # noqa: F401
