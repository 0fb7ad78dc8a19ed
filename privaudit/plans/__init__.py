"""Registered queries: every operator bound to the driver tables, with its SQL twin."""

from privaudit.plans.registry import ORACLES, QUERIES

from privaudit.plans import apis, crypto, explore, files, fleet, labels, leaks, rules, streams, text, widgets  # noqa: F401,E402

__all__ = ["ORACLES", "QUERIES"]
