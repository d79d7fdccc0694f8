"""All registered queries of the core engine and their SQL."""

from __future__ import annotations

from . import corpus, graphs, ops, records, timelines

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (corpus, graphs, timelines, ops, records):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
