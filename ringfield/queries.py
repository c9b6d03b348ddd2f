"""Registry of the map and scoring queries and of the SQL that checks them."""

from __future__ import annotations

from .plans import decide, design, maps, scores, steps, stores

QUERIES: dict = {**maps.QUERIES, **scores.QUERIES, **design.QUERIES, **decide.QUERIES, **steps.QUERIES, **stores.QUERIES}
ORACLES: dict = {**maps.ORACLES, **scores.ORACLES, **design.ORACLES, **decide.ORACLES, **steps.ORACLES, **stores.ORACLES}
