"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

from tenderloom.plans import archive, cards, catalogue, decide, indexed, normalise, rank, search

QUERIES = catalogue.QUERIES | archive.QUERIES | search.QUERIES | decide.QUERIES | normalise.QUERIES | rank.QUERIES | indexed.QUERIES | cards.QUERIES
SQL = catalogue.SQL | archive.SQL | search.SQL | decide.SQL | normalise.SQL | rank.SQL | indexed.SQL | cards.SQL
