"""All queries over the test tables, by name."""

from __future__ import annotations

from .plans import chain, graph, loose, more, reads, records, rows, signals

PARTS = [signals, graph, records, more, reads, chain, rows, loose]
QUERIES = {name: q for part in PARTS for name, q in part.QUERIES.items()}
ORACLES = {name: q for part in PARTS for name, q in part.ORACLES.items()}
FLAGSHIP = "f20_exec_summary"
