"""All queries of the core, by name."""

from __future__ import annotations

from loomgraph.plans import gate, graph, retrieval, sinks, topics, upkeep

FLAGSHIP = "rrf_hybrid"
_MODULES = [topics, graph, retrieval, upkeep, sinks, gate]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
